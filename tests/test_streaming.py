import json
import random
import shutil
import time
import uuid
from types import SimpleNamespace

from pyspark.sql import Row, functions as F

from textwarden.operators import analytics, sessions
from textwarden.operators.policies import STORE_SCHEMA
from textwarden.operators.scan import scan
from textwarden.plans.queries import planted
from textwarden.sources.alert_sink import FileTransport, _Writer, read_alerts
from textwarden.streaming import jobs
from textwarden.streaming.state import SessionsOfCells


# the checkpoint folder may outlive a test run
RUN = uuid.uuid4().hex


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def event(i, action="ALLOW", score=10, at=0):
    return {"event_id": f"e{i}", "timestamp": 1_700_000_000_000 + at, "destination_category": "EXTERNAL_AI",
            "detected_tags": ["PII"], "risk_score": score, "action": action, "device_id": "d1", "employee_id": "u1"}


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_ingest_drops_repeats_and_invalid_rows(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    put(source, "1.json", [event(1), event(1), event(2, score=150), event(3)])
    finish(jobs.ingest(spark, str(source), table, name=f"ingest_test_{RUN}", once=True))
    put(source, "2.json", [event(3), event(4)])
    finish(jobs.ingest(spark, str(source), table, name=f"ingest_test_{RUN}", once=True))
    assert sorted(r.event_id for r in spark.read.parquet(table).collect()) == ["e1", "e3", "e4"]


def test_ingest_loses_no_valid_event(spark, tmp_path):
    source, table, refused = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "refused")
    nameless = {k: v for k, v in event(0).items() if k != "event_id"}
    hours = 3_600_000
    put(source, "1.json", [nameless, nameless, event("x", score=150), event("x", score=20), event("new", at=9 * hours)])
    finish(jobs.ingest(spark, str(source), table, name=f"whole_test_{RUN}", once=True))
    put(source, "2.json", [event("old", at=-9 * hours), event("new", at=9 * hours)])
    finish(jobs.ingest(spark, str(source), table, name=f"whole_test_{RUN}", once=True))
    finish(jobs.reject_stream(spark, str(source), refused, name=f"refused_test_{RUN}", once=True))
    rows = spark.read.parquet(table).collect()
    named = sorted(r.event_id for r in rows if not r.event_id.startswith("evt_"))
    filled = [r.event_id for r in rows if r.event_id.startswith("evt_")]
    assert named == ["enew", "eold", "ex"] and len(set(filled)) == 2 and all(len(i) == 36 for i in filled)
    assert [r.risk_score for r in rows if r.event_id == "ex"] == [20] and rows[0].detected_tags == ["PII"]
    assert [(r.event_id, r.reject_reason) for r in spark.read.json(refused).collect()] == [("ex", "risk_score out of range")]


def test_stream_scan_equals_batch(spark, data, tmp_path):
    batch = planted(spark, data).select("doc_id", "text", "host", "action_type").withColumn(
        "ts", F.timestamp_millis(F.col("doc_id")))
    source, table = str(tmp_path / "payloads"), str(tmp_path / "events")
    batch.write.parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 20).parquet(source)
    finish(jobs.scan_stream(stream, table, "doc_id", name=f"scan_test_{RUN}", once=True))
    got = spark.read.parquet(table).select("payload_sha256_prefix", "risk_score", "action", "content_length")
    want = scan(batch).select(F.col("sha256_prefix"), "risk_score", "final_decision", "text_length")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_policies_are_read_for_every_batch(spark, tmp_path):
    rules = str(tmp_path / "rules")
    spark.createDataFrame([(1, "r", "{}", "WARN", 1, "")], STORE_SCHEMA).write.parquet(rules)
    source, table = tmp_path / "in", str(tmp_path / "out")
    schema = "id string, text string, host string, action_type string, ts timestamp"

    def run():
        stream = spark.readStream.schema(schema).json(str(source))
        finish(jobs.scan_stream(stream, table, "id", policies=lambda: spark.read.parquet(rules), name=f"rules_test_{RUN}", once=True))

    row = {"text": "let a = 1; let b = 2", "host": "docs.google.com", "action_type": "paste", "ts": "2024-01-01T00:00:00Z"}
    put(source, "1.json", [row | {"id": "1"}])
    run()
    spark.createDataFrame([(2, "s", "{}", "BLOCK", 1, "")], STORE_SCHEMA).write.mode("append").parquet(rules)
    put(source, "2.json", [row | {"id": "2"}])
    run()
    out = {r.event_id.split("_")[-1]: r.action for r in spark.read.parquet(table).collect()}
    assert out == {"1": "WARN", "2": "BLOCK"}


def test_a_replayed_batch_is_judged_by_the_same_rules(spark, tmp_path):
    """Rules that are appended between two runs of a batch wait for the next one."""
    rules, folder = str(tmp_path / "rules"), f"{tmp_path}/events_rules/batch=0"
    now = "date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx\")"

    def append(i, action):
        spark.range(1).selectExpr(f"cast({i} AS bigint) AS id", "'r' AS name", "'{}' AS conditions", f"'{action}' AS action",
                                  "1 AS enabled", f"{now} AS created_at").write.mode("append").parquet(rules)

    def judged(folder):
        payload = spark.createDataFrame([("let a = 1; let b = 2", "docs.google.com", "paste")], "text string, host string, action_type string")
        row = scan(payload, rules=jobs.rules_of_batch(spark.read.parquet(rules), folder)).first()
        return row.policy_id, row.final_decision

    append(1, "WARN")
    assert judged(folder) == ("1", "WARN")
    append(2, "BLOCK")
    append(1, "ALLOW")  # an edit of the first rule
    assert judged(folder) == ("1", "WARN")
    # the table was not whole when the first run ended: only its moment is left
    half = f"{tmp_path}/half/batch=0"
    spark.read.parquet(f"{folder}/moment").write.parquet(f"{half}/moment")
    assert judged(half) == ("1", "WARN")
    assert judged(f"{tmp_path}/events_rules/batch=1") == ("2", "BLOCK")


ALERT = "event_id string, risk_score int, action string, text string"


def alerts_of(spark, folder):
    return sorted(r.event_id for r in read_alerts(spark, folder, ALERT).collect())


def local(uri):
    return uri.replace("file://", "")


def test_alerts_are_there_once_whatever_ends_the_query(spark, tmp_path):
    """The query ends before its note, or after it and before its own commit, and starts again from its checkpoint."""
    source, out, name = tmp_path / "in", str(tmp_path / "alerts"), f"alert_test_{RUN}"
    put(source, "1.json", [event(1), event(2, "BLOCK"), event(3, "WARN", 70)])

    def run(folder, name):
        finish(jobs.alert_stream(jobs.read_events(spark, str(source)), folder, name=name, once=True))

    run(out, name)
    assert alerts_of(spark, out) == ["e2", "e3"]
    checkpoint = local(jobs.checkpoint_folder(spark, name))
    for case, lost in {"noted": "no such file", "not_noted": "notes"}.items():
        again, folder = f"{name}_{case}", str(tmp_path / case)
        shutil.copytree(checkpoint, local(jobs.checkpoint_folder(spark, again)), ignore=shutil.ignore_patterns("commits"))
        shutil.copytree(out, folder, ignore=shutil.ignore_patterns(lost))
        run(folder, again)
        assert alerts_of(spark, folder) == ["e2", "e3"]
    put(source, "2.json", [event(4, "BLOCK"), event(5)])
    run(out, name)
    assert alerts_of(spark, out) == ["e2", "e3", "e4"]
    row = read_alerts(spark, out, ALERT).filter("event_id = 'e3'").first()
    assert (row.risk_score, row.action) == (70, "WARN") and row.text.startswith("[DLP] WARN")


def test_an_epoch_that_fails_leaves_no_alert(tmp_path):
    transport = FileTransport(f"file://{tmp_path}/sink")
    writer = _Writer(transport)
    messages = [writer.write(iter([Row(event_id="a", payload="{}")])), writer.write(iter([])), None]
    assert [m.documents for m in messages[:2]] == [1, 0] and len(list((tmp_path / "sink/parts").iterdir())) == 1
    writer.abort(messages, 0)
    assert list((tmp_path / "sink/parts").iterdir()) == [] and not transport.noted(0)
    writer.commit([writer.write(iter([Row(event_id="a", payload="{}")]))], 0)
    writer.commit([writer.write(iter([Row(event_id="a", payload="{}")]))], 0)
    assert transport.noted(0) and len(list((tmp_path / "sink/parts").iterdir())) == 1


def memory(df, mode, name):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    finish(query)
    return df.sparkSession.table(name).collect()


def test_live_rollups_windows_and_sessions(spark, tmp_path):
    source = tmp_path / "in"
    minute = 60_000
    put(source, "1.json", [event(i, "BLOCK" if i % 2 else "ALLOW", at=i * minute) for i in range(6)]
        + [event(9, at=90 * minute)])
    events = jobs.with_time(jobs.read_events(spark, str(source)))
    rollup = memory(jobs.live_rollup(events, analytics.by_action), "complete", "rollup")
    assert {r.action: r.events for r in rollup} == {"ALLOW": 4, "BLOCK": 3}
    windows = memory(jobs.windowed_risk(events, "1 hour"), "complete", "windows")
    assert sum(r.events for r in windows) == 7
    put(source, "2.json", [event(100 + i, at=i) for i in range(101)])
    assert [r.events for r in memory(jobs.flood_stream(events), "complete", "floods")] == [102]


def stream_of(spark, source):
    """One file a batch, in the order of their names' times."""
    return jobs.with_time(spark.readStream.schema(jobs.ev.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(str(source)))


def written(df, mode, folder, name):
    """All rows that a stream gives, batch by batch."""
    def keep(batch, i):
        batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{folder}/batch_{i}")

    finish(df.writeStream.foreachBatch(keep).outputMode(mode).queryName(name).trigger(availableNow=True)
           .option("checkpointLocation", f"{folder}_state").start())
    return df.sparkSession.read.option("recursiveFileLookup", "true").parquet(folder).collect()


def test_last_events_equal_the_batch_form_and_idle_devices_go(spark, tmp_path):
    source, minute = tmp_path / "in", 60_000
    rows = [event(i, at=i * minute) | {"device_id": f"d{i % 3}"} for i in range(40)]
    for k in range(4):
        put(source, f"{k}.json", rows[10 * k:10 * k + 10])
        time.sleep(0.02)
    got = written(jobs.last_events(stream_of(spark, source), keep=5, idle="3 days"), "update", f"{tmp_path}/last", f"last_{RUN}")
    newest = {}
    for r in sorted(got, key=lambda r: r.batch):
        newest[r.device_id] = r.event_ids
    log = spark.createDataFrame(rows).select("device_id", "event_id", "timestamp")
    want = {}
    for r in jobs.ev.last_per_device(log, 5).orderBy("position").collect():
        want.setdefault(r.device_id, []).append(r.event_id)
    assert newest == want and all(len(r.event_ids) <= 5 for r in got)
    # one device goes on, the others are idle for longer than they may be
    put(source, "8.json", [event(100, at=9000 * minute) | {"device_id": "d0"}])
    time.sleep(0.02)
    put(source, "9.json", [event(101, at=9001 * minute) | {"device_id": "d0"}])
    got = written(jobs.last_events(stream_of(spark, source), keep=5, idle="3 days"), "update", f"{tmp_path}/idle", f"idle_{RUN}")
    newest = {}
    for r in sorted(got, key=lambda r: r.batch):
        newest[r.device_id] = r.event_ids
    assert newest["d1"] == newest["d2"] == [] and newest["d0"][:2] == ["e101", "e100"]


def test_sessions_equal_the_batch_form_on_a_skewed_stream(spark, tmp_path):
    """One employee sends most events; sessions touch, bridge and miss each other by a second."""
    rng = random.Random(5)
    source, second = tmp_path / "in", 1000
    times = sorted(rng.choice([rng.randint(0, 40_000), rng.randint(0, 400_000)]) for _ in range(600))
    rows = [event(i, score=rng.randint(0, 100), at=t * second) | {
        "employee_id": "hot" if i % 4 else f"u{i % 7}", "detected_tags": rng.choice([["A"], ["B", "A"], [], None])} for i, t in enumerate(times)]
    rows += [event(1000, at=500_000 * second) | {"employee_id": "edge"}, event(1001, at=501_800 * second) | {"employee_id": "edge"},
             event(1002, at=503_601 * second) | {"employee_id": "edge"}]
    for k in range(4):
        put(source, f"{k}.json", rows[k * len(rows) // 4:(k + 1) * len(rows) // 4])
        time.sleep(0.02)
    put(source, "8.json", [event(2000, at=900_000 * second) | {"employee_id": "end"}])  # time goes on
    time.sleep(0.02)
    put(source, "9.json", [event(2001, at=990_000 * second) | {"employee_id": "end"}])
    got = written(jobs.session_stream(stream_of(spark, source)), "append", f"{tmp_path}/sessions", f"sessions_{RUN}")
    batch = spark.createDataFrame([(r["employee_id"], r["timestamp"], r["risk_score"], r["detected_tags"]) for r in rows],
                                  "employee_id string, timestamp bigint, risk_score int, detected_tags array<string>")
    want = sessions.leak_sessions(jobs.with_time(batch), 1800).collect()

    def plain(r):
        return r.employee_id, r.session_start, r.session_end, r.events, r.max_risk, sorted(t for t in r.tags if t)

    ours = sorted(plain(r) for r in got if r.employee_id != "end")
    assert ours == sorted(map(plain, want)) and sum(r[3] for r in ours) == len(rows)


class Held:
    """State and timers of one key, as Spark keeps them for a processor."""

    def __init__(self):
        self.rows, self.timers, self.puts = [], set(), 0

    def getListState(self, name, schema):
        return self

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows, self.puts = list(rows), self.puts + 1

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def listTimers(self):
        return iter(sorted(self.timers))


def test_sessions_that_are_over_are_given_without_state_or_timers():
    """Cells come when they close; what is over by then never becomes state, the rest is kept under one timer."""
    rng, gap = random.Random(3), 1_000_000
    for many in (True, False):
        held, processor = Held(), SessionsOfCells(gap)
        processor.init(held)
        times = sorted(rng.randint(0, 300 * gap) for _ in range(200))
        marks, got, at = ([400_000] if many else range(0, 400_000, 700)), [], 0
        for now in marks:
            clock = SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now)
            closed = [t for t in times[at:] if (t // gap + 1) * gap <= now * 1000]
            at += len(closed)
            cells = [Row(cell=json.dumps({"first": t, "last": t, "events": 1, "tags": [f"T{t % 3}"]} | ({"max_risk": 5} if t % 2 else {}))) for t in closed]
            got += processor.handleInputRows(("u",), iter(cells), clock) if cells else []
            for timer in sorted(t for t in held.timers if t <= now):
                got += processor.handleExpiredTimer(("u",), clock, None)
                held.timers.discard(timer)
            assert len(held.timers) == bool(held.rows) and all((r[1] + 2 * gap) // 1000 + 1 > now for r in held.rows)
        want = []
        for t in times:
            if want and t - want[-1][1] <= gap:
                want[-1] = (want[-1][0], t, want[-1][2] + 1)
            else:
                want.append((t, t, 1))
        assert at == len(times) and sorted((r.first, r.last, r.events) for r in got) == want and not held.rows
        assert {r.max_risk for r in got} <= {5, None} and all(r.tags == sorted(set(r.tags)) for r in got)
        assert held.puts == 0 or not many


def test_late_events_are_kept(spark, tmp_path):
    source, on_time, late, minute = tmp_path / "in", f"{tmp_path}/on_time", f"{tmp_path}/late", 60_000
    put(source, "1.json", [event(1), event(2, at=60 * minute), event(3, at=-600 * minute)])
    time.sleep(0.02)
    put(source, "2.json", [event(4, at=55 * minute), event(5, at=49 * minute), {k: v for k, v in event(6).items() if k != "timestamp"}])
    time.sleep(0.02)
    put(source, "3.json", [event(7, at=50 * minute), event(8, at=300 * minute)])

    def run(name):
        finish(jobs.split_late(stream_of(spark, source), on_time, late, name=name, once=True))

    run(f"late_{RUN}")
    ids = lambda folder: sorted(r.event_id for r in spark.read.parquet(folder).collect())
    assert ids(on_time) == ["e1", "e2", "e3", "e4", "e7", "e8"] and ids(late) == ["e5", "e6"]
    windows = jobs.windowed_risk(spark.read.parquet(on_time).unionByName(spark.read.parquet(late)), "1 hour").collect()
    assert sum(r.events for r in windows) == 7  # all but the one without a time
    # the second batch again: same marks, same decision
    again = f"late_{RUN}_again"
    shutil.copytree(local(jobs.checkpoint_folder(spark, f"late_{RUN}")), local(jobs.checkpoint_folder(spark, again)),
                    ignore=lambda folder, names: [n for n in names if folder.endswith("commits") and n.strip(".").split(".")[0] in ("1", "2")])
    run(again)
    assert ids(on_time) == ["e1", "e2", "e3", "e4", "e7", "e8"] and ids(late) == ["e5", "e6"]
