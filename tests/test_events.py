import datetime as dt
import json
import random

import pytest
from pyspark.sql import Window, functions as F

from textwarden.operators import analytics, events as ev, policies, sessions
from textwarden.operators.files import quarantined, scan_files, scan_typed, text_files
from textwarden.operators.scan import scan
from textwarden.options import ScanOptions
from textwarden.plans.queries import event_rows
from textwarden.sources import payloads, sinks


@pytest.fixture(scope="module")
def stored(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    sinks.write_events(event_rows(spark, data), path)
    return sinks.read_events(spark, path)


def test_events_hold_no_text(spark, stored, data):
    names = set(stored.columns)
    assert not names & {"text", "payload", "redacted", "findings", "secrets", "narrative", "token", "original"}
    longest = stored.agg(F.max(F.length(F.to_json(F.struct(*stored.columns))))).first()[0]
    assert longest < 2000
    assert stored.count() == spark.read.parquet(f"{data}/events.parquet").count()


def test_written_events_prune_by_day(stored):
    plan = stored.filter("event_date = '2024-01-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def wire(spark, rows):
    return spark.createDataFrame(rows, ev.EVENT_SCHEMA)


def event(i=1, score=10, action="ALLOW", **over):
    row = dict(event_id=f"evt_{i}", timestamp=1_700_000_000_000 + i, destination_category="EXTERNAL_AI",
               detected_tags=["PII"], risk_score=score, action=action, content_length=5, payload_sha256_prefix=None,
               employee_id=None, device_id=None, browser_fingerprint=None)
    return tuple((row | over).values())


def test_validation_and_storage(spark):
    rows = [event(1), event(2, score=100), event(3, score=0), event(4, score=150), event(5, score=-1),
            event(6, action=None), event(7, timestamp=None), event(8, event_id=None, detected_tags=None)]
    df = wire(spark, rows)
    assert {r.event_id: r.reject_reason for r in ev.rejected(df).collect()} == {
        "evt_4": "risk_score out of range", "evt_5": "risk_score out of range", "evt_6": "missing action",
        "evt_7": "missing timestamp"}
    good = ev.accepted(df).collect()
    assert len(good) == 4 and all(r.received_at for r in good)
    filled = [r for r in good if r.event_id not in ("evt_1", "evt_2", "evt_3")][0]
    assert filled.event_id.startswith("evt_") and len(filled.event_id) == 36 and filled.detected_tags == []
    as_text = ev.accepted(df).selectExpr("* EXCEPT (detected_tags)", "to_json(detected_tags) AS detected_tags")
    for table in (ev.accepted(df), as_text):
        assert ev.decoded_tags(table).filter("event_id = 'evt_1'").first().detected_tags == ["PII"]


def test_listing_and_lookup(spark):
    df = wire(spark, [event(i, action="BLOCK" if i % 2 else "WARN") for i in range(9)])
    assert [r.event_id for r in ev.list_events(df, 3).collect()] == ["evt_8", "evt_7", "evt_6"]
    assert [r.event_id for r in ev.list_events(df, 2, "block").collect()] == ["evt_7", "evt_5"]
    assert ev.get_event(df, "evt_4").count() == 1 and ev.get_event(df, "nope").count() == 0


def test_alert_threshold_and_text(spark):
    df = wire(spark, [event(1, 69, "WARN"), event(2, 70, "WARN", employee_id=""), event(3, 10, "BLOCK", device_id="d")])
    rows = {r.event_id: r for r in ev.alerts(df).collect()}
    assert set(rows) == {"evt_2", "evt_3"}
    assert rows["evt_2"].text == "[DLP] WARN | Risk 70/100 | EXTERNAL_AI | Employee: unknown | Device: unknown"
    assert json.loads(ev.alert_payloads(df).filter("event_id = 'evt_3'").first().payload)["device_id"] == "d"


def test_event_id_is_base36(spark):
    assert spark.range(1).select(F.expr(ev.event_id("1700000000000L", "7"))).first()[0] == "evt_loyw3v28_7"


def test_unique_events_keep_one_row(spark):
    df = wire(spark, [event(1), event(1, score=99, timestamp=1), event(2)])
    assert {(r.event_id, r.risk_score) for r in ev.unique_events(df).collect()} == {("evt_1", 99), ("evt_2", 10)}


def test_last_per_device_equals_plain_window(spark):
    rng = random.Random(5)
    # one device holds a third of all rows, and times repeat
    rows = [event(i, timestamp=rng.randint(0, 300), device_id="hot" if i % 3 == 0 else f"d{rng.randint(0, 9)}")
            for i in range(3000)]
    df = wire(spark, rows)
    plain = df.withColumn("position", F.row_number().over(
        Window.partitionBy("device_id").orderBy(F.desc("timestamp"), "event_id"))).filter("position <= 100")
    pick = ["device_id", "position", "event_id"]
    assert set(ev.last_per_device(df).select(*pick).collect()) == set(plain.select(*pick).collect())


def test_identity_falls_back(spark):
    events = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "device_key string, n int")
    schema = "device_key string, employee_id string, device_id string"
    managed = spark.createDataFrame([("a", "m", ""), ("b", "", None)], schema)
    local = spark.createDataFrame([("a", "l", "ld", "x" * 99), ("b", "lb", "lbd", "ua")], schema + ", user_agent string")
    out = {r.n: r for r in ev.with_identity(events, managed, local).collect()}
    assert (out[1].employee_id, out[1].device_id, len(out[1].browser_fingerprint)) == ("m", "ld", 80)
    assert (out[2].employee_id, out[2].device_id) == ("lb", "lbd")
    assert out[3].employee_id is None


def test_options_on_events(spark, texts):
    judged = scan(texts(["hello there", "AKIA" + "ABCD1234EFGH5678"])).withColumn("ts", F.timestamp_millis(F.lit(0)))
    pending = ev.build_events(judged, "id", ScanOptions(hash_allowed=False)).orderBy("event_id").collect()
    assert pending[0].payload_sha256_prefix == "pending" and len(pending[1].payload_sha256_prefix) == 16
    assert ev.build_events(judged, "id", ScanOptions(enabled=False)).count() == 0
    assert [r.action for r in ev.build_events(judged, "id", ScanOptions(sample_rate=0)).collect()] == ["BLOCK"]


def session_events(spark, times):
    base = dt.datetime(2024, 1, 1)
    rows = [(f"e{i}", who, base + dt.timedelta(seconds=s), 10 + i % 5, ["A"] if i % 2 else ["B", "C"])
            for i, (who, s) in enumerate(times)]
    return spark.createDataFrame(rows, "event_id string, employee_id string, ts timestamp, risk_score int, detected_tags array<string>")


def test_sessions_equal_session_window(spark):
    rng = random.Random(11)
    times = [("hot" if i % 3 == 0 else f"u{i % 7}", rng.randint(0, 200_000)) for i in range(4000)]
    df = session_events(spark, times)
    ours = sessions.leak_sessions(df, 600).select("employee_id", "session_start", "session_end", "events", "max_risk")
    spark_own = (df.groupBy("employee_id", F.session_window("ts", "600 seconds")).agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"),
        F.count(F.lit(1)).alias("events"), F.max("risk_score").alias("max_risk")).drop("session_window"))
    assert set(ours.collect()) == set(spark_own.collect())


def test_session_gap_edge_and_tags(spark):
    df = session_events(spark, [("a", 0), ("a", 600), ("a", 1201)])
    out = sessions.leak_sessions(df, 600).orderBy("session_start").collect()
    assert [(r.events, r.tags) for r in out] == [(2, ["A", "B", "C"]), (1, ["B", "C"])]


def test_floods(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("d", base + dt.timedelta(milliseconds=500 * i)) for i in range(101)] + [("e", base)] * 100
    df = spark.createDataFrame(rows, "device_id string, ts timestamp")
    assert [(r.device_id, r.events) for r in sessions.floods(df).collect()] == [("d", 101)]


def test_score_levels(spark):
    df = wire(spark, [event(i, s) for i, s in enumerate([39, 40, 69, 70, 89, 90])])
    assert {r.band: r.events for r in analytics.score_bands(df).collect()} == {"low": 1, "medium": 2, "high": 3}
    row = analytics.risk_summary(df).first()
    assert (row.total, row.high_risk, row.critical) == (6, 3, 1)
    assert {r.axis: r.charted for r in analytics.threat_radar(df).collect()}["Source Code"] == 1


def test_stored_rules(spark, texts):
    store = spark.createDataFrame([
        (1, "off", '{"detectedCategories": ["CREDENTIAL"]}', "BLOCK", 0, ""),
        (2, "odd", "{}", "AUDIT", 1, "")], policies.STORE_SCHEMA)
    df = texts(["AKIA" + "ABCD1234EFGH5678"])
    first = scan(df, rules=policies.rules_from(store)).first()
    assert (first.policy_id, first.policy_name, first.reason) == ("1", "off", None)
    strict = ScanOptions(honour_rule_enabled=True)
    assert scan(df, rules=policies.rules_from(store, strict), options=strict).first().policy_id == "POLICY_001"
    row = policies.policy_row(spark, 3, "new", '{"maxRiskScore": 9}', "ALLOW")
    assert policies.read_policies(store.unionByName(row)).collect()[2].conditions.maxRiskScore == 9


def test_rules_need_no_shuffle_of_payloads(spark, texts):
    store = spark.createDataFrame([(1, "r", "{}", "BLOCK", 1, "")], policies.STORE_SCHEMA)
    plan = scan(texts(["x"]), rules=policies.rules_from(store))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_files(spark, tmp_path):
    secret = "AKIA" + "ABCD1234EFGH5678"
    (tmp_path / "prod.ENV").write_text("x")
    (tmp_path / "a.b.pem").write_text("x")
    (tmp_path / "notes.txt").write_text("key " + secret)
    (tmp_path / "late.md").write_text("x " * 32768 + secret)
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "photo.png").write_bytes(b"\x89PNG" + secret.encode())
    files = payloads.read_files(spark, str(tmp_path), "claude.ai")
    blocked = quarantined(files).collect()
    assert {r.name for r in blocked} == {"prod.ENV", "a.b.pem"}
    assert blocked[0].risk_score == 100 and blocked[0].factors.asDict() == {"s": 100, "d": 75, "v": 80, "a": 85, "c": 100}
    (tmp_path / "latin.txt").write_bytes("Schlüssel ".encode("latin-1") + secret.encode())
    (tmp_path / "cut.txt").write_bytes(b"x" * 65535 + "é ".encode() + secret.encode())
    (tmp_path / "big.md").write_text("x " * 600_000 + secret)
    files = payloads.read_files(spark, str(tmp_path), "claude.ai")
    assert {r.name for r in scan_files(files).collect()} == {"notes.txt", "late.md", "latin.txt", "cut.txt", "big.md"}
    off = ScanOptions(quarantine_files=False)
    assert quarantined(files, off).count() == 0 and text_files(files, off).filter("name = 'prod.ENV'").count() == 1
    inside = payloads.read_files(spark, str(tmp_path), "files.corp")
    assert quarantined(inside).count() == 0 and scan_files(inside).count() == 0


def test_typed_gate(texts):
    secret = "AKIA" + "ABCD1234EFGH5678"
    df = texts([secret, "a@b.co", "  a@b.co  ", "mail ana@example.org"])
    assert [r.id for r in scan_typed(df).collect()] == [0]
    assert scan_typed(texts([secret], host="localhost")).count() == 0


def test_json_payloads(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"payload_id": "1", "text": "a@b.co", "host": "Claude.AI", "ts": 5}\n')
    row = scan(payloads.read_json(spark, str(tmp_path))).first()
    assert row.tier == "EXTERNAL_AI" and row.ts == dt.datetime(1970, 1, 1, 0, 0, 0, 5000)
