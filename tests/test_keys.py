"""Ids stored once for ever: the index alone, and the ingest stream on top of it."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from textwarden.operators import events as ev, keys
from textwarden.operators.keys import KeyIndex, first_seen
from textwarden.streaming import jobs

RUN = uuid.uuid4().hex


@pytest.fixture
def index(spark, tmp_path):
    return KeyIndex(spark, f"file://{tmp_path}/index", buckets=7)


def of(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def test_repeated_keys_are_found_and_others_are_not(spark, index):
    assert index.repeated(of(spark, ["a"]), 5).collect() == []
    index.commit(spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key")), 0)
    index.commit(of(spark, ["late", "k1", None]), 1)
    asked = spark.range(4000, 9000).select(F.concat(F.lit("k"), "id").alias("key")).unionByName(of(spark, ["late", None, "no"]))
    got = {r.key for r in index.repeated(asked, 2).collect()}
    assert got == {f"k{i}" for i in range(4000, 5000)} | {"late"}
    # a batch sees earlier batches only
    assert [r.key for r in index.repeated(of(spark, ["late", "x"]), 1).collect()] == []
    assert index.repeated(of(spark, ["k1"]), 0).collect() == []


def test_filters_hold_every_key_and_few_others(spark, index):
    index.commit(spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key")), 0)
    filters = index._read("filters", keys.FILTERS, 9)
    assert filters.count() == 7 and filters.agg(F.sum("n")).first()[0] == 20_000
    met = index._dealt(spark.range(300_000).select(F.concat(F.lit("k"), "id").alias("key")))
    suspects = (met.groupBy("bucket").cogroup(filters.select("bucket", "bits").groupBy("bucket"))
                .applyInArrow(keys._suspected, "bucket int, key string"))
    assert 20_000 <= suspects.count() < 20_000 + 30


def test_a_commit_that_runs_again_replaces_its_keys(spark, index):
    index.commit(of(spark, ["a", "b"]), 3)
    index.commit(of(spark, ["b", "c"]), 3)
    assert sorted(r.key for r in index.repeated(of(spark, ["a", "b", "c"]), 4).collect()) == ["b", "c"]


def test_compaction_keeps_all_keys(spark, index, tmp_path):
    for i in range(4):
        index.commit(of(spark, [f"k{i}", f"k{i + 1}"]), i)
    new = index.compacted(f"file://{tmp_path}/new", 3, buckets=3)
    assert sorted(r.key for r in new.repeated(of(spark, [f"k{i}" for i in range(9)]), 4).collect()) == [f"k{i}" for i in range(5)]
    assert new._read("keys", keys.KEYS, 9).count() == 5


def test_only_met_buckets_are_read(spark, index):
    index.commit(spark.range(1000).select(F.col("id").cast("string").alias("key")), 0)
    one = index._dealt(of(spark, ["7"])).first().bucket
    read = index._read("keys", keys.KEYS, 1, [one])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_first_seen_rows(spark, index):
    index.commit(of(spark, ["e1"]), 0)
    rows = spark.createDataFrame([("e1", 1), ("e2", 2), (None, 3)], "event_id string, v int")
    assert sorted((r.event_id or "", r.v) for r in first_seen(rows, index, 1).collect()) == [("", 3), ("e2", 2)]


def event(i, at=0, **more):
    row = {"event_id": f"e{i}", "timestamp": 1_700_000_000_000 + at, "destination_category": "X", "risk_score": 1, "action": "ALLOW"}
    return {k: v for k, v in (row | more).items() if v is not None}


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def finish(query):
    query.awaitTermination(180)
    assert query.exception() is None


def test_ids_beyond_any_delay_are_stored_once(spark, tmp_path):
    source, table, name = tmp_path / "in", f"{tmp_path}/table", f"for_ever_{RUN}"
    day = 86_400_000
    put(source, "1.json", [event(1), event(2)])
    finish(jobs.ingest(spark, str(source), table, name=name, once=True))
    put(source, "2.json", [event(5, at=90 * day), event(6, at=400 * day)])
    finish(jobs.ingest(spark, str(source), table, name=name, once=True))
    # the first id again, long after any watermark would have dropped it from state
    put(source, "3.json", [event(1, at=400 * day), event(2), event(7, at=-900 * day)])
    finish(jobs.ingest(spark, str(source), table, name=name, once=True))
    assert sorted(r.event_id for r in spark.read.parquet(table).collect()) == ["e1", "e2", "e5", "e6", "e7"]


def test_a_replayed_batch_stores_the_same_rows(spark, tmp_path):
    """The job ends after the rows, or after the keys, and runs the batch again."""
    source, table = tmp_path / "in", f"{tmp_path}/table"
    nameless = event(0, event_id=None)
    put(source, "1.json", [event(1), event(2), nameless, nameless, event(3, risk_score=200)])
    batch = (spark.read.schema(ev.EVENT_SCHEMA).json(str(source))
             .select("*", F.col("_metadata.file_path").alias("_origin")))
    index = KeyIndex(spark, f"file://{tmp_path}/keys", buckets=4)
    jobs.store_batch(batch.filter("event_id = 'e1'"), 0, table, index)
    jobs.store_batch(batch, 1, table, index)
    first = sorted(r.event_id for r in spark.read.parquet(table).collect())
    jobs.store_batch(batch, 1, table, index)
    again = sorted(r.event_id for r in spark.read.parquet(table).collect())
    assert first == again and len(again) == 4 and {"e1", "e2"} <= set(again)
    assert all(len(i) == 36 for i in again if i.startswith("evt_"))


def test_random_ids_are_fixed_before_use(spark, tmp_path):
    batch = spark.createDataFrame([(None, 1, "X", None, 1, "ALLOW", None, None, None, None, None)] * 3, ev.EVENT_SCHEMA)
    index = KeyIndex(spark, f"file://{tmp_path}/keys", buckets=4)
    jobs.store_batch(batch, 0, f"{tmp_path}/table", index)
    rows = spark.read.parquet(f"{tmp_path}/table").select(F.col("event_id").alias("key"))
    assert rows.count() == 3 and index.repeated(rows, 1).count() == 3
