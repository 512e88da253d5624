"""Sliding windows from panes against one copy of an event per window."""

import random
import time

import pytest
from pyspark.sql import functions as F

from textwarden.operators import sessions


def copies(events, width, slide, keys=()):
    """The windows by copying each event into all that hold it."""
    return (events.groupBy(*keys, F.window("ts", width, slide).alias("w")).agg(*[F.expr(v).alias(n) for n, v, _ in sessions.TREND])
            .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[n for n, *_ in sessions.TREND]))


@pytest.fixture
def events(spark):
    def make(n, span, seed=0):
        rng = random.Random(seed)
        rows = [(rng.choice(["a", "b", None]), rng.choice(["BLOCK", "ALLOW"]), rng.choice([None, rng.randint(0, 100)]), rng.randint(-span, span) / 1000)
                for _ in range(n)]
        return spark.createDataFrame(rows, "device_id string, action string, risk_score int, at double").select(
            "*", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts")).unionByName(
            spark.createDataFrame([("a", "BLOCK", 1, None, None)], "device_id string, action string, risk_score int, at double, ts timestamp"))
    return make


@pytest.mark.parametrize("width, slide", [("1 minute", "10 seconds"), ("1 minute", "1 minute"), ("9 hours", "2 hours"),
                                          ("10 minutes", "4 minutes"), ("2 seconds", "300 milliseconds")])
@pytest.mark.parametrize("keys", [(), ("device_id",)])
def test_panes_equal_copies(events, width, slide, keys):
    data = events(400, 5_000_000)
    got = sessions.sliding(data, width, slide, keys=keys)
    want = copies(data.filter("ts IS NOT NULL"), width, slide, keys)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_empty_and_wrong_input(events):
    assert sessions.sliding(events(0, 1), "1 minute", "10 seconds").collect() == []
    with pytest.raises(ValueError):
        sessions.sliding(events(1, 1), "1 minute", "2 minutes")


def test_fine_windows_cost_what_tumbling_ones_cost(spark, tmp_path):
    """An hour by ten seconds, 360 windows an event, against an hour by an hour."""
    folder = f"{tmp_path}/events"
    (spark.range(4_000_000).selectExpr("concat('d', id % 50) AS device_id", "if(id % 3 = 0, 'BLOCK', 'ALLOW') AS action",
                                       "cast(id % 100 AS int) AS risk_score", "timestamp_millis(1700000000000 + id * 20) AS ts").write.parquet(folder))
    data = spark.read.parquet(folder)

    def seconds(slide):
        best = 1e9
        for _ in range(3):
            start = time.monotonic()
            sessions.risk_trend(data, "1 hour", slide).write.format("noop").mode("overwrite").save()
            best = min(best, time.monotonic() - start)
        return best

    tumbling, fine = seconds(None), seconds("10 seconds")
    assert fine < 2 * tumbling + 1.5, (tumbling, fine)
