"""Named queries that run the streaming jobs over the given tables, batch by batch, until the input is used up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textwarden.operators import analytics, events as ev
from textwarden.plans.queries import epoch, event_rows, planted, query
from textwarden.sources.alert_sink import read_alerts
from textwarden.sources.tables import scratch, table
from textwarden.streaming import jobs

#: partitions of the state of a stream; fixed at its first start, so a job for a cluster sets its own
STATE_PARTITIONS = "8"
#: events far in the future, which let a stream's time go on to the end
LATER = "9999-01-01 00:00:00", "9999-06-01 00:00:00"


def streaming(spark: SparkSession) -> SparkSession:
    """A session of its own, whose settings for state leave the caller's alone."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", STATE_PARTITIONS)
    return session


def arrive(parts: list[DataFrame], folder: str, start: Callable[[], StreamingQuery], fmt: str = "json") -> None:
    """Write the parts one after the other, each with as many files as it has partitions; the job takes each as one batch.

    ``start`` starts the job over what has arrived; it goes on from its checkpoint each time.
    """
    for part in parts:
        part.write.mode("append").format(fmt).save(folder)
        start().awaitTermination()


def batches_of(session: SparkSession, folder: str, schema: str | StructType, fmt: str = "json") -> DataFrame:
    return session.readStream.schema(schema).format(fmt).load(folder)


def named(folder: str) -> str:
    """A job's name from a folder of this run."""
    return folder.rsplit("/", 1)[1]


def wire_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as wire events; ids repeat by dropping the last digit."""
    return table(spark, sf, "events").selectExpr(
        "concat('evt_', event_id DIV 10) AS event_id", "unix_millis(cast(ts AS timestamp)) AS timestamp", "'EXTERNAL_AI' AS destination_category",
        "array(event_type) AS detected_tags", "cast(floor(value) AS int) AS risk_score", "'WARN' AS action", "event_id % 3 AS part")


@query
def stream_ingested(spark, sf):
    """Wire events in three batches, ingested: valid ones with ids never stored before."""
    folder, session = scratch(spark, "stream-ingest"), streaming(spark)
    wire = wire_rows(spark, sf)
    index = jobs.KeyIndex(session, f"{folder}/keys", buckets=16)

    def start() -> StreamingQuery:
        rows = batches_of(session, f"{folder}/in", ev.EVENT_SCHEMA).select("*", F.col("_metadata.file_path").alias("_origin"))
        return jobs._start(rows.writeStream.foreachBatch(lambda batch, i: jobs.store_batch(batch, i, f"{folder}/table", index)),
                           session, named(folder), True)

    arrive([wire.filter(f"part = {k}").drop("part") for k in range(3)], f"{folder}/in", start)
    return spark.read.parquet(f"{folder}/table").selectExpr("event_id", "timestamp", "risk_score", "array_join(detected_tags, ',') AS tags")


@query
def stream_scanned(spark, sf):
    """Payloads in two batches, scanned by the stream."""
    folder, session = scratch(spark, "stream-scan"), streaming(spark)
    payloads = planted(spark, sf).selectExpr("doc_id", "text", "host", "action_type", "timestamp_millis(doc_id) AS ts")
    arrive([payloads.filter(f"doc_id % 2 = {part}") for part in range(2)], f"{folder}/in", lambda: jobs.scan_stream(
        batches_of(session, f"{folder}/in", payloads.schema, "parquet"), f"{folder}/table", "doc_id", name=named(folder), once=True), "parquet")
    return spark.read.parquet(f"{folder}/table").selectExpr(
        "cast(split_part(event_id, '_', 3) AS bigint) AS doc_id", "payload_sha256_prefix", "risk_score", "action", "content_length")


def send(spark: SparkSession, sf: str, folder: str, start: Callable[[], StreamingQuery], cuts: int = 1) -> None:
    """The event table to a job in parts by time, then two events of the far future that belong to nobody."""
    rows = event_rows(spark, sf).drop("ml_probability", "ml_confidence")
    bounds = [0, *rows.approxQuantile("timestamp", [k / cuts for k in range(1, cuts)], 0.01), 1 << 62] if cuts > 1 else [0, 1 << 62]
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    later = [spark.range(1).selectExpr(f"'later' AS event_id", f"unix_millis(timestamp '{t}') AS timestamp", "0 AS risk_score", "'ALLOW' AS action",
                                       "'later' AS employee_id", "'later' AS device_id") for t in LATER]
    arrive([rows.filter(f"timestamp >= {int(a)} AND timestamp < {int(b)}") for a, b in zip(bounds, bounds[1:])] + later, f"{folder}/in", start)


@query
def stream_alerts(spark, sf):
    """The alert documents that the stream delivered."""
    folder, session = scratch(spark, "stream-alerts"), spark  # no state, and sinks are looked up in the active session
    send(spark, sf, folder, lambda: jobs.alert_stream(
        batches_of(session, f"{folder}/in", ev.EVENT_SCHEMA), f"{folder}/alerts", name=named(folder), once=True), 2)
    return read_alerts(spark, f"{folder}/alerts", "event_id string, text string, risk_score int, action string, timestamp bigint")


@query
def stream_rollup(spark, sf):
    """Events per action, as the live rollup stands at the end."""
    folder, session = scratch(spark, "stream-rollup"), streaming(spark)

    def start() -> StreamingQuery:
        live = jobs.live_rollup(batches_of(session, f"{folder}/in", ev.EVENT_SCHEMA).filter("event_id <> 'later'"), analytics.by_action)
        return jobs._start(live.writeStream.outputMode("complete").foreachBatch(
            lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/out")), session, named(folder), True)

    send(spark, sf, folder, start, 2)
    return spark.read.parquet(f"{folder}/out")


@query
def stream_last_100(spark, sf):
    """The newest events per device, as the state stands at the end of two batches."""
    folder, session = scratch(spark, "stream-last"), streaming(spark)

    def start() -> StreamingQuery:
        rows = jobs.with_time(batches_of(session, f"{folder}/in", ev.EVENT_SCHEMA)).filter("event_id <> 'later'")
        return jobs._start(jobs.last_events(rows, 100, idle="3650 days").writeStream.outputMode("update").foreachBatch(
            lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{folder}/out/part={i}")), session, named(folder), True)

    send(spark, sf, folder, start, 2)
    last = spark.read.parquet(f"{folder}/out").groupBy("device_id").agg(F.max_by("event_ids", "batch").alias("ids"))
    return last.select("device_id", F.posexplode("ids").alias("position", "event_id")).withColumn("position", F.col("position") + 1)


@query
def stream_sessions(spark, sf):
    """Sessions that the stream gave when they were over."""
    folder, session = scratch(spark, "stream-sessions"), streaming(spark)

    def start() -> StreamingQuery:
        rows = jobs.with_time(batches_of(session, f"{folder}/in", ev.EVENT_SCHEMA))
        return jobs._start(jobs.session_stream(rows, "4 hours").writeStream.outputMode("append").foreachBatch(
            lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/out/part={i}")), session, named(folder), True)

    send(spark, sf, folder, start)
    found = spark.read.parquet(f"{folder}/out").filter("employee_id <> 'later'")
    return found.selectExpr("employee_id", f"{epoch('session_start')} AS session_start", f"{epoch('session_end')} AS session_end", "events", "max_risk",
                            "array_join(array_sort(filter(tags, t -> t IS NOT NULL)), ',') AS tags")


@query
def late_events(spark, sf):
    """Events in three batches, parted into those on time and those more than two days behind; none is lost."""
    folder, session = scratch(spark, "stream-late"), streaming(spark)
    wire = table(spark, sf, "events").selectExpr("cast(event_id AS string) AS event_id", "unix_millis(cast(ts AS timestamp)) AS timestamp", "event_id % 3 AS part")
    arrive([wire.filter(f"part = {k}").drop("part") for k in range(3)], f"{folder}/in", lambda: jobs.split_late(
        jobs.with_time(batches_of(session, f"{folder}/in", "event_id string, timestamp bigint")),
        f"{folder}/on_time", f"{folder}/late", "2 days", name=named(folder), once=True))
    return (spark.read.parquet(f"{folder}/on_time").select("event_id", "batch", F.lit(False).alias("late"))
            .unionByName(spark.read.parquet(f"{folder}/late").select("event_id", "batch", F.lit(True).alias("late"))))
