"""Structured Streaming jobs. The scan itself is stateless and runs on a stream unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from textwarden.operators import analytics, events as ev
from textwarden.operators.keys import KeyIndex, first_seen
from textwarden.operators.policies import rules_as_of
from textwarden.operators.rule_table import RuleTable, compile_rules
from textwarden.operators.scan import scan
from textwarden.operators.sessions import micros
from textwarden.options import DEFAULTS, ScanOptions
from textwarden.sources.alert_sink import AlertSink
from textwarden.sources.tables import read_or_empty, shared_root
from textwarden.sources.workers import ship
from textwarden.streaming.state import LAST_SCHEMA, SESSION_SCHEMA, NewestEvents, SessionsOfCells, use_state_store


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """Checkpoint location of a job below the folder the cluster names."""
    return f"{shared_root(spark)}/{name}"


def _start(writer: DataStreamWriter, spark: SparkSession, name: str, once: bool) -> StreamingQuery:
    writer = writer.queryName(name).option("checkpointLocation", checkpoint_folder(spark, name))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Incoming events as JSON lines, with the wire schema."""
    return spark.readStream.schema(ev.EVENT_SCHEMA).json(folder)


def with_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.timestamp_millis("timestamp"))


def unique(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeats of an event id that arrive within the delay of each other (bounded state).

    Time is that of arrival (``received_at``), so an event is never late, however old its own
    time is. Every row must carry an id: fill it in first, or rows without one count as repeats.
    ``ingest`` drops repeats for ever, by an index of the stored ids.
    """
    return (with_time(events).withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["event_id"]))


def store_batch(batch: DataFrame, batch_id: int, table: str, index: KeyIndex) -> None:
    """Append the valid events of a batch whose ids were never stored, and commit their ids.

    Rows go to the batch's own folder before their ids do. If the job ends in between, the batch
    runs again under the same number, sees only earlier batches in the index, and replaces both.
    """
    spark = batch.sparkSession
    origin = "_origin" if "_origin" in batch.columns else None
    folder = f"{table}/batch={batch_id}"
    if origin is None:  # ids may be random: fix them first
        staged = f"{index.folder}/staged"
        ev.accepted(batch).write.mode("overwrite").parquet(staged)
        rows = spark.read.parquet(staged)
    else:
        rows = ev.accepted(batch, origin)
    fresh = first_seen(ev.unique_events(rows), index, batch_id)
    (fresh.withColumn("event_date", F.to_date(F.timestamp_millis("timestamp")))
     .write.mode("overwrite").partitionBy("event_date").parquet(folder))
    index.commit(read_or_empty(spark, folder, "event_id string").select(F.col("event_id").alias("key")), batch_id)


def ingest(spark: SparkSession, source: str, table: str, name: str = "ingest", once: bool = False,
           index: KeyIndex | None = None) -> StreamingQuery:
    """Append valid events with ids never stored before to the event table, by batch and day.

    Rows are checked and given an id before repeats are dropped, so a rejected row never takes
    an id away from a valid one. ``reject_stream`` keeps what this leaves out.
    """
    index = index or KeyIndex(spark, f"{table.rstrip('/')}_keys")
    rows = read_events(spark, source).select("*", F.col("_metadata.file_path").alias("_origin"))
    return _start(rows.writeStream.foreachBatch(lambda batch, i: store_batch(batch, i, table, index)), spark, name, once)


def reject_stream(spark: SparkSession, source: str, folder: str, name: str = "rejects",
                  once: bool = False) -> StreamingQuery:
    """Write the events that ``ingest`` refuses, with the reason, as JSON."""
    writer = ev.rejected(read_events(spark, source)).writeStream.format("json").option("path", folder)
    return _start(writer.outputMode("append"), spark, name, once)


def rules_of_batch(store: DataFrame, folder: str, options: ScanOptions = DEFAULTS) -> RuleTable:
    """The rules that a batch is judged by, kept in its folder: a batch that runs again gets the same ones.

    The first run notes its moment, takes the store as of then and keeps the compiled table. A run
    that ended before the table was whole compiles it again as of the noted moment, so rules
    appended in between wait for the next batch.
    """
    spark = store.sparkSession
    noted = read_or_empty(spark, f"{folder}/moment", "moment timestamp").first()
    if noted is None:
        spark.range(1).select(F.current_timestamp().alias("moment")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/moment")
        noted = spark.read.parquet(f"{folder}/moment").first()
    if read_or_empty(spark, f"{folder}/rules/cells", "cells array<array<int>>").isEmpty():
        return compile_rules(rules_as_of(store, F.lit(noted.moment)), f"{folder}/rules", options)
    return RuleTable(spark, f"{folder}/rules")


def scan_stream(payloads: DataFrame, table: str, suffix: str, policies=None, name: str = "scan",
                once: bool = False, options: ScanOptions = DEFAULTS) -> StreamingQuery:
    """Scan a stream of payloads into the event table.

    ``policies`` is a function that reads the rule table; it is called for every
    micro-batch, so edited rules take effect with the next one. The rules of each batch are
    kept beside the event table.
    """
    spark = payloads.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        rules = None if policies is None else rules_of_batch(policies(), f"{table.rstrip('/')}_rules/batch={batch_id}", options)
        events = ev.build_events(scan(batch, rules=rules, options=options), suffix, options)
        # one folder per micro-batch, by day: a batch that is run again replaces its own output
        (events.withColumn("event_date", F.to_date(F.timestamp_millis("timestamp")))
         .write.mode("overwrite").partitionBy("event_date").parquet(f"{table}/batch={batch_id}"))

    return _start(payloads.writeStream.foreachBatch(write), spark, name, once)


def alert_stream(events: DataFrame, folder: str, name: str = "alerts", once: bool = False) -> StreamingQuery:
    """Write every alert document exactly once (see ``alert_sink``); ``read_alerts`` gives them back."""
    spark = events.sparkSession
    ship(spark)
    spark.dataSource.register(AlertSink)  # the session must be the active one, where sinks are looked up
    documents = ev.alert_payloads(events).select("event_id", "payload")
    return _start(documents.writeStream.format(AlertSink.name()).option("path", folder).outputMode("append"), spark, name, once)


def live_rollup(events: DataFrame, rollup=analytics.by_action) -> DataFrame:
    """Any of the rollups over the stream so far (use output mode ``complete``)."""
    return rollup(events)


def windowed_risk(events: DataFrame, width: str = "5 minutes", slide: str | None = None,
                  delay: str = "10 minutes") -> DataFrame:
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (events.withWatermark("ts", delay).groupBy(window.alias("w"))
            .agg(F.count(F.lit(1)).alias("events"), F.max("risk_score").alias("max_risk"),
                 F.sum("risk_score").alias("total_risk")))


def flood_stream(events: DataFrame, limit: int = 100, delay: str = "10 minutes") -> DataFrame:
    return (events.withWatermark("ts", delay).groupBy("device_id", F.window("ts", "1 minute").alias("w"))
            .agg(F.count(F.lit(1)).alias("events")).filter(F.col("events") > limit))


def split_late(events: DataFrame, on_time: str, late: str, delay: str = "10 minutes", name: str = "late",
               once: bool = False) -> StreamingQuery:
    """Part a stream of events with ``ts`` into those on time and those more than ``delay`` behind; none is lost.

    An event is late if it lies behind the newest one of all earlier batches by more than the delay.
    Each batch notes its newest time beside the table, so one that runs again decides alike. Events
    without a time are late. Windows, floods and sessions over the table of events on time leave none
    of them out, and a correction can add the late ones when it suits.
    """
    marks = f"{on_time.rstrip('/')}_marks"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = read_or_empty(spark, marks, "newest timestamp, batch bigint").filter(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
        behind = F.lit(False) if newest is None else F.col("ts") < F.lit(newest) - F.expr(f"interval {delay}")
        is_late = F.coalesce(behind, F.lit(True)) | F.col("ts").isNull()
        batch.filter(~is_late).write.mode("overwrite").parquet(f"{on_time}/batch={batch_id}")
        batch.filter(is_late).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        batch.agg(F.max("ts").alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")

    return _start(events.writeStream.foreachBatch(write), events.sparkSession, name, once)


def session_stream(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes", salts: int = 8) -> DataFrame:
    """Activity sessions per employee with the union of their tags, each once when it is over (output mode ``append``).

    Events are first combined into cells as wide as the gap, per employee and salt; a closed cell is
    one row, however many events it holds, and only these meet per employee, where sessions grow
    over them. A session is over when no cell that could still reach it can close. Events more than
    ``delay`` behind the newest one are left out; ``split_late`` keeps them.
    """
    spark = events.sparkSession
    use_state_store(spark)
    tags = F.expr("if(coalesce(size(detected_tags), 0) > 0, detected_tags, array(cast(null AS string)))")
    rows = events.withColumn("_tags", tags).select("*", F.posexplode("_tags").alias("_n", "_tag"))
    cells = (rows.withWatermark("ts", delay)
             .groupBy("employee_id", F.window("ts", gap).alias("cell"), F.pmod(F.xxhash64("event_id"), F.lit(salts)).alias("salt"))
             .agg(F.unix_micros(F.min("ts")).alias("first"), F.unix_micros(F.max("ts")).alias("last"),
                  F.count_if(F.col("_n") == 0).alias("events"), F.max("risk_score").alias("max_risk"), F.collect_set("_tag").alias("tags")))
    # each column of a row is converted for the worker on its own, at several times the cost of reading this
    narrow = cells.select("employee_id", F.to_json(F.struct("first", "last", "events", "max_risk", "tags")).alias("cell"))
    found = narrow.groupBy("employee_id").transformWithState(
        SessionsOfCells(micros(gap)), SESSION_SCHEMA, "Append", "EventTime")
    return found.selectExpr("employee_id", "timestamp_micros(first) AS session_start", "timestamp_micros(last) AS session_end",
                            "events", "max_risk", "tags")


def last_events(events: DataFrame, keep: int = 100, idle: str = "30 days", delay: str = "10 minutes") -> DataFrame:
    """The ids of each device's newest events, as state of at most ``keep`` entries (output mode ``update``).

    A device that sends nothing for ``idle`` is forgotten, with a last row without ids. Events more than
    ``delay`` behind the newest one are left out; ``split_late`` keeps them.
    """
    use_state_store(events.sparkSession)
    rows = events.select("device_id", "event_id", "timestamp", "ts").withWatermark("ts", delay)
    return rows.groupBy("device_id").transformWithState(NewestEvents(keep, micros(idle) // 1000), LAST_SCHEMA, "Update", "EventTime")
