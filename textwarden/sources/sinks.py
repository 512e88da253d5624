"""Event, alert and policy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textwarden.operators.events import decoded_tags


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append events by day; readers prune by day.

    The rebalance hint gathers a day's rows into few files and lets Spark split a day that
    is too large for one task.
    """
    stored = events.withColumn("event_date", F.to_date(F.timestamp_millis("timestamp")))
    stored = stored.hint("rebalance", F.col("event_date"))
    (stored.write.mode(mode).partitionBy("event_date")
     .option("maxRecordsPerFile", 5_000_000).parquet(path))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Stored events with their tags as arrays, whoever wrote them."""
    return decoded_tags(spark.read.parquet(path))


def write_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    alerts.write.mode(mode).json(path)


def append_report(report: DataFrame, path: str) -> None:
    """Add a training report to the table of model versions."""
    report.write.mode("append").parquet(path)


def append_policies(rules: DataFrame, path: str) -> None:
    rules.write.mode("append").parquet(path)
