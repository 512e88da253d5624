"""Payload sources: tables, text, JSON lines, CSV and whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textwarden.functions.destination import host_of
from textwarden.sources.tables import spread


def read_table(spark: SparkSession, path: str, text: str, key: str, host: str | None = None,
               url: str | None = None, action_type: str = "paste", fmt: str = "parquet") -> DataFrame:
    """Payloads from a table with a text column; only the named columns are read."""
    source = spread(spark.read.format(fmt).load(path).select(*[c for c in (key, text, host, url) if c]))
    place = f"lower({host})" if host else host_of(url) if url else "''"
    return source.selectExpr(f"{key} AS payload_id", f"{text} AS text", f"coalesce({place}, '') AS host",
                             f"'{action_type}' AS action_type")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Payloads as JSON lines: payload_id, text, host, action_type, ts (epoch ms), identity."""
    schema = ("payload_id string, text string, host string, action_type string, ts bigint, "
              "employee_id string, device_id string, browser_fingerprint string")
    rows = spread(spark.read.schema(schema).json(path))
    return rows.withColumns({
        "ts": F.timestamp_millis("ts"), "host": F.lower(F.coalesce("host", F.lit(""))),
        "action_type": F.coalesce("action_type", F.lit("unknown"))})


def read_files(spark: SparkSession, path: str, host: str, pattern: str | None = None) -> DataFrame:
    """Files about to leave for ``host``: path, length, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", "content", F.lit(host.lower()).alias("host"))
