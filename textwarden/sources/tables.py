"""Reading and writing tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: bytes that one task of a scan takes
TASK_BYTES = 8 * 1024 * 1024
#: tasks per core at least, so that a small input reaches all cores
TASKS_PER_CORE = 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; a local one only in local mode, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def task_count(spark: SparkSession, size: int) -> int:
    """Tasks for a scan over so many bytes."""
    return max(spark.sparkContext.defaultParallelism * TASKS_PER_CORE, -(-size // TASK_BYTES))


def text_bytes(df: DataFrame) -> int:
    """Bytes of all strings and binaries of a table."""
    sizes = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return sum(n or 0 for n in df.agg(*map(F.sum, sizes)).first()) if sizes else 0


def spread(df: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Spread the rows over tasks of bounded size, at least a few per core.

    Scanning costs far more per byte than moving, and a file split may be one large Parquet row
    group: a task of a scan would grow with the splits. Files say little about the text in them,
    as repeated texts shrink to almost nothing, so the texts are measured, of ``files`` where the
    rows are joined from more than one table; reading them costs little beside a scan.
    """
    if df.isStreaming:
        return df
    source = df if files is None else files
    estimate = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(task_count(df.sparkSession, max(estimate, text_bytes(source))))
