"""Python workers that may use this package."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Hashable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: rows with whole texts travel to the workers in batches of at most so many, or fewer if the session says so
BATCH_ROWS = 2_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()
_KEPT: dict[Hashable, Any] = {}
_ASKED: set[Hashable] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they may not find it themselves."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def kept(build: Callable[..., Any], *args: Hashable) -> Any:
    """``build(*args)``, kept between the tasks of a Python worker that ask for it; the first task that does not drops it."""
    key = (build, args)
    if key not in _KEPT:
        _KEPT[key] = build(*args)
    _ASKED.add(key)
    return _KEPT[key]


def give_back() -> None:
    """Return what a finished task used to the system; an idle worker keeps its process, not its memory."""
    for key in _KEPT.keys() - _ASKED:  # of another operator, whose tasks are over
        del _KEPT[key]
    _ASKED.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema
                ) -> DataFrame:
    """``mapInArrow`` whose function may use this package, over batches of bounded size."""
    spark = df.sparkSession
    ship(spark)
    if not 0 < int(spark.conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(work, schema)
