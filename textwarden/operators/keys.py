"""A key index: which keys were stored before, however long ago.

Keys are dealt to buckets by their hash. Every commit adds, per bucket it meets, the keys
themselves and a Bloom filter of them, as one row. A batch tests its keys against the filters of
the buckets it meets, and reads stored keys only of buckets where a filter holds one of them; with
24 bits a key that is about one false alarm in a hundred thousand. The stored keys decide.

A batch sees only what batches with smaller numbers committed, and a batch that runs again
replaces its own files, so a replay comes to the same answer whatever its first run left behind.
Filters and keys of many commits are folded together by ``compacted``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textwarden.sources.tables import read_or_empty
from textwarden.sources.workers import ship

BUCKETS = 256
BITS_PER_KEY = 24
HASHES = 16
KEYS = "key string, batch bigint, bucket int"
FILTERS = "n bigint, bits binary, batch bigint, bucket int"


def _places(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """The bits of each key in a filter of ``size`` bits, a power of two; one row per hash."""
    with np.errstate(over="ignore"):
        steps = np.arange(HASHES, dtype=np.uint64)[:, None] * (second.view(np.uint64) | np.uint64(1))
        return (first.view(np.uint64) + steps) >> np.uint64(7) & np.uint64(size - 1)


def _filter(rows: pa.Table) -> pa.Table:
    """The filter of one bucket's keys; holds two numbers per key of a commit."""
    n = rows.num_rows
    size = 1 << max(10, (n * BITS_PER_KEY - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[_places(np.asarray(rows["first"]), np.asarray(rows["second"]), size).ravel()] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    return pa.table({"bucket": rows["bucket"][:1], "n": pa.array([n], pa.int64()), "bits": pa.array([packed], pa.binary())})


def _suspected(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """The keys of a bucket that one of its filters may hold."""
    first, second = np.asarray(keys["first"]), np.asarray(keys["second"])
    held = np.zeros(keys.num_rows, bool)
    for packed in filters["bits"]:
        bits = np.frombuffer(packed.as_buffer(), np.uint8)
        at = _places(first, second, 8 * len(bits))
        held |= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)
    return keys.select(["bucket", "key"]).filter(pa.array(held))


class KeyIndex:
    """Stored keys below a folder; null keys are never stored and never repeated."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        ship(spark)

    def _dealt(self, keys: DataFrame) -> DataFrame:
        hashed = keys.select(F.col("key").cast("string").alias("key")).filter("key IS NOT NULL").distinct()
        return hashed.withColumns({
            "first": F.xxhash64("key"), "second": F.xxhash64("key", F.lit(1)),
            "bucket": F.pmod(F.xxhash64("key", F.lit(2)), F.lit(self.buckets)).cast("int")})

    def _read(self, part: str, schema: str, before: int, buckets: list[int] | None = None) -> DataFrame:
        rows = read_or_empty(self.spark, f"{self.folder}/{part}", schema).filter(F.col("batch") < before)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def repeated(self, keys: DataFrame, batch: int) -> DataFrame:
        """The keys (key) that an earlier batch committed."""
        met = self._dealt(keys)
        # one number per bucket
        filters = self._read("filters", FILTERS, batch, [r.bucket for r in met.select("bucket").distinct().collect()])
        if filters.isEmpty():
            return self.spark.createDataFrame([], "key string")
        suspects = (met.groupBy("bucket").cogroup(filters.select("bucket", "bits").groupBy("bucket"))
                    .applyInArrow(_suspected, "bucket int, key string"))
        buckets = [r.bucket for r in suspects.select("bucket").distinct().collect()]
        stored = self._read("keys", KEYS, batch, buckets)
        return suspects.join(stored, ["bucket", "key"], "left_semi").select("key")

    def commit(self, keys: DataFrame, batch: int) -> None:
        """Store keys (key) under a batch number; a batch that runs again replaces what it stored."""
        self._write(self._dealt(keys), f"batch={batch}")

    def _write(self, dealt: DataFrame, name: str) -> None:
        dealt = dealt.persist()
        (dealt.select("key", "bucket").repartition("bucket").sortWithinPartitions("bucket", "key")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/keys/{name}"))
        (dealt.groupBy("bucket").applyInArrow(_filter, "bucket int, n bigint, bits binary")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/filters/{name}"))
        dealt.unpersist()

    def compacted(self, folder: str, batch: int, buckets: int | None = None) -> KeyIndex:
        """A new index with the keys of all batches up to this one as a single commit; switch to it at a restart."""
        new = KeyIndex(self.spark, folder, buckets or self.buckets)
        new.commit(self._read("keys", KEYS, batch + 1), batch)
        return new


def first_seen(rows: DataFrame, index: KeyIndex, batch: int, key: str = "event_id") -> DataFrame:
    """Rows whose key no earlier batch committed. Keys must not repeat within the batch (see ``unique_events``)."""
    known = index.repeated(rows.select(F.col(key).alias("key")), batch)
    return rows.join(known.withColumnRenamed("key", key), key, "left_anti")
