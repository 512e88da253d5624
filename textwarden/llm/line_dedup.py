"""Line de-duplication with once-seen and twice-seen Bloom filters.

A line's key is the line without blanks at both ends, A-Z in lower case. Keys of at least
``least`` code points that occur in two documents or more lose all their lines, except in the
document of the smallest id that holds the key. A first pass builds the filters over the
distinct keys of each document; a second one sends only the keys that the twice-seen filter
suspects through a shuffle, as SHA-256 digests, where they are confirmed exactly and the first
document is chosen; texts without any suspected line are never shuffled.

Defined results: a null or empty text is one empty line; repeated rows of one id are one
document, and a null id comes after all others; lines that repeat within their document stay.
Columns named like the added ones are replaced, all others pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from xxhash import xxh3_64_intdigest

from textwarden.llm import bloom
from textwarden.llm.common import BLANKS, map_batches, salted_join, stored

#: shorter keys, in code points, are left alone
LEAST = 10
ADDED = ["n_lines", "n_dropped"]


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()  # bytes.lower() changes A-Z only


def long_enough(key: bytes, least: int) -> bool:
    """At least so many code points; continuation bytes do not start one."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _keys(text: bytes | None, least: int) -> list[bytes]:
    if not text:
        return []
    return [k for k in {line_key(x) for x in text.split(b"\n")} if long_enough(k, least)]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys))


def _digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()


def suspected(documents: DataFrame, filter_, least: int, bits: int) -> DataFrame:
    """(_id, digest) of each distinct key of a document that the twice-seen filter holds."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = _keys(text, least)
                keys += own
                at += [i] * len(own)
            hit = np.flatnonzero(bloom.holds(filter_.value, _hashes(keys), bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([at[i] for i in hit], pa.int64())),
                 pa.array([_digest(keys[i]) for i in hit], pa.binary())], ["_id", "digest"])

    kind = documents.schema["_id"].dataType
    return map_batches(
        documents.select("_id", "_text"), find, T.StructType([T.StructField("_id", kind), T.StructField("digest", T.BinaryType())]))


def _drop(text: bytes | None, lost: set[bytes], least: int) -> tuple[bytes | None, int, int]:
    lines = (text or b"").split(b"\n")
    if not lost:
        return text, len(lines), 0
    kept = [x for x in lines if not (long_enough(k := line_key(x), least) and _digest(k) in lost)]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                bits: int = bloom.BITS) -> DataFrame:
    """The documents with repeated lines dropped, plus n_lines (before) and n_dropped."""
    spark = documents.sparkSession
    keep = [c for c in documents.columns if c not in ADDED and c != text_col]
    packed = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"),
                              F.struct(*keep).alias("_row"))
    narrow = packed.select("_id", "_text")
    bitmap = bloom.twice_seen(
        narrow, lambda b: _hashes([k for t in b.column(1).to_pylist() for k in _keys(t, least)]), bits)
    filter_ = spark.sparkContext.broadcast(bitmap)  # 2 ** bits bits, whatever the input

    # a struct of (is null, id) orders a null id last and survives grouping
    found = stored(suspected(packed, filter_, least, bits)
                   .select(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id")).alias("doc"),
                           "digest").distinct(), "suspected-lines")
    repeated = (found.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
                .filter("first <> last OR first.none <> last.none").select("digest", "first"))
    lost = (salted_join(found, repeated, ["digest"], F.col("doc"))
            .filter("NOT (doc <=> first)").groupBy("doc").agg(F.collect_list("digest").alias("_lost")))

    def suspect(text: bytes | None) -> bool:
        keys = _keys(text, least)
        return bool(keys) and bool(bloom.holds(filter_.value, _hashes(keys), bits).any())

    def flag(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([suspect(t) for t in batch.column(1).to_pylist()])],
                names=[*batch.schema.names, "_open"])

    flagged = map_batches(packed, flag, T.StructType([*packed.schema.fields, T.StructField("_open", T.BooleanType())]))
    doc = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))
    empty = F.lit(None).cast("array<binary>")
    whole = flagged.filter("NOT _open").select("_text", "_row", empty.alias("_lost"))
    opened = (flagged.filter("_open").withColumn("doc", doc).join(lost, "doc", "left")
              .select("_text", "_row", "_lost"))

    def cut(batches):
        for batch in batches:
            out = [_drop(t, set(x or ()), least)
                   for t, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.binary()), batch.column(1), pa.array([x[1] for x in out], pa.int64()),
                 pa.array([x[2] for x in out], pa.int64())], ["_text", "_row", *ADDED])

    done = map_batches(whole.unionByName(opened), cut, T.StructType(
        [packed.schema["_text"], packed.schema["_row"], *(T.StructField(c, T.LongType()) for c in ADDED)]))
    columns = [F.col("_text").cast("string").alias(text_col) if c == text_col else F.col(f"_row.`{c}`").alias(c)
               for c in documents.columns if c not in ADDED]
    return done.select(*columns, *ADDED)
