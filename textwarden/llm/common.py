"""Shared folder, skew-safe joins and packing helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textwarden.sources.tables import scratch
from textwarden.sources.workers import kept, map_batches, ship

__all__ = ["kept", "map_batches", "salted_join", "shared_folder", "ship", "stored"]

#: the white space that separates words, as bytes and as a Java character class
BLANKS = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: row groups of scratch tables, which a task holds while it writes
BLOCK_BYTES = 16 * 1024 * 1024
#: rows of one join key are dealt to this many tasks
SALTS = 64


#: a new folder name below ``spark.checkpoint.dir``
shared_folder = scratch


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("parquet.block.size", BLOCK_BYTES).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """``left`` joined to the one row per key of ``right``, the rows of a hot key dealt to ``salts`` tasks.

    ``right`` is repeated only for the (key, salt) pairs that occur in ``left``, so it never
    grows beyond the number of left rows, nor beyond ``salts`` rows a key.
    """
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    needed = dealt.select(*keys, "_salt").distinct()
    return dealt.join(needed.join(right, keys), [*keys, "_salt"], how).drop("_salt")
