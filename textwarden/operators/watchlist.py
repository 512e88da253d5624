"""Watched names in bulk: which of many names a text holds, as whole words, in any case.

A list of names becomes an automaton that reads a text once, whatever the number of names. Names
travel to the tasks in blocks of bounded size; a list beyond one block costs one more pass over the
texts per block. Matches are those of one alternation of all names between characters that are
neither letters, digits, ``_`` nor ``-``; only A-Z and a-z are alike.

Null and blank names watch for nothing, null texts hold nothing, and a repeated name is one name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from textwarden.functions.text import is_blank, plain_blanks
from textwarden.sources.workers import map_batches

#: characters of all names of a block: an automaton of at most about 300 MB in a Python worker
BLOCK_CHARS = 2_000_000
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")


def plain_lower(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def _automaton(names: list[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for name in names:
        machine.add_word(name, name)
    machine.make_automaton()
    return machine


def _held(machine, text: str) -> set[str]:
    low = plain_lower(text)
    found = set()
    for last, name in machine.iter(low):
        first = last - len(name) + 1
        if name not in found and (not first or low[first - 1] not in _WORD) and low[last + 1:last + 2] not in _WORD:
            found.add(name)
    return found


def cleaned(names: DataFrame, name: str = "name") -> DataFrame:
    """(name): each watched name once, in lower case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return names.filter(f"NOT {is_blank(name)}").select(F.translate(F.col(name).cast("string"), upper, lower).alias("name")).distinct()


def find_names(payloads: DataFrame, names: DataFrame, key: str, text: str = "text", name: str = "name") -> DataFrame:
    """(key, name): every watched name that a payload holds, once per payload row."""
    watched = cleaned(names, name)
    # two numbers
    total = watched.agg(F.sum(F.length("name") + 1)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    texts = payloads.select(F.col(key).alias("key"), F.expr(plain_blanks(text)).alias("text")).filter("text IS NOT NULL")
    schema = T.StructType([T.StructField(key, texts.schema["key"].dataType), T.StructField("name", T.StringType())])
    found = None
    for block in range(blocks):
        # a block of bounded size at a time
        own = watched if blocks == 1 else watched.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block)
        listed = payloads.sparkSession.sparkContext.broadcast([r.name for r in own.collect()])
        if listed.value:
            part = map_batches(texts, _searcher(listed, key), schema)
            found = part if found is None else found.unionByName(part)
    return payloads.sparkSession.createDataFrame([], schema) if found is None else found


def _searcher(listed, key: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(listed.value)
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                held = _held(machine, text)
                rows += [row] * len(held)
                found += sorted(held)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], [key, "name"])

    return work


def with_watched(detected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Signals of ``scan.detect`` with the category of a secret project where a payload holds a watched name."""
    holders = found.select(F.col(key).alias("_holder")).distinct()
    added = F.when(F.col("_holder").isNotNull(), F.array(F.lit("CONFIDENTIAL_PROJECT"))).otherwise(F.array().cast("array<string>"))
    return (detected.join(holders, F.col(key) == F.col("_holder"), "left")
            .withColumn("narrative", F.col("narrative").withField(
                "categories", F.array_union(F.col("narrative.categories"), added))).drop("_holder"))
