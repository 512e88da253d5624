"""Character grams of whole words: totals over tables, and counts of known grams per document.

A word's grams depend on the word alone, so words are counted first; every distinct word is cut into
grams once per table or task, not once per occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textwarden.sources.workers import map_batches

MAX_GRAM = 3
#: words of a batch that are looked at together, and known words that a task remembers at most
TOKENS, REMEMBERED = 50_000, 200_000


def words(text: str) -> str:
    """The words of a text in lower case, in order."""
    return f"filter(split(lower({text}), '\\\\s+'), w -> w <> '')"


def word_grams(word: str) -> str:
    """Character n-grams of 1 to 3 of a word that is padded by a blank on both sides."""
    grams = (f"transform(sequence(1, {MAX_GRAM}), n -> transform(sequence(1, length(p) + 1 - n), i -> substring(p, i, n)))")
    return f"flatten(flatten(transform(array(concat(' ', {word}, ' ')), p -> {grams})))"


def occurrences(texts: DataFrame, text: str = "text", **counted: Column) -> DataFrame:
    """(gram, a column for each condition): how often each gram occurs in the rows for which the condition holds."""
    each = texts.select(F.explode(F.expr(words(text))).alias("word"), *[c.alias(n) for n, c in counted.items()])
    totals = each.groupBy("word").agg(*[F.count_if(F.col(n)).alias(n) for n in counted])
    return of_words(totals, *counted)


def of_words(totals: DataFrame, *sums: str) -> DataFrame:
    """(gram, sums): the sums of words (word, sums) as sums of their grams."""
    # few rows of much work each
    tasks = totals.sparkSession.sparkContext.defaultParallelism * 4
    return totals.repartition(tasks, "word").select(F.explode(F.expr(word_grams("word"))).alias("gram"), *sums).groupBy("gram").agg(*[F.sum(n).alias(n) for n in sums])


def _grams(word: str) -> Iterator[str]:
    padded = f" {word} "
    return (padded[i:i + n] for n in range(1, MAX_GRAM + 1) for i in range(len(padded) + 1 - n))


class _Known:
    """Places and counts of the known grams of words."""

    def __init__(self, places: dict[str, int]):
        self.places, self.words = places, {}

    def of(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.words.get(word)
        if found is None:
            counts: dict[int, int] = {}
            for gram in _grams(word):
                place = self.places.get(gram)
                if place is not None:
                    counts[place] = counts.get(place, 0) + 1
            found = np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[word] = found
        return found


def _table(lists: pa.ListArray, times: np.ndarray | None, known: _Known, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, counts) of each row's words, each word ``times`` over."""
    tokens = lists.flatten().dictionary_encode()
    found = [known.of(w) for w in tokens.dictionary.to_pylist()]
    lengths = np.array([len(p) for p, _ in found], np.int64)
    starts = np.cumsum(lengths) - lengths
    places = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
    counts = np.concatenate([c for _, c in found]) if found else np.zeros(0)
    index = np.asarray(tokens.indices).astype(np.int64)
    bounds = np.cumsum([0, *np.asarray(lists.value_lengths().fill_null(0))])
    for a, b in zip(bounds, bounds[1:]):
        total = np.zeros(size)
        for at in range(a, b, TOKENS):
            own = index[at:min(b, at + TOKENS)]
            many = np.ones(len(own)) if times is None else times[at:min(b, at + TOKENS)].astype(np.float64)
            n = lengths[own]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            chosen = np.repeat(starts[own], n) + within
            total += np.bincount(places[chosen], counts[chosen] * np.repeat(many, n), size)
        held = np.flatnonzero(total)
        yield held, total[held]


def known_counts(df: DataFrame, terms: list[str], column: str = "words", times: str | None = None,
                 weights: list[float] | None = None) -> DataFrame:
    """The rows with ``positions`` (ascending, in ``terms``) and ``tfs`` of the known grams of their words.

    ``column`` is an array of words, ``times`` one of how often each occurs; both are left out of the result.
    With ``weights`` the counts are multiplied by those of their terms.
    """
    shared = df.sparkSession.sparkContext.broadcast((terms, np.ones(len(terms)) if weights is None else np.array(weights)))  # a vocabulary, bounded by the caller
    keep = [c for c in df.columns if c not in (column, times)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, factors = shared.value
        known = _Known({t: i for i, t in enumerate(listed)})
        for batch in batches:
            many = None if times is None else np.asarray(batch.column(2).flatten())
            rows = list(_table(batch.column(1), many, known, len(known.places)))
            offsets = pa.array(np.cumsum([0, *(len(p) for p, _ in rows)]), pa.int32())
            flat = [np.concatenate([r[k] for r in rows]) if rows else np.zeros(0) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat[0], pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(flat[1] * factors[flat[0].astype(np.int64)], pa.float64()))], ["row", "positions", "tfs"])

    packed = df.select(F.struct(*keep).alias("row"), column, *([times] if times else []))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, positions array<int>, tfs array<double>"
    return map_batches(packed, work, schema).select("row.*", "positions", "tfs")
