"""Quality rules by cross-document line frequency.

One pass over the texts measures each document and hashes its normalised lines (blanks
collapsed, A-Z in lower case). The distinct documents that hold a line are counted per host;
exact copies of a text count once. Lines in at least ``least_documents`` documents of a host
and in more than ``most_share`` per cent of them are removed; a document that loses more than
``most_removed`` per cent of its words so is depleted and rejected, besides those that fail the
base rules (under 20 words, or over 30 % of the words in repeated windows of 8 words).

Defined results: a null text has no words; a null host is a host of its own, apart from an
empty one; null and repeated ids are kept, each row by itself. Columns named like the added
ones are replaced, all others pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from textwarden.llm.common import BLANKS, map_batches, salted_join, stored

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
LEAST_DOCUMENTS, MOST_SHARE, MOST_REMOVED = 20, 2, 50
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = [*MEASURES, "base_failed", "removed_words", "kept"]
_MIX = np.random.default_rng(8).integers(1, 2 ** 63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows that occur twice or more; equal hashes are confirmed on the words."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    hashes = sum(codes[i:i + n] * _MIX[i] for i in range(window))
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    found = np.zeros(n, bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    places = defaultdict(list)
    for i in np.flatnonzero(found).tolist():
        places[tuple(words[i:i + window])].append(i)
    edges = np.zeros(len(words) + 1, np.int64)
    for at in places.values():
        if len(at) > 1:
            np.add.at(edges, at, 1)
            np.add.at(edges, np.array(at) + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def measure(text: bytes) -> tuple[list[int], dict[int, int]]:
    """The measures of a text, and the words of each distinct normalised line by the line's hash."""
    words = text.split()  # bytes.split() parts at exactly the blanks \x20 \x09-\x0D
    inner = len(text.translate(None, BLANKS))
    characters = len(text.decode("utf-8", "replace")) - (len(text) - inner)
    earlier: set[bytes] = set()
    lines: dict[int, int] = defaultdict(int)
    repeats = 0
    for line in text.split(b"\n"):
        parts = line.split()
        if parts:
            repeats += line in earlier
            earlier.add(line)
            lines[xxh3_64_intdigest(b" ".join(parts).lower())] += len(parts)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return [len(words), characters, symbols, repeats, repeated_words(words)], lines


def _measured(packed: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, digests, lines = [], [], []
            for text in batch.column(0).to_pylist():
                text = text or b""
                values, own = measure(text)
                found.append(values)
                digests.append(xxh3_128_digest(text))
                lines.append([{"line": h - (1 << 63), "words": n} for h, n in own.items()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(digests, pa.binary()),
                 *(pa.array([x[k] for x in found], pa.int64()) for k in range(len(MEASURES))),
                 pa.array(lines, pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())])))],
                names=[*batch.schema.names[1:], "text_hash", *(f"_{m}" for m in MEASURES), "lines"])

    line = T.StructType([T.StructField("line", T.LongType()), T.StructField("words", T.LongType())])
    return map_batches(packed, work, T.StructType(
        [*packed.schema.fields[1:], T.StructField("text_hash", T.BinaryType()),
         *(T.StructField(f"_{m}", T.LongType()) for m in MEASURES), T.StructField("lines", T.ArrayType(line))]))


def _frequent(measured: DataFrame, least_documents: int, most_share: float) -> tuple[DataFrame, DataFrame]:
    """(host, line) of the lines above the limits, and the lines of each distinct text of a host."""
    text = ["no_host", "host", "text_hash"]
    distinct = measured.groupBy(*text).agg(F.any_value("lines").alias("lines"))
    lines = stored(distinct.select(*text, F.inline("lines")), "host-lines")
    totals = distinct.groupBy("no_host", "host").agg(F.count(F.lit(1)).alias("documents"))
    key = ["no_host", "host", "line"]
    frequent = lines.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_documents)
    frequent = (salted_join(frequent, totals, ["no_host", "host"], F.col("line"))
                .filter(F.col("n") * 100 > F.col("documents") * most_share).select(*key))
    return frequent, lines


def _packed(documents: DataFrame, keep: list[str], host_col: str, text_col: str) -> DataFrame:
    host = F.col(host_col).cast("string")
    return documents.select(F.col(text_col).cast("string").cast("binary").alias("_text"),
                            host.isNull().alias("no_host"), F.coalesce(host, F.lit("")).alias("host"),
                            F.struct(*keep).alias("_row"))


def judge_lines(documents: DataFrame, host_col: str = "source", text_col: str = "text",
                least_documents: int = LEAST_DOCUMENTS, most_share: float = MOST_SHARE,
                most_removed: float = MOST_REMOVED) -> DataFrame:
    """The documents (without their text) with measures, base_failed, removed_words and kept."""
    keep = [c for c in documents.columns if c not in ADDED and c != text_col]
    measured = stored(_measured(_packed(documents, keep, host_col, text_col)), "line-quality")
    text = ["no_host", "host", "text_hash"]
    frequent, lines = _frequent(measured, least_documents, most_share)
    removed = (salted_join(lines, frequent, ["no_host", "host", "line"], F.col("text_hash"))
               .groupBy(*text).agg(F.sum("words").alias("removed_words")))
    out = salted_join(measured.drop("lines"), removed, text, F.struct("_row"), "left")
    failed = ((F.col("_n_words") < LEAST_WORDS)
              | (F.col("_n_repeat_words") * 100 > F.col("_n_words") * MOST_REPEATED))
    lost = F.coalesce("removed_words", F.lit(0))
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in keep), *(F.col(f"_{m}").alias(m) for m in MEASURES),
                      failed.alias("base_failed"), lost.alias("removed_words"),
                      (~failed & (lost * 100 <= F.col("_n_words") * most_removed)).alias("kept"))


def cut_lines(documents: DataFrame, host_col: str = "source", text_col: str = "text",
              least_documents: int = LEAST_DOCUMENTS, most_share: float = MOST_SHARE) -> DataFrame:
    """The documents with the lines above the limits taken out of their text; null texts stay null.

    Only texts that hold such a line meet their list of lines, by the hash of the text; the others
    pass through.
    """
    keep = [c for c in documents.columns if c != text_col]
    packed = _packed(documents, keep, host_col, text_col)
    text = ["no_host", "host", "text_hash"]
    measured = stored(_measured(packed).select(*text, "lines").distinct(), "line-quality")
    frequent, lines = _frequent(measured, least_documents, most_share)
    gone = (salted_join(lines, frequent, ["no_host", "host", "line"], F.col("text_hash"))
            .groupBy(*text).agg(F.collect_set("line").alias("gone")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([xxh3_128_digest(t or b"") for t in batch.column(0).to_pylist()], pa.binary())],
                                             names=[*batch.schema.names, "text_hash"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_without(t, gone) for t, gone in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["_text", "_row"])

    named = map_batches(packed, hashed, T.StructType([*packed.schema.fields, T.StructField("text_hash", T.BinaryType())]))
    joined = salted_join(named, gone, text, F.struct("_row"), "left").select("_text", "_row", "gone")
    done = map_batches(joined, cut, T.StructType([packed.schema["_text"], packed.schema["_row"]]))
    return done.select(*(F.col("_text").cast("string").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in documents.columns))


def _without(text: bytes | None, gone: list[int] | None) -> bytes | None:
    """A text without the lines of these hashes."""
    if text is None or not gone:
        return text
    lost = set(gone)
    return b"\n".join(x for x in text.split(b"\n")
                      if not (parts := x.split()) or xxh3_64_intdigest(b" ".join(parts).lower()) - (1 << 63) not in lost)
