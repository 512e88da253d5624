"""Best-fit packing of token sequences, planned on the histogram of lengths.

Texts become token ids with an end mark and are cut only where they exceed the capacity. The
number of pieces of each length is all that the plan needs: best fit by falling length runs over
counts, so one step fills a whole run of equal sequences, and the plan's size depends on the
capacity, not on the documents. A planned slot is a rank within a length; pieces get such ranks in
bounded cells (counts of the cells give their offsets), so a length that a third of all pieces
share is ranked by many tasks.

Defined results: a null text is empty and has the end mark alone; rows that repeat an id, or have
none, are documents of their own; empty tables give no rows; input columns named like the added
ones are replaced; equal lengths take their slots in the order of the stored pieces.
"""

from __future__ import annotations

import functools
import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from textwarden.llm.common import map_batches, stored

#: tokens of a sequence, and the id that ends a document
CAPACITY = 4096
END = 1
#: pieces of one length that a task ranks, about
CELL_ROWS = 50_000
#: words whose ids a worker remembers between batches, and the longest of them in bytes
REMEMBERED, LONGEST = 400_000, 64
#: texts are encoded in groups of about this many characters
HELD_CHARS = 1 << 22
#: letters of two Latin blocks: letters in every version of Unicode, as are their small forms (all but U+0130)
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_OTHER = re.compile(f"[^\x00-\x7f{_LETTERS}]").search
_CHUNKS = re.compile("[^ \t\n\x0b\x0c\r]+").findall
#: the words of text that has no other characters, as the tokenizer finds them (fixed value: the vocabulary file's pattern)
_WORDS = re.compile(rf"[{_LETTERS}]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^ \t\n\x0b\x0c\r0-9{_LETTERS}]+").findall


class Encoder:
    """Token ids of texts by the tokenizers library, each distinct word encoded once.

    The tokenizer must lower the case, drop white space, never look across it and mark the ends of
    words, as that of ``word_bpe_49k.json`` does. Text of ASCII and Latin letters is cut into words
    here; the library takes other chunks between blanks whole, and texts with special tokens.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.loads(source)
        self.special = [t["content"] for t in model["added_tokens"]]
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in model["model"]["vocab"].items() if t.endswith(model["model"]["end_of_word_suffix"])]] = True
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: set[str], odd: set[str]) -> None:
        """Remember the ids of these words; plain ones are encoded by the hundred, as each ends in one mark."""
        plain, odd = list(words - odd), list(words & odd)
        groups = [plain[a:a + 500] for a in range(0, len(plain), 500)]
        for group, ids in zip(groups, self._library([" ".join(g) for g in groups])):
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.known.update(zip(group, [data[x:y] for x, y in zip(at, at[1:])]))
            else:
                odd += group
        self.known.update(zip(odd, (x.tobytes() for x in self._library(odd))))

    def _words(self, text: str, odd: set[str]) -> list[str]:
        """The words of a text; chunks that are not plain are noted."""
        if text.isascii() or not _OTHER(text):
            return _WORDS(text.lower())
        chunks = _CHUNKS(text)
        odd.update(filter(_OTHER, chunks))
        return list(chain.from_iterable([c] if c in odd else _WORDS(c.lower()) for c in chunks))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        odd: set[str] = set()
        split = [self._words(t, odd) for t in texts]
        wanted = set().union(*split)
        if len(self.known) > REMEMBERED:  # keep the words that this batch has again, frequent ones among them
            self.known = {w: self.known[w] for w in wanted.intersection(self.known)}
        new = wanted.difference(self.known)
        self._learn(new, odd)
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for i, ids in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = ids.tobytes()
        for w in [w for w in new if len(w) > LONGEST]:
            del self.known[w]
        return out


@functools.lru_cache(maxsize=1)
def encoder_of(source: str) -> Encoder:
    """The encoder of a Python worker, kept between its tasks."""
    return Encoder(source)


def _groups(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    group = np.cumsum(lengths) // HELD_CHARS
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
    yield from ((a, b) for a, b in zip(edges, edges[1:]) if a < b)


def pieces(documents: DataFrame, source: str, text_col: str = "text", capacity: int = CAPACITY, end: int = END
           ) -> DataFrame:
    """The other input columns plus (piece, start, length, ids): each document's tokens in pieces of the capacity.

    ``ids`` are the tokens as little-endian unsigned 32-bit numbers; ``source`` is the tokenizer's JSON.
    """
    added = ["piece", "start", "length", "ids"]
    keep = [c for c in documents.columns if c not in (text_col, *added)]
    packed = documents.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
                              F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"))
    shared = documents.sparkSession.sparkContext.broadcast(source)  # the vocabulary file, fixed size
    mark, width = np.array([end], "<u4").tobytes(), 4 * capacity

    def work(batches):
        encoder = encoder_of(shared.value)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _groups(np.fromiter(map(len, texts), np.int64, len(texts))):
                rows, number, cut = [], [], []
                for row, ids in enumerate(encoder.encode(texts[a:b]), a):
                    ids += mark
                    for k, at in enumerate(range(0, len(ids), width)):
                        rows.append(row)
                        number.append(k)
                        cut.append(ids[at:at + width])
                piece = np.array(number, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(rows)), pa.array(piece), pa.array(piece * capacity),
                     pa.array([len(x) // 4 for x in cut], pa.int64()), pa.array(cut, pa.binary())], ["_row", *added])

    schema = T.StructType([packed.schema["_row"], *(T.StructField(c, T.LongType()) for c in added[:3]),
                           T.StructField("ids", T.BinaryType())])
    out = map_batches(packed, work, schema)
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in keep), *added)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length its slots as (first rank, first sequence, pieces a sequence, offset), ranks ascending.

    Best fit by falling length. Sequences of equal free space are runs of consecutive numbers; a
    step gives a run as many pieces of one length as each of its sequences holds.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # space -> runs (first sequence, how many)
    spaces: list[int] = []
    opened = 0
    slots: dict[int, list[tuple[int, int, int, int]]] = {}

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a length must lie between 1 and {capacity}, not {length}")
        left, rank, out = counts[length], 0, slots.setdefault(length, [])
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space], spaces[at]
            else:
                space, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = space // length
            full = min(n, left // each)
            if full:
                out.append((rank, first, each, capacity - space))
                put(space - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and 0 < left < each:  # the last pieces leave a sequence of the run with more space than the others
                out.append((rank, first, each, capacity - space))
                put(space - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            put(space, first, n)
    return slots


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with a ``length`` plus (sequence_id, offset): their places in as few sequences as best fit finds."""
    keep = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    rows = stored(rows.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"))
                  .withColumn("_at", F.monotonically_increasing_id()), "pieces")
    length = F.col("_row.length").alias("_length")
    # one row per length, at most the capacity
    counts = {r["_length"]: r["count"] for r in rows.groupBy(length).count().collect()}
    spark = rows.sparkSession
    cells = spark.createDataFrame([(n, -(-c // CELL_ROWS)) for n, c in counts.items()], "_length long, _cells long")
    dealt = (rows.select("_row", "_at", length).join(F.broadcast(cells), "_length")
             .withColumn("_cell", F.pmod(F.xxhash64("_at"), "_cells")).drop("_cells"))
    own = Window.partitionBy("_length", "_cell").orderBy("_at")
    before = Window.partitionBy("_length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    # about one row per CELL_ROWS pieces
    offsets = (dealt.groupBy("_length", "_cell").count()
               .select("_length", "_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")))
    ranked = (dealt.withColumn("_rank", F.row_number().over(own) - 1).join(offsets, ["_length", "_cell"])
              .select("_row", "_length", (F.col("_rank") + F.col("_before")).alias("_rank")))
    slots = spark.sparkContext.broadcast({n: np.array(s, np.int64) for n, s in plan(counts, capacity).items()})

    def work(batches):
        for batch in batches:
            lengths, ranks = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                steps = slots.value[n]
                step = steps[np.searchsorted(steps[:, 0], ranks[at], side="right") - 1]
                into = ranks[at] - step[:, 0]
                sequence[at] = step[:, 1] + into // step[:, 2]
                offset[at] = step[:, 3] + into % step[:, 2] * n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence), pa.array(offset)],
                                             ["_row", "sequence_id", "offset"])

    schema = T.StructType([ranked.schema["_row"], T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    out = map_batches(ranked, work, schema)
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in keep), "sequence_id", "offset")


def pack(documents: DataFrame, source: str, text_col: str = "text", capacity: int = CAPACITY, end: int = END
         ) -> DataFrame:
    """The documents' pieces with their ids, sequence and offset."""
    return place(pieces(documents, source, text_col, capacity, end), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, none longer than the capacity."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.reduce(
        held, F.lit(b""), lambda all_, x: F.concat(all_, x["ids"])).alias("ids"))
