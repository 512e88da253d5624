"""Byte-level BPE by a pair occurrence index.

The distinct pre-tokens of a batch are laid out as one array of symbols with links to the
neighbours. An index maps each mergeable adjacent pair to all its positions in the batch. The
active ranks are applied in ascending order from a heap: all occurrences of a pair merge at
once, and the lists of the pairs to the left and right are extended. In a vocabulary whose
tokens each come from one merge, a new pair never ranks below the merge that made it, so this
gives each pre-token the merges that it would get alone.

Defined results: a null text is empty and has no tokens; texts are encoded whole; the strings
of special tokens are tokens of their own, nothing is added, cut or padded; decoding keeps
special tokens and replaces invalid UTF-8. Columns named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from textwarden.llm.common import kept, map_batches

#: pre-token pattern of the byte-level vocabulary (fixed value)
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: a batch of texts is encoded when it holds this many characters
HELD_CHARS = 1 << 21
#: pre-tokens that a worker remembers between batches, but for those of the last one
REMEMBERED = 150_000
ADDED = ["n_tokens", "ids_sha256", "decoded_sha256"]


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the characters from 256 on.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class Vocabulary:
    """Merges and tokens of a byte-level BPE file, as arrays; a few MB for 50,000 tokens."""

    def __init__(self, source: str):
        model = json.loads(source)
        ids, merges = model["model"]["vocab"], model["model"]["merges"]
        letters = byte_characters()
        back = {c: b for b, c in enumerate(letters)}
        self.size = max(ids.values()) + 1
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.byte_ids = np.array([ids[c] for c in letters], np.int64)
        tokens = {i: bytes(back[c] for c in t) for t, i in ids.items()}
        tokens |= {i: t.encode() for t, i in self.special.items()}
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.left, self.right = left, right
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        made_at = dict(zip(self.made.tolist(), range(len(merges))))
        if len(made_at) < len(merges) or any(
                max(made_at.get(a, -1), made_at.get(b, -1)) >= r
                for r, (a, b) in enumerate(zip(left.tolist(), right.tolist()))):
            raise ValueError("each token must come from one merge, of tokens that were made before it")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for pairs that never merge."""
        pairs = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], -1)


class PairIndex:
    """Positions of every mergeable adjacent pair of a batch of pre-tokens, by rank."""

    def __init__(self, words: list[bytes], vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        self.word = np.repeat(np.arange(len(words)), lengths)
        self.symbol = vocabulary.byte_ids[raw]
        n = len(raw)
        at = np.arange(n, dtype=np.int64)
        same = np.append(self.word[1:] == self.word[:-1], False) if n else np.zeros(0, bool)
        self.next = np.where(same, at + 1, -1)
        self.prev = np.full(n, -1, np.int64)
        self.prev[1:][same[:-1]] = at[:-1][same[:-1]]
        self.lists: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self.add(np.flatnonzero(same))

    def add(self, at: np.ndarray) -> None:
        """List the pairs that begin at these positions under their ranks."""
        ranks = self.vocabulary.rank(self.symbol[at], self.symbol[self.next[at]])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        edges = np.flatnonzero(np.diff(ranks)) + 1
        for part, r in zip(np.split(at, edges), ranks[np.concatenate([[0], edges])].tolist()):
            if r not in self.lists:
                self.lists[r] = []
                heapq.heappush(self.heap, r)
            self.lists[r].append(part)

    def merge_all(self) -> None:
        symbol, next_, prev = self.symbol, self.next, self.prev
        left, right, made = self.vocabulary.left, self.vocabulary.right, self.vocabulary.made
        while self.heap:
            r = heapq.heappop(self.heap)
            parts = self.lists.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            a, b = left[r], right[r]
            at = at[symbol[at] == a]  # a position may have merged since it was listed
            at = at[next_[at] >= 0]
            at = at[symbol[next_[at]] == b]
            if a == b and len(at) > 1:
                at = self.alternate(np.unique(at))
            if not len(at):
                continue
            gone = next_[at]
            after = next_[gone]
            symbol[at] = made[r]
            symbol[gone] = -1
            next_[at] = after
            inner = after >= 0
            prev[after[inner]] = at[inner]
            before = prev[at]
            self.add(np.unique(np.concatenate([before[before >= 0], at[inner]])))

    def alternate(self, at: np.ndarray) -> np.ndarray:
        """Of overlapping occurrences in a run (aaaa), every other one from the left."""
        joined = np.concatenate([[False], self.next[at[:-1]] == at[1:]])
        index = np.arange(len(at))
        start = np.maximum.accumulate(np.where(joined, 0, index))
        return at[(index - start) % 2 == 0]

    def results(self, n_words: int) -> list[list[int]]:
        """The token ids of each pre-token."""
        live = self.symbol >= 0
        counts = np.bincount(self.word[live], minlength=n_words)
        ids, edges = self.symbol[live].tolist(), np.concatenate([[0], np.cumsum(counts)]).tolist()
        return [ids[x:y] for x, y in zip(edges, edges[1:])]


class Coder:
    """Encodes and decodes batches of texts; remembers a bounded number of pre-tokens.

    ``known`` maps a pre-token to its ids as comma-joined text, and their bytes.
    """

    def __init__(self, source: str):
        self.vocabulary = Vocabulary(source)
        self.decimal = list(map(str, range(len(self.vocabulary.tokens))))
        self.find = regex.compile(PATTERN).findall
        names = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.known: dict[str, tuple[str, bytes]] = {}

    def pretokens(self, text: str) -> list[str]:
        if self.special is None or self.special.search(text) is None:
            return self.find(text)
        out: list[str] = []
        for i, piece in enumerate(self.special.split(text)):
            out += [piece] if i % 2 else self.find(piece)
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the pre-tokens of these texts that are not known yet."""
        wanted = set().union(*texts)
        if len(self.known) > REMEMBERED:  # keep those that this batch has again, frequent ones among them
            self.known = {w: self.known[w] for w in wanted.intersection(self.known)}
        new = wanted.difference(self.known)
        special, tokens, decimal = self.vocabulary.special, self.vocabulary.tokens, self.decimal
        words = [w for w in new if w not in special]
        index = PairIndex([w.encode() for w in words], self.vocabulary)
        index.merge_all()
        found = index.results(len(words)) + [[special[w]] for w in new if w in special]
        words += [w for w in new if w in special]
        self.known.update({w: (",".join([decimal[i] for i in ids]), b"".join([tokens[i] for i in ids]))
                           for w, ids in zip(words, found)})

    def split(self, texts: list[str]) -> list[list[str]]:
        split = [self.pretokens(t) for t in texts]
        self.learn(split)
        return split

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(map(int, ",".join([self.known[w][0] for w in words]).split(","))) if words else []
                for words in self.split(texts)]

    def decode(self, ids: list[int]) -> str:
        tokens = self.vocabulary.tokens
        return b"".join([tokens[i] for i in ids]).decode("utf-8", "replace")


def coder_of(source: str) -> Coder:
    """The coder of a Python worker, kept between its encoding tasks."""
    return kept(Coder, source)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, by Spark's reader, so that any store serves."""
    return spark.read.text(path, wholetext=True).first()[0]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch of about HELD_CHARS bytes; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(0)), 0))
    group = np.cumsum(sizes) // HELD_CHARS
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(edges, edges[1:]) if a < b)


def coded(documents: DataFrame, source: str, text_col: str, columns: list[T.StructField], function,
          keep: list[str] | None = None) -> DataFrame:
    """Input columns (or those of ``keep``) plus ``columns``, whose values ``function(coder, texts)`` gives as lists."""
    added = [c.name for c in columns]
    keep = [c for c in (documents.columns if keep is None else keep) if c not in added]
    packed = documents.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
                              F.struct(*keep).alias("_row"))
    shared = documents.sparkSession.sparkContext.broadcast(source)  # the vocabulary file, fixed size

    def work(batches):
        coder = coder_of(shared.value)
        for batch in batches:
            for a, b in _slices(batch):
                texts = batch.column(0).slice(a, b - a).to_pylist()
                values = function(coder, texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(a, b - a), *(pa.array(v) for v in values)], ["_row", *added])
                del texts, values

    out = map_batches(packed, work, T.StructType([packed.schema["_row"], *columns]))
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in keep), *added)


def encode(documents: DataFrame, source: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The documents with the token ids of each whole text; ``source`` is the vocabulary's JSON."""
    return coded(documents, source, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))],
                 lambda coder, texts: [pa.array(coder.encode(texts), pa.list_(pa.int32()))])


def decode(encoded: DataFrame, source: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The texts of token ids; null ids give a null text."""
    keep = [c for c in encoded.columns if c != text_col]
    packed = encoded.select(F.col(ids_col).alias("_ids"), F.struct(*keep).alias("_row"))
    shared = encoded.sparkSession.sparkContext.broadcast(source)

    def work(batches):
        coder = coder_of(shared.value)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], ["_row", text_col])

    out = map_batches(packed, work, T.StructType([packed.schema["_row"], T.StructField(text_col, T.StringType())]))
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in keep), text_col)


def _digests(coder: Coder, texts: list[str]) -> list[list]:
    """Token count, digest of the ids and digest of the decoded text."""
    out: list[list] = [[], [], []]
    for words in coder.split(texts):
        own = [coder.known[w] for w in words]
        ids = ",".join([x[0] for x in own])
        text = b"".join([x[1] for x in own]).decode("utf-8", "replace")
        out[0].append(ids.count(",") + bool(ids))
        out[1].append(hashlib.sha256(ids.encode()).hexdigest())
        out[2].append(hashlib.sha256(text.encode()).hexdigest())
    return out


def digests(documents: DataFrame, source: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every document encoded and decoded: n_tokens, ids_sha256 (comma-joined), decoded_sha256.

    With ``keep``, only these input columns stay, and texts need not travel back from the workers.
    """
    return coded(documents, source, text_col,
                 [T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.StringType()) for c in ADDED[1:])],
                 _digests, keep)
