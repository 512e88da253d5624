"""Ranked lexical search over an inverted index: short lists term by term, long lists document by document.

Every task turns its documents into shards: a table of document lengths and one list of postings per
term, written as a table, so no text is shuffled. A search joins the terms of its items with the
lists, takes their document frequencies from the lists' sizes, and deals the lists of a shard with
the items in blocks. Within a shard the short lists of an item are added up at once (term at a
time); the sums, ordered by document, become one more list with a known maximum. Windows of
documents whose bounds cannot reach an item's twentieth score so far are skipped; in the others,
candidates come from the lists that could lift a document above it, and the rest are only looked
up for these (document at a time). The best of all shards meet in two steps.

Defined results: null texts have no terms; such documents and items are neither counted nor found.
Repeated documents or items are each searched and found on their own; documents without an id count
in the statistics and are never returned; an item without an id is ranked under a null one. Equal
scores rank by ascending id. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from textwarden.llm.common import map_batches, salted_join, stored

TOP = 20
#: a task closes a shard when it holds this many terms
HELD = 1 << 19
#: items of a block, and shards that a task goes through for a block
BLOCK, SHARDS = 256, 8
#: texts that are taken out of a batch at a time
TEXTS = 512
#: documents of a window
WINDOW = 128
#: lists that together have at most one posting for this many documents of a shard are added up first
SHORT = 8
#: windows that are scored together
TOGETHER = 8
#: most distinct terms of all items that are broadcast; beyond, they are joined by shuffle
BROADCAST_TERMS = 500_000
#: bytes that belong to terms stay, A-Z in lower case; all others separate
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_INDEX = "shard long, term binary, n long, total long, a binary, b binary"


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(TERM_BYTES).split()


class _Codes(dict):
    """Numbers for terms in the order of their first occurrence."""

    def __missing__(self, term: bytes) -> int:
        self[term] = code = len(self)
        return code


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """Slices of a number array as binary values."""
    width = values.itemsize
    offsets = (np.concatenate([[0], ends]) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _shard(number: int, ids: list, codes: list[np.ndarray], vocabulary: _Codes) -> Iterator[pa.RecordBatch]:
    """A row with the ids and lengths of the documents, a row per term with documents (as steps) and counts."""
    names = ["shard", "term", "n", "total", "a", "b"]
    lengths = np.array([len(c) for c in codes], np.int64)
    known = np.array([i is not None for i in ids])
    own = np.array([i or 0 for i in ids], np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([None], pa.binary()), pa.array([len(ids)]), pa.array([int(lengths.sum())]),
         pa.array([own.tobytes()]), pa.array([np.where(known, lengths, -lengths).tobytes()])], names)
    key = np.concatenate(codes) * len(ids) + np.repeat(np.arange(len(ids)), lengths)
    codes.clear()
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(first, append=len(key))
    key = key[first]
    code, doc = np.divmod(key, len(ids))
    del key, first
    steps = np.diff(doc, prepend=0)
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    steps[starts] = doc[starts]
    ends = np.append(starts[1:], len(code))
    words = list(vocabulary)  # codes ascend in the order of insertion
    steps, times = steps.astype(np.uint32), times.astype(np.uint32)
    del code, doc
    for at in range(0, len(starts), 10_000):
        part = slice(at, at + 10_000)
        low, high = starts[part][0], ends[part][-1]
        n = ends[part] - starts[part]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), number)), pa.array(words[part], pa.binary()), pa.array(n), pa.nulls(len(n), pa.int64()),
             _lists(ends[part] - low, steps[low:high]), _lists(ends[part] - low, times[low:high])], names)


def index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored inverted index; a row without a term describes the documents of a shard."""
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")
                             ).filter("text IS NOT NULL")

    def work(batches):
        number = TaskContext.get().partitionId() << 32
        ids, codes, vocabulary, held = [], [], _Codes(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                for doc, text in zip(*(c.to_pylist() for c in whole.slice(at, TEXTS).columns)):
                    found = terms(text)
                    if not found:
                        continue
                    ids.append(doc)
                    codes.append(np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found)))
                    held += len(found)
                    if held >= HELD:
                        yield from _shard(number, ids, codes, vocabulary)
                        number += 1
                        ids, codes, vocabulary, held = [], [], _Codes(), 0
        if ids:
            yield from _shard(number, ids, codes, vocabulary)

    return stored(map_batches(texts, work, _INDEX), "lexical-index")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query, item_id, term, times): every row of the items is a query of its own."""
    texts = items.select(F.col(id_col).cast("long").alias("item_id"),
                         F.col(text_col).cast("string").cast("binary").alias("text")).filter("text IS NOT NULL")

    def work(batches):
        for batch in batches:
            for query, item, text in zip(*(c.to_pylist() for c in batch.columns)):
                own: dict[bytes, int] = {}
                for t in terms(text):
                    own[t] = own.get(t, 0) + 1
                m = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([query] * m, pa.int64()), pa.array([item] * m, pa.int64()), pa.array(own, pa.binary()),
                     pa.array(own.values(), pa.int64())], ["query", "item_id", "term", "times"])

    numbered = texts.withColumn("query", F.monotonically_increasing_id()).select("query", "item_id", "text")
    return stored(map_batches(numbered, work, "query long, item_id long, term binary, times long"), "item-terms")


class _List:
    """Postings of a term within a shard: documents ascending, their scores at weight one, bounds by window."""

    def __init__(self, steps: bytes, times: bytes, spread: np.ndarray):
        self.docs = np.cumsum(np.frombuffer(steps, np.uint32).astype(np.int64))
        tf = np.frombuffer(times, np.uint32).astype(np.int64)
        self.scores = (1_000_000_000 * tf) // (1000 * tf + 12 * spread[self.docs])
        self.most = int(self.scores.max())
        self.bounds = _bounds(self.docs, self.scores, len(spread))


def _bounds(docs: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """The largest score in each window of documents."""
    out = np.zeros(-(-n // WINDOW), np.int64)
    if len(docs):
        window = docs // WINDOW
        starts = np.flatnonzero(np.diff(window, prepend=-1))
        out[window[starts]] = np.maximum.reduceat(scores, starts)
    return out


def _summed(docs: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents ascending, each with the sum of its scores."""
    if not len(docs):
        return docs, scores
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], scores[order]
    starts = np.flatnonzero(np.diff(docs, prepend=-1))
    return docs[starts], np.add.reduceat(scores, starts)


def _looked_up(docs: np.ndarray, scores: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The score of each wanted document, 0 where it has none."""
    at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
    return np.where(docs[at] == wanted, scores[at], 0)


class _Best:
    """The best documents of a query so far, highest first, equal scores by ascending id."""

    def __init__(self, gains: list[tuple[bytes, int]], top: int):
        self.gains, self.top = gains, top
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def bar(self) -> int:
        """The least score that can still be taken."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def take(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.bar
        ids, scores = np.concatenate([self.ids, ids[good]]), np.concatenate([self.scores, scores[good]])
        order = np.lexsort((ids, -scores))[:self.top]
        self.ids, self.scores = ids[order], scores[order]


def search_shard(best: _Best, ids: np.ndarray, open_: np.ndarray, lists: dict[bytes, _List]) -> None:
    """Let a query's best documents take those of a shard; ``open_`` marks the documents that may be returned."""
    own = sorted(((len(lists[t].docs), t, gain) for t, gain in best.gains if gain > 0 and t in lists))
    n, held, short = len(ids), 0, 0
    while short < len(own) and held + own[short][0] <= n // SHORT:
        held += own[short][0]
        short += 1
    # term at a time: one list of sums
    if short:
        docs, sums = _summed(np.concatenate([lists[t].docs for _, t, _ in own[:short]]),
                             np.concatenate([lists[t].scores * gain for _, t, gain in own[:short]]))
        parts = [(docs, sums, int(sums.max()), _bounds(docs, sums, n))]
    else:
        parts = []
    parts += [(x.docs, x.scores * gain, x.most * gain, x.bounds * gain) for x, gain in ((lists[t], g) for _, t, g in own[short:])]
    if not parts:
        return
    bounds = np.sum([p[3] for p in parts], axis=0)
    # sums of the short lists alone already bound the twentieth score from below
    bar = best.bar
    if short:
        sums = parts[0][1][open_[parts[0][0]]]
        if len(sums) >= best.top:
            bar = max(bar, int(np.partition(sums, -best.top)[-best.top]))
    order = np.argsort(-bounds, kind="stable")
    for at in range(0, len(order), TOGETHER):
        windows = order[at:at + TOGETHER]
        windows = np.sort(windows[bounds[windows] >= bar])
        if not len(windows):
            break
        # lists that cannot lift a document to the bar by themselves need no candidates
        most = [int(p[3][windows].max()) for p in parts]
        falling = sorted(range(len(parts)), key=lambda i: most[i])
        rest, passive = 0, set()
        for i in falling:
            rest += most[i]
            if rest >= bar:
                break
            passive.add(i)
        docs_found, scores_found = [], []
        for i, (docs, scores, _, _) in enumerate(parts):
            if i not in passive:
                low, high = np.searchsorted(docs, windows * WINDOW), np.searchsorted(docs, (windows + 1) * WINDOW)
                docs_found += [docs[a:b] for a, b in zip(low, high) if a < b]
                scores_found += [scores[a:b] for a, b in zip(low, high) if a < b]
        if not docs_found:
            continue
        docs, scores = _summed(np.concatenate(docs_found), np.concatenate(scores_found))
        for i in sorted(passive, key=lambda i: -most[i]):
            hopeful = scores + rest_of(most, passive, i) >= bar
            docs, scores = docs[hopeful], scores[hopeful]
            if not len(docs):
                break
            scores = scores + _looked_up(parts[i][0], parts[i][1], docs)
        good = open_[docs]
        best.take(ids[docs[good]], scores[good])
        bar = max(bar, best.bar)


def rest_of(most: list[int], passive: set[int], i: int) -> int:
    """What the passive lists from ``i`` on, in falling order, can still add."""
    return sum(most[j] for j in passive if (most[j], -j) <= (most[i], -i))


def _searched(n_documents: int, n_terms: int, top: int):
    """Rows sorted by (block, part, shard, kind): queries of a cell first, then each shard's documents and lists."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, shard, ids, lengths, lists = None, {}, None, None, None, {}

        def close_shard():
            if shard is not None and lists:
                for best in queries.values():
                    search_shard(best, ids, lengths > 0, lists)

        def results():
            for query, best in queries.items():
                m = len(best.ids)
                if m:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([query] * m, pa.int64()), pa.array([cell[1]] * m, pa.int64()), pa.array(best.ids),
                         pa.array(best.scores)], ["query", "part", "doc_id", "score"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                block, part, at, kind, term, a, b, names, gains = row
                if (block, part) != cell:
                    close_shard()
                    yield from results()
                    cell, queries, shard, lists = (block, part), {}, None, {}
                if kind == 0:
                    queries[-1 - at] = _Best(list(zip(names, gains)), top)
                    continue
                if at != shard:
                    close_shard()
                    shard, lists = at, {}
                if kind == 1:
                    ids, lengths = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                    spread = 75 + (25 * np.abs(lengths) * n_documents) // n_terms
                else:
                    lists[term] = _List(a, b, spread)
        close_shard()
        yield from results()

    return work


def search(items: DataFrame, shards: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of an index for every item."""
    asked = item_terms(items, id_col, text_col)
    totals = shards.filter("term IS NULL").agg(F.count(F.lit(1)), F.sum("n"), F.sum("total")).first()
    n_shards, n_documents, n_terms = totals[0], totals[1] or 0, totals[2] or 1
    n_queries = asked.select("query").distinct().count()
    blocks = max(1, -(-n_queries // BLOCK))
    parts = max(1, -(-n_shards // SHARDS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    wanted = asked.groupBy("term").agg(F.collect_set("block").alias("blocks"))
    lists = shards.filter("term IS NOT NULL")
    if wanted.count() <= BROADCAST_TERMS:
        hits = lists.join(F.broadcast(wanted), "term")
    else:
        hits = salted_join(lists, wanted, ["term"], F.col("shard"))
    hits = stored(hits.select("shard", "term", "n", "a", "b", "blocks"), "item-lists")
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_documents + 2) / (2 * F.sum("n") + 1)))
    weights = hits.groupBy("term").agg(weight.alias("weight"))
    weighed = (asked.join(weights, "term").groupBy("block", "query")
               .agg(F.sort_array(F.collect_list(F.struct("term", (F.col("weight") * F.col("times")).alias("gain")))).alias("own")))
    part = F.pmod(F.xxhash64("shard"), F.lit(parts)).alias("part")
    nothing = F.lit(None)
    no_names, no_gains = nothing.cast("array<binary>").alias("names"), nothing.cast("array<long>").alias("gains")
    rows = (
        weighed.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"),
                       (-1 - F.col("query")).alias("shard"), F.lit(0).alias("kind"), nothing.cast("binary").alias("term"),
                       nothing.cast("binary").alias("a"), nothing.cast("binary").alias("b"),
                       F.col("own.term").alias("names"), F.col("own.gain").alias("gains"))
        .unionByName(shards.filter("term IS NULL").select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), part, "shard",
            F.lit(1).alias("kind"), "term", "a", "b", no_names, no_gains))
        .unionByName(hits.select(F.explode("blocks").alias("block"), part, "shard", F.lit(2).alias("kind"), "term", "a", "b",
                                 no_names, no_gains)))
    rows = rows.repartition(2 * blocks * parts, "block", "part").sortWithinPartitions("block", "part", "shard", "kind")
    found = map_batches(rows, _searched(n_documents, n_terms, top), "query long, part long, doc_id long, score long")
    ranked = found
    for keys in (["query", F.expr("part div 256")], ["query"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    named = asked.select("query", "item_id").distinct()
    return ranked.join(named, "query").select("item_id", "rank", "doc_id", "score")
