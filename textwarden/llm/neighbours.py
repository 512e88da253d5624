"""Approximate nearest neighbours by NN-descent and greedy graph search, for the inner product.

The neighbour graph starts from blocks of vectors that are near in ``TABLES`` random hyperplane
orders. Each round of NN-descent brings the sampled neighbours and reverse neighbours of every
vector together by Spark joins, compares them with each other, and keeps the nearest ``DEGREE``
of each: neighbours of neighbours become neighbours. A query walks the graph greedily: it
repeatedly expands the best ``BEAM`` vectors that it has not expanded yet, until none is left
among its best. Graph and walk use copies in single precision, each with a scale of its own, and
compute in double precision, so neither a vector's size nor that of the others costs it digits;
the scores of the result are computed on the original vectors, ``REFINED`` times as many as asked.

Equal vectors are one node, the smallest of their ids, with as many of their smallest ids as a
query can return; graph and walk see distinct vectors only, and the winners become ids at the end.

All vectors are indexed. No group exceeds a block or twice the sample; a vector that is
everybody's neighbour meets its neighbours in a bounded sample, as in the method, and its
joins are salted. Defined results: vectors that are null, zero, hold nulls or non-finite
numbers, or have another length than most, take no part; null ids take no part; of rows that
repeat an id the largest vector counts; equal scores order by the smaller id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from textwarden.llm.common import map_batches, salted_join, shared_folder, stored

DEGREE, TABLES, BLOCK = 32, 12, 1024
ROUNDS, SAMPLE = 3, 16
BEAM, STEPS, REFINED = 96, 12, 3
_PLANES = 16
_GRAPH = "id long, ids array<long>, scores array<double>"
_LONGS, _DOUBLES = pa.list_(pa.int64()), pa.list_(pa.float64())


def _matrix(vecs: list[bytes]) -> np.ndarray:
    """The vectors of packed copies, as doubles."""
    raw = np.frombuffer(b"".join(vecs), np.uint8).reshape(len(vecs), -1)
    return raw[:, 8:].copy().view(np.float32) * raw[:, :8].copy().view(np.float64)


def _best(ids: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` best distinct ids, best first, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:most]
    return ids[first], scores[first]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vector) as doubles, of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
    sound = ("id IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) "
             "AND abs(x) < double('infinity')) AND exists(vector, x -> x <> 0)")
    rows = rows.filter(sound).groupBy("id").agg(F.max("vector").alias("vector"))
    rows = stored(rows, "vectors")
    row = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (row.n if row else 0))


def _distinct(rows: DataFrame, most: int) -> DataFrame:
    """(id, vector, ids): each distinct vector with its ``most`` smallest ids, the first of them as its id."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))  # limited in each task before the shuffle
    groups = rows.withColumn("n", rank).filter(F.col("n") <= most).groupBy("vector").agg(
        F.sort_array(F.collect_list("id")).alias("ids"))
    return stored(groups.select(F.col("ids")[0].alias("id"), "vector", "ids"), "distinct-vectors")


def _packed(rows: DataFrame) -> DataFrame:
    """(id, vec): a scale in double precision, then the vector over it in single precision.

    The scale is a power of two near the vector's largest component, so vectors that were in
    single precision lose nothing.
    """
    def work(batches):
        for batch in batches:
            out = []
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                scale = np.ldexp(1.0, np.frexp(np.abs(x).max(axis=1))[1] - 1)
                out = [a.tobytes() + b.tobytes() for a, b in zip(scale, (x / scale[:, None]).astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "vec"])

    return stored(map_batches(rows, work, "id long, vec binary"), "packed-vectors")


def _merged(lists: DataFrame, degree: int) -> DataFrame:
    """Rows of (id, ids, scores) combined to the best ``degree`` of each id."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def done(out):
            ids, scores = _best(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), degree)
            out.append((last, ids, scores))

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                               pa.array([x[1] for x in out], _LONGS),
                                               pa.array([x[2] for x in out], _DOUBLES)], ["id", "ids", "scores"])

        for batch in batches:
            out = []
            for id_, ids, scores in zip(*(c.to_pylist() for c in batch.columns)):
                if id_ != last:
                    if held:
                        done(out)
                    last, held = id_, []
                held.append((np.array(ids, np.int64), np.array(scores, np.float64)))
                if len(held) > 64:
                    held = [_best(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), degree)]
            yield rows(out)
        if held:
            out = []
            done(out)
            yield rows(out)

    return map_batches(lists.repartition("id").sortWithinPartitions("id"), work, _GRAPH)


def _blocks(packed: DataFrame, n: int, degree: int, tables: int, block: int) -> DataFrame:
    """The first graph: the best of each vector within its block of every table."""
    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1).to_pylist())
            for t in range(tables):
                y = x @ np.random.default_rng(t).standard_normal((x.shape[1], _PLANES))
                code = (y[:, :-1] > 0) @ (1 << np.arange(_PLANES - 2, -1, -1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int32)),
                     pa.array(y[:, -1]), *batch.columns], ["table", "code", "place", "id", "vec"])

    def compare(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows >= 2 * block:
                yield from best(held.slice(0, block))
                held = held.slice(block)
        if held is not None and held.num_rows:
            half = held.num_rows // 2 if held.num_rows > block else held.num_rows
            yield from best(held.slice(0, half))
            yield from best(held.slice(half))

    def best(rows):
        table, ids = np.asarray(rows.column("table")), np.asarray(rows.column("id"))
        for t in np.unique(table):
            at = np.flatnonzero(table == t)
            if len(at) < 2:
                continue
            x = _matrix(rows.column("vec").take(pa.array(at)).to_pylist())
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            k = min(degree, len(at) - 1)
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at]), pa.array(list(ids[at][near]), _LONGS),
                 pa.array(list(np.take_along_axis(s, near, 1)), _DOUBLES)], ["id", "ids", "scores"])

    parts = max(8, -(-n * tables // (block * 8)))
    placed = (map_batches(packed, place, "table int, code int, place double, id long, vec binary")
              .repartitionByRange(parts, "table", "code", "place").sortWithinPartitions("table", "code", "place", "id"))
    return map_batches(placed, compare, _GRAPH)


def _descend(graph: DataFrame, packed: DataFrame, round_: int, sample: int) -> DataFrame:
    """One round: (id, ids, scores) of the neighbours' neighbours that beat the worst neighbour of each."""
    edges = graph.select(F.col("id").alias("u"), F.explode(F.expr(
        f"slice(transform(array_sort(transform(ids, v -> named_struct('h', xxhash64(id, v, {round_}), 'v', v))), x -> x.v), "
        f"1, {sample})")).alias("v"))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    chance = Window.partitionBy("u").orderBy(F.xxhash64("u", "v", F.lit(round_)), "v")
    drawn = both.withColumn("n", F.row_number().over(chance)).filter(F.col("n") <= 2 * sample).drop("n")
    nodes = packed.join(graph.select("id", F.element_at("scores", -1).alias("worst")), "id").withColumnRenamed("id", "v")
    groups = salted_join(drawn, nodes, ["v"], F.col("u"), salts=4)

    def work(batches):
        last, held = None, []

        def compare(rows):
            ids = np.array([r[0] for r in rows], np.int64)
            x = _matrix([r[1] for r in rows])
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            good = s > np.array([r[2] for r in rows])[:, None]
            return [(ids[i], ids[good[i]], s[i][good[i]]) for i in np.flatnonzero(good.any(axis=1))]

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                               pa.array([x[1] for x in out], _LONGS),
                                               pa.array([x[2] for x in out], _DOUBLES)], ["id", "ids", "scores"])

        for batch in batches:
            out = []
            for u, v, vec, worst in zip(*(c.to_pylist() for c in batch.columns)):
                if u != last:
                    if len(held) > 1:
                        out += compare(held)
                    last, held = u, []
                held.append((v, vec, worst))
            yield rows(out)
        if len(held) > 1:
            yield rows(compare(held))

    return map_batches(groups.select("u", "v", "vec", "worst").repartition("u").sortWithinPartitions("u", "v"),
                       work, _GRAPH)


def build_graph(packed: DataFrame, n: int, degree: int = DEGREE, tables: int = TABLES, block: int = BLOCK,
                rounds: int = ROUNDS, sample: int = SAMPLE) -> DataFrame:
    """(id, ids, scores): the approximate nearest neighbours of every vector, nearest first."""
    graph = stored(_merged(_blocks(packed, n, degree, tables, block), degree), "graph")
    for k in range(rounds):
        graph = stored(_merged(graph.unionByName(_descend(graph, packed, k, sample)), degree), "graph")
    return graph


def _adjacent(graph: DataFrame, packed: DataFrame, n: int) -> tuple[DataFrame, str]:
    """(node, ids, vecs) with the neighbours' vectors at hand, bucketed by node so that steps need not move it."""
    edges = graph.select(F.col("id").alias("node"), F.explode("ids").alias("v"))
    joined = salted_join(edges, packed.withColumnRenamed("id", "v"), ["v"], F.col("node"), salts=4)
    lists = (joined.groupBy("node").agg(F.collect_list(F.struct("v", "vec")).alias("near"))
              .select("node", F.expr("transform(near, x -> x.v)").alias("ids"),
                      F.expr("transform(near, x -> x.vec)").alias("vecs")))
    name = f"adjacent_{uuid.uuid4().hex}"
    buckets = max(16, -(-n // BLOCK))
    (lists.repartition(buckets, "node").write.bucketBy(buckets, "node")
     .option("path", shared_folder(graph.sparkSession, "adjacent")).saveAsTable(name))
    return graph.sparkSession.table(name), name


_STATE = "q long, vec binary, ids array<long>, scores array<double>, done array<boolean>, todo array<long>"


def _advance(rows: DataFrame, beam: int, pool: int) -> DataFrame:
    """Combine each query's pool with newly met vectors and choose what to expand next."""
    def work(batches):
        last, held, vec, expanded = None, [], None, set()

        def done(out):
            ids, scores = _best(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), pool)
            keep = ids != last  # a query is not its own candidate
            ids, scores = ids[keep], scores[keep]
            todo = [i for i in ids.tolist() if i not in expanded][:beam]
            ready = expanded | set(todo)
            out.append((last, vec, ids, scores, [i in ready for i in ids.tolist()], todo))

        def table(out):
            kinds = (pa.int64(), pa.binary(), _LONGS, _DOUBLES, pa.list_(pa.bool_()), _LONGS)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)],
                                              ["q", "vec", "ids", "scores", "done", "todo"])

        for batch in batches:
            out = []
            for q, own, ids, scores, flags in zip(*(c.to_pylist() for c in batch.columns)):
                if q != last:
                    if held:
                        done(out)
                    last, held, vec, expanded = q, [], None, set()
                held.append((np.array(ids, np.int64), np.array(scores, np.float64)))
                if own is not None:
                    vec, expanded = own, {i for i, f in zip(ids, flags) if f}
            yield table(out)
        if held:
            out = []
            done(out)
            yield table(out)

    return map_batches(rows.select("q", "vec", "ids", "scores", "done").repartition("q").sortWithinPartitions("q"),
                       work, _STATE)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, ids, scores) of the neighbours of an expanded vector that beat the query's floor."""
    for batch in batches:
        out = []
        for q, vec, floor, ids, vecs in zip(*(c.to_pylist() for c in batch.columns)):
            s = _matrix(vecs) @ _matrix([vec])[0]
            good = s > floor
            out.append((q, np.array(ids, np.int64)[good], s[good]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.nulls(len(out), pa.binary()),
             pa.array([x[1] for x in out], _LONGS), pa.array([x[2] for x in out], _DOUBLES),
             pa.nulls(len(out), pa.list_(pa.bool_()))], ["q", "vec", "ids", "scores", "done"])


def search(vectors: DataFrame, every: int, top: int, id_col: str = "vec_id", vec_col: str = "embedding",
           beam: int = BEAM, steps: int = STEPS, **graph_options) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of each row whose id is divisible by ``every``."""
    rows = usable(vectors, id_col, vec_col)
    nodes = _distinct(rows, top + 1)
    packed = _packed(nodes)
    n = packed.count()
    graph = build_graph(packed, n, **graph_options)
    near, name = _adjacent(graph, packed, n)
    pool = 3 * beam
    asked = stored(salted_join(rows.filter(F.col("id") % every == 0), nodes.select("vector", F.col("id").alias("q")),
                               ["vector"], F.col("id")).select(F.col("id").alias("query_id"), "q"), "queries")
    queries = packed.join(asked.select(F.col("q").alias("id")).distinct(), "id")
    first = (queries.join(graph, "id", "left")
             .select(F.col("id").alias("q"), "vec", F.coalesce("ids", F.array().cast("array<long>")).alias("ids"),
                     F.coalesce("scores", F.array().cast("array<float>")).alias("scores"))
             .withColumn("done", F.expr("transform(ids, x -> false)")))
    state = stored(_advance(first, beam, pool), "walk")
    for _ in range(steps):
        if state.filter("size(todo) > 0").isEmpty():
            break
        floor = F.when(F.size("scores") >= pool, F.element_at("scores", -1)).otherwise(F.lit(float("-inf")))
        frontier = state.select("q", "vec", floor.cast("double").alias("floor"), F.explode("todo").alias("node"))
        met = map_batches(frontier.join(near, "node").select("q", "vec", "floor", "ids", "vecs"), _expand,
                          "q long, vec binary, ids array<long>, scores array<double>, done array<boolean>")
        state = stored(_advance(state.drop("todo").unionByName(met), beam, pool), "walk")
    # a query's equals are its candidates too
    found = state.select("q", F.explode(F.concat(F.array("q"), F.slice("ids", 1, REFINED * top))).alias("node"))
    joined = salted_join(found, nodes.withColumnRenamed("id", "node"), ["node"], F.col("q"), salts=4)
    joined = joined.join(nodes.select(F.col("id").alias("q"), F.col("vector").alias("other")), "q")
    scored = joined.select("q", "node", "ids", F.expr(
        "aggregate(zip_with(vector, other, (x, y) -> x * y), 0D, (a, x) -> a + x)").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "node")
    best = scored.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top + 1)
    # one more than asked, as a query is among the ids itself
    lists = best.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.expr(
        "transform(ids, i -> struct(-score AS low, i AS vec_id, score AS score))")))), 1, top + 1).alias("found"))
    results = salted_join(asked, lists, ["q"], F.col("query_id"))
    results = results.select("query_id", F.posexplode(F.slice(F.expr(
        "filter(found, x -> x.vec_id <> query_id)"), 1, top)).alias("at", "hit"))
    out = stored(results.select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score"), "nearest")
    graph.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    return out
