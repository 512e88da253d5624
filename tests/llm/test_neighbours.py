import numpy as np
from pyspark.sql import functions as F

from textwarden.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, id string, rank int"


def brute(rows, every, top):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v) or len(v) != 16:
            continue
        good[i] = max(good.get(i, v), v)
    ids = np.array(sorted(good))
    x = np.array([np.array(good[i], np.float32).astype(float) for i in ids])
    out = {}
    for k, i in enumerate(ids):
        if i % every == 0:
            s = x @ x[k]
            order = [j for j in np.lexsort((ids, -s)) if j != k][:top]
            out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_scores_order_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    near = rng.standard_normal(16)
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(rng.standard_normal((700, 16)))]
    rows += [(1000 + i, [float(y) for y in near + 0.01 * rng.standard_normal(16)]) for i in range(300)]
    rows += [(2000, rows[5][1]), (2001, rows[5][1]), (2020, None), (2040, [0.0] * 16), (2060, [float("nan")] * 16),
             (2080, [1.0] * 15 + [None]), (2100, [float("inf")] + [1.0] * 15), (2120, [1.0, 2.0]), (None, rows[0][1]),
             (0, rows[0][1]), (20, [9.0] * 16)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    got = {}
    for r in neighbours.search(df, 20, 10, block=128, tables=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 20, 10)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [x[0] for x in found] == list(range(1, 11))
        assert [(-x[2], x[1]) for x in found] == sorted((-x[2], x[1]) for x in found)
        hits += len({x[1] for x in found} & {x[0] for x in want[q]})
    assert hits >= 0.95 * 10 * len(want)
    exact = dict(want[40])
    assert all(abs(s - exact[v]) < 1e-9 for _, v, s in got[40] if v in exact)


def test_fewer_rows_than_asked_and_none(spark):
    rows = [(i * 20, [float(i == k) + 1 for k in range(4)], "x", 1) for i in range(5)]
    out = neighbours.search(spark.createDataFrame(rows, SCHEMA), 20, 20).collect()
    assert len(out) == 20 and all(r.vec_id != r.query_id for r in out)
    assert neighbours.search(spark.createDataFrame([], SCHEMA), 20, 20).count() == 0
    assert neighbours.search(spark.createDataFrame(rows[:1], SCHEMA), 20, 20).count() == 0


def recall(spark, rows, every, top, **options):
    """(share of the right ids, ids by query, right ids by query)."""
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    got, want = {}, {q: [i for i, _ in found] for q, found in brute(rows, every, top).items()}
    for r in neighbours.search(df, every, top, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want)
    share = sum(len(set(got[q]) & set(want[q])) for q in want) / (top * len(want))
    return share, got, want


def test_recall_beside_one_row_of_huge_norm(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(rng.standard_normal((700, 16)))]
    rows.append((5001, [1e8 * y for y in rows[3][1]]))
    share = recall(spark, rows, 20, 10, block=128, tables=4)[0]
    assert share >= 0.95, share


def test_groups_of_equal_vectors_larger_than_a_block(spark):
    rng = np.random.default_rng(4)
    same, short = rng.standard_normal((2, 16))
    rows = []
    for i in range(1200):
        v = (same, 0.25 * short, rng.standard_normal(16))[i % 3]
        rows.append((i * 7919 % 1200, [float(y) for y in v]))
    share, got, want = recall(spark, rows, 30, 10, block=64, tables=4, rounds=1, beam=16, steps=6)
    assert share >= 0.95, share
    equal = {i for i, v in rows if v[0] == float(same[0])}
    whole = [q for q in want if q in equal and set(want[q]) <= equal]
    assert whole and all(got[q] == want[q] for q in whole)
