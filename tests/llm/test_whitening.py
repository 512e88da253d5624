"""Whitening against numpy's eigendecomposition and exact integers."""

import math

import numpy as np
import pytest

from textwarden.llm import queries, whitening
from textwarden.llm.whitening import Spectrum, secular


@pytest.mark.parametrize("seed", range(30))
def test_secular_roots_and_vectors(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 40))
    d = np.sort(np.cumsum(rng.exponential(size=k) ** 3 + 1e-6))
    z, weight = rng.normal(size=k) * 10.0 ** rng.integers(-3, 3, k), float(rng.exponential()) + 1e-3
    values, turn = secular(d, z, weight)
    want = np.linalg.eigvalsh(np.diag(d) + weight * np.outer(z, z))
    assert np.allclose(values, want, rtol=1e-9, atol=1e-9 * want[-1])
    assert np.abs(turn.T @ turn - np.eye(k)).max() < 1e-12


def brute(x):
    x = np.asarray(x, float)
    off = x - x.mean(axis=0)
    return off.T @ off


@pytest.mark.parametrize("shape", [(1, 3), (5, 8), (200, 6), (300, 20)])
def test_updates_and_joins_keep_the_scatter(shape):
    rng = np.random.default_rng(shape[0])
    x = rng.integers(-50, 50, shape).astype(float)
    x[:, -1] = 7  # a constant dimension: deflated for ever
    parts = []
    for rows in np.array_split(x, 3):
        if len(rows):
            parts.append(Spectrum.empty(shape[1]))
            for r in rows:
                parts[-1].add(r)
    whole = parts[0]
    for p in parts[1:]:
        whole.join(p)
    assert whole.n == len(x) and np.allclose(whole.mean, x.mean(axis=0))
    scale = max(1.0, whole.values[-1])
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(shape[1])).max() < 1e-10
    assert np.abs(whole.vectors * whole.values @ whole.vectors.T - brute(x)).max() < 1e-9 * scale


def check(found, rows):
    """Results of ``whiten`` against plain arithmetic on the same (id, vector) rows."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [tuple(math.floor(256 * c) for c in v) for _, v in kept]
    fit = sorted(set(xs))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    cov = brute(fit) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(4, int((e > 1e-9 * e.sum()).sum()))
    assert len(found) == k * len(kept)
    got = {}
    for r in found:
        assert r.n == n and abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
        got.setdefault((r.id, r.component), []).append(r)
    for c in range(1, k + 1):
        want, have = [], []
        for i in {i for i, _ in kept}:
            mine = [x for (j, _), x in zip(kept, xs) if j == i]
            pairs = sorted((sum((n * a - s) ** 2 for a, s in zip(x, sums)),
                            (np.array(x) - np.array(sums) / n) @ u[:, c - 1] / math.sqrt(e[c - 1])) for x in mine)
            ours = sorted((r.deviation, r.whitened) for r in got[i, c])
            assert [p[0] for p in pairs] == [p[0] for p in ours]
            if len({p[0] for p in pairs}) == len(pairs):
                want += [p[1] for p in pairs]
                have += [p[1] for p in ours]
        want, have = np.array(want), np.array(have)
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-8 * max(1, np.abs(want).max())


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(60)]
    rows += [(3, rows[0][1]), (None, rows[1][1]), (90, None), (91, [1.0, None, 0.0, 0.0, 0.0]),
             (92, [float("nan")] * 5), (93, [float("inf")] + [0.0] * 4), (94, [-0.0] * 5), (94, [-1e-9] * 5)]
    short = [(95, [1.0, 2.0]), (96, [])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + short],
                                  "vec_id long, embedding array<double>, n int, whitened string").repartition(5)
    check(whitening.whiten(table).collect(), rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_no_spread_gives_no_rows(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(table).collect() == []


def test_fewer_components_than_asked(spark):
    table = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    assert sorted((r.id, r.component) for r in whitening.whiten(table).collect()) == [(i, 1) for i in range(6)]


def test_many_tasks_combine_in_a_tree(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(400)]
    fit = spark.createDataFrame([([int(256 * c) for c in v],) for _, v in rows], "x array<long>").repartition(40)
    s = whitening.decompose(fit, 3)
    assert s.n == 400
    want = brute([[int(256 * c) for c in v] for _, v in rows])
    assert np.abs(s.vectors * s.values @ s.vectors.T - want).max() < 1e-9 * s.values[-1]


def test_large_entries_stay_exact(spark):
    table = spark.createDataFrame([(i, [float((i * 7919 % 101) * 2 ** 11), float(i)]) for i in range(50)],
                                  "vec_id long, embedding array<double>")
    check(whitening.whiten(table).collect(), [(r.vec_id, r.embedding) for r in table.collect()])


def test_query_against_numpy(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    found = queries.op11_whitening(spark, data).withColumnRenamed("vec_id", "id").collect()
    check(found, rows)
