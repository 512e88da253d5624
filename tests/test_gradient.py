"""The classifier's passes and minimiser against plain numpy."""

import numpy as np
import pytest

from textwarden.operators import gradient
from textwarden.operators.training import C


def plain(x, y, s):
    """Newton's method to the last digit on dense features; the intercept is free."""
    a = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([1 / C] * x.shape[1] + [0.0])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve((a * (s * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (s * (p - y)) + ridge @ w)
        w = w - step
    return w


def weights(y):
    return np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y == 0).sum()))


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 12)) * (rng.random((160, 12)) < 0.5)
    y = (x[:, 0] - x[:, 1] + rng.normal(size=160) > 0.4).astype(int)
    fold = np.arange(160) % 5
    table = [(int(y[i]), int(fold[i]), np.flatnonzero(x[i]).tolist(), x[i][x[i] != 0].tolist()) for i in range(160)]
    return spark.createDataFrame(table, "label int, fold int, positions array<int>, values array<double>").repartition(7), x, y, fold


def test_models_equal_a_plain_solver(rows):
    df, x, y, fold = rows
    models = gradient.minimise(gradient.Passes(df, 12), tolerance=1e-9)
    for m in range(6):
        own = fold != m
        assert np.abs(models[m] - plain(x[own], y[own], weights(y[own]))).max() < 1e-6


def test_gradient_is_the_slope_of_the_loss(rows):
    df = rows[0]
    passes = gradient.Passes(df, 12)
    at = np.tile(np.linspace(-1, 1, 13), (6, 1))
    loss, slope = passes(at)
    for i in (0, 5, 12):
        moved = at.copy()
        moved[:, i] += 1e-6
        assert np.abs((passes(moved)[0] - loss) / 1e-6 - slope[:, i]).max() < 1e-3


def test_predictions_use_the_model_that_left_the_fold_out(rows, spark):
    df, x, y, fold = rows
    models = np.arange(6 * 13, dtype=float).reshape(6, 13) / 100
    found = gradient.predicted(df.unionByName(spark.createDataFrame([(1, None, [], [])], df.schema)), models).collect()
    assert len(found) == 161
    by_fold = {}
    for r in found:
        by_fold.setdefault(r.fold, []).append(r.margin)
    for f in range(5):
        want = x[fold == f] @ models[f, :-1] + models[f, -1]
        assert np.allclose(sorted(by_fold[f]), sorted(want))
    assert by_fold[None] == [models[5, -1]]


def test_one_class_or_no_rows(spark):
    schema = "label int, fold int, positions array<int>, values array<double>"
    one = spark.createDataFrame([(1, 0, [0], [1.0]), (1, 1, [], []), (None, 0, [0], [1.0])], schema)
    models = gradient.minimise(gradient.Passes(one, 2), iterations=20)
    assert models.shape == (6, 3) and np.isfinite(models).all() and models[5, -1] > 0
    none = gradient.minimise(gradient.Passes(spark.createDataFrame([], schema), 2))
    assert (none == 0).all()


def test_vocabulary_and_features(spark):
    docs = spark.createDataFrame([(1, "ab ab"), (2, "b"), (3, "")], "id int, text string")
    counts = gradient.gram_counts(docs, "id")
    terms = gradient.inverse_frequencies(gradient.vocabulary(counts, 4), 3).orderBy("position").collect()
    assert [(r.term, r.occurrences, r.df) for r in terms] == [(" ", 6, 2), (" a", 2, 1), ("b", 3, 2), ("b ", 3, 2)]
    listed = gradient.inverse_frequencies(gradient.vocabulary(counts, 4), 3)
    rows = {r.id: r for r in gradient.features(docs, counts, listed, "id").collect()}
    assert rows[3].positions == [] and rows[1].positions == [0, 1, 2, 3] and abs(sum(v * v for v in rows[1].values) - 1) < 1e-12
