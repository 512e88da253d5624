"""The text classifier as tables: vocabulary, inverse frequencies, features, and gradient passes.

Words are counted per document, and grams only cut from distinct words; the vocabulary is a top list
of bounded length, and a document's features are one row. A pass over the features gives loss and
gradient of several models at once: the model of the whole training part and those that leave out
one fold each read the same rows. Tasks add up in place and send one row of numbers; the minimiser
works on these sums and never sees a document.

Documents without a known gram have no features and count with their label; null labels are left out.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textwarden.operators import grams
from textwarden.operators.training import C, FOLDS, MAX_ITERATIONS, MAX_TERMS
from textwarden.sources.workers import map_batches

#: correction pairs of the minimiser
PAIRS = 10
#: rows of partial sums that come to the driver, at most
PARTIALS = 16


def gram_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, words, times): the words of each document and how often each occurs, which tells the counts of all its grams."""
    # one shuffle by key serves both groupings
    each = docs.select(key, text).repartition(key).select(key, F.explode(F.expr(grams.words(text))).alias("word"))
    counted = each.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).agg(F.collect_list(F.struct("word", "n")).alias("c")).select(
        key, F.col("c.word").alias("words"), F.col("c.n").alias("times"))


def vocabulary(counts: DataFrame, top: int = MAX_TERMS) -> DataFrame:
    """(term, occurrences, df, position): the grams that occur most, ties by code point, numbered from 0 by term."""
    spark = counts.sparkSession
    each = counts.select(F.explode(F.arrays_zip("words", "times")).alias("c")).groupBy(F.col("c.words").alias("word")).agg(F.sum("c.times").alias("n"))
    # at most ``top`` rows from here on
    found = sorted((r.gram, r.n) for r in grams.of_words(each, "n").orderBy(F.desc("n"), "gram").limit(top).collect())
    holding = grams.known_counts(counts.select("words", "times"), [t for t, _ in found], times="times")
    df = dict(holding.select(F.explode("positions").alias("p")).groupBy("p").count().collect())
    return spark.createDataFrame([(t, n, df[i], i) for i, (t, n) in enumerate(found)], "term string, occurrences bigint, df bigint, position int")


def inverse_frequencies(terms: DataFrame, documents: int) -> DataFrame:
    """The vocabulary with the smoothed ``idf``."""
    return terms.withColumn("idf", F.log((F.lit(1.0) + documents) / (F.lit(1.0) + F.col("df"))) + 1)


def features(docs: DataFrame, counts: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """The documents' other columns with ``positions`` and ``values``: TF-IDF of unit length."""
    listed = terms.select("term", "idf").orderBy("position").collect()  # bounded by the vocabulary
    found = grams.known_counts(counts, [r.term for r in listed], times="times", weights=[r.idf for r in listed])
    rows = found.selectExpr(key, "positions", "tfs", "sqrt(aggregate(tfs, 0D, (a, v) -> a + v * v)) AS norm")
    return docs.join(rows, key, "left").selectExpr(
        *docs.columns, "coalesce(positions, cast(array() AS array<int>)) AS positions",
        "coalesce(transform(tfs, v -> v / norm), cast(array() AS array<double>)) AS values")


class Passes:
    """Loss and gradient of models over features (label, fold, positions, values), in one pass for all models.

    Model ``m`` of 0 to ``folds - 1`` leaves out the rows of fold ``m``, the last model leaves out none.
    The loss is the logistic one with classes of equal weight, plus ``|w|^2 / (2 C)``; a model is its
    coefficients and the intercept, which the penalty leaves free.
    """

    def __init__(self, rows: DataFrame, terms: int, folds: int = FOLDS):
        self.terms, self.folds = terms, folds
        self.rows = rows.select(F.col("label").cast("double").alias("label"), F.coalesce("fold", F.lit(-1)).alias("fold"),
                                "positions", "values").filter("label IS NOT NULL")
        # one row per fold and label
        counts = {(r.fold, int(r.label)): r["count"] for r in self.rows.groupBy("fold", "label").count().collect()}
        self.weights = np.ones((folds + 1, 2))
        for m in range(folds + 1):
            own = [sum(n for (f, y), n in counts.items() if y == label and f != m) for label in (0, 1)]
            self.weights[m] = [sum(own) / (2 * n) if n else 0.0 for n in own]

    def __call__(self, models: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(loss by model, gradient by model) at these models."""
        spark, size, weights, folds = self.rows.sparkSession, self.terms + 1, self.weights, self.folds
        shared = spark.sparkContext.broadcast(models)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(models), size + 1))
            for batch in batches:
                _add(total, batch, shared.value, weights, folds)
            yield _partial(total)

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(models) * (size + 1))
            for batch in batches:
                for row in batch.column(0):
                    total += np.frombuffer(row.as_buffer())
            yield _partial(total)

        parts = map_batches(map_batches(self.rows, work, "part binary").coalesce(PARTIALS), gather, "part binary").collect()
        shared.unpersist()
        total = sum((np.frombuffer(r.part) for r in parts), np.zeros(len(models) * (size + 1))).reshape(len(models), size + 1)
        loss, gradient = total[:, -1].copy(), total[:, :-1].copy()
        loss += (models[:, :-1] ** 2).sum(axis=1) / (2 * C)
        gradient[:, :-1] += models[:, :-1] / C
        return loss, gradient


def _partial(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])


def _add(total: np.ndarray, batch: pa.RecordBatch, models: np.ndarray, weights: np.ndarray, folds: int) -> None:
    """Add a batch's gradients and losses to the running sums, one row per model."""
    label, fold = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    lengths = np.diff(np.asarray(batch.column(2).offsets))
    position, value = np.asarray(batch.column(2).flatten()).astype(np.int64), np.asarray(batch.column(3).flatten())
    row = np.repeat(np.arange(len(label)), lengths)
    for m, model in enumerate(models):
        margin = np.bincount(row, model[position] * value, len(label)) + model[-1]
        weight = np.where(label > 0, weights[m, 1], weights[m, 0]) * ((fold != m) | (m == folds))
        off = weight * (1 / (1 + np.exp(-np.clip(margin, -700, 700))) - label)
        total[m, :-2] += np.bincount(position, value * off[row], total.shape[1] - 2)
        total[m, -2] += off.sum()
        total[m, -1] += (weight * np.logaddexp(0, np.where(label > 0, -margin, margin))).sum()


def _minimiser(size: int, tolerance: float, iterations: int) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory BFGS as a coroutine: yields points, is sent (loss, gradient), returns the minimum."""
    x = np.zeros(size)
    loss, gradient = yield x
    moves, turns = [], []
    for _ in range(iterations):
        if np.abs(gradient).max() <= tolerance:
            break
        step, kept = -gradient, []
        for s, y in zip(reversed(moves), reversed(turns)):
            a = (s @ step) / (s @ y)
            kept.append(a)
            step = step - a * y
        if moves:
            step = step * (moves[-1] @ turns[-1]) / (turns[-1] @ turns[-1])
        else:
            step = step / max(1.0, np.sqrt(gradient @ gradient))
        for s, y, a in zip(moves, turns, reversed(kept)):
            step = step + (a - (y @ step) / (s @ y)) * s
        slope, length, low, high = gradient @ step, 1.0, 0.0, np.inf
        for _ in range(30):  # a length that lowers the loss and flattens the slope enough
            new = x + length * step
            new_loss, new_gradient = yield new
            if new_loss > loss + 1e-4 * length * slope + 1e-12 * abs(loss):
                high = length
            elif new_gradient @ step < 0.9 * slope:
                low = length
            else:
                break
            length = (low + high) / 2 if np.isfinite(high) else 2 * length
        moved, turned = new - x, new_gradient - gradient
        x, loss, gradient = new, new_loss, new_gradient
        if moved @ turned > 1e-14 * (turned @ turned):
            moves, turns = [*moves, moved][-PAIRS:], [*turns, turned][-PAIRS:]
    return x


def minimise(passes: Passes, tolerance: float = 1e-4, iterations: int = MAX_ITERATIONS) -> np.ndarray:
    """The models of all folds and of the whole, each step of all of them in one pass."""
    count, size = passes.folds + 1, passes.terms + 1
    searches = [_minimiser(size, tolerance, iterations) for _ in range(count)]
    points = np.array([next(s) for s in searches])
    done: dict[int, np.ndarray] = {}
    while len(done) < count:
        losses, gradients = passes(points)
        for m, search in enumerate(searches):
            if m not in done:
                try:
                    points[m] = search.send((float(losses[m]), gradients[m]))
                except StopIteration as end:
                    done[m] = points[m] = end.value
    return points


def predicted(rows: DataFrame, models: np.ndarray, folds: int = FOLDS) -> DataFrame:
    """Feature rows with ``margin``, ``probability`` and ``prediction``: of the model that left out their fold, or of the whole."""
    columns = [c for c in rows.columns if c not in ("positions", "values")]
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.asarray(batch.column(1).fill_null(folds))
            lengths = np.diff(np.asarray(batch.column(2).offsets))
            row = np.repeat(np.arange(len(fold)), lengths)
            position = np.asarray(batch.column(2).flatten()).astype(np.int64)
            terms = shared.value[fold[row], position] * np.asarray(batch.column(3).flatten())
            margin = np.bincount(row, terms, len(fold)) + shared.value[fold, -1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(margin)], ["row", "margin"])

    packed = rows.select(F.struct(*columns).alias("row"), F.col("fold").cast("int").alias("fold"), "positions", "values")
    schema = f"row {packed.schema['row'].dataType.simpleString()}, margin double"
    out = map_batches(packed, work, schema).select("row.*", "margin")
    return out.withColumn("probability", 1 / (1 + F.exp(-F.col("margin")))).withColumn("prediction", (F.col("margin") > 0).cast("int"))
