"""Whitening of embeddings by an incremental eigendecomposition.

Vectors become integers (``floor(256 c)``), and each distinct one counts once. Every task keeps the
mean, eigenvalues and eigenvectors of the vectors it has met; a further vector is a centred rank-one
update: the secular equation gives the new eigenvalues, entries that it cannot move are deflated,
and eigenvectors come from weights recomputed for the found roots, so they stay orthogonal. Spectra
of tasks combine in a tree, the eigenvectors of one being rank-one updates of the other. A last
pass measures the covariance in the basis so found (Rayleigh-Ritz), which makes the result exact to
double precision whatever the updates have lost. Sums and deviations are integers.

Defined results: vectors that are null or hold null or non-finite entries are dropped; so are those
of another length than the most frequent one (the longer of equally frequent), and empty ones. Rows
without an id and rows that repeat one have results of their own. Components whose eigenvalue is
zero (fewer distinct vectors than dimensions) have no rows, so a table of one distinct vector, or an
empty one, gives none. Entries of 2^45 or more raise an error, as do deviations beyond a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from textwarden.llm.common import map_batches, ship, stored

SCALE = 256
COMPONENTS = 4
#: spectra or sums that one task combines
FAN = 16
#: halvings of a root's interval; the last pass needs no more
HALVINGS = 40
_EPS = np.finfo(float).eps
_SPECTRUM = "id long, n long, mean array<double>, eigenvalues array<double>, eigenvectors array<double>"
_MATRIX = "id long, entries array<double>"


@dataclass
class Spectrum:
    """Mean and eigendecomposition of the scatter of ``n`` vectors; eigenvalues ascend."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def add(self, x: np.ndarray) -> None:
        """One more vector: scatter grows by n / (n + 1) times the square of its distance from the mean."""
        off = x - self.mean
        if self.n:
            self.rank_one(off, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + off / self.n

    def join(self, other: Spectrum) -> None:
        """The spectrum of both sets: one update for each eigenvector, one for the distance of the means."""
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.rank_one(vector, value)
        total = self.n + other.n
        off = other.mean - self.mean
        self.rank_one(off, self.n * other.n / total)
        self.mean = self.mean + off * (other.n / total)
        self.n = total

    def rank_one(self, x: np.ndarray, weight: float) -> None:
        """The eigendecomposition after adding ``weight * outer(x, x)``."""
        z = x @ self.vectors
        norm = float(np.sqrt(z @ z))
        if weight * norm * norm == 0:
            return
        least = 8 * _EPS * max(self.values[-1], weight * norm * norm)
        edges = np.flatnonzero(np.diff(self.values) > least) + 1
        if len(edges) + 1 < len(z):  # equal eigenvalues: turn their space until one axis holds all of z
            for a, b in zip([0, *edges], [*edges, len(z)]):
                if b - a > 1:
                    self._reflect(z, a, b)
        moved = np.flatnonzero(weight * norm * np.abs(z) > least)
        if len(moved):
            values, turn = secular(self.values[moved], z[moved], weight)
            self.values[moved] = values
            self.vectors[:, moved] = self.vectors[:, moved] @ turn
            order = np.argsort(self.values, kind="stable")
            self.values, self.vectors = self.values[order], self.vectors[:, order]

    def _reflect(self, z: np.ndarray, a: int, b: int) -> None:
        axis = z[a:b].copy()
        length = -np.copysign(np.sqrt(axis @ axis), axis[-1])
        axis[-1] -= length
        square = axis @ axis
        if square > 0:
            part = self.vectors[:, a:b]
            part -= np.outer(part @ axis, axis * (2 / square))
            z[a:b] = 0
            z[b - 1] = length


def secular(d: np.ndarray, z: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of ``diag(d) + weight * outer(z, z)``, d ascending and apart, z not zero.

    A root lies between each two entries of d, the last one above all. It is sought as its distance
    from the nearer entry, so that differences to the entries keep their digits.
    """
    squares = weight * z * z
    top = squares.sum()
    gap = np.append(np.diff(d), top)
    middle = 1 + (squares / (d - (d + gap / 2)[:, None])).sum(axis=1)
    right = middle < 0
    right[-1] = False
    origin = np.where(right, np.append(d[1:], d[-1]), d)
    off = d - origin[:, None]
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, gap / 2)
    if middle[-1] < 0:
        low[-1], high[-1] = gap[-1] / 2, gap[-1]
    for _ in range(HALVINGS):
        at = (low + high) / 2
        above = 1 + (1 / (off - at[:, None])) @ squares > 0
        high = np.where(above, at, high)
        low = np.where(above, low, at)
    found = (low + high) / 2
    apart = found[:, None] - off  # root i minus entry j
    # weights for which these roots are exact
    between = d[:, None] - d
    lower = np.tril(np.ones_like(between, bool), -1)
    ratio = np.ones_like(apart)
    k = len(d)
    if k > 1:
        shifted = between[1:, :]  # entry i + 1 minus entry j
        below = lower.T[:-1, :]  # i < j
        ratio[:-1] = apart[:-1] / np.where(below, between[:-1], shifted)
    exact = np.sqrt(np.maximum(ratio.prod(axis=0) * apart[-1] / weight, 0))
    turn = (np.copysign(exact, z) / -apart).T
    turn /= np.sqrt((turn * turn).sum(axis=0))
    return origin + found, turn


def integer_vectors(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows that take part, all of one length."""
    raw = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = raw.filter(F.col("v").isNotNull() & (F.size("v") > 0)
                       & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    entry = lambda c: F.when(F.abs(c) < 2.0 ** 45, F.floor(c * SCALE)).otherwise(
        F.raise_error(F.lit("an entry of a vector is too large to whiten")).cast("long"))
    return whole.select("id", F.transform("v", entry).alias("x"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The vectors of a batch with one column, as rows."""
    return np.asarray(batch.column(0).flatten()).reshape(-1, d)


def _tree(partials: DataFrame, schema: str, combine: Callable[[pd.DataFrame], pd.DataFrame], name: str):
    """The one row left when rows are combined by FAN until no others remain; None of an empty table."""
    ship(partials.sparkSession)
    while True:
        partials = stored(partials, name)
        rows = partials.limit(2).collect()
        if len(rows) < 2:
            return rows[0] if rows else None
        group = F.expr(f"id div {FAN}")
        partials = partials.groupBy(group).applyInPandas(combine, schema)


def _numbered() -> int:
    return TaskContext.get().partitionId()


def decompose(fit: DataFrame, d: int) -> Spectrum | None:
    """The spectrum of the scatter of all rows of ``fit`` (x)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(d)
        for batch in batches:
            for x in _matrix(batch, d).astype(float):
                own.add(x)
        if own.n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([_numbered()], pa.int64()), pa.array([own.n], pa.int64()),
                 *(pa.array([a.ravel().tolist()], pa.list_(pa.float64())) for a in (own.mean, own.values, own.vectors))],
                ["id", "n", "mean", "eigenvalues", "eigenvectors"])

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        # a numbered copy of what the tasks found; at most FAN rows of d * d numbers
        rows = rows.sort_values(["n", "id"], ascending=[False, True], kind="stable")
        spectra = [_spectrum(r) for r in rows.itertuples()]
        for other in spectra[1:]:
            spectra[0].join(other)
        s = spectra[0]
        return pd.DataFrame({"id": [int(rows["id"].min()) // FAN], "n": [s.n], "mean": [s.mean.tolist()],
                             "eigenvalues": [s.values.tolist()], "eigenvectors": [s.vectors.ravel().tolist()]})

    row = _tree(map_batches(fit.select("x"), work, _SPECTRUM), _SPECTRUM, combine, "spectra")
    return None if row is None else _spectrum(row)


def _spectrum(row) -> Spectrum:
    d = len(row.mean)
    return Spectrum(int(row.n), np.array(row.mean, float), np.array(row.eigenvalues, float),
                    np.array(row.eigenvectors, float).reshape(d, d))


def scatter(fit: DataFrame, centre: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum of the outer squares of the centred vectors, seen in a basis (columns)."""
    d, k = basis.shape

    def work(batches):
        total = np.zeros((k, k))
        for batch in batches:
            seen = (_matrix(batch, d) - centre) @ basis
            total += seen.T @ seen
        yield pa.RecordBatch.from_arrays([pa.array([_numbered()], pa.int64()),
                                          pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["id", "entries"])

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(rows.sort_values("id")["entries"].to_list()), axis=0)
        return pd.DataFrame({"id": [int(rows["id"].min()) // FAN], "entries": [total.tolist()]})

    return np.array(_tree(map_batches(fit.select("x"), work, _MATRIX), _MATRIX, combine, "scatter").entries).reshape(k, k)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Exact number of rows and sums by dimension; tasks add up in Python's integers where longs could overflow."""
    def work(batches):
        n, sums = 0, [0] * d
        for batch in batches:
            x = _matrix(batch, d)
            if not len(x):
                continue
            n += len(x)
            safe = int(np.abs(x).max()) < 2 ** 62 // len(x)
            sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0) if safe else x.astype(object).sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, d), pa.int32()), pa.array([str(n), *map(str, sums)])], ["pos", "part"])

    totals = {r.pos: int(r.total) for r in map_batches(fit.select("x"), work, "pos int, part string").groupBy("pos")
              .agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()}  # one row per dimension
    return totals.get(-1, 0), [totals.get(i, 0) for i in range(d)]


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
           ) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each row and component."""
    spark = embeddings.sparkSession
    rows = stored(integer_vectors(embeddings, id_col, vector_col), "integer-vectors")
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    d = length.d
    rows = rows.filter(F.size("x") == d)
    fit = stored(rows.select("x").distinct(), "distinct-vectors")
    n, sums = _sums(fit, d)
    centre = np.array([s / n for s in sums])
    rough = decompose(fit, d)
    basis = np.linalg.qr(rough.vectors)[0]
    small = scatter(fit, centre, basis) / n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    trace = values.sum()
    k = int((values[:components] > 8 * d * _EPS * trace).sum()) if trace > 0 else 0
    if not k:
        return spark.createDataFrame([], schema)
    axes = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(axis=0), range(k)])
    scaled = axes / np.sqrt(values[:k])
    error = float(np.abs(scatter(fit, centre, scaled) / n - np.eye(k)).max())
    explained = values[:k] / trace
    total = np.array(sums, object)
    bound = max(map(abs, sums))

    def work(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, d)
            if not len(x):
                continue
            largest = n * int(np.abs(x).max()) + bound
            whole = x if d * largest * largest < 2 ** 63 else x.astype(object)
            off = n * whole - (total.astype(np.int64) if whole is x else total)
            deviation = (off * off).sum(axis=1)
            seen = (x - centre) @ scaled
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, n, np.int64)), pa.array(np.repeat(deviation, k).tolist(), pa.int64()),
                 pa.array(seen.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_batches(rows, work, schema)
