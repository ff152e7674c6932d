"""Embedding whitening by LOBPCG over distributed covariance products.

Entries become integers; the covariance V of the distinct vectors is never formed. What the iteration needs
is V times a block of directions: every task multiplies its centred rows with the block and back, and Spark
adds up the parts by dimension, so that the driver gets one dimension x block matrix however many rows there
are. Each round does the Rayleigh-Ritz step on the span of the iterate, its residuals and the previous
directions, all of them orthonormal, and with products of their own, so that rounding does not build up. It
ends when the residuals V q - e q of all wanted components, from a product made for that, are certified to
be small. The rows are then projected on the components and divided by the roots of the eigenvalues.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, map_arrow

COMPONENTS = 16
#: Directions beside the wanted ones: they speed up the last of these.
GUARD = 6
#: Entries are ``floor(SCALE * c) + OFFSET``.
SCALE, OFFSET = 64, 1_000_000
#: Certified residuals, as a share of the largest eigenvalue; and rounds before an error is raised.
TOLERANCE, ROUNDS = 1e-12, 500
#: Rows of a batch: 4,096 vectors of 1,000 entries take 32 MB.
ROWS = 4096
_LONG = 2**63


def gridded(vectors: DataFrame, embedding: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id`` and ``x``, the integer vector, of the rows whose vectors are sound.

    Left out are null vectors, empty ones, and those with null, not finite entries or entries beyond the grid
    of 64-bit integers.
    """
    entry = lambda c: F.lit(SCALE) * c.cast("double")
    sound = lambda c: F.coalesce(F.abs(entry(c)) < F.lit(2.0**62), F.lit(False))  # noqa: E731  false for null, NaN, infinite
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(embedding).alias("v")).filter((F.size("v") > 0) & F.forall("v", sound))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(entry(c)).cast("long") + OFFSET).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows' vectors, all of one length, as an int64 matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), -1)


@dataclass(frozen=True)
class Fit:
    """Distinct vectors, their number and the sums of each dimension."""

    rows: DataFrame
    n: int
    sums: tuple[int, ...]

    def centring(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole and fractional parts of the mean: the whole ones are taken off as integers, so that nothing is rounded away."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n / self.n for s in self.sums])


def fit_list(grid: DataFrame) -> Fit | None:
    """Each distinct vector once, written to the shared folder; None without rows.

    Of vectors of several lengths only those of the most frequent one count (the longest of equals).
    """
    lengths = grid.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    rows = cut(grid.filter(F.size("x") == lengths["d"]).select("x").distinct())
    sums = rows.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    return Fit(rows, sums[0]["n"], tuple(int(r["s"]) for r in sums))


def _summed(fit: Fit, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """1/n times the sum over tasks of ``part(centred rows)``, a matrix of ``width`` columns, added up by Spark row by row."""
    whole, rest = fit.centring()
    names = [f"c{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            found = part((_matrix(batch.column(0)) - whole) - rest)
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), *[pa.array(np.ascontiguousarray(c)) for c in total.T]], names=["i", *names])

    parts = map_arrow(fit.rows, run, "i long, " + ", ".join(f"{c} double" for c in names), rows=ROWS)
    found = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).orderBy("i").collect()
    return np.array([[r[c] for c in names] for r in found]) / fit.n


def product(fit: Fit, block: np.ndarray) -> np.ndarray:
    """V times the block (dimensions x directions): one pass over the fit list."""
    return _summed(fit, block.shape[1], lambda rows: rows.T @ (rows @ block))


def _orthonormal(block: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """The part of ``block`` that is orthogonal to ``against``, as orthonormal columns; dependent ones go."""
    for _ in range(2):  # the second time takes what rounding left
        for other in against:
            block = block - other @ (other.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8 * s[0]]
    return block


@dataclass(frozen=True)
class Components:
    """Eigenvalues (falling), unit eigenvectors as columns, the trace of V, the largest residual, and the rounds it took."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    rounds: int


def components(fit: Fit, wanted: int = COMPONENTS, tolerance: float = TOLERANCE, seed: int = 17) -> Components:
    """The leading eigenpairs of the fit list's covariance, by LOBPCG.

    Directions without variance are left out: eigenvalues within the tolerance of zero count as
    zero. Raises if the residuals cannot be certified in ROUNDS rounds.
    """
    d = len(fit.sums)
    m = min(d, wanted + GUARD)
    trace = float(_summed(fit, 1, lambda rows: np.array([[np.square(rows).sum()]]))[0, 0])
    if trace == 0:
        return Components(np.empty(0), np.empty((d, 0)), 0.0, 0.0, 0)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    ax, p = product(fit, x), np.empty((d, 0))
    certified, best = False, np.inf
    for done in range(ROUNDS):
        theta, c = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        theta, c = theta[::-1], c[:, ::-1]
        x, ax = x @ c, ax @ c
        residuals = ax - x * theta
        size = np.linalg.norm(residuals, axis=0)
        count = min(wanted, m)
        worst = size[:count].max() / theta[0]
        if worst <= tolerance and certified:
            kept = theta[:count] > tolerance * theta[0]
            return Components(theta[:count][kept], x[:, :count][:, kept], trace, float(worst), done)
        if certified := worst <= tolerance:  # once more from orthonormal vectors and a product of their own
            x = np.linalg.qr(x)[0]
            ax = product(fit, x)
            continue
        best = min(best, worst)
        w = _orthonormal(residuals[:, size > tolerance / 10 * theta[0]], [x])
        p = _orthonormal(p, [x, w])
        more = np.hstack([w, p])
        if not more.shape[1]:
            certified = False
            x = np.linalg.qr(x)[0]
            ax = product(fit, x)
            continue
        basis, image = np.hstack([x, more]), np.hstack([ax, product(fit, more)])
        values, c = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        c = c[:, ::-1][:, :m]
        p = more @ c[m:]
        x, ax = basis @ c, image @ c
    raise RuntimeError(f"LOBPCG: residuals stay at {best:.2e} of the largest eigenvalue after {ROUNDS} rounds")


def identity_error(fit: Fit, found: Components) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    scaled = found.vectors / np.sqrt(found.values)

    def part(rows: np.ndarray) -> np.ndarray:
        y = rows @ scaled
        return y.T @ y

    return float(np.abs(_summed(fit, len(found.values), part) - np.eye(len(found.values))).max())


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum over dimensions of (n x - S)^2 of each row, exactly; an error where it does not fit a long."""
    bound = float(np.abs(x.astype(np.float64) * n - sums.astype(np.float64)).max(initial=0)) + 1
    if float(np.abs(x).max(initial=0)) * n < 2**62 and bound**2 * x.shape[1] < 2**62:
        apart = x * n - sums.astype(np.int64)
        return np.einsum("ij,ij->i", apart, apart).tolist()
    apart = x.astype(object) * n - sums
    out = [int(v) for v in (apart * apart).sum(axis=1)]
    if any(v >= _LONG for v in out):
        raise OverflowError("a squared deviation does not fit 64 bits: there are too many or too distant vectors")
    return out


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, embedding: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per sound row of ``vectors`` and component: ``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``n`` counts the distinct vectors, ``deviation`` is the exact sum over dimensions of (n x - S)^2, ``whitened`` the centred
    vector on the component over the root of its eigenvalue, ``explained`` the component's share of the variance.

    Rows with a null vector, or with null, not finite or enormous entries have no result, nor have those whose
    length is not the most frequent one. A null key stays null; repeated rows have results of their own and count once in the
    fit. There are at most as many components as directions with variance: one distinct vector, or an
    empty table, gives an empty result. Other columns are ignored.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    grid = gridded(vectors, embedding, key)
    fit = fit_list(grid)
    found = components(fit, wanted) if fit else None
    if found is None or not len(found.values):
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums = fit.n, np.array(fit.sums, dtype=object)
    whole, rest = fit.centring()
    scaled, explained, error = found.vectors / np.sqrt(found.values), found.values / found.trace, identity_error(fit, found)
    k = len(explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            y = ((x - whole) - rest) @ scaled
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
            columns = [
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n, np.int64)),
                pa.array(np.repeat(np.array(_deviations(x, n, sums), np.int64), k)), pa.array(y.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = grid.filter(F.size("x") == len(fit.sums)).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    return map_arrow(rows, run, schema, rows=ROWS)
