"""Embedding whitening by incremental eigendecomposition.

1. Every partition keeps the eigendecomposition of the scatter matrix of its rows (sum of centred outer products) and
   follows each row by one centred rank-one update: the new eigenvalues are the roots of the secular equation
   1 + rho * sum(z_i^2 / (d_i - lambda)) = 0, after deflation of zero weights and equal eigenvalues; eigenvectors come
   from the weights for which the computed roots are exact (Gu and Eisenstat), so they are orthogonal to rounding.
   Equal rows of a batch are one update with a weight.
2. The spectra of partitions are combined in a tree, eight at a time: the second's eigenpairs and the difference of the
   means go into the first by successive rank-one updates.  A spectrum has dims^2 numbers, whatever the rows.
3. Rayleigh-Ritz: the leading ``components + oversample`` vectors span a subspace; one distributed pass gives the
   covariance applied to it, a small eigenproblem the Ritz pairs.  While a residual is above ``tolerance`` times the
   trace, the pass is repeated on the covariance times the subspace.

Rows whose vector is null, empty, or holds a null or non-finite entry are dropped, and so are vectors of another length
than the most frequent one (the longer of two equally frequent ones): they are no points of the same space.  An entry c
becomes floor(scale * c) + offset; beyond +-2^62 it becomes that bound.  Repeated rows and equal vectors all count.  A
component without variance (eigenvalue at rounding level of the trace) does not exist: one row, or equal rows only, have
no component and so no output.  No rows give no output.  A null id is kept.  Only the id and the vector are read; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stage, unstage

EPS = np.finfo(float).eps
FAN_IN = 8
STATE = "part long, n long, sums array<string>, mean array<double>, spectrum array<double>, basis binary"


# ------------------------------------------------------------- rank-one updates
def _secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Root j of 1/rho + sum(z2 / (d - x)) in (d[j], d[j+1]), the last one up to d[-1] + rho * sum(z2).

    Returns the nearest pole's index and the offset from it, which keeps differences to poles accurate.
    """
    k = len(d)
    upper = np.append(d[1:], d[-1] + rho * z2.sum())
    width = upper - d
    left = np.tril(np.ones((k, k), dtype=bool)).T  # left[i, j]: pole i at or below root j
    middle = 1 / rho + (z2[:, None] / (d[:, None] - (d + width / 2))).sum(0)
    near = np.arange(k)
    near[:-1] += middle[:-1] < 0
    origin, flipped = d[near], near > np.arange(k)  # flipped: the pole above is the nearest
    below, right = np.where(flipped, -width, 0.0), np.where(flipped, 0.0, width)  # both poles, seen from the origin
    lo, hi = np.where(flipped, -width / 2, 0.0), np.where(flipped, 0.0, width / 2)
    hi[-1] = width[-1]
    x = (lo + hi) / 2
    gaps = d[:, None] - origin
    for _ in range(80):
        delta = gaps - x
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            term = z2[:, None] / delta
            slope = term / delta
            w = 1 / rho + term.sum(0)
            bound = 1 / rho + np.abs(term).sum(0)
            up = w < 0
            lo, hi = np.where(up, x, lo), np.where(up, hi, x)
            psi = (slope * left).sum(0)
            phi = slope.sum(0) - psi
            a, b = below - x, right - x
            c = w - a * psi - b * phi
            p, q = (a + b) * w - a * b * (psi + phi), a * b * w
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            y = x + step
        done = (np.abs(w) <= k * EPS * bound) | (hi - lo <= 2 * EPS * np.abs(x))
        if done.all():
            break
        y = np.where(np.isfinite(y) & (y > lo) & (y < hi), y, (lo + hi) / 2)
        x = np.where(done, x, y)
    return near, x


def rank_one(d: np.ndarray, basis: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``basis @ diag(d) @ basis.T + rho * outer(v, v)``; d ascending, rho positive."""
    z = v @ basis
    norm2 = float(z @ z)
    if not norm2 > 0:
        return d, basis
    tol = 8 * EPS * max(abs(d[-1]), abs(d[0]), rho * norm2)
    # equal eigenvalues: turn their vectors so that one of them takes the whole weight
    alive = np.flatnonzero(rho * np.sqrt(norm2) * np.abs(z) > tol)
    if len(alive) == 0:
        return d, basis
    if (np.diff(d[alive]) <= tol).any():
        basis, z, start = basis.copy(), z.copy(), 0
        while start < len(alive):
            end = start + 1
            while end < len(alive) and d[alive[end]] - d[alive[start]] <= tol:
                end += 1
            if end - start > 1:
                at = alive[start:end]
                u = z[at].copy()
                size = np.sqrt(u @ u)
                u[-1] += size if u[-1] >= 0 else -size
                z[at], z[at[-1]] = 0.0, -size if u[-1] >= 0 else size
                basis[:, at] -= np.outer(basis[:, at] @ u, u * (2 / (u @ u)))
            start = end
        alive = np.flatnonzero(rho * np.sqrt(norm2) * np.abs(z) > tol)
    poles, w = d[alive], z[alive]
    near, x = _secular_roots(poles, w * w, rho)
    differ = (poles[:, None] - poles[near]) - x  # poles[i] - root[j], without cancellation
    spread = poles[:, None] - poles
    # weights that make the computed roots exact
    np.fill_diagonal(spread, -1.0)
    k = len(poles)
    ratio = differ / np.where(np.eye(k, dtype=bool), -1.0, spread)
    weights = np.sqrt(np.abs(ratio.prod(1))) * np.where(w < 0, -1.0, 1.0)
    turn = weights[:, None] / differ
    turn /= np.sqrt((turn * turn).sum(0))
    if len(alive) == len(d):
        out_d, out = poles[near] + x, basis @ turn
    else:
        out_d, out = d.copy(), basis.copy()
        out_d[alive], out[:, alive] = poles[near] + x, basis[:, alive] @ turn
    order = np.argsort(out_d, kind="stable")
    if (order[1:] < order[:-1]).any():
        out_d, out = out_d[order], out[:, order]
    return out_d, out


class Spectrum:
    """Count, mean and eigendecomposition of the scatter matrix of the rows seen so far."""

    def __init__(self, dims: int):
        self.n, self.mean, self.d, self.basis = 0, np.zeros(dims), np.zeros(dims), np.eye(dims)

    def add(self, row: np.ndarray, weight: int) -> None:
        """``weight`` equal rows: one centred rank-one update."""
        step, total = row - self.mean, self.n + weight
        if self.n:
            self.d, self.basis = rank_one(self.d, self.basis, step, self.n * weight / total)
        self.mean, self.n = self.mean + step * (weight / total), total

    def merge(self, other: Spectrum) -> None:
        """The other's eigenpairs and the difference of the means, one after the other."""
        if not other.n:
            return
        step, total = other.mean - self.mean, self.n + other.n
        if self.n:
            self.d, self.basis = rank_one(self.d, self.basis, step, self.n * other.n / total)
            for value, vector in zip(other.d[::-1], other.basis.T[::-1]):
                if value > EPS * other.d[-1]:
                    self.d, self.basis = rank_one(self.d, self.basis, vector, value)
        else:
            self.d, self.basis = other.d, other.basis
        self.mean, self.n = self.mean + step * (other.n / total), total


# -------------------------------------------------------------------- whole numbers
def _sums(x: np.ndarray) -> list[int]:
    """Exact column sums of a batch of longs."""
    small = not len(x) or np.abs(x).max() < 1 << 40
    return [int(s) for s in (x if small else x.astype(object)).sum(0)]


def _row_of(state: Spectrum, sums: list[int], part: int) -> dict:
    return {"part": part, "n": state.n, "sums": [str(s) for s in sums], "mean": state.mean, "spectrum": state.d,
            "basis": np.ascontiguousarray(state.basis).tobytes()}


def _state_of(row) -> tuple[Spectrum, list[int]]:
    out = Spectrum(len(row.mean))
    out.n, out.mean, out.d = int(row.n), np.array(row.mean), np.array(row.spectrum)
    out.basis = np.frombuffer(row.basis).reshape(len(out.d), len(out.d)).copy()
    return out, [int(s) for s in row.sums]


# ------------------------------------------------------------------------ the passes
def quantised(vector: Column, scale: int, offset: int) -> Column:
    """Longs floor(scale * c) + offset, within +-2^62."""
    bound = float(2 ** 62)
    return F.transform(vector, lambda c: F.greatest(F.lit(-bound), F.least(F.lit(bound), F.floor(c.cast("double") * scale)
                                                                           .cast("double"))).cast("long") + F.lit(offset))


def _clean(vectors: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> tuple[DataFrame, int]:
    """(id, x) of the usable rows, and their number of dimensions."""
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~bad).select(F.col(f"`{id_col}`").alias("id"), v.alias("v"))
    most = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if most is None:
        return rows.select("id", quantised(F.col("v"), scale, offset).alias("x")), 0
    return rows.where(F.size("v") == most.dims).select("id", quantised(F.col("v"), scale, offset).alias("x")), most.dims


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["x"].to_numpy()).astype(np.int64)


def _spectra(rows: DataFrame, dims: int, offset: int) -> DataFrame:
    """One state per partition that has rows; rows are shifted by -offset, which no covariance sees."""
    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        state, sums = Spectrum(dims), [0] * dims
        for batch in batches:
            if len(batch):
                x = _matrix(batch)
                sums = [a + b for a, b in zip(sums, _sums(x))]
                for row, weight in zip(*np.unique(x, axis=0, return_counts=True)):
                    state.add((row - offset).astype(float), int(weight))
        if state.n:
            yield pd.DataFrame([_row_of(state, sums, TaskContext.get().partitionId())])

    return rows.select("x").mapInPandas(follow, STATE)


def _combined(states: DataFrame) -> tuple[Spectrum, list[int]]:
    """All states as one, eight at a time."""
    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        (total, sums), *rest = [_state_of(r) for r in group.itertuples()]
        for state, s in rest:
            total.merge(state)
            sums = [a + b for a, b in zip(sums, s)]
        return pd.DataFrame([_row_of(total, sums, key[0])])

    left = stage(states, "white-spectra")
    while left.count() > 1:
        above = stage(left.groupBy(F.floor(F.col("part") / FAN_IN).alias("part")).applyInPandas(merge, STATE), "white-spectra")
        unstage(left)
        left = above
    return _state_of(left.first())


def _summed(rows: DataFrame, partial, width: int) -> np.ndarray:
    """The sum over partitions of ``partial(batches)``, a matrix of ``width`` columns, added up by row number in Spark."""
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = partial(x for x in (_matrix(b) for b in batches if len(b)))
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "values": list(total)})

    found = rows.select("x").mapInPandas(task, "i int, values array<double>").groupBy("i").agg(
        F.array(*[F.sum(F.col("values")[j]) for j in range(width)]).alias("values"))
    return np.array([r["values"] for r in found.orderBy("i").collect()])


def _ritz(rows: DataFrame, mean: np.ndarray, n: int, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values and vectors of the covariance in the span of ``basis``, and the covariance times the span."""
    def partial(matrices: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for x in matrices:
            c = x - mean
            total = c.T @ (c @ basis) + (0 if total is None else total)
        return total

    image = _summed(rows, partial, basis.shape[1]) / n
    inner = basis.T @ image
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    return values, basis @ turn, image @ turn


class Whitening:
    """mean and components (dims x k) that whiten vectors; eigenvalues, share of the variance, exact sums and count."""

    def __init__(self, n, sums, mean, components, values, trace, passes):
        self.n, self.sums, self.mean, self.components = n, sums, mean, components
        self.values, self.trace, self.passes = values, trace, passes

    def apply(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.components) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sum over dimensions of (n * x - S)^2 per row, in whole numbers.

        With m the rounded mean, n * x - S = n * (x - m) - (S - n * m), whose parts are small.
        """
        middle = [round(s / self.n) for s in self.sums]
        rest = [s - self.n * m for s, m in zip(self.sums, middle)]
        wide = max(map(abs, middle)) >= 1 << 40 or (len(x) and np.abs(x).max() >= 1 << 40)
        y = x.astype(object) - np.array(middle, dtype=object) if wide else x - np.array(middle)
        if len(y) and (wide or np.abs(y).max() >= 1 << 24 or self.n >= 1 << 32):
            y = y.astype(object)
        r = np.array(rest, dtype=y.dtype)
        square, cross, fixed = (y * y).sum(1), (y * r).sum(1), sum(v * v for v in rest)
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + fixed for a, b in zip(square, cross)]


def fit(rows: DataFrame, dims: int, components: int, oversample: int, tolerance: float, max_passes: int, offset: int) -> Whitening | None:
    state, sums = _combined(_spectra(rows, dims, offset))
    mean = np.array([float(Decimal(s) / state.n) for s in sums])
    trace = float(state.d.sum()) / state.n
    k = min(components, dims)
    basis = state.basis[:, ::-1][:, :min(dims, k + oversample)]
    for passes in range(1, max_passes + 1):
        basis = np.linalg.qr(basis)[0]
        values, vectors, image = _ritz(rows, mean, state.n, basis)
        residual = np.sqrt(((image - vectors * values)[:, :k] ** 2).sum(0)).max()
        if residual <= tolerance * trace:
            break
        basis = image
    k = int((values[:k] > 64 * EPS * dims * trace).sum()) if trace > 0 else 0
    return Whitening(state.n, sums, mean, vectors[:, :k], values[:k], trace, passes)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, scale: int = 1024,
           offset: int = 100000, oversample: int = 8, tolerance: float = 1e-14, max_passes: int = 8) -> DataFrame:
    """Per usable row: id, n (rows fitted), deviation decimal(38,0) (exact sum over dimensions of (n * x - S)^2; null if it
    has more digits), whitened array<double> (by falling eigenvalue), explained array<double> (eigenvalue over trace) and
    identity_error (largest absolute entry of the whitened covariance minus the identity, measured on all rows)."""
    spark = vectors.sparkSession
    ship(spark)
    schema = f"id {vectors.schema[id_col].dataType.simpleString()}, n long, deviation string, whitened array<double>"
    rows, dims = _clean(vectors, id_col, vector_col, scale, offset)
    model = fit(rows, dims, components, oversample, tolerance, max_passes, offset) if dims else None
    k = len(model.values) if model else 0
    if not k:
        out = spark.createDataFrame([], schema).withColumns({"explained": F.array().cast("array<double>"), "identity_error": F.lit(0.0)})
    else:
        def covariance(matrices: Iterator[np.ndarray]) -> np.ndarray | None:
            total = None
            for x in matrices:
                w = model.apply(x)
                total = w.T @ w + (0 if total is None else total)
            return total

        def centre(matrices: Iterator[np.ndarray]) -> np.ndarray | None:
            total = None
            for x in matrices:
                total = model.apply(x).sum(0)[None, :] + (0 if total is None else total)
            return total

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = _matrix(batch)
                    yield pd.DataFrame({"id": batch["id"].astype(object), "n": model.n, "deviation": [str(v) for v in model.deviations(x)],
                                        "whitened": list(model.apply(x))})

        both = _summed(rows, lambda m: _stacked(m, covariance, centre), k)
        shift = both[k] / model.n
        error = float(np.abs(both[:k] / model.n - np.outer(shift, shift) - np.eye(k)).max())
        out = rows.mapInPandas(apply, schema).withColumns({
            "explained": F.array(*[F.lit(float(v / model.trace)) for v in model.values]), "identity_error": F.lit(error)})
    return out.withColumnsRenamed({"id": id_col}).withColumn("deviation", F.expr("try_cast(deviation as decimal(38,0))"))


def _stacked(matrices: Iterator[np.ndarray], *partials) -> np.ndarray | None:
    """Rows of several partial sums over the same batches, one batch at a time."""
    total = None
    for x in matrices:
        part = np.vstack([p(iter([x])) for p in partials])
        total = part if total is None else total + part
    return total
