"""Whitening of embeddings from variances alone: the polarisation identity recovers every covariance.

``Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b)``: it is enough to aggregate squared centred values of each
dimension and of each sum of two dimensions. Entries are fixed-point integers (``floor(256 c)``), so the sums
are whole numbers and exact in whatever order tasks finish. Values are centred before they are squared, at the whole
number next to the mean; what is left of the mean (``R``, exact too) is taken out at the end:
``n * sum(r^2) - R^2`` is ``n^2`` times the variance.

Two passes over the fit list (each distinct vector once, written to the shared folder): one for sums, one for
squares. A task holds one batch and ``d (d + 1) / 2`` totals and emits one row per total; Spark adds them. Only
these totals, bounded by the dimensions and not by the rows, reach the driver, which assembles V for ``eigh``.
Vectors are then projected where they lie, without a shuffle.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped; entries beyond
a 64-bit integer take its nearest end; of vectors of several lengths only the most frequent length of the fit list stays
(ties: the longest); repeated rows count once in the fit and each get their result; an empty table gives no rows;
components without variance (up to rounding) are null and left out of the identity error; with fewer dimensions than
components there are as many as dimensions; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framespan.llm.common import remove, stored

SCALE = 256
COMPONENTS = 4
#: Totals travel as signed numbers of this many 32-bit limbs, so that sums over any number of tasks stay exact.
LIMBS = 5
#: Eigenvalues under this share of the largest are rounding, not variance.
NO_VARIANCE = 1e-13


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: size, exact sums, centre, eigenvalues and unit eigenvectors (columns) by falling eigenvalue."""

    n: int
    sums: list[int]
    centre: list[int]
    covariance: np.ndarray
    eigenvalues: np.ndarray
    vectors: np.ndarray

    @property
    def rest(self) -> list[int]:
        """Sums of the entries less their centre."""
        return [s - self.n * c for s, c in zip(self.sums, self.centre)]

    def explained(self, k: int) -> list[float | None]:
        trace = float(np.trace(self.covariance))
        return [float(e) / trace if trace > 0 else None for e in self.eigenvalues[:k]]

    def weights(self, k: int) -> np.ndarray:
        """Columns that turn centred vectors into whitened ones; NaN where a component has no variance."""
        e = self.eigenvalues[:k]
        spread = np.where(e > NO_VARIANCE * max(float(self.eigenvalues[0]), 0.0), e, np.nan)
        return self.vectors[:, :k] / np.sqrt(spread)


def fixed_point(vector: Column, scale: int = SCALE) -> Column:
    """The vector as whole numbers ``floor(scale * entry)``, null where it is not a usable vector."""
    entries = vector.cast("array<double>")
    usable = (F.size(entries) > 0) & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(usable, F.transform(entries, lambda c: F.floor(F.lit(float(scale)) * c).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _roomy(rows: np.ndarray, limit: int) -> np.ndarray:
    """int64 where all values stay under ``limit`` in size, else Python integers: slower, exact at any size."""
    return rows if not rows.size or max(abs(int(rows.max())), abs(int(rows.min()))) < limit else rows.astype(object)


def _limbs(value: int) -> list[int]:
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & 0xFFFFFFFF)
        value >>= 32
    return [*out, value]


def _added(parts: DataFrame, keys: list[str]) -> dict[tuple, int]:
    """Exact totals of the limbs by key. One row per dimension or pair of dimensions."""
    rows = parts.groupBy(*keys).agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).collect()
    return {tuple(r[k] for k in keys): sum(int(r[f"l{k}"]) << (32 * k) for k in range(LIMBS)) for r in rows}


def _totals(fit: DataFrame, width: int, of_batch) -> DataFrame:
    """(at, l0..): totals of ``of_batch`` over the fit list, one row per total and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(_matrix(batch.column(0)))
        limbs = np.array([_limbs(int(v)) for v in total], np.int64).reshape(width, LIMBS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), *[pa.array(limbs[:, k]) for k in range(LIMBS)]], names=["at", *[f"l{k}" for k in range(LIMBS)]])

    return fit.mapInArrow(run, "at int, " + ", ".join(f"l{k} long" for k in range(LIMBS)))


def _sums(x: np.ndarray) -> np.ndarray:
    return _roomy(x, 2**62 // len(x)).sum(axis=0).astype(object)


def pair_squares(r: np.ndarray) -> np.ndarray:
    """Sums over the rows of squares of each dimension and of each sum of two dimensions, by (i, j), i <= j."""
    r = _roomy(r, int((2**61 // len(r)) ** 0.5) // 2)
    out = []
    for i in range(r.shape[1]):
        out.append((r[:, i] * r[:, i]).sum().reshape(1) if r.dtype != object else np.array([(r[:, i] * r[:, i]).sum()], object))
        both = r[:, i : i + 1] + r[:, i + 1 :]
        out.append((both * both).sum(axis=0))
    return np.concatenate([part.astype(object) for part in out])


def covariance(n: int, rest: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """V from exact integers: each entry is one correctly rounded quotient."""
    d = len(rest)
    spread = {(i, j): n * q - (rest[i] if i == j else rest[i] + rest[j]) ** 2 for (i, j), q in squares.items()}
    v = np.zeros((d, d))
    for (i, j), s in spread.items():
        v[i, j] = v[j, i] = s / (n * n) if i == j else (s - spread[i, i] - spread[j, j]) / (2 * n * n)
    return v


def fit_list(vectors: DataFrame, vec_col: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, str, int]:
    """Each distinct fixed-point vector of the ruling length once, as a scratch table; its path; that length (0: no vectors)."""
    distinct, path = stored(vectors.select(fixed_point(F.col(f"`{vec_col}`"), scale).alias("x")).where("x is not null").distinct(), "fit-list")
    ruling = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = ruling["d"] if ruling else 0
    return distinct.where(F.size("x") == d), path, d


def fit(fit_rows: DataFrame, d: int) -> Whitening | None:
    """The whitening of a fit list of ``d`` dimensions, None where it has no rows."""
    n = fit_rows.count()
    if not n:
        return None
    by_dim = _added(_totals(fit_rows, d, _sums), ["at"])
    sums = [by_dim[(i,)] for i in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    middle = np.array(centre, object)
    small = middle.astype(np.int64) if all(abs(c) < 2**61 for c in centre) else None

    def squares(x: np.ndarray) -> np.ndarray:
        x = _roomy(x, 2**61)
        return pair_squares(x - small if small is not None and x.dtype != object else x.astype(object) - middle)

    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    found = _added(_totals(fit_rows, len(pairs), squares), ["at"])
    v = covariance(n, [s - n * c for s, c in zip(sums, centre)], {pair: found[(at,)] for at, pair in enumerate(pairs)})
    values, vectors = np.linalg.eigh(v)
    return Whitening(n, sums, centre, v, values[::-1].copy(), vectors[:, ::-1].copy())


def _centred(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Exact ``n x - S`` and, as double, ``x - S / n``."""
    centre, rest = np.array(model.centre, object), np.array(model.rest, object)
    widest = max((abs(int(v)) for v in (x.max(), x.min())), default=0) + max(abs(c) for c in model.centre)
    if widest * model.n * 2 < 2**62:
        r = x - centre.astype(np.int64)
        return r * model.n - rest.astype(np.int64), r - np.array([v / model.n for v in model.rest])
    r = x.astype(object) - centre
    return r * model.n - rest, r.astype(float) - np.array([v / model.n for v in model.rest])


def _deviation(y: np.ndarray) -> list[int | None]:
    """Sum of squares by row, null beyond 38 digits."""
    y = _roomy(y, int((2**62 // y.shape[1]) ** 0.5))
    return [v if v < 10**38 else None for v in map(int, (y * y).sum(axis=1))]


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id, deviation decimal(38,0), whitened array) for every usable vector."""
    kind = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = min(components, len(model.sums))
    weights = model.weights(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y, centred = _centred(_matrix(batch.column(1)), model)
                w = centred @ weights
                flat = pa.array(w.ravel(), mask=np.isnan(w).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviation(y), pa.decimal128(38, 0)), lists], names=[id_col, "deviation", "whitened"])

    usable = vectors.select(F.col(f"`{id_col}`"), fixed_point(F.col(f"`{vec_col}`"), scale).alias("_x")).where(F.size("_x") == len(model.sums))
    return usable.mapInArrow(run, schema)


def identity_error(fit_rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> float | None:
    """The largest entry of (covariance of the whitened fit list - identity), measured on all its rows."""
    k = min(components, len(model.sums))
    weights = model.weights(k)
    live = ~np.isnan(weights).any(axis=0)
    if not live.any():
        return None
    weights = weights[:, live]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((weights.shape[1],) * 2), np.zeros(weights.shape[1])
        for batch in batches:
            if batch.num_rows:
                w = _centred(_matrix(batch.column(0)), model)[1] @ weights
                total += w.T @ w
                first += w.sum(axis=0)
        flat = np.concatenate([total.ravel(), first])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "v"])

    parts = fit_rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.array([r["v"] for r in sorted(parts, key=lambda r: r["at"])])
    m = weights.shape[1]
    first = flat[m * m :] / model.n
    return float(np.abs(flat[: m * m].reshape(m, m) / model.n - np.outer(first, first) - np.eye(m)).max())


def whitening_report(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: n, deviation (null beyond a long), whitened, explained, identity_error."""
    rows, path, d = fit_list(vectors, vec_col)
    model = fit(rows, d)
    error = identity_error(rows, model, components) if model else None
    remove(vectors.sparkSession, path)
    shares = model.explained(components) if model else []
    out = whiten(vectors, model, id_col, vec_col, components)
    explained = F.array(*[F.lit(s).cast("double") for s in shares]) if shares else F.array().cast("array<double>")
    long = out.select(f"`{id_col}`", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return long.select(
        F.col(f"`{id_col}`"),
        (F.col("_at") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        F.get(explained, F.col("_at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
