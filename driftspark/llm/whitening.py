"""Whitening of embeddings: leading principal components, scaled to unit variance.

1. Every vector is an array of longs (``grid`` quantises floats). The fit list is each
   distinct vector once, staged; its sums are exact integers.
2. Covariance. Each task centres its vectors, then multiplies them into one upper triangle;
   triangles of all tasks are added up by a grouping on (i, j). Centring takes the integer
   part of the mean off in integers first, so a common offset costs no digits.
3. The d x d matrix is all that reaches the driver. Householder reflections make it
   tridiagonal, Sturm counts bisect the leading eigenvalues, inverse iteration gives their
   vectors, and vectors of eigenvalues closer than CLUSTER are kept orthogonal.
4. Components are broadcast (d x k doubles) and every row is projected in one pass. The
   identity error is measured by a pass over the fit list, not derived from the model.

Defined results: rows whose vector is null, empty, holds nulls, or holds entries beyond
LARGEST take no part, nor do vectors of another length than the one that most distinct
vectors have (of equal ones the longer). Rows without id stay, with a null id; rows that
repeat an id or a vector are projected each. Components whose eigenvalue is rounding error next to the first
(rank deficit, one distinct vector) are not given, so there may be fewer than asked for,
or none. ``deviation`` is exact, null where it passes 64 bits. Empty tables give empty
results. Columns that are not named are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.llm import shared

COMPONENTS = 16
# Largest size of an entry (sums of a batch then fit 64 bits), most tasks that
# send partial sums, rows handled at a time, and the relative gap below which eigenvalues
# count as one cluster.
LARGEST = 1 << 45
PARTIALS = 4096
STRIP = 8192
CLUSTER = 1e-3


def grid(vector: Column, scale: float, shift: int) -> Column:
    """floor(scale * entry) + shift as longs; null for vectors with null or non-finite entries."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * F.lit(float(scale))) <= F.lit(float(LARGEST // 2))))
    return F.when(fine, F.transform(F.when(fine, v), lambda c: F.floor(c * F.lit(float(scale))) + F.lit(shift)))


@dataclass(frozen=True)
class Model:
    n: int
    sums: list[int]
    values: np.ndarray  # leading eigenvalues, falling
    vectors: np.ndarray  # one column per component
    trace: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Integer part of the mean, and n times the rest, per dimension."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, dtype=np.int64), np.array([s - self.n * w for s, w in zip(self.sums, whole)], dtype=np.int64)


# --- the eigenproblem of one symmetric matrix ------------------------------------------

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflectors of the Householder reduction of symmetric ``a``."""
    a = np.array(a, dtype=np.float64)
    d = len(a)
    reflectors = []
    for k in range(d - 2):
        x = a[k + 1:, k]
        size = np.sqrt((x * x).sum())
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        length = np.sqrt((v * v).sum())
        v = v / length if length else np.zeros(len(x))
        p = a[k + 1:, k + 1:] @ v
        q = p - (v @ p) * v
        a[k + 1:, k + 1:] -= 2 * (np.outer(v, q) + np.outer(q, v))
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0]) if length else 0.0
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def below(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of the tridiagonal matrix lie below each of ``at``."""
    tiny = np.finfo(float).tiny * 1e4
    square = np.concatenate([[0.0], off * off])
    q, count = np.ones(len(at)), np.zeros(len(at), dtype=np.int64)
    for a, b in zip(diag, square):
        q = a - at - b / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected to neighbouring doubles or the norm's precision."""
    d = len(diag)
    around = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    low, high = (diag - around).min(), (diag + around).max()
    spread = max(abs(low), abs(high))
    lo, hi = np.full(k, low - 1e-12 * spread), np.full(k, high + 1e-12 * spread + np.finfo(float).tiny)
    rank = d - np.arange(k)  # the j-th largest has this many eigenvalues at or below it
    for _ in range(200):
        middle = (lo + hi) / 2
        if (hi - lo <= np.finfo(float).eps * 0.5 * spread).all() or ((middle <= lo) | (middle >= hi)).all():
            break
        up = below(diag, off, middle) < rank
        lo, hi = np.where(up, middle, lo), np.where(up, hi, middle)
    return (lo + hi) / 2


def _solver(diag: np.ndarray, off: np.ndarray, shift: float, least: float):
    """Solves (T - shift) y = b by elimination with row exchanges; vanishing pivots become ``least``."""
    d = len(diag)
    one, two, three = diag - shift, np.append(off, 0.0), np.zeros(d)
    steps = []
    for i in range(d - 1):
        if abs(one[i]) >= abs(off[i]):
            one[i] = one[i] or least
            m = off[i] / one[i]
            one[i + 1] -= m * two[i]
            steps.append((m, False))
        else:
            m = one[i] / off[i]
            one[i], two_i = off[i], two[i]
            two[i], three[i] = one[i + 1], two[i + 1]
            one[i + 1] = two_i - m * two[i]
            two[i + 1] = -m * three[i]
            steps.append((m, True))
    one[-1] = one[-1] or least

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.tolist()
        for i, (m, exchanged) in enumerate(steps):
            if exchanged:
                y[i], y[i + 1] = y[i + 1], y[i] - m * y[i + 1]
            else:
                y[i + 1] -= m * y[i]
        for i in range(d - 1, -1, -1):
            s = y[i]
            if i + 1 < d:
                s -= two[i] * y[i + 1]
            if i + 2 < d:
                s -= three[i] * y[i + 2]
            y[i] = s / one[i]
        return np.array(y)

    return solve


def inverse_iteration(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix for the falling ``values``."""
    d, norm = len(diag), max(np.abs(diag).max(), np.abs(off).max() if len(off) else 0.0, np.finfo(float).tiny)
    random = np.random.default_rng(11)
    found: list[np.ndarray] = []
    first = 0  # where the cluster of close values begins
    shift = np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        shift = min(value, shift - 4 * np.finfo(float).eps * norm) if j > first else value
        solve = _solver(diag, off, shift, np.finfo(float).eps * norm)
        y = random.standard_normal(d)
        for _ in range(6):
            y = y / np.abs(y).max()
            y = solve(y)
            y = y / np.abs(y).max()
            for _ in range(2):
                for other in found[first:j]:
                    y = y - (other @ y) * other
            y = y / np.sqrt((y * y).sum())
        found.append(y)
    return np.array(found).T


def eigenpairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues of symmetric ``a``, falling, and their unit vectors as columns.
    A vector's entry of largest size is positive."""
    diag, off, reflectors = tridiagonal(a)
    values = leading(diag, off, k)
    vectors = inverse_iteration(diag, off, values)
    for i in range(len(reflectors) - 1, -1, -1):
        v = reflectors[i]
        vectors[i + 1:] -= 2 * np.outer(v, v @ vectors[i + 1:])
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(k)]
    return values, vectors * np.where(top < 0, -1.0, 1.0)


# --- distributed sums -------------------------------------------------------------------

def _strips(batch: pa.RecordBatch, column: int, d: int):
    """Runs of at most STRIP vectors of a batch as int64 matrices."""
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) if len(lists) else np.zeros((0, d), np.int64)
    for at in range(0, len(flat), STRIP):
        yield at, flat[at:at + STRIP]


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""
    def partial(batches):
        n, total = 0, [0] * d
        for batch in batches:
            for _, x in _strips(batch, 0, d):
                n += len(x)
                total = [a + int(b) for a, b in zip(total, x.sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array([n, *total], pa.decimal128(38, 0)), pa.array(range(d + 1), pa.int32())], names=["s", "i"])

    rows = fit.coalesce(PARTIALS).mapInArrow(partial, "s decimal(38,0), i int").groupBy("i").agg(F.sum("s").alias("s")).collect()  # d + 1 rows
    by = {r.i: int(r.s) for r in rows}
    return by.get(0, 0), [by.get(i + 1, 0) for i in range(d)]


def _products(fit: DataFrame, d: int, model: Model, turn: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the centred vectors (turned by the matrix, if any) and of their products."""
    whole, rest = model.centre()
    mean = rest / model.n
    k = d if turn is None else turn.shape[1]
    i, j = np.triu_indices(k)

    def partial(batches):
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in _strips(batch, 0, d):
                c = (x - whole) - mean
                c = c if turn is None else c @ turn
                total += c.sum(axis=0)
                square += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([i, np.arange(k)]).astype(np.int32)), pa.array(np.concatenate([j, np.full(k, -1)]).astype(np.int32)),
                                          pa.array(np.concatenate([square[i, j], total]))], names=["i", "j", "s"])

    rows = fit.coalesce(PARTIALS).mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # a triangle
    total, square = np.zeros(k), np.zeros((k, k))
    for r in rows:
        if r.j < 0:
            total[r.i] = r.s
        else:
            square[r.i, r.j] = square[r.j, r.i] = r.s
    return total, square


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows that take part."""
    x = F.col(vector_col)
    fine = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) <= F.lit(LARGEST)))
    return df.select(F.col(id_col).alias("id"), x.cast("array<bigint>").alias("x")).where(F.coalesce(fine, F.lit(False)))


def fitted(rows: DataFrame, k: int = COMPONENTS) -> tuple[DataFrame, Model | None]:
    """The staged fit list of ``rows`` (id, x) and its model; no model without vectors."""
    fit = shared.staged(rows.select("x").distinct(), "fit")
    lengths = fit.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return fit, None
    d = lengths.d
    fit = fit.where(F.size("x") == d)
    n, sums = _sums(fit, d)
    model = Model(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    _, square = _products(fit, d, model, None)
    covariance = square / n
    if not np.trace(covariance) > 0:
        return fit, model
    values, vectors = eigenpairs(covariance, min(k, d))
    kept = int((values > 64 * d * np.finfo(float).eps * values[0]).sum())
    return fit, Model(n, sums, values[:kept], vectors[:, :kept], float(np.trace(covariance)))


def identity_error(fit: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    total, square = _products(fit, len(model.sums), model, model.vectors / np.sqrt(model.values))
    mean = total / model.n
    return float(np.abs(square / model.n - np.outer(mean, mean) - np.eye(len(mean))).max())


def project(rows: DataFrame, model: Model) -> DataFrame:
    """(id, component, deviation, whitened) of ``rows`` (id, x) of the model's length."""
    d, k = len(model.sums), len(model.values)
    whole, rest = model.centre()
    n, values = model.n, model.values
    held = rows.sparkSession.sparkContext.broadcast(model.vectors / np.sqrt(values))

    def run(batches):
        turn = held.value
        for batch in batches:
            for at, x in _strips(batch, 1, d):
                z = x - whole
                rough = n * z.astype(np.float64) - rest
                fits = (rough * rough).sum(axis=1) < 9.2e18
                exact = np.where(fits[:, None], z, 0) * n - np.where(fits[:, None], rest, 0)
                deviation = pa.array(np.repeat((exact * exact).sum(axis=1), k), mask=np.repeat(~fits, k))
                white = (z - rest / n) @ turn
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(x)).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     deviation, pa.array(white.reshape(-1))], names=["id", "component", "deviation", "whitened"])

    return rows.where(F.size("x") == d).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, component int, deviation long, whitened double")


def whitened(df: DataFrame, id_col: str, vector_col: str, k: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row."""
    rows = usable(df, id_col, vector_col)
    fit, model = fitted(rows, k)
    if model is None or not len(model.values):
        kind = rows.schema["id"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    out = project(rows, model)
    return out.select("id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      F.element_at(shares, F.col("component")).alias("explained"), F.lit(identity_error(fit, model)).alias("identity_error"))


def op11_query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    rows = rows.select("vec_id", grid(F.col("embedding"), 64.0, 1_000_000).alias("x"))
    return whitened(rows, "vec_id", "x").withColumnRenamed("id", "vec_id")
