"""Exact two-sample p-values at small sizes (K1, K6), one row per group.

``two_sample`` takes (keys..., value, n_a, n_b) counts and returns both forms of each test in
named columns: the asymptotic one always, the exact one where the usual routine has it.

- Mann-Whitney: exact where a side has at most EXACT_SIDE rows and no value is tied. The
  number of arrangements with U = u are the coefficients of the Gaussian binomial
  prod (1 - q^(m+i)) / (1 - q^i), folded factor by factor over an array of counts; division by
  (1 - q^i) is multiplication by (1 + q^i)(1 + q^2i)(1 + q^4i)..., so each step is one shifted add.
- Kolmogorov-Smirnov: exact where both sides have at most EXACT_KS rows together. Lattice
  paths that stay strictly inside the band |i m - j n| < D n m are counted row by row; a row is
  the prefix sum of the row before, taken inside the band.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.functions import pvalues as pv
from driftspark.operators import ranks

# Fixed value: largest smaller side of the exact Mann-Whitney form, as the usual routine has it.
EXACT_SIDE = 8
# Bound of the exact KS form: counts of lattice paths fit doubles up to here.
EXACT_KS = 1000


def _shifted_adds(array: str, shifts: str) -> str:
    """Fold of ``a[u] += sign(s) a[u - |s|]`` over signed shifts, on an array of doubles."""
    return (f"aggregate({shifts}, {array}, (_a, _s) -> transform(_a, (_x, _u) -> _x + "
            f"CASE WHEN _u < abs(_s) THEN 0.0D WHEN _s < 0 THEN -_a[_u + _s] ELSE _a[_u - _s] END))")


def _doubling(step: str, upto: str) -> str:
    """step, 2 step, 4 step, ... up to ``upto`` (each as bigint)."""
    return f"filter(transform(sequence(0, 62), _k -> shiftleft(cast({step} as bigint), _k)), _z -> _z > 0 AND _z <= {upto})"


def choose(n: str, k: str) -> str:
    """Binomial coefficient as a double."""
    return f"aggregate(filter(sequence(0, cast({k} as int)), _i -> _i > 0), 1.0D, (_c, _i) -> _c * (({n}) - ({k}) + _i) / _i)"


def mann_whitney_exact(n: str, m: str, u: str) -> str:
    """Two-sided p of U for sides of ``n`` <= ``m`` rows without ties: 2 P(U <= min), at most 1."""
    low = f"cast(least({u}, {n} * {m} - {u}) as bigint)"
    start = f"transform(sequence(0, {low}), _i -> CASE WHEN _i = 0 THEN 1.0D ELSE 0.0D END)"
    shifts = (f"flatten(transform(sequence(1, cast({n} as int)), _f -> concat(array(cast(-({m} + _f) as bigint)), {_doubling('_f', low)})))")
    total = f"aggregate({_shifted_adds(start, shifts)}, 0.0D, (_t, _x) -> _t + _x)"
    return f"least(1.0D, 2 * {total} / ({choose(f'({n} + {m})', n)}))"


def ks_exact(n: str, m: str, h: str) -> str:
    """P(D >= h / (n m)) for sides of ``n`` and ``m`` rows: 1 - paths inside the band / all paths."""
    width = f"cast({m} as bigint)"
    inside = f"(CASE WHEN abs(_r * {m} - _j * {n}) < {h} THEN _v ELSE 0.0D END)"
    first = f"transform(sequence(0, {width}), _j -> CASE WHEN _j * {n} < {h} THEN 1.0D ELSE 0.0D END)"
    # a path enters row r at a place that the row's band holds, and stays in it
    entered = f"transform(_p, (_v, _j) -> CASE WHEN _r * {m} - _j * {n} < {h} THEN _v ELSE 0.0D END)"
    sums = _shifted_adds(entered, _doubling("1", width))
    fold = f"aggregate(sequence(1, cast({n} as int)), {first}, (_p, _r) -> transform({sums}, (_v, _j) -> {inside}))"
    return f"greatest(0.0D, least(1.0D, 1 - element_at({fold}, -1) / ({choose(f'({n} + {m})', n)})))"


def two_sample(counts: DataFrame, keys: Sequence[str], value: str = "value", partitions: int | None = None) -> DataFrame:
    """keys..., n_a, n_b, u_stat, mw_asymptotic, mw_exact, ks_d, ks_asymptotic, ks_exact.

    Groups with an empty side have null statistics. The exact forms are null where they do
    not apply (ties or two sides above EXACT_SIDE; more than EXACT_KS rows)."""
    keys = list(keys)
    cum = ranks.cumulative(counts.where(F.col(value).isNotNull()), keys, value, ["n_a", "n_b"], partitions)
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    ta, tb = F.col("tot_n_a").cast("double"), F.col("tot_n_b").cast("double")
    t = a + b
    gap = F.abs(F.col("cum_n_a").cast("double") * tb - F.col("cum_n_b").cast("double") * ta)
    g = cum.groupBy(*keys).agg(F.max("tot_n_a").alias("n_a"), F.max("tot_n_b").alias("n_b"),
                               F.sum(a * (F.col("cum_n_b") - F.lit(0.5) * b)).alias("_u"), F.sum(t * t * t - t).alias("_ties"), F.max(gap).alias("_h"))
    g = g.withColumn("u_stat", F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), F.col("_u")))
    n, m = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    s = F.sqrt(n * m / 12.0 * ((n + m + 1) - F.try_divide("_ties", (n + m) * (n + m - 1))))
    g = g.withColumn("_z", F.try_divide(F.greatest(F.col("u_stat"), n * m - F.col("u_stat")) - n * m / 2.0 - 0.5, s))
    asymptotic = F.when(F.col("u_stat").isNull(), None).when(F.col("_z").isNull() | (F.col("_z") <= 0), F.lit(1.0)).otherwise(pv.normal_two_sided("_z"))
    g = g.withColumn("mw_asymptotic", asymptotic).withColumn("ks_d", F.when(F.col("u_stat").isNotNull(), F.col("_h") / (n * m)))
    root = F.sqrt(n * m / (n + m))
    g = g.withColumn("_lam", F.when(F.col("ks_d").isNotNull(), (root + 0.12 + F.try_divide(F.lit(0.11), root)) * F.col("ks_d")))
    g = g.withColumn("ks_asymptotic", pv.kolmogorov_sf("_lam")).withColumn("_n", F.least("n_a", "n_b")).withColumn("_m", F.greatest("n_a", "n_b"))
    mw = f"CASE WHEN u_stat IS NOT NULL AND _ties = 0 AND _n <= {EXACT_SIDE} THEN {mann_whitney_exact('_n', '_m', 'u_stat')} END"
    ks = f"CASE WHEN ks_d IS NOT NULL AND _n + _m <= {EXACT_KS} THEN {ks_exact('_n', '_m', '_h')} END"
    return g.withColumn("mw_exact", F.expr(mw)).withColumn("ks_exact", F.expr(ks)).select(
        *keys, "n_a", "n_b", "u_stat", "mw_asymptotic", "mw_exact", "ks_d", "ks_asymptotic", "ks_exact")
