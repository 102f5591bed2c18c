"""Drift detectors over all rows.

Inputs are long frames ``(keys..., role, value)`` with role in {ref, rec}. Every
detector returns one row per group of ``keys`` and never gathers a group into one
task: KS runs on the two-phase running counts, chi-squared and PSI on grouped counts.

Defaults follow the monitored loop: alpha 0.01, PSI alert 0.2 (strict), 10 PSI bins,
eps 1e-6, at least 20 rows per side for KS/chi-squared and 50 for PSI.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.functions import pvalues as pv
from driftspark.functions import special
from driftspark.operators import ranks
from driftspark.operators.windows import REC, REF

# Decision defaults.
ALPHA = 0.01
PSI_ALERT = 0.2
PSI_BINS = 10
PSI_EPS = 1e-6
MIN_N_TEST = 20
MIN_N_PSI = 50
POSITIVE_THRESHOLD = 0.5


def ks_test(long: DataFrame, keys: Sequence[str], role: str = "role", value: str = "value",
            min_n: int = MIN_N_TEST, partitions: int | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov (K1): n_ref, n_rec, ks_d, ks_p, enough_rows per group.

    D = max over distinct values of |F_ref - F_rec|; p from the Kolmogorov tail at
    (sqrt(ne) + 0.12 + 0.11/sqrt(ne)) * D, ne = n m / (n + m), null where a side is
    empty. ``enough_rows``: both sides have ``min_n`` rows; decisions heed it (``gated``).
    """
    counts = ranks.value_counts(long, keys, value, role, [REF, REC], ["n_ref", "n_rec"])
    return ks_from_counts(counts, keys, value, min_n, partitions)


def ks_from_counts(counts: DataFrame, keys: Sequence[str], value: str = "value",
                   min_n: int = MIN_N_TEST,
                   partitions: int | None = None) -> DataFrame:
    """KS from (keys..., value, n_ref, n_rec) rows, one per distinct value."""
    keys = list(keys)
    cum = ranks.cumulative(counts, keys, value, ["n_ref", "n_rec"], partitions)
    share = lambda side: F.try_divide(F.col(f"cum_n_{side}").cast("double"), F.col(f"tot_n_{side}"))
    gap = F.abs(share("ref") - share("rec"))
    g = cum.groupBy(*keys).agg(
        F.max("tot_n_ref").alias("n_ref"),
        F.max("tot_n_rec").alias("n_rec"),
        F.max(gap).alias("ks_d"),
    )
    ne = _effective()
    g = g.withColumn("_lam", F.when(ne > 0, (F.sqrt(ne) + F.lit(0.12) + F.try_divide(F.lit(0.11), F.sqrt(ne))) * F.col("ks_d")))
    return (g.withColumn("ks_p", pv.kolmogorov_sf("_lam"))
             .withColumn("enough_rows", _enough(min_n))
             .withColumn("n_ref", F.coalesce("n_ref", F.lit(0)).cast("long"))
             .withColumn("n_rec", F.coalesce("n_rec", F.lit(0)).cast("long"))
             .drop("_lam"))


def _effective():
    """n m / (n + m) in doubles: a product of two counts may pass 64 bits."""
    a, b = F.col("n_ref").cast("double"), F.col("n_rec").cast("double")
    return F.try_divide(a * b, a + b)


def _enough(min_n: int):
    return (F.coalesce("n_ref", F.lit(0)) >= min_n) & (F.coalesce("n_rec", F.lit(0)) >= min_n)


def gated(value: str, otherwise: float):
    """What a decision uses of a statistic: ``otherwise`` where rows are too few."""
    return F.when(F.col("enough_rows"), F.coalesce(F.col(value), F.lit(otherwise))).otherwise(F.lit(otherwise))


def category_counts(long: DataFrame, keys: Sequence[str], role: str = "role",
                    value: str = "value") -> DataFrame:
    """Contingency rows (keys..., value, n_ref, n_rec): the full-outer alignment of the
    two count vectors (J1) as one grouped count, missing side = 0."""
    return ranks.value_counts(long, keys, value, role, [REF, REC], ["n_ref", "n_rec"])


def chi2_test(long: DataFrame, keys: Sequence[str], role: str = "role", value: str = "value",
              min_n: int = MIN_N_TEST, yates: bool = True) -> DataFrame:
    """Chi-squared homogeneity test on category x role (K2).

    chi2 = N * (sum_i O_ref,i^2 / (R_i C_ref) + sum_i O_rec,i^2 / (R_i C_rec)) - N,
    which needs only per-group sums (no join of group totals back to categories).
    With one degree of freedom (two categories) the Yates correction of the usual
    contingency routine applies: |ad - bc|/N is reduced by min(0.5, |ad - bc|/N).
    Fewer than 2 categories or an empty side give null. Also returns Cramer's V in the
    standard form sqrt(chi2 / N) for a K x 2 table (Y2) and ``enough_rows``. Products
    of counts are taken in doubles. Name id-like columns (G3) in the caller's ``exclude``.
    """
    cc = category_counts(long, keys, role, value)
    return chi2_from_counts(cc, keys, value, min_n, yates)


def chi2_from_counts(cc: DataFrame, keys: Sequence[str], value: str = "value",
                     min_n: int = MIN_N_TEST, yates: bool = True) -> DataFrame:
    """Chi-squared from (keys..., value, n_ref, n_rec) contingency rows."""
    keys = list(keys)
    cc = cc.where((F.col("n_ref") + F.col("n_rec")) > 0)
    a, b = F.col("n_ref").cast("double"), F.col("n_rec").cast("double")
    r = a + b
    g = cc.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_categories"),
        F.sum("n_ref").alias("n_ref"),
        F.sum("n_rec").alias("n_rec"),
        F.sum(a * a / r).alias("_s_ref"),
        F.sum(b * b / r).alias("_s_rec"),
        F.min_by(a, value).alias("_a"), F.min_by(b, value).alias("_b"),
        F.max_by(a, value).alias("_c"), F.max_by(b, value).alias("_d"),
    )
    n = a + b
    plain = n * (F.try_divide("_s_ref", a) + F.try_divide("_s_rec", b)) - n
    dev = F.greatest(F.abs(F.col("_a") * F.col("_d") - F.col("_b") * F.col("_c")) / n - F.lit(0.5), F.lit(0.0))
    yt = F.try_divide(dev * dev * n, (F.col("_a") + F.col("_b")) / n * ((F.col("_c") + F.col("_d")) / n) * a * b)
    stat = F.when((F.col("n_categories") == 2) & F.lit(bool(yates)), yt).otherwise(F.greatest(plain, F.lit(0.0)))
    g = (g.withColumn("chi2", stat.cast("double"))
          .withColumn("dof", (F.col("n_categories") - 1).cast("long")))
    g = g.withColumn("chi2", F.when((F.col("n_categories") >= 2) & (a > 0) & (b > 0), F.col("chi2")))
    return (g.withColumn("chi2_p", special.chi2_sf("chi2", "dof"))
             .withColumn("cramers_v", F.sqrt(F.col("chi2") / n))
             .withColumn("enough_rows", _enough(min_n))
             .drop("_s_ref", "_s_rec", "_a", "_b", "_c", "_d"))


def psi_edges(long: DataFrame, keys: Sequence[str], role: str = "role", value: str = "value",
              bins: int = PSI_BINS, out_of_range: str = "drop") -> DataFrame:
    """Quantile edges of the reference (A8): keys..., edges (sorted, distinct).

    Linear-interpolated quantiles at 0, 1/bins, ..., 1, de-duplicated; fewer than
    three distinct edges fall back to ``bins`` equal-width bins between min and max.
    ``out_of_range="extend"`` replaces the outer edges by -inf/+inf (G5).
    """
    counts = ranks.value_counts(long, keys, value, role, [REF, REC], ["n_ref", "n_rec"])
    return psi_edges_from_counts(counts, keys, value, bins, out_of_range)


def psi_edges_from_counts(counts: DataFrame, keys: Sequence[str], value: str = "value",
                          bins: int = PSI_BINS, out_of_range: str = "drop") -> DataFrame:
    probs = [i / bins for i in range(bins + 1)]
    names = [f"_e{i}" for i in range(bins + 1)]
    q = ranks.quantiles_from_counts(counts, keys, value, "n_ref", probs, names)
    uniq = F.array_sort(F.array_distinct(F.array(*[F.col(c) for c in names])))
    lo, hi = F.col(names[0]), F.col(names[-1])
    step = (hi - lo) / F.lit(float(bins))
    linear = F.array(*[lo + step * F.lit(i) for i in range(bins)], hi)
    edges = F.when(F.size(uniq) < 3, linear).otherwise(uniq)
    if out_of_range == "extend":
        k = F.size(edges)
        edges = F.concat(F.array(F.lit(float("-inf"))),
                         F.slice(edges, 2, k - 2), F.array(F.lit(float("inf"))))
    elif out_of_range != "drop":
        raise ValueError(out_of_range)
    return q.select(*keys, edges.alias("edges"))


def psi(long: DataFrame, keys: Sequence[str], role: str = "role", value: str = "value",
        bins: int = PSI_BINS, eps: float = PSI_EPS, min_n: int = MIN_N_PSI,
        out_of_range: str = "drop") -> DataFrame:
    """Population stability index (K3) plus the one-sided KL terms.

    Reference-quantile bins; bin i holds e_i <= v < e_(i+1), the last bin is closed,
    values outside [e_0, e_k] are dropped (G5 parity) unless ``out_of_range="extend"``.
    Proportions divide by the in-range count and are floored at ``eps`` without
    renormalising (X10); PSI = sum (r - c) ln(r / c), null where the reference is empty;
    ``enough_rows`` tells whether both sides have ``min_n`` rows.
    The edge array of a group reaches its rows by a join on the group keys (J6).
    """
    counts = ranks.value_counts(long, keys, value, role, [REF, REC], ["n_ref", "n_rec"])
    return psi_from_counts(counts, keys, value, bins, eps, min_n, out_of_range)


def psi_from_counts(counts: DataFrame, keys: Sequence[str], value: str = "value",
                    bins: int = PSI_BINS, eps: float = PSI_EPS, min_n: int = MIN_N_PSI,
                    out_of_range: str = "drop") -> DataFrame:
    """PSI from (keys..., value, n_ref, n_rec) rows."""
    keys = list(keys)
    edges = psi_edges_from_counts(counts, keys, value, bins, out_of_range)
    sizes = counts.groupBy(*keys).agg(F.sum("n_ref").alias("n_ref"), F.sum("n_rec").alias("n_rec"))
    # at most bins+1 edges: count the edges at or below the value with static probes
    le = sum(F.coalesce(F.try_element_at(F.col("edges"), F.lit(i)) <= F.col(value), F.lit(False)).cast("int")
             for i in range(1, bins + 2))
    b = counts.join(edges, on=keys, how="inner").withColumn("_bucket", le)
    k = F.size("edges") - 1
    b = (b.withColumn("_bin", F.when(F.col(value) == F.element_at("edges", -1), k - 1)
                      .otherwise(F.col("_bucket") - 1))
          .where((F.col(value) >= F.element_at("edges", 1)) & (F.col(value) <= F.element_at("edges", -1))))
    hist = b.groupBy(*keys, "_bin").agg(F.sum("n_ref").alias("h_ref"), F.sum("n_rec").alias("h_rec"))
    grid = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("_bin"))
    full = (grid.join(hist, on=[*keys, "_bin"], how="left")
                .fillna(0, subset=["h_ref", "h_rec"]))
    w = Window.partitionBy(*keys)
    rp = F.greatest(F.col("h_ref") / F.greatest(F.sum("h_ref").over(w), F.lit(1)), F.lit(eps))
    cp = F.greatest(F.col("h_rec") / F.greatest(F.sum("h_rec").over(w), F.lit(1)), F.lit(eps))
    terms = full.select(*keys, rp.alias("_r"), cp.alias("_c"))
    g = terms.groupBy(*keys).agg(
        F.sum((F.col("_r") - F.col("_c")) * F.log(F.col("_r") / F.col("_c"))).alias("psi"),
        F.sum(F.col("_r") * F.log(F.col("_r") / F.col("_c"))).alias("kl_ref_rec"),
        F.sum(F.col("_c") * F.log(F.col("_c") / F.col("_r"))).alias("kl_rec_ref"),
    )
    g = sizes.join(g, on=keys, how="left")
    return g.withColumn("enough_rows", _enough(min_n))


def positive_ratio(df: DataFrame, keys: Sequence[str], score: str | None, role: str = "role",
                   threshold: float = POSITIVE_THRESHOLD,
                   binary_cols: Sequence[str] = ()) -> DataFrame:
    """Share of recent rows predicted positive.

    With a score column: mean(score >= threshold) over non-null recent scores. Else
    the first of ``binary_cols`` whose recent values all lie in {0, 1}: mean(x = 1).
    Null when neither applies. ``binary_cols`` are resolved at plan time by the caller.
    """
    rec = df.where(F.col(role) == REC)
    if score is not None:
        # a NaN is a missing score, not one above every threshold
        known = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
        return rec.groupBy(*keys).agg(
            F.avg(F.when(known.isNotNull(), (known >= threshold).cast("double"))).alias("pos_ratio"))
    if not binary_cols:
        return rec.groupBy(*keys).agg(F.lit(None).cast("double").alias("pos_ratio"))
    aggs = []
    for c in binary_cols:
        aggs.append(F.bool_and(F.when(F.col(c).isNotNull(), F.col(c).isin(0, 1))).alias(f"_bin_{c}"))
        aggs.append(F.avg(F.when(F.col(c).isNotNull(), (F.col(c) == 1).cast("double"))).alias(f"_pr_{c}"))
    g = rec.groupBy(*keys).agg(*aggs)
    pick = F.lit(None).cast("double")
    for c in reversed(list(binary_cols)):
        pick = F.when(F.coalesce(F.col(f"_bin_{c}"), F.lit(False)), F.col(f"_pr_{c}")).otherwise(pick)
    return g.select(*keys, pick.alias("pos_ratio"))


def positive_from_counts(counts: DataFrame, keys: Sequence[str], value: str = "value",
                         threshold: float = POSITIVE_THRESHOLD) -> DataFrame:
    """K4 from (keys..., value, n_ref, n_rec) rows: share of the recent values at or above
    the threshold; null for a group without recent values."""
    n = F.when(F.col(value).isNotNull(), F.col("n_rec")).otherwise(0)
    up = F.when(F.col(value) >= threshold, n).otherwise(0)
    return counts.groupBy(*keys).agg(F.try_divide(F.sum(up).cast("double"), F.sum(n)).alias("pos_ratio"))


def verdict(pvalues: DataFrame, psi_df: DataFrame | None, keys: Sequence[str],
            alpha: float = ALPHA, psi_alert: float = PSI_ALERT) -> DataFrame:
    """Per-group decision.

    ``pvalues``: (keys..., column, p). drift_any = some p < alpha; should_trigger =
    drift_any OR psi > psi_alert (strict). Also p_min and the share of rejecting columns.
    The p-value rows and the PSI row of a group are stacked and aggregated once (no
    join); without keys the result is the single row of one poll.
    """
    keys = list(keys)
    rows = pvalues.select(*keys, F.col("p").cast("double").alias("p"), F.lit(None).cast("double").alias("psi"))
    if psi_df is not None:
        rows = rows.unionByName(psi_df.select(*keys, F.lit(None).cast("double").alias("p"),
                                              F.col("psi").cast("double").alias("psi")))
    drift = F.coalesce(F.bool_or(F.col("p") < alpha), F.lit(False))
    psi = F.max("psi")
    g = rows.groupBy(*keys).agg(
        drift.alias("drift_any"),
        F.min("p").alias("p_min"),
        F.avg(F.when(F.col("p").isNotNull(), (F.col("p") < alpha).cast("double"))).alias("reject_share"),
        F.count("p").alias("n_tests"),
        psi.alias("psi"),
        (drift | F.coalesce(psi > psi_alert, F.lit(False))).alias("should_trigger"),
    )
    return g


def dkw_band(ks: DataFrame, gamma: float = 0.05) -> DataFrame:
    """DKW half-width sqrt(ln(2/gamma) / (2 ne)) for the ECDF gap and D > eps."""
    eps = F.sqrt(F.try_divide(F.lit(math.log(2.0 / gamma)), F.lit(2.0) * _effective()))
    return ks.withColumn("dkw_eps", eps).withColumn("dkw_exceeds", F.col("ks_d") > F.col("dkw_eps"))
