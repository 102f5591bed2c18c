"""Scenario comparison.

Input is a run table: a scenario label, an ordinal that fixes the order of first
appearance, and metric columns. All statistics come from per-value counts:

- pairs (J2): scenarios ordered by first appearance, every (a, b) with a before b;
- Mann-Whitney U (K6): per value, U_a += n_a * (#b below + half the tied b), from
  the two-phase running counts keyed by (metric, a, b); tie term sum(t^3 - t);
  two-sided p with continuity correction and tie-corrected variance;
- Cliff's delta (K7): exactly (2 U_a - n m) / (n m), at any size;
- Benjamini-Hochberg (K9) and Holm (Y1) over the small table of tests;
- summaries (A6/A7/K10): n, mean, population std, min, quartiles, max for the
  global scope and one scope per scenario.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.functions import pvalues as pv
from driftspark.operators import ranks
from driftspark.session import work_dir

# Cliff's delta magnitude bounds (negligible / small / medium / large).
CLIFF_BOUNDS = (0.147, 0.33, 0.474)
SUMMARY_PROBS = (0.25, 0.5, 0.75)


def normalise_scenario(df: DataFrame, col: str = "scenario") -> DataFrame:
    """Null → '', then blank → 'default' (an all-blank column becomes all 'default')."""
    s = F.coalesce(F.col(col).cast("string"), F.lit(""))
    return df.withColumn(col, F.when(F.trim(s) == "", F.lit("default")).otherwise(s))


def scenario_order(runs: DataFrame, scenario: str, ordinal: str) -> DataFrame:
    """(scenario, first_ord, scenario_rank) by first appearance.

    One row per scenario. It is used several times (both sides of the pair join, the
    summary order), so it is checkpointed once instead of re-scanning the runs.
    """
    first = runs.groupBy(scenario).agg(F.min(ordinal).alias("first_ord"))
    w = Window.orderBy("first_ord", scenario)  # one row per scenario: a tiny table
    work_dir(runs.sparkSession)
    return first.withColumn("scenario_rank", F.row_number().over(w)).checkpoint(eager=True)


def scenario_pairs(order: DataFrame, scenario: str) -> DataFrame:
    """Every pair (A, B) with A before B.

    The scenario list (one row per scenario) becomes one sorted array; the pairs are
    generated from it with array functions and exploded, so no join is planned.
    """
    arr = order.agg(F.array_sort(F.collect_list(F.struct(F.col("scenario_rank").alias("r"),
                                                         F.col(scenario).alias("s")))).alias("_a"))
    pairs = F.flatten(F.transform("_a", lambda a: F.transform(
        F.filter("_a", lambda b: b["r"] > a["r"]),
        lambda b: F.struct(a["s"].alias("A"), b["s"].alias("B"), a["r"].alias("a_rank"), b["r"].alias("b_rank")))))
    return arr.select(F.explode(pairs).alias("_p")).select("_p.A", "_p.B", "_p.a_rank", "_p.b_rank")


def to_long_metrics(runs: DataFrame, scenario: str, metrics: Sequence[str]) -> DataFrame:
    """(metric, scenario, value) with non-null values only (bad cells already null)."""
    long = runs.select(scenario, *[F.col(m).cast("double").alias(m) for m in metrics]) \
               .unpivot([scenario], list(metrics), "metric", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def mann_whitney(long: DataFrame, pairs: DataFrame, scenario: str, metrics: Sequence[str],
                 partitions: int | None = None) -> DataFrame:
    """Metric, A, B, nA, nB, u_stat, pvalue, cliffs_delta per pair.

    Pairs without values on one side keep their row with null p and delta.
    """
    counts = value_counts_by_scenario(long, scenario)
    return mann_whitney_from_counts(counts, pairs, scenario, metrics, partitions)


def mann_whitney_from_counts(counts: DataFrame, pairs: DataFrame, scenario: str, metrics: Sequence[str],
                             partitions: int | None = None) -> DataFrame:
    """Mann-Whitney, delta and sizes from (metric, scenario, value, n) rows."""
    side = pairs.select("A", "B", F.col("A").alias("_s"), F.lit(1).alias("_is_a")).unionByName(
        pairs.select("A", "B", F.col("B").alias("_s"), F.lit(0).alias("_is_a")))
    pc = (counts.join(side, counts[scenario] == side["_s"])
          .groupBy("metric", "A", "B", "value")
          .agg(F.sum(F.when(F.col("_is_a") == 1, F.col("n")).otherwise(0)).alias("n_a"),
               F.sum(F.when(F.col("_is_a") == 0, F.col("n")).otherwise(0)).alias("n_b")))
    cum = ranks.cumulative(pc, ["metric", "A", "B"], "value", ["n_a", "n_b"], partitions)
    # doubles: products of counts may pass 64 bits
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    t = a + b
    g = cum.groupBy("metric", "A", "B").agg(
        F.sum("n_a").alias("nA"), F.sum("n_b").alias("nB"),
        F.sum(a * (F.col("cum_n_b") - F.lit(0.5) * b)).alias("u_stat"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    # every (pair, metric) keeps a row even without values (J4): the metric list is fixed at plan time
    grid = pairs.select("*", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    g = grid.join(g, on=["metric", "A", "B"], how="left")
    nA, nB = F.col("nA").cast("double"), F.col("nB").cast("double")
    n = nA + nB
    u = F.greatest(F.col("u_stat"), nA * nB - F.col("u_stat"))
    s = F.sqrt(nA * nB / 12.0 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    g = g.withColumn("_z", (u - nA * nB / 2.0 - 0.5) / s)
    p = (F.when(F.col("nA").isNull() | F.col("nB").isNull() | (F.col("nA") == 0) | (F.col("nB") == 0),
                F.lit(None).cast("double"))
         .when(F.col("_z").isNull() | (F.col("_z") <= 0), F.lit(1.0))
         .otherwise(pv.normal_two_sided("_z")))
    delta = F.when((F.col("nA") > 0) & (F.col("nB") > 0),
                   (F.lit(2.0) * F.col("u_stat") - nA * nB) / (nA * nB))
    return g.select("metric", "A", "B", "a_rank", "b_rank",
                    F.coalesce(F.col("nA"), F.lit(0)).cast("long").alias("nA"),
                    F.coalesce(F.col("nB"), F.lit(0)).cast("long").alias("nB"),
                    "u_stat", p.alias("pvalue"), delta.alias("cliffs_delta"))


def metric_ord(metrics: Sequence[str], col: str = "metric") -> F.Column:
    """Position of the metric in the plan-time metric list."""
    m = F.create_map(*[x for i, name in enumerate(metrics) for x in (F.lit(name), F.lit(i))])
    return m[F.col(col)]


def cliff_magnitude(delta: F.Column) -> F.Column:
    """Negligible / small / medium / large by |delta|."""
    a = F.abs(delta)
    s, m, l_ = CLIFF_BOUNDS
    return (F.when(delta.isNull(), F.lit(None))
            .when(a < s, "negligible").when(a < m, "small").when(a < l_, "medium").otherwise("large"))


def _ordered(tests: DataFrame, p: str, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Tests with ``_pf`` (null p counts as 1), rank ``_rank`` by it and group size ``_m``."""
    x = tests.withColumn("_pf", F.coalesce(F.col(p), F.lit(1.0))).withColumn("_one", F.lit(1))
    x = ranks.scan(x, keys, ["_pf", *order], {"_rank": ("_one", "sum")})
    if not keys:
        return x.withColumn("_m", tests.agg(F.count(F.lit(1)).alias("m")).scalar())
    sizes = tests.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_m"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return x.join(sizes, same).drop(*[f"_k_{k}" for k in keys])


def bh_adjust(tests: DataFrame, p: str = "pvalue", out: str = "pvalue_fdr",
              order: Sequence[str] = ("metric_ord", "a_rank", "b_rank"),
              keys: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg over all rows (or per ``keys``); null p counts as 1.0.

    Ranks and the reversed running minimum of p n / rank are scans over range partitions, so
    any number of tests spreads over tasks. Rows keep their identity, so no reordering back
    is needed (W8).
    """
    x = _ordered(tests, p, order, keys).withColumn("_v", F.col("_pf") * F.col("_m") / F.col("_rank"))
    x = ranks.scan(x, keys, ["_rank"], {"_low": ("_v", "min")}, reverse=True)
    return x.select(*tests.columns, F.least(F.col("_low"), F.lit(1.0)).alias(out))


def holm_adjust(tests: DataFrame, p: str = "pvalue", out: str = "pvalue_holm",
                order: Sequence[str] = ("metric_ord", "a_rank", "b_rank"),
                keys: Sequence[str] = ()) -> DataFrame:
    """Holm-Bonferroni, running max of (J - k + 1) p_(k), capped at 1, per ``keys``."""
    x = _ordered(tests, p, order, keys).withColumn("_v", (F.col("_m") - F.col("_rank") + 1) * F.col("_pf"))
    x = ranks.scan(x, keys, ["_rank"], {"_high": ("_v", "max")})
    return x.select(*tests.columns, F.least(F.col("_high"), F.lit(1.0)).alias(out))


def value_counts_by_scenario(long: DataFrame, scenario: str) -> DataFrame:
    """(metric, scenario, value, n): the reduced form shared by tests and summaries."""
    return long.groupBy("metric", scenario, "value").agg(F.count(F.lit(1)).alias("n"))


def summaries_from_counts(counts: DataFrame, scenario: str, order: DataFrame | None = None,
                          partitions: int | None = None) -> DataFrame:
    """A6/A7/K10 from per-value counts: n, mean, population std (two passes), min,
    quartiles, max for the global scope and each scenario scope."""
    scoped = counts.select("metric", "value", "n", F.explode(F.array(
        F.lit("global"), F.concat(F.lit("scenario:"), F.col(scenario)))).alias("summary_scope"))
    keys = ["metric", "summary_scope"]
    scoped = scoped.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    first = scoped.groupBy(*keys).agg(
        F.sum("n").alias("summary_n"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("summary_mean"),
        F.min("value").alias("summary_min"), F.max("value").alias("summary_max"))
    # second pass for the spread: one row per scope joined back (small side)
    dev = scoped.join(first.select(*keys, "summary_mean"), keys).groupBy(*keys).agg(
        F.sum(F.col("n") * (F.col("value") - F.col("summary_mean")) ** 2).alias("_ss"))
    q = ranks.quantiles_from_counts(scoped, keys, "value", "n", SUMMARY_PROBS,
                                    ["summary_p25", "summary_median", "summary_p75"], partitions).drop("n")
    out = (first.join(dev, keys).withColumn("summary_std", F.sqrt(F.col("_ss") / F.col("summary_n"))).drop("_ss")
           .join(q, keys))
    if order is not None:
        o = order.select(F.concat(F.lit("scenario:"), F.col(scenario)).alias("summary_scope"), "scenario_rank")
        out = out.join(o, on="summary_scope", how="left")
    return out


REPORT_COLUMNS = ("metric", "A", "B", "nA", "nB", "pvalue", "cliffs_delta", "row_type", "pvalue_fdr",
                  "summary_scope", "summary_n", "summary_mean", "summary_std", "summary_min",
                  "summary_p25", "summary_median", "summary_p75", "summary_max")
