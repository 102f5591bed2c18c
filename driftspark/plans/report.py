"""Scenario report (K12, section 3.3): pairs → tests → FDR, stacked with summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.operators import compare as K
from driftspark.operators import ranks
from driftspark.operators.columns import find_column


def scenario_report(runs: DataFrame, scenario: str, metrics: Sequence[str], ordinal: str,
                    fdr: bool = True, partitions: int | None = None) -> DataFrame:
    """Rows of the published report layout: Mann-Whitney rows, then summary rows.

    ``pvalue_fdr`` is filled on test rows when ``fdr`` and some p-value exists. The
    two row kinds are stacked by name with missing columns as null (U1, S9).
    """
    found = find_column(runs, scenario)  # P18: an upper-case header is accepted too
    if found is None:
        raise ValueError(f"no scenario column {scenario!r}")
    if found != scenario:
        runs = runs.withColumnRenamed(found, scenario)
    runs = K.normalise_scenario(runs, scenario)
    order = K.scenario_order(runs, scenario, ordinal)
    pairs = K.scenario_pairs(order, scenario)
    long = K.to_long_metrics(runs, scenario, metrics)
    counts = K.value_counts_by_scenario(long, scenario)
    tests = K.mann_whitney_from_counts(counts, pairs, scenario, metrics, partitions)
    tests = tests.withColumn("metric_ord", K.metric_ord(metrics))
    if fdr:
        tests = K.bh_adjust(tests)
        # BH applies only when some p-value exists
        any_p = F.max(F.col("pvalue").isNotNull().cast("int")).over(Window.partitionBy())
        tests = tests.withColumn("pvalue_fdr", F.when(any_p == 1, F.col("pvalue_fdr")))
    else:
        tests = tests.withColumn("pvalue_fdr", F.lit(None).cast("double"))
    test_rows = tests.select(
        "metric", "A", "B", "nA", "nB", "pvalue", "cliffs_delta",
        F.lit("mannwhitney").alias("row_type"), "pvalue_fdr",
        F.col("metric_ord").alias("_m"), F.lit(0).alias("_kind"), "a_rank", "b_rank")
    summ = K.summaries_from_counts(counts, scenario, order, partitions)
    summ = summ.withColumn("metric_ord", K.metric_ord(metrics))
    summary_rows = summ.select(
        "metric", F.col("summary_scope").alias("A"), F.lit("").alias("B"),
        F.col("summary_n").cast("long").alias("nA"), F.lit(0).cast("long").alias("nB"),
        F.lit(None).cast("double").alias("pvalue"), F.lit(None).cast("double").alias("cliffs_delta"),
        F.lit("summary").alias("row_type"), "summary_scope",
        F.col("summary_n").cast("long").alias("summary_n"), "summary_mean", "summary_std", "summary_min",
        "summary_p25", "summary_median", "summary_p75", "summary_max",
        F.col("metric_ord").alias("_m"), F.lit(1).alias("_kind"),
        F.coalesce(F.col("scenario_rank"), F.lit(0)).alias("a_rank"), F.lit(0).alias("b_rank"))
    out = test_rows.unionByName(summary_rows, allowMissingColumns=True)
    # tests by (metric, pair); summaries by (scope, metric), as in the published file
    k2 = F.when(F.col("_kind") == 0, F.col("_m")).otherwise(F.col("a_rank"))
    k3 = F.when(F.col("_kind") == 0, F.col("a_rank")).otherwise(F.col("_m"))
    return out.orderBy("_kind", k2, k3, "b_rank").select(*K.REPORT_COLUMNS)
