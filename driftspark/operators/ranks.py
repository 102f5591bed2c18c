"""Exact running counts over a globally ordered value, without one task per group.

KS, mid-ranks, Mann-Whitney U, Cliff's delta, AUC and exact quantiles all need, for
each distinct value of a group, how many values of each role lie at or below it. A
window ``partitionBy(group).orderBy(value)`` would put a whole group into one task,
and a single group (one column, one scenario) may hold a third of all rows. The
plan here is two-phase:

1. ``value_counts``: one row per (group, value) with a count per role; partial
   aggregation folds ties and hot values before the shuffle.
2. A range shuffle on (group, value): Spark samples the bounds and places every
   row with its own binary search, so a dominant group spans many partitions and
   equal values stay together. The range partition id is a bucket that is monotone
   in (group, value).
3. Inside a bucket, a window ``partitionBy(bucket, group).orderBy(value)`` gives the
   local running sums and the bucket totals.
4. Bucket totals (one row per group and bucket) get running offsets by a window over
   that small table and are joined back on (group, bucket).

The result is exact; the bounds only decide balance. A task holds one range
partition, i.e. about (distinct values) / (shuffle partitions) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.session import work_dir



def value_counts(df: DataFrame, keys: Sequence[str], value: str, role: str,
                 roles: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """(keys..., value, n_<role>...) with one row per distinct value of each group."""
    names = list(names or [f"n_{r}" for r in roles])
    aggs = [F.count_if(F.col(role) == F.lit(r)).alias(n) for r, n in zip(roles, names)]
    return (df.where(F.col(value).isNotNull())
            .groupBy(*keys, value).agg(*aggs))


def cumulative(counts: DataFrame, keys: Sequence[str], value: str, count_cols: Sequence[str],
               partitions: int | None = None, ties: bool = False) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running count) and ``tot_<c>`` (group total).

    ``counts`` must hold one row per (keys, value), as produced by ``value_counts``.
    A range shuffle on (keys, value) gives every row a monotone bucket (its range
    partition): Spark samples the bounds and assigns rows with its own binary search,
    so a dominant group spans many partitions. Bucket totals (one row per group and
    partition) get running offsets; rows add their offset to the running sum inside
    the bucket. ``partitions`` fixes the number of range partitions; by default the
    session's shuffle partition count applies (and AQE may coalesce adjacent ones,
    which keeps the order). With ``ties``, rows may share a value: each then has the running
    count up to and including all of them.
    """
    keys = list(keys)
    n = partitions
    r = counts.repartitionByRange(n, *keys, value) if n else counts.repartitionByRange(*keys, value)
    b = r.withColumn("_bucket", F.spark_partition_id())
    w_local = Window.partitionBy("_bucket", *keys).orderBy(value)
    between = w_local.rangeBetween if ties else w_local.rowsBetween
    w_local = between(Window.unboundedPreceding, Window.currentRow)
    w_part = Window.partitionBy("_bucket", *keys)
    local = b.select("*", *[F.sum(c).over(w_local).alias(f"_l_{c}") for c in count_cols],
                     *[F.sum(c).over(w_part).alias(f"_t_{c}") for c in count_cols])
    # The range bounds are sampled from shuffle output whose read order is not fixed, so
    # two evaluations of ``local`` may bucket rows differently. It is used twice (rows and
    # bucket totals), hence written once to the shared checkpoint folder; a lost executor
    # then re-reads that copy.
    work_dir(counts.sparkSession)
    local = local.checkpoint(eager=True)
    totals = local.groupBy(*keys, "_bucket").agg(*[F.max(f"_t_{c}").alias(f"_t_{c}") for c in count_cols])
    w_run = Window.partitionBy(*keys).orderBy("_bucket")
    w_all = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys, "_bucket",
        *[(F.sum(f"_t_{c}").over(w_run) - F.col(f"_t_{c}")).alias(f"_o_{c}") for c in count_cols],
        *[F.sum(f"_t_{c}").over(w_all).alias(f"tot_{c}") for c in count_cols],
    )
    j = local.join(offsets, on=[*keys, "_bucket"], how="inner")
    keep = [c for c in counts.columns]
    return j.select(*keep, *[F.col(f"tot_{c}") for c in count_cols],
                    *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"cum_{c}") for c in count_cols])


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], running: dict[str, tuple[str, str]],
         exclusive: bool = False, reverse: bool = False, partitions: int | None = None) -> DataFrame:
    """Running ``sum``, ``max`` or ``min`` over all rows of a group in the order of columns.

    ``running``: new column -> (column, operation). The same plan as ``cumulative``, for any
    associative operation: a range shuffle on (keys, order), running values inside a bucket,
    bucket totals combined in order (one row per group and bucket), and each row joined with
    what the buckets before it hold. ``reverse`` runs from the last row to the first,
    ``exclusive`` leaves the row itself out (null where nothing is before it). Rows equal in
    all of ``order`` have no defined order among themselves.
    """
    keys, order = list(keys), list(order)
    r = df.repartitionByRange(partitions, *keys, *order) if partitions else df.repartitionByRange(*keys, *order)
    b = r.withColumn("_bucket", F.spark_partition_id())
    by = [F.desc(c) if reverse else F.asc(c) for c in order]
    last = -1 if exclusive else Window.currentRow
    local = Window.partitionBy("_bucket", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, last)
    whole = Window.partitionBy("_bucket", *keys)
    fn = {"sum": F.sum, "max": F.max, "min": F.min}
    both = {"sum": lambda x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x + y), "max": lambda x, y: F.greatest(x, y), "min": lambda x, y: F.least(x, y)}
    b = b.select("*", *[fn[op](c).over(local).alias(f"_l_{n}") for n, (c, op) in running.items()],
                 *[fn[op](c).over(whole).alias(f"_t_{n}") for n, (c, op) in running.items()])
    work_dir(df.sparkSession)
    b = b.checkpoint(eager=True)  # buckets of two evaluations may differ, see ``cumulative``
    totals = b.groupBy(*keys, "_bucket").agg(*[F.max(f"_t_{n}").alias(f"_t_{n}") for n in running])
    before = Window.partitionBy(*keys).orderBy(F.desc("_bucket") if reverse else F.asc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"),
                            *[fn[op](f"_t_{n}").over(before).alias(f"_o_{n}") for n, (c, op) in running.items()])
    same = F.col("_bucket") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = [both[op](F.col(f"_o_{n}"), F.col(f"_l_{n}")).alias(n) for n, (c, op) in running.items()]
    return b.join(offsets, same).select(*df.columns, *out)


def cumulative_one_phase(counts: DataFrame, keys: Sequence[str], value: str,
                         count_cols: Sequence[str]) -> DataFrame:
    """Reference formulation (one task per group). Used only to test ``cumulative``."""
    w = (Window.partitionBy(*keys).orderBy(value)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    w_all = Window.partitionBy(*keys)
    return counts.select(
        "*",
        *[F.sum(c).over(w_all).alias(f"tot_{c}") for c in count_cols],
        *[F.sum(c).over(w).alias(f"cum_{c}") for c in count_cols],
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str] | None = None,
                    partitions: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles (numpy/pandas 'linear', DuckDB quantile_cont).

    Built on the running counts, so no group is gathered into one task (Spark's
    exact ``percentile`` keeps every distinct value of a group in one buffer).
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
              .agg(F.count(F.lit(1)).alias("_n")))
    return quantiles_from_counts(counts, keys, value, "_n", probs, names, partitions)


def quantiles_from_counts(counts: DataFrame, keys: Sequence[str], value: str, count_col: str,
                          probs: Sequence[float], names: Sequence[str] | None = None,
                          partitions: int | None = None) -> DataFrame:
    """Quantiles from (keys..., value, count) rows; rows with count 0 are ignored."""
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    keys = list(keys)
    counts = counts.where(F.col(count_col) > 0).select(*keys, value, F.col(count_col).alias("_n"))
    cum = cumulative(counts, keys, value, ["_n"], partitions)
    cum = cum.withColumn("_before", F.col("cum__n") - F.col("_n"))
    aggs = []
    for p, name in zip(probs, names):
        h = (F.col("tot__n") - 1) * F.lit(float(p))
        lo = F.floor(h)
        hi = F.ceil(h)
        at = lambda r: (F.col("_before") <= r) & (F.col("cum__n") > r)
        aggs.append(F.min(F.when(at(lo), F.col(value))).alias(f"_lo_{name}"))
        aggs.append(F.min(F.when(at(hi), F.col(value))).alias(f"_hi_{name}"))
        aggs.append(F.max(h - lo).alias(f"_fr_{name}"))
    agg = cum.groupBy(*keys).agg(F.max("tot__n").alias("n"), *aggs)
    return agg.select(
        *keys, "n",
        *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")).alias(n)
          for n in names],
    )
