"""Sampling and splitting (M1-M5, U2) by hash of a row key.

No operator here gathers a class or a sample into one task: Bernoulli decisions are
per row; the exact-quota stratified split ranks rows inside each class with the
two-phase running counts of ``ranks``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.functions.hashing import SPAN, hash_int, uniform
from driftspark.operators import ranks
from driftspark.operators.windows import REC, REF
from driftspark.session import work_dir

# Seeds of the reference (ref) and recent (rec) samples (M5), and their share.
REF_SEED = 42
REC_SEED = 7
SAMPLE_FRACTION = 0.2
HALF_SPLIT_SEED = 13


def sample_hash(df: DataFrame, key: str, fraction: float = SAMPLE_FRACTION, seed: int = REF_SEED) -> DataFrame:
    """Bernoulli sample by key hash (M1). The detector itself runs on all rows."""
    return df.where(uniform(F.col(key), seed) < F.lit(float(fraction)))


def sample_fixed(df: DataFrame, key: str, n: int, fraction: float = 1.0, seed: int = REF_SEED,
                 partitions: int | None = None) -> DataFrame:
    """The Bernoulli sample, cut to the ``n`` rows with the smallest (key hash, key) (M1, M2).

    ``fraction`` 1 gives a sample of fixed size; fewer rows than ``n`` are all kept. No task holds
    the sample: counts of the hash's leading 16 bits (65,536 rows at most) say in which cell
    the n-th row lies, smaller cells are kept by a filter and only the rows of that one cell are
    ranked, by running counts. Of rows that share the last key, any may be the last ones.
    """
    rows = df.withColumn("_h", hash_int(F.col(key), seed)).withColumn("_cell", F.shiftright("_h", 32))
    rows = rows.where(F.col("_h") < F.lit(int(fraction * SPAN)))
    run = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).select("_cell", "_n", F.sum("_n").over(run).alias("_upto"))
    over = upto.where(F.col("_upto") >= n)
    last = F.coalesce(over.agg(F.min("_cell")).scalar(), F.lit(1 << 16))
    room = n - over.agg(F.min(F.col("_upto") - F.col("_n"))).scalar()
    whole = rows.where(F.col("_cell") < last)
    ordered = rows.where(F.col("_cell") == last).withColumn("_ord", F.struct("_h", F.col(key).alias("k"))).withColumn("_n", F.lit(1).cast("long"))
    part = ranks.cumulative(ordered, ["_cell"], "_ord", ["_n"], partitions).where(F.col("cum__n") <= room)
    return whole.select(*df.columns).unionByName(part.select(*df.columns))


def split_half(df: DataFrame, key: str | None, seed: int = HALF_SPLIT_SEED,
               role: str = "role") -> DataFrame:
    """Disjoint ref/rec halves by key hash (M3); replaces sample + ``subtract``."""
    if key is None:
        raise ValueError("a key column is needed for a reproducible split")
    u = uniform(F.col(key), seed)
    return df.withColumn(role, F.when(u < F.lit(0.5), F.lit(REF)).otherwise(F.lit(REC)))


def stratified_split(df: DataFrame, key: str, label: str, test_fraction: float = 0.2,
                     seed: int = 42, out: str = "is_test",
                     partitions: int | None = None) -> DataFrame:
    """Exact-quota stratified split (M4).

    In each class c, the ceil(f * n_c) rows with the smallest (key hash, key) form the
    test set. Nothing is sorted as a whole: counts of the hash's leading 16 bits (65,536 cells
    a class at most) say in which cell the quota ends, only that cell's rows are ranked, by
    running counts, and every row is then compared with its class's last (key hash, key).
    Rows of one class that share a key stay on one side: a key whose rows do not all fit the
    quota is left to training, so the test part may miss the quota by less than one key.
    Rows without a label are left out; a null key comes first.
    """
    rows = df.withColumn("_h", F.coalesce(hash_int(F.col(key), seed), F.lit(-1).cast("long")))
    work_dir(df.sparkSession)
    rows = rows.checkpoint(eager=True).withColumn("_cell", F.shiftright("_h", 32))  # read three times, hashed once
    run = Window.partitionBy(label).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = rows.where(F.col(label).isNotNull()).groupBy(label, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    quota = F.ceil(F.sum("_n").over(Window.partitionBy(label)) * F.lit(float(test_fraction)))
    cells = cells.select(label, "_cell", (F.sum("_n").over(run) - F.col("_n")).alias("_before"), F.sum("_n").over(run).alias("_upto"), quota.alias("_quota"))
    over = F.min(F.when(F.col("_upto") > F.col("_quota"), F.struct(F.col("_cell").alias("cell"), (F.col("_quota") - F.col("_before")).alias("room"))))
    cut = cells.groupBy(label).agg(over.alias("_cut")).select(
        label, F.coalesce(F.col("_cut.cell"), F.lit(1 << 16).cast("long")).alias("_last"), F.col("_cut.room").alias("_room")).checkpoint(eager=True)
    order = F.struct(F.col("_h").alias("h"), F.col(key).alias("k"))
    part = rows.join(F.broadcast(cut), label).where(F.col("_cell") == F.col("_last"))
    part = part.select(F.col(label), "_room", order.alias("_ord")).withColumn("_n", F.lit(1).cast("long"))
    part = ranks.cumulative(part, [label], "_ord", ["_n"], partitions, ties=True).where(F.col("cum__n") <= F.col("_room"))
    ends = cut.join(part.groupBy(label).agg(F.max("_ord").alias("_end")), label, "left").select(label, "_last", "_end")
    inside = (F.col("_cell") < F.col("_last")) | ((F.col("_cell") == F.col("_last")) & F.coalesce(order <= F.col("_end"), F.lit(False)))
    return rows.join(F.broadcast(ends), label).select(*df.columns, inside.alias(out))


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set difference with distinct semantics (U2); Catalyst plans an anti join."""
    return a.subtract(b)
