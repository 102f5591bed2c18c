"""Two-sample distances beside the tests of ``detectors``: energy distance and MMD.

Both work on per-value counts (keys..., value, n_ref, n_rec), so ties and hot values fold
before any shuffle, and neither writes a pair of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.functions.hashing import uniform
from driftspark.operators import ranks

# Number of random frequencies, and the seeds of their draws.
FREQUENCIES = 128
SEEDS = (101, 102)


def energy_from_counts(counts: DataFrame, keys: Sequence[str], value: str = "value",
                       partitions: int | None = None) -> DataFrame:
    """Energy distance 2 E|X - Y| - E|X - X'| - E|Y - Y'|: n_ref, n_rec, energy per group.

    All three means are taken over all pairs (a row with itself included). With running
    counts N(v) and running sums S(v) up to a value, the pairs of v with all values below
    it add up to v N(v) - S(v): weighted prefix sums on the range partitions replace the
    pairs. Values are first moved by the group's least value, which changes no distance.
    Null where a side is empty.
    """
    keys = list(keys)
    least = counts.groupBy(*keys).agg(F.min(value).alias("_least"))
    x = counts.where(F.col(value).isNotNull()).join(least, keys) if keys else counts.where(F.col(value).isNotNull()).withColumn("_least", least.scalar())
    v = F.col(value).cast("double") - F.col("_least")
    x = x.select(*keys, v.alias("_v"), *[F.col(c).cast("double").alias(c) for c in ("n_ref", "n_rec")],
                 (F.col("n_ref") * v).alias("_s_ref"), (F.col("n_rec") * v).alias("_s_rec"))
    cum = ranks.cumulative(x, keys, "_v", ["n_ref", "n_rec", "_s_ref", "_s_rec"], partitions)
    below = lambda side: F.col("_v") * F.col(f"cum_n_{side}") - F.col(f"cum__s_{side}")
    a, b = F.col("n_ref"), F.col("n_rec")
    g = cum.groupBy(*keys).agg(F.max("tot_n_ref").alias("_n"), F.max("tot_n_rec").alias("_m"),
                               F.sum(a * below("rec") + b * below("ref")).alias("_xy"),
                               F.sum(a * below("ref")).alias("_xx"), F.sum(b * below("rec")).alias("_yy"))
    n, m = F.col("_n"), F.col("_m")
    energy = 2 * F.try_divide("_xy", n * m) - 2 * F.try_divide("_xx", n * n) - 2 * F.try_divide("_yy", m * m)
    return g.select(*keys, n.cast("long").alias("n_ref"), m.cast("long").alias("n_rec"), F.when(energy.isNotNull(), F.greatest(energy, F.lit(0.0))).alias("energy"))


def frequency(j: Column) -> Column:
    """Standard normal draw number ``j``: Box-Muller on two hash uniforms, alike in both engines."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(j, SEEDS[0])))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(j, SEEDS[1]))


def mmd_from_counts(counts: DataFrame, keys: Sequence[str], value: str = "value", frequencies: int = FREQUENCIES) -> DataFrame:
    """Squared maximum mean discrepancy under the kernel exp(-(x - y)^2 / (2 sigma^2)):
    n_ref, n_rec, sigma, mmd2, mmd2_se per group.

    Random Fourier features: with frequencies w drawn from N(0, 1 / sigma^2) the kernel is the
    mean of cos(w (x - y)), so mmd2 is the mean over w of the squared differences of the
    sides' mean cosines and sines. Frequencies are hashes of their number, the same for
    every group and run. ``mmd2_se`` is the standard error of that mean over the drawn
    frequencies: the exact value (all pairs, a row with itself included) lies within about
    three of them. sigma is the pooled standard deviation; null where it is 0 or a side is empty.
    """
    keys = list(keys)
    x = counts.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), *[F.col(c).cast("double").alias(c) for c in ("n_ref", "n_rec")])
    w = F.col("n_ref") + F.col("n_rec")
    mean = x.groupBy(*keys).agg((F.sum(w * F.col("_v")) / F.sum(w)).alias("_mean"), F.sum("n_ref").alias("_n"), F.sum("n_rec").alias("_m"))
    x = x.join(mean, keys)
    spread = x.groupBy(*keys).agg(F.sqrt(F.sum(w * (F.col("_v") - F.col("_mean")) ** 2) / F.sum(w)).alias("sigma"))
    x = x.join(spread, keys).where(F.col("sigma") > 0)
    waves = F.transform(F.sequence(F.lit(1), F.lit(frequencies)), lambda j: F.struct(j.alias("j"), frequency(j).alias("w")))
    drawn = x.sparkSession.range(1).select(F.explode(waves).alias("f")).select("f.j", "f.w").collect()  # the frequencies
    table = F.array(*[F.struct(F.lit(r.j).alias("j"), F.lit(r.w).alias("w")) for r in drawn])
    z = (F.col("_v") - F.col("_mean")) / F.col("sigma")
    each = x.select(*keys, "n_ref", "n_rec", "_n", "_m", "sigma", z.alias("_z"), F.explode(table).alias("f"))
    angle = F.col("_z") * F.col("f.w")
    part = lambda side, fn: F.sum(F.col(f"n_{side}") * fn(angle))
    per = each.groupBy(*keys, "f.j").agg(F.max("_n").alias("_n"), F.max("_m").alias("_m"), F.max("sigma").alias("sigma"),
                                         part("ref", F.cos).alias("rc"), part("ref", F.sin).alias("rs"), part("rec", F.cos).alias("cc"), part("rec", F.sin).alias("cs"))
    gap = lambda a, b: F.pow(F.try_divide(a, "_n") - F.try_divide(b, "_m"), F.lit(2.0))
    per = per.withColumn("_d", gap("rc", "cc") + gap("rs", "cs"))
    g = per.groupBy(*keys).agg(F.max("sigma").alias("sigma"), F.avg("_d").alias("mmd2"), (F.stddev_samp("_d") / F.sqrt(F.count("_d"))).alias("mmd2_se"))
    sizes = mean.select(*keys, F.col("_n").cast("long").alias("n_ref"), F.col("_m").cast("long").alias("n_rec"))
    return sizes.join(g, keys, "left").select(*keys, "n_ref", "n_rec", "sigma", "mmd2", "mmd2_se")
