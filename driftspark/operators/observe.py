"""Observability queries over cycle and run tables.

Range frames over a whole history would put one model (or the whole table) into one
task, so they are written as fan-outs on the cycle grid: a cycle contributes to the
L = horizon/step windows that contain it, and each window is a bounded group of at
most L cycles. "Previous row" lookups (lag) use row numbers from the two-phase running
counts and an equi-join on (keys, row number - 1).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.operators import ranks


def _idx(ts: Column, step_s: int) -> Column:
    return (F.unix_seconds(ts.cast("timestamp")) / F.lit(step_s)).cast("long")


def trailing(cycles: DataFrame, keys: Sequence[str], cycle: str, step: dt.timedelta,
             horizon: dt.timedelta, value: str, how: str = "sum", q: float = 0.95,
             out: str | None = None) -> DataFrame:
    """Aggregate of ``value`` over the cycles in (t - horizon, t] for every grid cycle t
    present in ``cycles`` (O1 with how="sum", O2 with how="percentile").

    Sums of whole numbers and decimals are differences of running sums, two rows a cycle
    however many cycles the horizon has. Other aggregates, and sums of doubles (differences
    would lose digits), copy each cycle to the windows that hold it. One row per key and cycle;
    null keys are a group of their own; a window without values gives null.
    """
    step_s = int(step.total_seconds())
    lag_n = max(int(horizon.total_seconds()) // step_s, 1)
    out = out or f"{how}_{value}"
    base = cycles.select(*keys, _idx(F.col(cycle), step_s).alias("_i"), F.col(value).alias("_v"))
    if how == "sum" and isinstance(cycles.schema[value].dataType, (T.IntegralType, T.DecimalType)):
        return _trailing_sum(base, keys, lag_n).select(*keys, F.timestamp_seconds(F.col("_i") * step_s).alias(cycle), F.col("_sum").alias(out))
    fan = base.select(*keys, "_i", "_v", F.explode(F.sequence(F.col("_i"), F.col("_i") + lag_n - 1)).alias("_e"))
    if how == "sum":
        agg = F.sum("_v")
    elif how == "percentile":
        agg = F.percentile(F.col("_v"), F.lit(q))  # groups hold at most L values
    elif how == "max":
        agg = F.max("_v")
    else:
        raise ValueError(how)
    here = F.max("_here").alias("_here")
    fan = fan.withColumn("_here", F.col("_e") == F.col("_i"))
    g = fan.groupBy(*keys, "_e").agg(agg.alias(out), here).where("_here")
    return g.select(*keys, F.timestamp_seconds(F.col("_e") * step_s).alias(cycle), out)


def _trailing_sum(base: DataFrame, keys: Sequence[str], lag_n: int) -> DataFrame:
    """(keys, _i, _sum): the running sum at a cycle less the one ``lag_n`` cycles earlier."""
    one = base.groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"), F.count("_v").alias("_n"))
    ends = F.array(F.struct(F.col("_i").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("_i") - lag_n).alias("at"), F.lit(-1).alias("sign")))
    rows = one.select("*", F.explode(ends).alias("_end")).select(*keys, "_i", "_end.*", "_v", "_n")
    own = F.col("sign") == 1
    # at one point the cycle itself comes first, so that the window that begins after it leaves it out
    rows = rows.select(*keys, "_i", "at", "sign", (-F.col("sign")).alias("_last"), F.when(own, F.col("_v")).alias("_v"), F.when(own, F.col("_n")).otherwise(0).alias("_n"))
    run = ranks.scan(rows, keys, ["at", "_last"], {"_cv": ("_v", "sum"), "_cn": ("_n", "sum")})
    g = run.groupBy(*keys, "_i").agg(F.sum(F.col("sign") * F.coalesce("_cv", F.lit(0))).alias("_sum"), F.sum(F.col("sign") * F.col("_cn")).alias("_n"))
    return g.select(*keys, "_i", F.when(F.col("_n") > 0, F.col("_sum")).alias("_sum"))


def first_detection(cycles: DataFrame, keys: Sequence[str], cycle: str, flag: str, step: dt.timedelta,
                    horizon: dt.timedelta, out: str = "first_detection") -> DataFrame:
    """O3: for every cycle t, the first flagged cycle in [t, t + horizon] (or null)."""
    step_s = int(step.total_seconds())
    lead_n = int(horizon.total_seconds()) // step_s
    base = cycles.select(*keys, _idx(F.col(cycle), step_s).alias("_i"), F.col(flag).cast("boolean").alias("_f"))
    hits = base.where("_f").select(*keys, "_i", F.explode(
        F.sequence(F.col("_i") - lead_n, F.col("_i"))).alias("_s"))
    g = hits.groupBy(*keys, "_s").agg(F.min("_i").alias("_first"))
    return (base.select(*keys, F.col("_i").alias("_s")).join(g, on=[*keys, "_s"], how="left")
            .select(*keys, F.timestamp_seconds(F.col("_s") * step_s).alias(cycle),
                    F.timestamp_seconds(F.col("_first") * step_s).alias(out)))


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
                  prefix: str = "prev_") -> DataFrame:
    """Lag by one row inside ``keys`` ordered by ``order`` (which must be unique).

    Row numbers come from the two-phase running counts (a dominant key is spread over
    many tasks); the previous row is found by an equi-join on the row number.
    """
    keys = list(keys)
    o = F.struct(*[F.col(c) for c in order]).alias("_o")
    x = df.select("*", o)
    counts = x.groupBy(*keys, "_o").agg(F.count(F.lit(1)).alias("_n"))
    rn = ranks.cumulative(counts, keys, "_o", ["_n"]).select(*keys, "_o", F.col("cum__n").alias("_rn"))
    x = x.join(rn, on=[*keys, "_o"])
    prev = x.select(*keys, (F.col("_rn") + 1).alias("_rn"), *[F.col(c).alias(prefix + c) for c in cols])
    return x.join(prev, on=[*keys, "_rn"], how="left").drop("_o", "_rn")


def transitions(runs: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, stage: str,
                from_stage: str, to_stage: str) -> DataFrame:
    """Gaps (seconds) from the last ``from_stage`` run to the next ``to_stage`` run."""
    x = with_previous(runs, keys, order, [stage, ts])
    t = x.where((F.col("prev_" + stage) == from_stage) & (F.col(stage) == to_stage))
    return t.select(*keys, F.col(ts).alias("detected_at"),
                    (F.unix_micros(F.col(ts).cast("timestamp"))
                     - F.unix_micros(F.col("prev_" + ts).cast("timestamp"))).cast("double").alias("gap_us"))


def pre_post(runs: DataFrame, build: Sequence[str], stage: str, ts: str,
             stages: tuple[str, str] = ("pre", "post")) -> DataFrame:
    """One row per build with the pre and post times (pivot); an unpaired pre is a
    failed run. Duration = post - pre in seconds (O5)."""
    pre, post = stages
    p = (runs.where(F.col(stage).isin(pre, post)).groupBy(*build).pivot(stage, [pre, post])
         .agg(F.min(ts).alias("first"), F.max(ts).alias("last")))
    return p.select(*build, F.col(f"{pre}_first").alias(pre), F.col(f"{post}_last").alias(post),
                    ((F.unix_micros(F.col(f"{post}_last").cast("timestamp"))
                      - F.unix_micros(F.col(f"{pre}_first").cast("timestamp"))) / 1e6).alias("duration_s"),
                    (F.col(f"{pre}_first").isNotNull() & F.col(f"{post}_last").isNull()).alias("failed"))


def stage_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, exact p95 and max per key (p95 from the running counts)."""
    simple = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"),
                                   F.count(value).alias("n"))
    q = ranks.exact_quantiles(df, keys, value, [0.95], ["p95"]).drop("n")
    return simple.join(q, on=list(keys), how="left")


# --- S13 resource samples ------------------------------------------------------------

# Memory units of the container statistics, in MiB.
MEM_UNITS_MIB = {"B": 1.0 / (1024 * 1024), "KiB": 1.0 / 1024, "MiB": 1.0, "GiB": 1024.0, "TiB": 1024.0 * 1024,
                 "kB": 1000.0 / (1024 * 1024), "MB": 1e6 / (1024 * 1024), "GB": 1e9 / (1024 * 1024)}


def _mem_mib(text: Column) -> Column:
    num = F.regexp_extract(text, r"^\s*([0-9.]+)", 1).cast("double")
    unit = F.regexp_extract(text, r"([A-Za-z]+)\s*$", 1)
    m = F.create_map(*[x for k, v in MEM_UNITS_MIB.items() for x in (F.lit(k), F.lit(v))])
    return num * m[unit]


def parse_resource(sample: Column) -> Column:
    """``"cpu%,used / limit,mem%"`` → struct(cpu_perc, mem_used_mb, mem_limit_mb,
    mem_perc), with memory converted to MiB by unit (G11: a GiB limit is not MiB)."""
    parts = F.split(sample, ",")
    mem = F.split(F.element_at(parts, 2), "/")
    pct = lambda c: F.regexp_extract(c, r"([0-9.]+)\s*%", 1).cast("double")
    return F.struct(pct(F.element_at(parts, 1)).alias("cpu_perc"),
                    _mem_mib(F.element_at(mem, 1)).alias("mem_used_mb"),
                    _mem_mib(F.element_at(mem, 2)).alias("mem_limit_mb"),
                    pct(F.element_at(parts, 3)).alias("mem_perc"))


def scenario_tag(s: Column) -> Column:
    """Lower case, spaces → '_', keep [a-z0-9._-], empty → 'manual'."""
    t = F.regexp_replace(F.regexp_replace(F.lower(s), " ", "_"), r"[^a-z0-9._-]", "")
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("manual")).otherwise(t)


def coerce_numeric(c: Column) -> Column:
    """Text → double, unparsable → null."""
    return c.try_cast("double")
