"""The monitoring cycle as one Spark plan (section 3.1 of the blueprint).

``snapshot`` is one poll: the two windows before ``now``, every numeric column by KS,
every string column by chi-squared, PSI and positive ratio on the score column, and
the verdict. ``cycle_tests`` replays the poll over a whole table: cycle ends on a
grid every ``step``; counts are reduced on step-wide panes before the fan-out to the
2W/step cycles that contain each pane.

Nothing is collected: column lists come from the schema at plan time and every
statistic is a grouped aggregate keyed by (cycle, column).
"""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.operators import columns as C
from driftspark.operators import detectors as D
from driftspark.operators import ranks, windows


@dataclass
class MonitorConfig:
    """Knobs of the monitored loop; defaults are the loop's defaults."""
    alpha: float = D.ALPHA
    psi_alert: float = D.PSI_ALERT
    psi_bins: int = D.PSI_BINS
    psi_eps: float = D.PSI_EPS
    min_n_test: int = D.MIN_N_TEST
    min_n_psi: int = D.MIN_N_PSI
    positive_threshold: float = D.POSITIVE_THRESHOLD
    score_col: str = "score"
    null_policy: str = "per_column"
    out_of_range: str = "drop"
    exclude: Sequence[str] = field(default_factory=tuple)
    yates: bool = True
    adjust: str | None = None  # G15: None (raw p, as the loop does), "holm" or "bh" per cycle


def _adjusted(tests: DataFrame, keys: Sequence[str], cfg: "MonitorConfig") -> DataFrame:
    """Optionally replace p by its Holm or BH adjustment over the columns of a cycle."""
    from driftspark.operators import compare as K
    if cfg.adjust is None:
        return tests
    if cfg.adjust == "holm":
        x = K.holm_adjust(tests, "p_value", "_adj", order=["column_name"], keys=list(keys))
    elif cfg.adjust == "bh":
        x = K.bh_adjust(tests, "p_value", "_adj", order=["column_name"], keys=list(keys))
    else:
        raise ValueError(cfg.adjust)
    return x.withColumn("p_raw", F.col("p_value")).withColumn("p_value", F.col("_adj")).drop("_adj")


def _roles(df: DataFrame, cfg: MonitorConfig, skip, numeric, categorical) -> C.Roles:
    """Column roles with the G2 warning: an assumed score column is reported."""
    found = C.roles(df, skip, cfg.score_col, numeric, categorical)
    if found.assumed:
        warnings.warn(f"score column {cfg.score_col!r} not found; PSI and positive ratio use {found.score!r}",
                      stacklevel=3)
    return found


TESTS = {"column_name": "string", "test": "string", "n_ref": "long", "n_rec": "long", "stat": "double", "p_value": "double"}


def _stacked(parts: Sequence[DataFrame], like: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All test rows; none, with the same columns, for a table without a testable column."""
    if not parts:
        return like.select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in TESTS.items()]).limit(0)
    return reduce(DataFrame.unionByName, parts)


def _numeric_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], policy: str) -> DataFrame:
    return C.to_long(df, ids, cols, "double", "column_name", "value", policy)


def _string_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], policy: str) -> DataFrame:
    return C.to_long(df, ids, cols, "string", "column_name", "value", policy)


def snapshot_frames(roled: DataFrame, cfg: MonitorConfig, keys: Sequence[str] = (),
                    numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None,
                    score: str | None = "auto") -> dict[str, DataFrame]:
    """Detectors on a frame that already carries ``role`` (ref/rec) and ``keys``.

    Returns ``tests`` (keys, column_name, test, n_ref, n_rec, stat, p_value, drift),
    ``psi`` (keys, score_col, psi, kl...), ``pos_ratio`` and ``verdict``.
    """
    keys = list(keys)
    skip = set(cfg.exclude) | set(keys) | {"role"}
    found = _roles(roled, cfg, skip, numeric, categorical)
    num, cat = found.numeric, found.categorical
    ids = [*keys, "role"]
    gk = [*keys, "column_name"]
    parts = []
    if num:
        ks = D.ks_test(_numeric_long(roled, ids, num, cfg.null_policy), gk, min_n=cfg.min_n_test)
        parts.append(ks.select(*gk, F.lit("ks").alias("test"), "n_ref", "n_rec",
                               F.col("ks_d").alias("stat"), D.gated("ks_p", 1.0).alias("p_value")))
    if cat:
        ch = D.chi2_test(_string_long(roled, ids, cat, cfg.null_policy), gk, min_n=cfg.min_n_test,
                         yates=cfg.yates)
        parts.append(ch.select(*gk, F.lit("chi2").alias("test"), "n_ref", "n_rec",
                               F.col("chi2").alias("stat"), D.gated("chi2_p", 1.0).alias("p_value")))
    tests = _adjusted(_stacked(parts, roled, keys), keys, cfg).withColumn("drift", F.col("p_value") < cfg.alpha)

    if score == "auto":
        score = found.score
    psi_df = None
    if score is not None:
        long = _numeric_long(roled, ids, [score], cfg.null_policy)
        psi_df = (D.psi(long, gk, bins=cfg.psi_bins, eps=cfg.psi_eps, min_n=cfg.min_n_psi,
                        out_of_range=cfg.out_of_range).withColumn("psi", D.gated("psi", 0.0))
                  .withColumnRenamed("column_name", "score_col"))
        pos = D.positive_ratio(roled, keys, score, threshold=cfg.positive_threshold)
    else:
        pos = D.positive_ratio(roled, keys, None, binary_cols=found.binary)
    pvals = tests.select(*keys, "column_name", F.col("p_value").alias("p"))
    psi_key = psi_df.select(*keys, "psi") if psi_df is not None else None
    verdict = D.verdict(pvals, psi_key, keys, cfg.alpha, cfg.psi_alert)
    return {"tests": tests, "psi": psi_df, "pos_ratio": pos, "verdict": verdict}


def snapshot(df: DataFrame, ts: str | None, now: dt.datetime | str, width: dt.timedelta,
             cfg: MonitorConfig | None = None, key: str | None = None, **kw) -> dict[str, DataFrame]:
    """One poll at ``now`` over ref = [now-2W, now-W) and rec = [now-W, inf); halves by the hash
    of ``key`` where the table has no column ``ts`` (P6). Without a testable column there are no
    tests and the verdict is false."""
    cfg = cfg or MonitorConfig()
    roled = windows.split_roles(df, ts, now, width, key)
    cfg = replace(cfg, exclude=(*cfg.exclude, *[c for c in (ts, key) if c]))
    return snapshot_frames(roled, cfg, **kw)


def pane_counts(df: DataFrame, ts: str, cols: Sequence[str], value_type: str, step: dt.timedelta,
                origin=None, null_policy: str = "per_column") -> DataFrame:
    """(_pane, column_name, value, _n): counts per step-wide pane, column and value."""
    panes = df.select(windows.pane_index(F.col(ts), step, origin).alias("_pane"), *cols)
    long = C.to_long(panes, ["_pane"], cols, value_type, "column_name", "value", null_policy)
    return long.groupBy("_pane", "column_name", "value").agg(F.count(F.lit(1)).alias("_n"))


def counts_from_panes(pc: DataFrame, width: dt.timedelta, step: dt.timedelta, origin=None) -> DataFrame:
    """Pane counts → (cycle_end, column_name, value, n_ref, n_rec) for every cycle."""
    fan = windows.fan_out_cycles(pc, "_pane", width, step, origin)
    return (fan.groupBy("cycle_end", "column_name", "value")
               .agg(F.sum(F.when(F.col("role") == windows.REF, F.col("_n")).otherwise(0)).alias("n_ref"),
                    F.sum(F.when(F.col("role") == windows.REC, F.col("_n")).otherwise(0)).alias("n_rec")))


def cycle_counts(df: DataFrame, ts: str, cols: Sequence[str], value_type: str,
                 width: dt.timedelta, step: dt.timedelta, origin=None,
                 null_policy: str = "per_column") -> DataFrame:
    """(cycle_end, column_name, value, n_ref, n_rec) for every cycle of the table.

    Counts are taken per (pane, column, value) first; each pane row then fans out to
    its 2W/step cycles and is summed again, so the fan-out multiplies aggregated rows.
    """
    return counts_from_panes(pane_counts(df, ts, cols, value_type, step, origin, null_policy),
                             width, step, origin)


def tests_from_cycle_counts(num_counts: DataFrame | None, cat_counts: DataFrame | None,
                            score_counts: DataFrame | None, cfg: MonitorConfig) -> dict[str, DataFrame]:
    """KS / chi-squared / PSI and the verdict from per-cycle counts (batch or streaming)."""
    gk = ["cycle_end", "column_name"]
    parts = []
    if num_counts is not None:
        ks = D.ks_from_counts(num_counts, gk, "value", cfg.min_n_test)
        parts.append(ks.select(*gk, F.lit("ks").alias("test"), "n_ref", "n_rec",
                               F.col("ks_d").alias("stat"), D.gated("ks_p", 1.0).alias("p_value")))
    if cat_counts is not None:
        ch = D.chi2_from_counts(cat_counts, gk, "value", cfg.min_n_test, cfg.yates)
        parts.append(ch.select(*gk, F.lit("chi2").alias("test"), "n_ref", "n_rec",
                               F.col("chi2").alias("stat"), D.gated("chi2_p", 1.0).alias("p_value")))
    if not parts:
        raise ValueError("no numeric and no string columns to test")
    tests = parts[0]
    for p in parts[1:]:
        tests = tests.unionByName(p)
    tests = _adjusted(tests, ["cycle_end"], cfg).withColumn("drift", F.col("p_value") < cfg.alpha)
    psi_df = pos = None
    if score_counts is not None:
        pos = D.positive_from_counts(score_counts, ["cycle_end", "column_name"], "value", cfg.positive_threshold)
        psi_df = (D.psi_from_counts(score_counts, gk, "value", cfg.psi_bins, cfg.psi_eps, cfg.min_n_psi,
                                    cfg.out_of_range).withColumn("psi", D.gated("psi", 0.0))
                  .withColumnRenamed("column_name", "score_col"))
    pvals = tests.select("cycle_end", "column_name", F.col("p_value").alias("p"))
    verdict = D.verdict(pvals, psi_df.select("cycle_end", "psi") if psi_df is not None else None,
                        ["cycle_end"], cfg.alpha, cfg.psi_alert)
    return {"tests": tests, "psi": psi_df, "pos_ratio": pos, "verdict": verdict}


def cycle_tests(df: DataFrame, ts: str, width: dt.timedelta, step: dt.timedelta,
                cfg: MonitorConfig | None = None, numeric: Sequence[str] | None = None,
                categorical: Sequence[str] | None = None, score: str | None = "auto",
                origin=None) -> dict[str, DataFrame]:
    """Replay of the loop over all cycles; keyed by ``cycle_end``."""
    cfg = cfg or MonitorConfig()
    skip = set(cfg.exclude) | {ts}
    found = _roles(df, cfg, skip, numeric, categorical)
    num, cat = found.numeric, found.categorical
    if score == "auto":
        score = found.score
    nc = cycle_counts(df, ts, num, "double", width, step, origin, cfg.null_policy) if num else None
    cc = cycle_counts(df, ts, cat, "string", width, step, origin, cfg.null_policy) if cat else None
    sc = (cycle_counts(df, ts, [score], "double", width, step, origin, cfg.null_policy)
          if score is not None else None)
    return tests_from_cycle_counts(nc, cc, sc, cfg)


def metrics_long(tests: DataFrame, psi_df: DataFrame | None, keys: Sequence[str],
                 model: str = "fraud", scenario: str = "", pos: DataFrame | None = None) -> DataFrame:
    """Long ``metrics(keys..., scenario, model, metric, column, value)`` rows."""
    keys = list(keys)
    p = tests.select(*keys, F.lit(scenario).alias("scenario"), F.lit(model).alias("model"),
                     F.lit("pvalue").alias("metric"), F.col("column_name").alias("column"),
                     F.col("p_value").alias("value"))
    d = tests.select(*keys, F.lit(scenario).alias("scenario"), F.lit(model).alias("model"),
                     F.lit("drift_detected").alias("metric"), F.col("column_name").alias("column"),
                     F.col("drift").cast("double").alias("value"))
    out = p.unionByName(d)
    if psi_df is not None:
        out = out.unionByName(psi_df.select(
            *keys, F.lit(scenario).alias("scenario"), F.lit(model).alias("model"),
            F.lit("psi").alias("metric"), F.col("score_col").alias("column"), F.col("psi").alias("value")))
    if pos is not None:
        out = out.unionByName(pos.select(
            *keys, F.lit(scenario).alias("scenario"), F.lit(model).alias("model"),
            F.lit("pos_ratio").alias("metric"), F.col("column_name").alias("column"), F.col("pos_ratio").alias("value")))
    return out


# keep ranks importable from here for callers that tune bucket sizes
__all__ = ["MonitorConfig", "snapshot", "snapshot_frames", "cycle_counts", "cycle_tests",
           "metrics_long", "ranks"]
