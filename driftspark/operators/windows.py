"""Reference / recent windows (P5, P6, T2) and monitoring cycles.

A single poll at time ``now`` compares ref = [now-2W, now-W) with rec = [now-W, inf).
Replayed over a table, a cycle ends every ``step`` on a grid anchored at ``origin``;
cycle e compares ref = [e-2W, e-W) with rec = [e-W, e).

For cycles, rows are first reduced on step-wide panes and each pane is then fanned
out to the 2W/step cycles that contain it, so the fan-out applies to aggregated
rows. Cycle ends are on a grid anchored at the epoch unless ``origin`` says otherwise.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

REF, REC = "ref", "rec"


def _ts_literal(value: dt.datetime | str) -> Column:
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def _bound(df: DataFrame, ts: str, value: dt.datetime | str) -> Column:
    """A literal of the column's own type, so the comparison reaches the Parquet scan
    as a pushed filter (a cast on the column side would block pushdown)."""
    lit = _ts_literal(value)
    if isinstance(df.schema[ts].dataType, TimestampNTZType):
        return lit.cast("timestamp_ntz")
    return lit


def window_pair(df: DataFrame, ts: str, now: dt.datetime | str, width: dt.timedelta,
                role: str = "role") -> DataFrame:
    """Rows of the two windows before ``now`` with a ``role`` column (P5).

    The lower bound is a literal, so it reaches the Parquet scan as a pushed filter.
    """
    if ts not in df.columns:
        raise ValueError(f"no time column {ts!r}; use sampling.split_half")
    if isinstance(now, str):
        now = dt.datetime.fromisoformat(now)
    rec_from = _bound(df, ts, now - width)
    ref_from = _bound(df, ts, now - 2 * width)
    t = F.col(ts)
    return (df.where(t >= ref_from)
            .withColumn(role, F.when(t >= rec_from, F.lit(REC)).otherwise(F.lit(REF))))


def split_roles(df: DataFrame, ts: str | None, now, width: dt.timedelta, key: str | None = None,
                seed: int = 13, role: str = "role") -> DataFrame:
    """Window pair when the time column exists, else a hash half split (M3)."""
    if ts and ts in df.columns:
        return window_pair(df, ts, now, width, role)
    from driftspark.operators.sampling import split_half
    return split_half(df, key, seed=seed, role=role)


def pane_index(ts: Column, step: dt.timedelta, origin: dt.datetime | str | None = None) -> Column:
    step_s = int(step.total_seconds())
    base = F.unix_seconds(ts.cast("timestamp"))
    if origin is not None:
        base = base - F.unix_seconds(_ts_literal(origin))
    return F.floor(base / F.lit(step_s)).cast("long")


def fan_out_cycles(panes: DataFrame, pane_col: str, width: dt.timedelta, step: dt.timedelta,
                   origin: dt.datetime | str | None = None, role: str = "role",
                   cycle: str = "cycle_end") -> DataFrame:
    """Pane rows → one row per (cycle, role) that contains the pane.

    With r = W/step, pane p is ``rec`` for the cycles ending at p+1..p+r and ``ref``
    for p+r+1..p+2r (cycle e covers panes e-2r .. e-1).
    """
    w_s, s_s = int(width.total_seconds()), int(step.total_seconds())
    if w_s % s_s:
        raise ValueError("window width must be a multiple of the step")
    r = w_s // s_s
    off = F.explode(F.sequence(F.lit(1), F.lit(2 * r))).alias("_off")
    x = panes.select("*", off)
    end_idx = F.col(pane_col) + F.col("_off")
    origin_s = F.unix_seconds(_ts_literal(origin)) if origin is not None else F.lit(0)
    return (x.withColumn(role, F.when(F.col("_off") <= r, F.lit(REC)).otherwise(F.lit(REF)))
             .withColumn(cycle, F.timestamp_seconds(origin_s + end_idx * F.lit(s_s)))
             .drop("_off", pane_col))


def changed(cycle_end: Column, width: dt.timedelta, periods) -> Column:
    """Whether the two windows of a cycle hold different shares of a labelled drift period.

    ``periods``: (from, to) in ISO form, not overlapping. A window pair wholly inside or wholly
    outside a period compares like with like, so an alert there is a false one.
    """
    w = int(width.total_seconds())
    end = F.unix_seconds(cycle_end.cast("timestamp"))
    out = F.lit(False)
    for start, stop in periods:
        a, b = (F.unix_seconds(_ts_literal(t)) for t in (start, stop))

        def inside(lo, hi, a=a, b=b):
            return F.greatest(F.least(hi, b) - F.greatest(lo, a), F.lit(0))

        out = out | (inside(end - w, end) != inside(end - 2 * w, end - w))
    return out


def in_period(ts: Column, periods) -> Column:
    """Whether a time lies in one of the half-open periods."""
    out = F.lit(False)
    for start, stop in periods:
        out = out | ((ts >= _ts_literal(start)) & (ts < _ts_literal(stop)))
    return out
