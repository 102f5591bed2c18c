"""Alert policy over ordered cycles.

Per model and cycle the detector says ``should_trigger``. The policy decides:

- edge mode: fire on a rising edge only; stay quiet while the alert holds; re-arm
  after ``clear_streak`` cycles without drift (``streak="cumulative"`` counts those
  cycles even when drift returns in between, as the monitored loop does;
  ``"consecutive"`` restarts the count). The alert flag is set even when the attempt
  is refused by the cooldown (G7); such cycles are reported as ``suppressed``.
- level mode: attempt on every drifting cycle.
- both: an attempt needs ``cooldown`` since the previous attempt.

Cycles lie on a grid of width ``step``; cycles without a verdict count as clear. The
state (alert, streak, cycles since the last attempt capped at ceil(cooldown/step)) is
finite, so each cycle is a map from state to state and maps compose associatively.
The plan is a parallel prefix: chunks of ``chunk`` cycles compose their maps, groups of
``chunk`` chunk maps compose into one map again, and so on until a model has one group;
start states then go down the same tree, and every chunk replays its cycles from its own.
The running trigger count comes from the two-phase running sums. No step holds more than
one chunk of cycles, or ``chunk`` state maps, of a model.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.operators import ranks
from driftspark.session import work_dir

# Policy defaults of the monitored loop.
COOLDOWN = dt.timedelta(seconds=300)
CLEAR_STREAK = 3
CHUNK = 1024


class _Codec:
    def __init__(self, n_clear: int, k_cool: int):
        self.n, self.k = n_clear, k_cool
        self.size = 2 * n_clear * (k_cool + 1)

    def decode(self, s: str) -> tuple[str, str, str]:
        n, k1 = self.n, self.k + 1
        return f"(({s}) div {n * k1})", f"((({s}) div {k1}) % {n})", f"(({s}) % {k1})"

    def encode(self, a: str, k: str, c: str) -> str:
        return f"((({a}) * {self.n} + ({k})) * {self.k + 1} + ({c}))"


def _transition_sql(codec: _Codec, s: str, x: str, mode: str, streak: str) -> tuple[str, str, str]:
    """(next state, attempted, suppressed) as SQL for state ``s`` and input ``x``."""
    a, k, c = codec.decode(s)
    n, kc = codec.n, codec.k
    c1 = f"least({c} + 1, {kc})"
    can = f"({c1} >= {kc})"
    if mode == "level":
        nxt = codec.encode("0", "0", f"(CASE WHEN {x} AND {can} THEN 0 ELSE {c1} END)")
        return nxt, f"({x} AND {can})", f"({x} AND NOT {can})"
    rising = f"({x} AND {a} = 0)"
    keep_k = "0" if streak == "consecutive" else k
    k_clear = f"({k} + 1)"
    nxt = (f"(CASE WHEN {rising} THEN {codec.encode('1', '0', f'(CASE WHEN {can} THEN 0 ELSE {c1} END)')} "
           f"WHEN {x} THEN {codec.encode(a, keep_k, c1)} "
           f"WHEN {a} = 1 AND {k_clear} >= {n} THEN {codec.encode('0', '0', c1)} "
           f"WHEN {a} = 1 THEN {codec.encode('1', k_clear, c1)} "
           f"ELSE {codec.encode('0', '0', c1)} END)")
    return nxt, f"({rising} AND {can})", f"({rising} AND NOT {can})"


def _starts(maps: DataFrame, keys: list[str], size: int, init: str, width: int) -> DataFrame:
    """(keys..., _ch, _s0): the state before each chunk, from the chunks' state maps.

    A model's chunks are folded in groups of ``width`` neighbours; groups of a model with
    more of them get their own start states from the tree above."""
    span = maps.groupBy(*keys).agg((F.floor(F.max("_ch") / width) - F.floor(F.min("_ch") / width)).alias("n"))
    groups = maps.groupBy(*keys, F.floor(F.col("_ch") / width).alias("_up")).agg(
        F.array_sort(F.collect_list(F.struct("_ch", "_map"))).alias("_ms"))
    if (span.agg(F.max("n")).first()[0] or 0) == 0:
        groups = groups.withColumn("_from", F.expr(f"CAST({init} AS BIGINT)"))
    else:
        work_dir(maps.sparkSession)
        groups = groups.checkpoint(eager=True)
        compose = (f"aggregate(_ms, transform(sequence(0, {size - 1}), z -> CAST(z AS BIGINT)), "
                   f"(m, e) -> transform(m, s -> element_at(e._map, CAST(s + 1 AS INT))))")
        above = _starts(groups.select(*keys, F.col("_up").alias("_ch"), F.expr(compose).alias("_map")), keys, size, init, width)
        groups = groups.join(above.withColumnRenamed("_ch", "_up").withColumnRenamed("_s0", "_from"), on=[*keys, "_up"])
    folded = groups.select(*keys, F.expr(
        "aggregate(_ms, named_struct('st', _from, 'out', array(named_struct('ch', CAST(0 AS BIGINT), 's0', CAST(0 AS BIGINT)))), "
        "(acc, m) -> named_struct('st', element_at(m._map, CAST(acc.st + 1 AS INT)), "
        "'out', concat(acc.out, array(named_struct('ch', CAST(m._ch AS BIGINT), 's0', acc.st)))))").alias("_f"))
    return folded.select(*keys, F.explode(F.slice("_f.out", 2, 1 << 30)).alias("_o")).select(
        *keys, F.col("_o.ch").alias("_ch"), F.col("_o.s0").alias("_s0"))


def apply_policy(verdicts: DataFrame, keys: Sequence[str], cycle: str, trigger: str,
                 step: dt.timedelta, mode: str = "edge", cooldown: dt.timedelta = COOLDOWN,
                 clear_streak: int = CLEAR_STREAK, streak: str = "cumulative",
                 chunk: int = CHUNK) -> DataFrame:
    """One output row per grid cycle between each model's first and last verdict.

    Columns: keys..., cycle, should_trigger, attempted (= fired), suppressed,
    alert (state after the cycle), clear_streak, trigger_count (running).
    """
    if mode not in ("edge", "level") or streak not in ("cumulative", "consecutive"):
        raise ValueError((mode, streak))
    keys = list(keys)
    step_s = int(step.total_seconds())
    kc = max(int(math.ceil(cooldown.total_seconds() / step_s)), 1)
    codec = _Codec(max(int(clear_streak), 1), kc)
    init = codec.encode("0", "0", str(kc))

    v = verdicts.select(*keys, (F.unix_seconds(F.col(cycle).cast("timestamp")) / step_s).cast("long").alias("_i"),
                        F.col(trigger).cast("boolean").alias("_x"))
    v = v.groupBy(*keys, "_i").agg(F.bool_or("_x").alias("_x"))
    # one row per cycle and model; used for the span and the grid, so written once
    work_dir(verdicts.sparkSession)
    v = v.checkpoint(eager=True)
    span = v.groupBy(*keys).agg(F.min("_i").alias("_lo"), F.max("_i").alias("_hi"))
    # grid of chunks per model, then cycles per chunk (each chunk at most ``chunk`` rows)
    chunks = span.select(*keys, "_lo", "_hi", F.explode(F.sequence(
        F.floor(F.col("_lo") / chunk), F.floor(F.col("_hi") / chunk))).alias("_ch"))
    cyc = chunks.select(*keys, "_ch", F.explode(F.sequence(
        F.greatest(F.col("_ch") * chunk, F.col("_lo")),
        F.least(F.col("_ch") * chunk + chunk - 1, F.col("_hi")))).alias("_i"))
    grid = cyc.join(v, on=[*keys, "_i"], how="left").withColumn("_x", F.coalesce("_x", F.lit(False)))
    per_chunk = grid.groupBy(*keys, "_ch").agg(
        F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_cs"))

    nxt, att, sup = _transition_sql(codec, "s", "e._x", mode, streak)
    compose = (f"aggregate(_cs, transform(sequence(0, {codec.size - 1}), z -> CAST(z AS BIGINT)), "
               f"(m, e) -> transform(m, s -> CAST({nxt} AS BIGINT)))")
    maps = per_chunk.select(*keys, "_ch", F.expr(compose).alias("_map"))
    starts = _starts(maps, keys, codec.size, init, chunk)
    # replay each chunk from its start state
    s_next, s_att, s_sup = _transition_sql(codec, "acc.st", "e._x", mode, streak)
    replay = (f"aggregate(_cs, named_struct('st', CAST(_s0 AS BIGINT), 'rows', CAST(array() AS "
              f"array<struct<i:bigint,x:boolean,att:boolean,sup:boolean,st:bigint>>)), "
              f"(acc, e) -> named_struct('st', CAST({s_next} AS BIGINT), 'rows', concat(acc.rows, "
              f"array(named_struct('i', CAST(e._i AS BIGINT), 'x', e._x, 'att', {s_att}, 'sup', {s_sup}, "
              f"'st', CAST({s_next} AS BIGINT))))))")
    rows = (per_chunk.join(starts, on=[*keys, "_ch"]).select(*keys, F.expr(replay).alias("_r"))
            .select(*keys, F.explode("_r.rows").alias("e")))
    a, k, _ = codec.decode("e.st")
    out = rows.select(
        *keys, F.col("e.i").alias("_i"),
        F.timestamp_seconds(F.col("e.i") * step_s).alias(cycle),
        F.col("e.x").alias("should_trigger"), F.col("e.att").alias("attempted"),
        F.col("e.sup").alias("suppressed"),
        (F.expr(a) == 1).alias("alert"), F.expr(k).cast("int").alias("clear_streak"))
    counts = out.select(*keys, "_i", F.col("attempted").cast("long").alias("_f"))
    cum = ranks.cumulative(counts, keys, "_i", ["_f"]).select(*keys, "_i", F.col("cum__f").alias("trigger_count"))
    return out.join(cum, on=[*keys, "_i"]).drop("_i")


def policy_fold_reference(rows: list[bool], mode: str = "edge", cooldown_cycles: int = 10,
                          clear_streak: int = CLEAR_STREAK, streak: str = "cumulative") -> list[tuple]:
    """Plain-Python statement of the loop's policy on one model, for tests."""
    last, prev, clear, out, total = -10 ** 9, False, 0, [], 0
    for i, x in enumerate(rows):
        att = sup = False
        if mode == "level":
            if x:
                att = i - last >= cooldown_cycles
                sup = not att
                if att:
                    last = i
        elif x and not prev:
            att = i - last >= cooldown_cycles
            sup = not att
            if att:
                last = i
            prev, clear = True, 0
        elif x and prev:
            if streak == "consecutive":
                clear = 0
        elif prev:
            clear += 1
            if clear >= clear_streak:
                prev, clear = False, 0
        total += att
        out.append((x, att, sup, prev, clear, total))
    return out
