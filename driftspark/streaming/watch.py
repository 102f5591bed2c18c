"""Structured Streaming version of the monitoring loop.

Instead of re-reading the whole lake every 30 s (T1), the watcher is a streaming query over
new files, and no row is lost however the files are ordered:

1. Each micro-batch is reduced to step-wide panes (counts and sums per group, or counts per
   value) and written as an additive *delta* to a directory of its epoch, with overwrite, so
   a replayed epoch changes nothing (T5). A pane is the sum of its deltas, whenever they came.
   Every COMPACT epochs the older deltas are summed into one base, so readers stay cheap.
2. Rows of a pane that the watermark (largest time seen in earlier epochs, less the delay)
   had already passed are late (T3): they are merged like all others, and counted in a side
   table by epoch and pane.
3. ``run_loop`` tests every cycle that a micro-batch touched, open ones and those with a
   silent side included, and publishes metrics (T6), verdicts and failures of that epoch. If
   the evaluation fails, the cycles are halved until the failing ones are alone: the others
   are published, the failing ones leave a row with their error (T5).
4. ``alerts``: a second stream over the verdict table, keyed by model, runs the alert policy
   (T4) in ``transformWithState``. The state holds the cycles of the last ``horizon``; a
   late verdict replays the policy from its cycle on and emits what changed. Event-time
   timers fold cycles beyond the horizon into one state.
5. ``policy_stream`` is the policy on verdicts that come in order, with a row per grid cycle.

Checkpoints and tables live under the session's shared work folder.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftspark.operators import windows
from driftspark.session import scratch_path

# Deltas are summed into a base after so many epochs.
COMPACT = 32


def table_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """A table as a stream of new files. The table is a directory of files or one file."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return r.parquet(path)
    return r.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def _interval(td: dt.timedelta) -> str:
    return f"{int(td.total_seconds())} seconds"


def _numbers(spark: SparkSession, path: str, name: str, done: bool = False) -> list[int]:
    """Numbers N of the directories ``name=N`` in ``path`` (completed ones only, if asked)."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*" + ("/_SUCCESS" if done else ""))
    found = p.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(p)
    paths = [(x.getPath().getParent() if done else x.getPath()).getName() for x in found] if found else []
    return sorted(int(x.split("=")[1]) for x in paths)


@dataclass
class EpochTable:
    """A table of one directory per epoch; a replayed epoch overwrites its own."""
    spark: SparkSession
    path: str
    schema: str

    def write(self, df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def read(self) -> DataFrame:
        if not _numbers(self.spark, self.path, "epoch"):
            return self.spark.createDataFrame([], f"{self.schema}, epoch long")
        return self.spark.read.schema(f"{self.schema}, epoch long").parquet(self.path)


@dataclass
class Panes:
    """Pane counts kept as additive deltas: keys, and columns that are summed."""
    spark: SparkSession
    path: str
    keys: dict[str, str]
    sums: dict[str, str]

    def _schema(self) -> str:
        return ", ".join(f"{k} {v}" for k, v in [*self.keys.items(), *self.sums.items()])

    def add(self, delta: DataFrame, epoch: int) -> None:
        """``delta`` has one row per key of the micro-batch."""
        self._write(delta, f"deltas/epoch={epoch}")
        bases = _numbers(self.spark, self.path, "base", done=True)
        if epoch - (bases[-1] if bases else -1) > COMPACT:
            self.compact(epoch - 1)

    def _write(self, df: DataFrame, name: str) -> None:
        # sorted by pane, so that a reader of some panes skips row groups
        df.select(*self.keys, *self.sums).sortWithinPartitions("_pane").write.mode("overwrite").parquet(f"{self.path}/{name}")

    def _parts(self, upto: int | None = None) -> DataFrame:
        base = ([-1] + [b for b in _numbers(self.spark, self.path, "base", done=True) if upto is None or b <= upto])[-1]
        deltas = [e for e in _numbers(self.spark, f"{self.path}/deltas", "epoch") if e > base and (upto is None or e <= upto)]
        where = [f"{self.path}/base={base}"] if base >= 0 else []
        where += [f"{self.path}/deltas/epoch={e}" for e in deltas]
        return self.spark.read.schema(self._schema()).parquet(*where) if where else self.spark.createDataFrame([], self._schema())

    def read(self, lo: int | None = None, hi: int | None = None) -> DataFrame:
        """One row per key, of the panes from ``lo`` to ``hi`` (a filter that reaches the scan)."""
        parts = self._parts()
        if lo is not None:
            parts = parts.where(F.col("_pane").between(lo, hi))
        return parts.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums])

    def compact(self, upto: int) -> None:
        """Sum everything up to epoch ``upto`` into a base; readers use it once it is complete."""
        summed = self._parts(upto).groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums])
        self._write(summed, f"base={upto}")


class Arrivals:
    """What came when: rows and largest time by epoch and pane, and the rows that came late."""

    def __init__(self, spark: SparkSession, path: str, step: dt.timedelta, delay: dt.timedelta):
        self.seen = EpochTable(spark, f"{path}/seen", "_pane long, n_rows long, max_us long")
        self.late = EpochTable(spark, f"{path}/late", "_pane long, n_late long")
        self.step_s, self.delay_us = int(step.total_seconds()), int(delay.total_seconds() * 1e6)

    def mark_us(self, before: int | None = None) -> int | None:
        """The watermark in microseconds, from the epochs before one (or all)."""
        rows = self.seen.read()
        rows = rows if before is None else rows.where(F.col("epoch") < before)
        top = rows.agg(F.max("max_us")).first()[0]
        return None if top is None else top - self.delay_us

    def add(self, rows: DataFrame, epoch: int) -> None:
        """``rows`` have ``_pane`` and ``_us``."""
        self.seen.write(rows.groupBy("_pane").agg(F.count(F.lit(1)).alias("n_rows"), F.max("_us").alias("max_us")), epoch)
        mark = self.mark_us(before=epoch)
        own = self.seen.read().where(F.col("epoch") == epoch)
        passed = (F.col("_pane") + 1) * (self.step_s * 1_000_000) <= F.lit(mark)
        self.late.write(own.where(F.coalesce(passed, F.lit(False))).select("_pane", F.col("n_rows").alias("n_late")), epoch)


def _with_pane(batch: DataFrame, ts: str, step: dt.timedelta) -> DataFrame:
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return batch.where(F.col(ts).isNotNull()).select("*", us.alias("_us"), F.floor(us / int(step.total_seconds() * 1e6)).cast("long").alias("_pane"))


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    query = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


# --- panes of counts and sums ---------------------------------------------------------

def pane_sink(spark: SparkSession, path: str, ts: str, step: dt.timedelta, delay: dt.timedelta, groups: dict[str, str] | None = None,
              value: str | None = None) -> tuple[Panes, Arrivals, Callable[[DataFrame, int], None]]:
    """The pane table at ``path``, its arrivals, and the writer of one micro-batch."""
    sums = {"n": "long"} | ({"sum_value": "double"} if value else {})
    panes = Panes(spark, f"{path}/panes", {"_pane": "long"} | (groups or {}), sums)
    arrivals = Arrivals(spark, path, step, delay)

    def write(batch: DataFrame, epoch: int) -> None:
        rows = _with_pane(batch, ts, step).persist()
        try:
            aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("sum_value")] if value else [])
            panes.add(rows.groupBy(*panes.keys).agg(*aggs), epoch)
            arrivals.add(rows, epoch)
        finally:
            rows.unpersist()

    return panes, arrivals, write


def run_pane_sink(stream: DataFrame, path: str, checkpoint: str, ts: str, step: dt.timedelta, delay: dt.timedelta,
                  groups: dict[str, str] | None = None, value: str | None = None) -> tuple[Panes, Arrivals]:
    """Run the stream into the pane table until all that is there has been read."""
    panes, arrivals, write = pane_sink(stream.sparkSession, path, ts, step, delay, groups, value)
    _run(stream, write, checkpoint)
    return panes, arrivals


def latest(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key's row of the last epoch that wrote it."""
    rest = [c for c in table.columns if c not in (*keys, "epoch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r")).select(*keys, "_r.*")


def read_cycles(panes: Panes, arrivals: Arrivals, width: dt.timedelta, step: dt.timedelta) -> DataFrame:
    """Panes fanned out to their 2W/step cycles and summed per (cycle_end, role, groups).
    ``closed``: the watermark has passed the cycle's end; ``n_late``: rows that came after
    it had passed their pane (they are counted in ``n_rows`` as well)."""
    groups = [k for k in panes.keys if k != "_pane"]
    late = arrivals.late.read().groupBy("_pane").agg(F.sum("n_late").alias("n_late"))
    rows = panes.read()
    if groups:  # late rows are not known by group
        rows = rows.withColumn("n_late", F.lit(None).cast("long"))
    else:
        rows = rows.join(late, "_pane", "left").withColumn("n_late", F.coalesce("n_late", F.lit(0)))
    aggs = [F.sum("n").alias("n_rows"), F.sum("n_late").alias("n_late")]
    if "sum_value" in panes.sums:
        aggs.append(F.sum("sum_value").alias("sum_value"))
    out = windows.fan_out_cycles(rows, "_pane", width, step).groupBy("cycle_end", "role", *groups).agg(*aggs)
    mark = arrivals.mark_us()
    return out.withColumn("closed", F.coalesce(F.unix_micros("cycle_end") <= F.lit(mark), F.lit(False)))


# --- T4 streaming policy -------------------------------------------------------------

POLICY_OUT = ("model string, cycle_end timestamp, should_trigger boolean, attempted boolean, "
              "suppressed boolean, alert boolean, clear_streak int, trigger_count long")
POLICY_STATE = "alert boolean, clear int, last_attempt long, last_idx long, total long"


def _policy_fn(step_s: int, cooldown_cycles: int, clear_streak: int, mode: str, streak: str):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (model,) = key
        if state.exists:
            alert, clear, last_att, last_idx, total = state.get
        else:
            alert, clear, last_att, last_idx, total = False, 0, -(10 ** 12), None, 0
        rows = pd.concat(list(pdfs), ignore_index=True)
        idx = (rows["cycle_end"].astype("int64") // (10 ** 9 * step_s)).astype("int64")
        trig = dict(zip(idx.tolist(), rows["should_trigger"].fillna(False).astype(bool).tolist()))
        lo = min(trig) if last_idx is None else last_idx + 1
        out = []
        for i in range(lo, max(trig) + 1) if trig and max(trig) >= lo else []:
            x = trig.get(i, False)  # gaps in the grid are clear cycles
            att = sup = False
            if mode == "level":
                if x:
                    att = i - last_att >= cooldown_cycles
                    sup = not att
            elif x and not alert:
                att = i - last_att >= cooldown_cycles
                sup = not att
                alert, clear = True, 0
            elif x and alert:
                if streak == "consecutive":
                    clear = 0
            elif alert:
                clear += 1
                if clear >= clear_streak:
                    alert, clear = False, 0
            if att:
                last_att = i
            total += int(att)
            out.append((model, pd.Timestamp(i * step_s, unit="s"), x, att, sup,
                        alert if mode == "edge" else False, clear if mode == "edge" else 0, total))
            last_idx = i
        state.update((alert, clear, last_att, last_idx, total))
        yield pd.DataFrame(out, columns=["model", "cycle_end", "should_trigger", "attempted", "suppressed",
                                         "alert", "clear_streak", "trigger_count"])
    return fn


def policy_stream(verdicts: DataFrame, step: dt.timedelta, cooldown: dt.timedelta, clear_streak: int = 3,
                  mode: str = "edge", streak: str = "cumulative") -> DataFrame:
    """T4 on a stream of (model, cycle_end, should_trigger) rows, cycles in order."""
    step_s = int(step.total_seconds())
    kc = max(-(-int(cooldown.total_seconds()) // step_s), 1)
    fn = _policy_fn(step_s, kc, clear_streak, mode, streak)
    return verdicts.groupBy("model").applyInPandasWithState(
        fn, POLICY_OUT, POLICY_STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> None:
    q = (df.writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def new_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    return scratch_path(spark, f"{name}-table"), scratch_path(spark, f"{name}-checkpoint")


# --- one loop: panes, late rows, metrics, verdicts, failures, alerts -----------------------

@dataclass
class Loop:
    """Tables of one running loop; ``epoch`` columns tell which micro-batch wrote a row."""
    spark: SparkSession
    path: str
    panes: Panes
    arrivals: Arrivals
    metrics: EpochTable
    verdicts: EpochTable
    failures: EpochTable
    alerts: EpochTable

    def current(self, table: str) -> DataFrame:
        """The last state of a table: each cycle's rows of the last epoch that wrote it."""
        keys = {"metrics": ["cycle_end", "scenario", "model", "metric", "column"], "verdicts": ["cycle_end"], "alerts": ["model", "cycle_end"]}
        return latest(getattr(self, table).read(), keys[table])

    def open_failures(self) -> DataFrame:
        """Failed cycles that no later epoch has published."""
        done = self.verdicts.read().groupBy("cycle_end").agg(F.max("epoch").alias("done"))
        return self.failures.read().join(done, "cycle_end", "left").where("done is null or done < epoch").drop("done")


METRICS = "cycle_end timestamp, scenario string, model string, metric string, column string, value double"
VERDICTS = "cycle_end timestamp, drift_any boolean, p_min double, reject_share double, n_tests long, psi double, should_trigger boolean"
ALERTS = POLICY_OUT + ", revised boolean"


def open_loop(spark: SparkSession, path: str, step: dt.timedelta, delay: dt.timedelta) -> Loop:
    panes = Panes(spark, f"{path}/panes", {"_pane": "long", "column_name": "string", "num": "double", "cat": "string"}, {"_n": "long"})
    table = lambda name, schema: EpochTable(spark, f"{path}/{name}", schema)
    return Loop(spark, path, panes, Arrivals(spark, path, step, delay), table("metrics", METRICS), table("verdicts", VERDICTS),
                table("failures", "cycle_end timestamp, error string"), table("alerts", ALERTS))


def _value_counts(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Counts per pane, column and value of one micro-batch."""
    kv = F.explode(F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("num"),
                   F.lit(None).cast("string").alias("cat")) for c in numeric],
        *[F.struct(F.lit(c).alias("column_name"), F.lit(None).cast("double").alias("num"),
                   F.col(c).cast("string").alias("cat")) for c in categorical])).alias("_kv")
    x = rows.select("_pane", kv).select("_pane", "_kv.*").where(F.col("num").isNotNull() | F.col("cat").isNotNull())
    return x.groupBy("_pane", "column_name", "num", "cat").agg(F.count(F.lit(1)).alias("_n"))


def loop_writer(loop: Loop, ts: str, width: dt.timedelta, step: dt.timedelta, numeric: Sequence[str], categorical: Sequence[str],
                score: str | None, cfg=None, evaluate=None) -> Callable[[DataFrame, int], None]:
    """What one micro-batch does: store, then test and publish every cycle that it touched."""
    from driftspark.plans import monitor
    cfg, evaluate = cfg or monitor.MonitorConfig(), evaluate or monitor.tests_from_cycle_counts
    spark, step_s = loop.spark, int(step.total_seconds())
    r = int(width.total_seconds()) // step_s

    def frames(ends: DataFrame, lo: int, hi: int) -> dict[str, DataFrame]:
        stored = loop.panes.read(lo - 2 * r + 1, hi + 2 * r - 1)

        def counts(cols, field):
            if not cols:
                return None
            x = stored.where(F.col("column_name").isin(*cols)).select("_pane", "column_name", F.col(field).alias("value"), "_n")
            return monitor.counts_from_panes(x, width, step).join(ends, "cycle_end", "left_semi")

        return evaluate(counts(list(numeric), "num"), counts(list(categorical), "cat"), counts([score] if score else [], "num"), cfg)

    def publish(found: dict[str, DataFrame], epoch: int) -> None:
        names = [c.split(" ")[0] for c in VERDICTS.split(", ")]
        loop.verdicts.write(found["verdict"].select(*names), epoch)
        long = monitor.metrics_long(found["tests"], found["psi"], ["cycle_end"], pos=found.get("pos_ratio"))
        loop.metrics.write(long.select("cycle_end", "scenario", "model", "metric", "column", F.col("value").cast("double").alias("value")), epoch)

    def write(batch: DataFrame, epoch: int) -> None:
        rows = _with_pane(batch, ts, step).persist()
        try:
            loop.panes.add(_value_counts(rows, numeric, categorical), epoch)
            loop.arrivals.add(rows, epoch)
        finally:
            rows.unpersist()
        touched = loop.arrivals.seen.read().where(F.col("epoch") == epoch).select("_pane")
        span = touched.agg(F.min("_pane").alias("lo"), F.max("_pane").alias("hi")).first()  # two integers
        if span.lo is None:
            return
        cycles = touched.select(F.explode(F.sequence(F.col("_pane") + 1, F.col("_pane") + 2 * r)).alias("_e")).distinct()
        ends = lambda c: c.select(F.timestamp_seconds(F.col("_e") * step_s).alias("cycle_end"))
        failed: list[tuple[int, str]] = []
        try:
            publish(frames(ends(cycles), span.lo, span.hi), epoch)
        except Exception:  # noqa: BLE001  some cycle cannot be tested: find out which
            good: list[int] = []

            def probe(some: list[int]) -> None:
                try:
                    part = spark.createDataFrame([(i,) for i in some], "_e long")
                    frames(ends(part), span.lo, span.hi)["verdict"].write.format("noop").mode("overwrite").save()
                    good.extend(some)
                except Exception as e:  # noqa: BLE001
                    if len(some) == 1:
                        failed.append((some[0], str(e)[:500]))
                        return
                    probe(some[:len(some) // 2])
                    probe(some[len(some) // 2:])

            probe(sorted(x._e for x in cycles.collect()))  # the cycles of one micro-batch
            if good:
                publish(frames(ends(spark.createDataFrame([(i,) for i in good], "_e long")), span.lo, span.hi), epoch)
        rows = spark.createDataFrame(failed, "_e long, error string")
        loop.failures.write(rows.select(F.timestamp_seconds(F.col("_e") * step_s).alias("cycle_end"), "error"), epoch)

    return write


def run_loop(stream: DataFrame, path: str, checkpoint: str, ts: str, width: dt.timedelta, step: dt.timedelta, delay: dt.timedelta,
             numeric: Sequence[str], categorical: Sequence[str], score: str | None, cfg=None, evaluate=None) -> Loop:
    """Run the detector over all that the stream has; see ``Loop`` for the tables."""
    loop = open_loop(stream.sparkSession, path, step, delay)
    _run(stream, loop_writer(loop, ts, width, step, numeric, categorical, score, cfg, evaluate), checkpoint)
    return loop


class AlertPolicy(StatefulProcessor):
    """The policy of one model: cycles within the horizon, and the state before them."""

    def __init__(self, step_s: int, cooldown: int, clear_streak: int, mode: str, streak: str):
        self.step_s, self.cooldown, self.clear_streak, self.mode, self.streak = step_s, cooldown, clear_streak, mode, streak

    def init(self, handle: StatefulProcessorHandle) -> None:
        state = "alert boolean, clear int, last long, total long"
        self.handle = handle
        self.base = handle.getValueState("base", f"cycle long, {state}")
        self.cycles = handle.getMapState("cycles", "cycle long", f"x boolean, attempted boolean, suppressed boolean, {state}")

    def step(self, before: int | None, state: tuple, i: int, x: bool) -> tuple:
        """(attempted, suppressed, alert, clear, last attempt, total) after cycle ``i``."""
        alert, clear, last, total = state
        if alert and before is not None and i - before > 1:  # silent cycles in between are clear ones
            clear += i - before - 1
            if clear >= self.clear_streak:
                alert, clear = False, 0
        attempted = suppressed = False
        if x and (self.mode == "level" or not alert):
            attempted = i - last >= self.cooldown
            suppressed = not attempted
        if self.mode == "edge":
            if x and not alert:
                alert, clear = True, 0
            elif x:
                clear = 0 if self.streak == "consecutive" else clear
            elif alert:
                clear += 1
                if clear >= self.clear_streak:
                    alert, clear = False, 0
        return attempted, suppressed, alert, clear, i if attempted else last, total + int(attempted)

    def handleInputRows(self, key, rows, timerValues):
        new: dict[int, tuple[int, bool]] = {}
        for pdf in rows:
            for end, x, epoch in zip(pdf["cycle_end"], pdf["should_trigger"], pdf["epoch"]):
                i = int(end.timestamp()) // self.step_s
                new[i] = max(new.get(i, (-1, False)), (int(epoch), bool(x)))
        stored = {k[0]: tuple(v) for k, v in self.cycles.iterator()}  # the cycles of one horizon
        base = self.base.get() if self.base.exists() else (None, False, 0, -(10 ** 12), 0)
        changed = [i for i, (_, x) in new.items() if (base[0] is None or i > base[0]) and (i not in stored or stored[i][0] != x)]
        out = []
        if changed:
            lo = min(changed)
            known = sorted(i for i in stored if i < lo)
            before, state = (known[-1], stored[known[-1]][3:]) if known else (base[0], base[1:])
            for i in sorted({*changed, *(c for c in stored if c >= lo)}):
                x = new[i][1] if i in new else stored[i][0]
                attempted, suppressed, *state = self.step(before, tuple(state), i, x)
                row = (x, attempted, suppressed, *state)
                if stored.get(i) != row:
                    self.cycles.updateValue((i,), row)
                    if i not in stored:
                        self.handle.registerTimer(i * self.step_s * 1000)
                    edge = self.mode == "edge"
                    out.append((key[0], pd.Timestamp(i * self.step_s, unit="s"), x, attempted, suppressed, state[0] if edge else False, state[1] if edge else 0, state[3], i in stored))
                before = i
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in ALERTS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """The watermark, a horizon behind, has passed this cycle: fold all up to it."""
        upto = expiredTimerInfo.getExpiryTimeInMs() // 1000 // self.step_s
        gone = sorted((k[0], tuple(v)) for k, v in self.cycles.iterator() if k[0] <= upto)
        for i, _ in gone:
            self.cycles.removeKey((i,))
        if gone:
            self.base.update((gone[-1][0], *gone[-1][1][3:]))
        yield pd.DataFrame([], columns=[c.split(" ")[0] for c in ALERTS.split(", ")])

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession):
    """``transformWithState`` needs the RocksDB store; the session's setting comes back."""
    name, wanted = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    old = spark.conf.get(name)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def alerts(verdicts: DataFrame, step: dt.timedelta, cooldown: dt.timedelta, horizon: dt.timedelta, clear_streak: int = 3,
           mode: str = "edge", streak: str = "cumulative") -> DataFrame:
    """T4 on a stream of (model, cycle_end, should_trigger, epoch) rows in any order.

    Verdicts older than ``horizon`` behind the newest cycle come too late for the policy:
    Spark drops them here and counts them (numRowsDroppedByWatermark); the verdict table has them."""
    step_s = int(step.total_seconds())
    kc = max(-(-int(cooldown.total_seconds()) // step_s), 1)
    rows = verdicts.select("model", "cycle_end", "should_trigger", "epoch").withWatermark("cycle_end", _interval(horizon))
    return rows.groupBy("model").transformWithStateInPandas(AlertPolicy(step_s, kc, clear_streak, mode, streak), ALERTS, "Update", "EventTime")


def run_alerts(loop: Loop, checkpoint: str, step: dt.timedelta, cooldown: dt.timedelta, horizon: dt.timedelta, model: str = "fraud", **kw) -> None:
    """Run the policy over the verdicts that the loop has published."""
    spark = loop.spark
    stream = spark.readStream.schema(f"{VERDICTS}, epoch long").parquet(loop.verdicts.path)
    with _rocksdb(spark):
        _run(alerts(stream.withColumn("model", F.lit(model)), step, cooldown, horizon, **kw), loop.alerts.write, checkpoint, "update")
