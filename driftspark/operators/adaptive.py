"""Change detectors over ordered values of a key: EDDM and ADWIN.

EDDM is a scan: positions, distances between errors and their prefix means are running sums
on range partitions, so a key of any size spreads over tasks. ADWIN depends on what it cut
before, so a key's values are folded in order; its state is an exponential histogram of
O(log n) buckets and its input comes in sorted batches, so memory follows the state, not the
key. Reduce rows to panes (hours, days) before ADWIN, as the monitored loop does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftspark.operators import ranks

# EDDM's warning and drift shares and its least number of errors; ADWIN's
# buckets per row of the histogram and least rows of a sub-window.
WARNING, DRIFT, LEAST_ERRORS = 0.95, 0.90, 30
BUCKETS, LEAST_ROWS = 5, 5


def eddm(df: DataFrame, keys: Sequence[str], order: Sequence[str], error: str, partitions: int | None = None) -> DataFrame:
    """EDDM per error: keys..., position, n_errors, mean_distance, sd_distance, level, ratio, zone.

    ``error`` is boolean; null counts as no error. A distance is the number of rows since the
    error before (since the start for the first); level = mean + 2 sd (population) of the
    distances so far, ratio = level over its largest value from the LEAST_ERRORS-th error on,
    zone ``drift`` below 0.90 and ``warning`` below 0.95, null before. Detection does not reset
    the history. Rows equal in all of ``order`` and the error are interchangeable.
    """
    keys, order = list(keys), list(order)
    x = df.select(*keys, *order, F.coalesce(F.col(error), F.lit(False)).alias("_e")).withColumn("_one", F.lit(1).cast("long"))
    x = ranks.scan(x, keys, [*order, "_e"], {"position": ("_one", "sum")}, partitions=partitions)
    x = x.where("_e").select(*keys, "position")
    x = ranks.scan(x, keys, ["position"], {"_before": ("position", "max")}, exclusive=True, partitions=partitions)
    x = x.withColumn("_d", (F.col("position") - F.coalesce("_before", F.lit(0))).cast("double")).withColumn("_dd", F.col("_d") * F.col("_d")).withColumn("_one", F.lit(1).cast("long"))
    x = ranks.scan(x, keys, ["position"], {"n_errors": ("_one", "sum"), "_sd": ("_d", "sum"), "_sdd": ("_dd", "sum")}, partitions=partitions)
    mean = F.col("_sd") / F.col("n_errors")
    x = x.select(*keys, "position", "n_errors", mean.alias("mean_distance"), F.sqrt(F.greatest(F.col("_sdd") / F.col("n_errors") - mean * mean, F.lit(0.0))).alias("sd_distance"))
    x = x.withColumn("level", F.col("mean_distance") + 2 * F.col("sd_distance")).withColumn("_known", F.when(F.col("n_errors") >= LEAST_ERRORS, F.col("level")))
    x = ranks.scan(x, keys, ["position"], {"_top": ("_known", "max")}, partitions=partitions)
    ratio = F.when(F.col("_top").isNotNull(), F.try_divide("level", "_top"))
    zone = F.when(ratio < DRIFT, F.lit("drift")).when(ratio < WARNING, F.lit("warning")).when(ratio.isNotNull(), F.lit("stable"))
    return x.select(*keys, "position", "n_errors", "mean_distance", "sd_distance", "level", ratio.alias("ratio"), zone.alias("zone"))


class Adwin:
    """Adaptive window: buckets of (level, rows, sum, sum of squares), oldest first.

    A value enters as a bucket of one row. More than BUCKETS buckets of a level merge their two
    oldest into one of twice the rows. While some cut of the window into an older and a newer
    part (LEAST_ROWS rows each at least) has means further apart than the bound at
    confidence ``delta``, the oldest bucket goes.
    """

    def __init__(self, delta: float, buckets: list[tuple] | None = None):
        self.delta, self.buckets = delta, list(buckets or [])

    def cut_found(self) -> bool:
        n, s, q = (sum(b[i] for b in self.buckets) for i in (1, 2, 3))
        if n < 2 * LEAST_ROWS:
            return False
        variance = max(q / n - (s / n) ** 2, 0.0)
        log = math.log(2 * math.log(n) / self.delta)
        n0 = s0 = 0.0
        for _, k, x, _ in self.buckets[:-1]:
            n0, s0 = n0 + k, s0 + x
            if n0 >= LEAST_ROWS and n - n0 >= LEAST_ROWS:
                inverse = 1 / n0 + 1 / (n - n0)
                if abs(s0 / n0 - (s - s0) / (n - n0)) > math.sqrt(2 * inverse * variance * log) + 2 / 3 * inverse * log:
                    return True
        return False

    def add(self, x: float) -> tuple[int, float, int]:
        """(rows of the window, its mean, rows cut) after value ``x``."""
        self.buckets.append((0, 1, x, x * x))
        level = 0
        while True:
            at = [i for i, b in enumerate(self.buckets) if b[0] == level]
            if len(at) <= BUCKETS:
                break
            i, j = at[:2]
            a, b = self.buckets[i], self.buckets[j]
            self.buckets[i:j + 1] = [(level + 1, a[1] + b[1], a[2] + b[2], a[3] + b[3])]
            level += 1
        cut = 0
        while self.cut_found():
            cut += self.buckets.pop(0)[1]
        n = sum(b[1] for b in self.buckets)
        return n, sum(b[2] for b in self.buckets) / n, cut


ADWIN_OUT = "width long, mean double, n_cut long, drift boolean"


def adwin(df: DataFrame, keys: Sequence[str], order: str, value: str, delta: float = 0.002) -> DataFrame:
    """ADWIN after each value of each key: keys..., order, value, width, mean, n_cut, drift.

    Values of a key are taken in the order of ``order`` (unique per key); nulls and NaNs are
    left out. One shuffle by key and a sort; each task folds its keys batch by batch.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, order, F.col(value).cast("double").alias(value))
    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    dealt = dealt.sortWithinPartitions(*keys, order)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, window = None, Adwin(delta)
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for i, x in enumerate(columns[n + 1]):
                key = tuple(c[i] for c in columns[:n])
                if key != now:
                    now, window = key, Adwin(delta)
                out.append(window.add(x))
            extra = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.float64()),
                     pa.array([r[2] for r in out], pa.int64()), pa.array([r[2] > 0 for r in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "width", "mean", "n_cut", "drift"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return dealt.mapInArrow(run, f"{schema}, {ADWIN_OUT}")


class AdwinProcessor(StatefulProcessor):
    """The same window as state of a stream: one row of buckets per key.

    Values of a micro-batch are taken in their order; one that is not after the last that was
    taken comes too late for the window and leaves a row with null results.
    """

    def __init__(self, delta: float):
        self.delta = delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")
        self.buckets = handle.getListState("buckets", "lv int, n long, s double, q double")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        table = pd.concat(list(rows), ignore_index=True).sort_values("at")
        window = Adwin(self.delta, [tuple(b) for b in self.buckets.get()] if self.buckets.exists() else [])
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for at, x in zip(table["at"].tolist(), table["value"].tolist()):
            if last is not None and at <= last:
                out.append((key[0], at, x, None, None, None, None))
                continue
            n, mean, cut = window.add(x)
            last = at
            out.append((key[0], at, x, n, mean, cut, cut > 0))
        self.buckets.put([tuple(b) for b in window.buckets])
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["key", "at", "value", "width", "mean", "n_cut", "drift"]).astype({"width": "Int64", "n_cut": "Int64", "drift": "boolean"})

    def close(self) -> None:
        pass


def adwin_stream(stream: DataFrame, delta: float = 0.002) -> DataFrame:
    """ADWIN on a stream of (key string, at long, value double); run it under RocksDB."""
    rows = stream.where(F.col("value").isNotNull() & ~F.isnan("value")).select("key", "at", "value")
    return rows.groupBy("key").transformWithStateInPandas(AdwinProcessor(delta), f"key string, at long, value double, {ADWIN_OUT}", "Update", "None")
