"""Streaming watcher against the batch plans on the smoke tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftspark.plans import catalog, monitor
from driftspark.streaming import watch

SF = "/root/testdata/sf0.001"
DAY = dt.timedelta(days=1)


def test_stream_policy_equals_batch_on_closed_cycles(spark):
    batch = catalog.q_policy_edge(spark, SF)
    stream = catalog.q_stream_policy(spark, SF)
    last = stream.agg(F.max("cycle_end")).first()[0]
    b = sorted(map(tuple, batch.where(F.col("cycle_end") <= last).collect()))
    s = sorted(map(tuple, stream.collect()))
    assert s == b and len(s) > 100


def test_stream_windows_equals_batch_fanout(spark):
    s = {(r.cycle_end, r.role): (r.n_rows, r.sum_value) for r in catalog.q_stream_windows(spark, SF).collect()}
    ev = spark.read.parquet(f"{SF}/events.parquet")
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    per = ev.groupBy(day.alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).collect()
    want = {}
    for r in per:
        for off, role in ((1, "rec"), (2, "ref")):
            want.setdefault(int(r.d) + off, {}).setdefault(role, [0, 0.0])
            want[int(r.d) + off][role][0] += r.n
            want[int(r.d) + off][role][1] += r.v
    for (end, role), (n, v) in s.items():
        key = int(end.timestamp()) // 86400
        assert want[key][role][0] == n
        assert want[key][role][1] == pytest.approx(v, abs=1e-5)


@pytest.fixture(scope="module")
def unordered(spark, tmp_path_factory):
    """The events table as five files split by hash, so that every file spans the month."""
    path = tmp_path_factory.mktemp("unordered")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(5):
        ev.where(F.pmod(F.hash("event_id"), F.lit(5)) == i).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return str(path)


def test_five_unordered_files_lose_nothing(spark, unordered):
    """With the production delay of an hour; late rows are merged and counted."""
    got = {(r.cycle_end, r.role): r for r in catalog.q_stream_windows(spark, unordered).collect()}
    want = {(r.cycle_end, r.role): r for r in catalog.q_stream_windows(spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) == 60
    assert all(got[k].n_rows == want[k].n_rows and got[k].closed == want[k].closed and got[k].sum_value == pytest.approx(want[k].sum_value, abs=1e-4) for k in got)
    assert sum(r.n_late for r in want.values()) == 0
    total, late = sum(r.n_rows for r in got.values()), sum(r.n_late for r in got.values())
    assert total == 2000 and 0.7 * total < late < total  # four of five files came after the mark


def test_five_unordered_files_give_the_same_policy_and_verdicts(spark, unordered):
    for query in (catalog.q_stream_policy, catalog.q_stream_drift):
        got, want = (sorted(map(tuple, query(spark, sf).collect())) for sf in (unordered, SF))
        assert got == want and len(got) > 30


def _loop(spark, source, path, cfg=None, evaluate=None):
    stream = watch.table_stream(spark, f"{source}/events.parquet", catalog.EVENTS_SCHEMA, max_files=1)
    return watch.run_loop(stream, f"{path}/loop", f"{path}/ck", "ts", DAY, DAY, dt.timedelta(hours=1), ["value"], ["event_type"], "value",
                          cfg or monitor.MonitorConfig(score_col="value", alpha=0.2), evaluate)


def _rows(df):
    return sorted(map(str, df.collect()))


def test_one_loop_over_unordered_files(spark, unordered, tmp_path, monkeypatch):
    """Metrics, verdicts and alerts of five unordered files equal those of one; replaying an
    epoch or summing deltas into a base changes nothing."""
    one, five = _loop(spark, SF, tmp_path / "one"), _loop(spark, unordered, tmp_path / "five")
    policy = dict(step=DAY, cooldown=dt.timedelta(days=3), horizon=dt.timedelta(days=90), clear_streak=2)
    watch.run_alerts(one, f"{tmp_path}/a1", **policy)
    watch.run_alerts(five, f"{tmp_path}/a5", **policy)
    assert _rows(one.current("verdicts")) == _rows(five.current("verdicts"))
    key = lambda r: (r.cycle_end, r.metric, r.column)
    a, b = ({key(r): r.value for r in x.current("metrics").collect()} for x in (one, five))
    assert a == pytest.approx(b, nan_ok=True) and {k[1] for k in a} == {"pvalue", "drift_detected", "psi", "pos_ratio"}
    alert = lambda x: _rows(x.current("alerts").drop("revised"))
    assert alert(one) == alert(five)
    assert any("attempted=True" in r for r in alert(one))
    assert five.failures.read().count() == 0

    before = [_rows(five.panes.read()), _rows(five.current("verdicts")), _rows(five.arrivals.late.read())]
    last = max(watch._numbers(spark, f"{five.panes.path}/deltas", "epoch"))
    write = watch.loop_writer(five, "ts", DAY, DAY, ["value"], ["event_type"], "value", monitor.MonitorConfig(score_col="value", alpha=0.2))
    batch = sorted(spark.read.parquet(f"{unordered}/events.parquet").inputFiles())
    seen = [spark.read.parquet(f) for f in batch]
    counts = {f: df.agg(F.count(F.lit(1))).first()[0] for f, df in zip(batch, seen)}
    mine = five.arrivals.seen.read().where(F.col("epoch") == last).agg(F.sum("n_rows")).first()[0]
    replay = [df for f, df in zip(batch, seen) if counts[f] == mine]
    assert replay
    five.panes.compact(last - 1)
    assert _rows(five.panes.read()) == before[0]
    if len(replay) == 1:
        write(replay[0], last)
        assert [_rows(five.panes.read()), _rows(five.current("verdicts")), _rows(five.arrivals.late.read())] == before


def test_a_poisoned_cycle_is_isolated(spark, tmp_path):
    """It leaves a row with its error; all other cycles are published."""
    bad = dt.datetime(2024, 1, 10)

    def poisoned(num, cat, score, cfg):
        hit = F.col("cycle_end") == F.lit(bad.strftime("%Y-%m-%d")).cast("timestamp")
        num = num.withColumn("n_ref", F.when(hit, F.raise_error(F.lit("broken pane")).cast("long")).otherwise(F.col("n_ref")))
        return monitor.tests_from_cycle_counts(num, cat, score, cfg)

    loop = _loop(spark, SF, tmp_path, evaluate=poisoned)
    failed = loop.open_failures().collect()
    assert [r.cycle_end for r in failed] == [bad] and "broken pane" in failed[0].error
    ends = {r.cycle_end for r in loop.current("verdicts").collect()}
    assert len(ends) == 30 and bad not in ends


def test_late_verdicts_revise_the_policy(spark, tmp_path):
    """Verdicts in three files out of order: the last state equals the policy on all in order."""
    from driftspark.operators import policy
    xs = [i % 7 in (0, 1) or i % 11 == 3 for i in range(40)]
    rows = [(i, x) for i, x in enumerate(xs)]
    loop = watch.open_loop(spark, str(tmp_path), DAY, DAY)
    ends = lambda part: spark.createDataFrame(part, "i long, x boolean").select(
        F.timestamp_seconds((F.col("i") + 19_000) * 86400).alias("cycle_end"), F.col("x").alias("drift_any"), F.lit(0.5).alias("p_min"), F.lit(0.5).alias("reject_share"),
        F.lit(1).cast("long").alias("n_tests"), F.lit(0.1).alias("psi"), F.col("x").alias("should_trigger"))
    wrong = [(i, not x) for i, x in rows if i % 5 == 0]
    for epoch, part in enumerate([[r for r in rows if r[0] % 2 and r[0] % 5] + wrong, [r for r in rows if r[0] % 2 == 0], rows[5::10]]):
        loop.verdicts.write(ends(part).coalesce(1), epoch)
        watch.run_alerts(loop, f"{tmp_path}/ck", DAY, dt.timedelta(days=5), dt.timedelta(days=90))
    assert loop.alerts.read().where("revised").count() > 0
    got = [(r.should_trigger, r.attempted, r.suppressed, r.alert, r.clear_streak, r.trigger_count) for r in loop.current("alerts").orderBy("cycle_end").collect()]
    assert got == policy.policy_fold_reference(xs, cooldown_cycles=5)
    # a horizon of five days: timers fold older cycles, a verdict behind it changes nothing
    short = watch.open_loop(spark, f"{tmp_path}/short", DAY, DAY)
    for epoch, part in enumerate([rows[:30], rows[30:], [(2, not xs[2])]]):
        short.verdicts.write(ends(part).coalesce(1), epoch)
        watch.run_alerts(short, f"{tmp_path}/ck5", DAY, dt.timedelta(days=5), dt.timedelta(days=5))
    got = [(r.should_trigger, r.attempted, r.suppressed, r.alert, r.clear_streak, r.trigger_count) for r in short.current("alerts").orderBy("cycle_end").collect()]
    assert got == policy.policy_fold_reference(xs, cooldown_cycles=5)
