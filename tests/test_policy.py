"""Policy fold: parallel-prefix plan against a plain statement of the loop."""

import datetime as dt
import random

import pytest

from driftspark.operators import policy


def _run(spark, xs, chunk, **kw):
    base = dt.datetime(2024, 1, 1)
    rows = [("m", base + dt.timedelta(hours=i), x) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "model string, cycle_end timestamp, trig boolean")
    out = policy.apply_policy(df, ["model"], "cycle_end", "trig", dt.timedelta(hours=1), chunk=chunk, **kw)
    got = sorted(out.collect(), key=lambda r: r.cycle_end)
    return [(r.should_trigger, r.attempted, r.suppressed, r.alert, r.clear_streak, r.trigger_count) for r in got]


@pytest.mark.parametrize("mode,streak", [("edge", "cumulative"), ("edge", "consecutive"), ("level", "cumulative")])
@pytest.mark.parametrize("chunk", [5, 1024])
def test_matches_reference(spark, mode, streak, chunk):
    rnd = random.Random(7)
    xs = [rnd.random() < 0.4 for _ in range(60)]
    got = _run(spark, xs, chunk, mode=mode, streak=streak, cooldown=dt.timedelta(hours=3), clear_streak=3)
    want = policy.policy_fold_reference(xs, mode, 3, 3, streak)
    if mode == "level":
        want = [(x, a, s, False, 0, t) for (x, a, s, _, _, t) in want]
    assert got == want


def test_blueprint_trace(spark):
    # drift at cycles 1, 2, 6, 11, 12; re-arm after 3 clears; cooldown 3 cycles → fires at 1, 6, 11
    xs = [i in (1, 2, 6, 11, 12) for i in range(14)]
    got = _run(spark, xs, 4, cooldown=dt.timedelta(hours=3), clear_streak=3)
    assert [i for i, r in enumerate(got) if r[1]] == [1, 6, 11]
