"""Scenario comparison against the published report (recovered F1 samples)."""

import math

import pytest
from pyspark.sql import functions as F

from driftspark.operators import compare as K
from driftspark.plans.report import scenario_report

# Recovered F1 of the 'default' (16) and 'manual' (24) runs, in run order.
DEFAULT_F1 = [
    0.8196856906534326, 0.8434994771697456, 0.8414043583535109, 0.8414043583535109,
    0.8220681686886193, 0.833678756476684, 0.8264971287940935, 0.8168398031711318,
    0.8168398031711318, 0.8124904798172125, 0.8093628088426528, 0.8038875390489414,
    0.8085198399827008, 0.8434994771697456, 0.8434994771697456, 0.8154471544715447,
]
MANUAL_F1 = [
    0.8201603665521191, 0.8236355435272892, 0.8264971287940935, 0.8154471544715447,
    0.8154471544715447, 0.8168398031711318, 0.8168398031711318, 0.8168398031711318,
    0.8089605734767025, 0.8089605734767025, 0.8124904798172125, 0.8124904798172125,
    0.807721309003167, 0.807721309003167, 0.8093628088426528, 0.8093628088426528,
    0.8093628088426528, 0.7933479437927033, 0.8038875390489414, 0.8038875390489414,
    0.8085198399827008, 0.8085198399827008, 0.7975921745673439, 0.8154471544715447,
]


def _runs(spark, a, b, names=("default", "manual")):
    rows = [(i, names[0], v) for i, v in enumerate(a)] + [(100 + i, names[1], v) for i, v in enumerate(b)]
    return spark.createDataFrame(rows, "run long, scenario string, f1 double")


@pytest.mark.parametrize("partitions", [None, 13])
def test_golden_report(spark, partitions):
    rep = scenario_report(_runs(spark, DEFAULT_F1, MANUAL_F1), "scenario", ["f1"], "run",
                          partitions=partitions).collect()
    t = [r for r in rep if r.row_type == "mannwhitney"]
    assert len(t) == 1
    assert (t[0].A, t[0].B, t[0].nA, t[0].nB) == ("default", "manual", 16, 24)
    assert t[0].pvalue == pytest.approx(0.0025464726577283, rel=1e-9)
    assert t[0].cliffs_delta == pytest.approx(0.5703125, abs=1e-12)
    assert t[0].pvalue_fdr == pytest.approx(t[0].pvalue)
    s = {r.summary_scope: r for r in rep if r.row_type == "summary"}
    assert list(s) == ["global", "scenario:default", "scenario:manual"]
    g = s["global"]
    assert g.summary_n == 40
    assert g.summary_mean == pytest.approx(0.816699156517, abs=1e-11)
    assert g.summary_std == pytest.approx(0.012362094106, abs=1e-11)
    assert g.summary_p25 == pytest.approx(0.808850390103, abs=1e-11)
    assert g.summary_median == pytest.approx(0.815447154472, abs=1e-11)
    assert g.summary_p75 == pytest.approx(0.820637317086, abs=1e-11)
    d = s["scenario:default"]
    assert d.summary_p25 == pytest.approx(0.814707985808, abs=1e-11)
    assert d.summary_p75 == pytest.approx(0.841404358354, abs=1e-11)
    m = s["scenario:manual"]
    assert m.summary_std == pytest.approx(0.007335207821, abs=1e-11)
    assert m.summary_median == pytest.approx(0.809362808843, abs=1e-11)


def test_golden_watcher(spark):
    manual = MANUAL_F1[:21] + MANUAL_F1[23:]  # builds 32 and 33 (entries 22, 23) absent
    assert len(manual) == 22
    rep = scenario_report(_runs(spark, DEFAULT_F1, manual), "scenario", ["f1"], "run").collect()
    t = [r for r in rep if r.row_type == "mannwhitney"][0]
    assert t.pvalue == pytest.approx(0.0050676000971462, rel=1e-9)
    assert t.cliffs_delta == pytest.approx(0.5397727272727, abs=1e-12)


def test_cliffs_delta_sign_and_scale(spark):
    rep = scenario_report(_runs(spark, [1.0] * 5, [2.0] * 5, ("x", "y")), "scenario", ["f1"], "run").collect()
    t = [r for r in rep if r.row_type == "mannwhitney"][0]
    assert t.cliffs_delta == -1.0
    rep = scenario_report(_runs(spark, [2.0] * 5, [1.0] * 5, ("x", "y")), "scenario", ["f1"], "run").collect()
    assert [r for r in rep if r.row_type == "mannwhitney"][0].cliffs_delta == 1.0


def test_bh_bounds_and_values(spark):
    p = [0.001, 0.02, 0.04, 0.2, 0.8]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "a_rank int, pvalue double")
    out = K.bh_adjust(df, order=["a_rank"]).orderBy("a_rank").collect()
    adj = [r.pvalue_fdr for r in out]
    assert adj == pytest.approx([0.005, 0.05, 0.2 / 3, 0.25, 0.8])
    assert all(0 <= v <= 1 for v in adj)
    assert adj == sorted(adj)


def test_holm(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "a_rank int, pvalue double")
    out = {r.a_rank: r.pvalue_holm for r in K.holm_adjust(df, order=["a_rank"]).collect()}
    # sorted: .005*4=.02, .01*3=.03, .03*2=.06, .04*1=.04 -> running max .02 .03 .06 .06
    assert out == pytest.approx({3: 0.02, 0: 0.03, 2: 0.06, 1: 0.06})


def test_three_scenarios_separated(spark):
    import random
    rnd = random.Random(42)
    rows = []
    for s, mu in (("E1", 0.80), ("E2", 0.60), ("E3", 0.78)):
        rows += [(len(rows), s, rnd.gauss(mu, 0.02)) for _ in range(30)]
    df = spark.createDataFrame(rows, "run long, scenario string, f1 double")
    rep = scenario_report(df, "scenario", ["f1"], "run").where(F.col("row_type") == "mannwhitney").collect()
    by = {(r.A, r.B): r for r in rep}
    assert len(by) == 3
    assert by[("E1", "E2")].pvalue < 0.001
    assert by[("E2", "E3")].pvalue < 0.001
    for r in rep:
        assert r.nA == 30 and r.nB == 30 and not math.isnan(r.pvalue)
