"""Detector invariants and hand-checked values (blueprint section 5, items c-e)."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.functions import hashing, special
from driftspark.functions import pvalues as pv
from driftspark.operators import detectors as D
from driftspark.operators import columns, extras, observe, ranks

SF = "/root/testdata/sf0.001"


def _long(spark, ref, rec):
    rows = [("x", "ref", float(v)) for v in ref] + [("x", "rec", float(v)) for v in rec]
    return spark.createDataFrame(rows, "column_name string, role string, value double")


def test_two_phase_equals_one_phase(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    long = li.select(F.lit("p").alias("k"), F.when(F.col("l_linenumber") % 2 == 0, "ref").otherwise("rec").alias("role"),
                     F.col("l_extendedprice").alias("value"))
    counts = ranks.value_counts(long, ["k"], "value", "role", ["ref", "rec"], ["a", "b"])
    two = ranks.cumulative(counts, ["k"], "value", ["a", "b"], partitions=7)
    one = ranks.cumulative_one_phase(counts, ["k"], "value", ["a", "b"])
    cols = ["k", "value", "cum_a", "cum_b", "tot_a", "tot_b"]
    assert sorted(map(tuple, two.select(cols).collect())) == sorted(map(tuple, one.select(cols).collect()))


def test_many_range_partitions_keep_every_row(spark):
    rng = np.random.default_rng(9)
    rows = [(f"g{i % 3}", float(v), 1, 1) for i, v in enumerate(np.round(rng.normal(0, 10, 20000), 2))]
    df = spark.createDataFrame(rows, "k string, value double, a long, b long").repartition(16)
    counts = df.groupBy("k", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    two = ranks.cumulative(counts, ["k"], "value", ["a", "b"], partitions=37)
    one = ranks.cumulative_one_phase(counts, ["k"], "value", ["a", "b"])
    cols = ["k", "value", "cum_a", "cum_b", "tot_a"]
    assert two.count() == counts.count()
    assert sorted(map(tuple, two.select(cols).collect())) == sorted(map(tuple, one.select(cols).collect()))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    xs = np.round(rng.lognormal(3, 1, 2000), 2)
    df = spark.createDataFrame([("g", float(v)) for v in xs], "g string, v double")
    for t in (None, 13):
        q = ranks.exact_quantiles(df, ["g"], "v", [0.0, 0.1, 0.25, 0.5, 0.95, 1.0], partitions=t).first()
        want = np.quantile(xs, [0.0, 0.1, 0.25, 0.5, 0.95, 1.0])
        assert [q.q00, q.q10, q.q25, q.q50, q.q95, q.q100] == pytest.approx(list(want), rel=1e-12)


def test_ks_statistic_matches_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = np.round(rng.normal(0, 1, 300), 3), np.round(rng.normal(0.3, 1, 250), 3)
    r = D.ks_test(_long(spark, a, b), ["column_name"], partitions=11).first()
    grid = np.sort(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    assert r.ks_d == pytest.approx(np.max(np.abs(fa - fb)), abs=1e-15)
    ne = len(a) * len(b) / (len(a) + len(b))
    lam = (math.sqrt(ne) + 0.12 + 0.11 / math.sqrt(ne)) * r.ks_d
    q = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    assert r.ks_p == pytest.approx(min(max(q, 0), 1), rel=1e-9)


def test_ks_small_sample_gate(spark):
    r = D.ks_test(_long(spark, range(19), range(100)), ["column_name"]).withColumn("ks_p", D.gated("ks_p", 1.0)).first()
    assert r.ks_p == 1.0


def test_chi2_yates_hand_checked(spark):
    # 2x2: category u has (ref 10, rec 20), category v (ref 30, rec 40)
    rows = ([("c", "ref", "u")] * 10 + [("c", "rec", "u")] * 20 + [("c", "ref", "v")] * 30 + [("c", "rec", "v")] * 40)
    df = spark.createDataFrame(rows, "column_name string, role string, value string")
    r = D.chi2_test(df, ["column_name"]).first()
    n, a, b, c, d = 100.0, 10.0, 20.0, 30.0, 40.0
    dev = max(abs(a * d - b * c) / n - 0.5, 0)
    want = dev * dev * n ** 3 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert r.chi2 == pytest.approx(want, rel=1e-12)
    assert r.chi2_p == pytest.approx(math.erfc(math.sqrt(want / 2)), rel=1e-9)
    r2 = D.chi2_test(df, ["column_name"], yates=False).first()
    assert r2.chi2 == pytest.approx(n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)), rel=1e-12)


def test_chi2_single_category_gives_one(spark):
    rows = [("c", "ref", "u")] * 30 + [("c", "rec", "u")] * 30
    df = spark.createDataFrame(rows, "column_name string, role string, value string")
    assert D.chi2_test(df, ["column_name"]).withColumn("chi2_p", D.gated("chi2_p", 1.0)).first().chi2_p == 1.0


def test_psi_identity_and_out_of_range(spark):
    xs = [float(i % 97) for i in range(500)]
    assert D.psi(_long(spark, xs, xs), ["column_name"]).first().psi == pytest.approx(0.0, abs=1e-15)
    shifted = [x + 1000 for x in xs]
    drop = D.psi(_long(spark, xs, shifted), ["column_name"]).first().psi
    ext = D.psi(_long(spark, xs, shifted), ["column_name"], out_of_range="extend").first().psi
    assert drop > 0 and ext > drop  # dropped values shrink the current histogram (G5)


def test_psi_matches_numpy_histogram(spark):
    rng = np.random.default_rng(5)
    ref, cur = rng.exponential(50, 400), rng.exponential(55, 300)
    got = D.psi(_long(spark, ref, cur), ["column_name"]).first().psi
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    rh, _ = np.histogram(ref, bins=edges)
    ch, _ = np.histogram(cur, bins=edges)
    rp = np.clip(rh / max(rh.sum(), 1), 1e-6, None)
    cp = np.clip(ch / max(ch.sum(), 1), 1e-6, None)
    assert got == pytest.approx(float(np.sum((rp - cp) * np.log(rp / cp))), rel=1e-12)


def test_pvalue_tails(spark):
    df = spark.createDataFrame([(x,) for x in (0.3, 1.0, 2.5, 3.2, 6.0)], "x double")
    for r in df.select("x", pv.erfc("x").alias("e")).collect():
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-9)
    crit = spark.createDataFrame([(3.841458820694124, 1), (9.487729036781154, 4), (11.070497693516351, 5)],
                                 "x double, k int")
    for r in crit.select(special.chi2_sf("x", "k").alias("p")).collect():
        assert r.p == pytest.approx(0.05, rel=1e-9)


def test_hash_uniform_matches_python(spark):
    def py(key, seed):
        return int(hashlib.md5(f"{key}:{seed}".encode()).hexdigest()[:12], 16) / 2 ** 48
    df = spark.range(0, 50).select(F.col("id"), hashing.uniform(F.col("id"), 42).alias("u"))
    for r in df.collect():
        assert r.u == py(r.id, 42)


@pytest.mark.parametrize("stride", [1, 2 ** 31])
def test_draws_of_two_seeds_are_uncorrelated(spark, stride):
    k = F.col("id") * stride
    u = np.array(spark.range(4000).select(hashing.uniform(k, 1), hashing.uniform(k, 2), hashing.uniform(k + stride, 1)).collect())
    assert abs(u.mean(axis=0) - 0.5).max() < 0.03 and abs(u.var(axis=0) - 1 / 12).max() < 0.01
    c = np.corrcoef(u.T)
    assert max(abs(c[0, 1]), abs(c[0, 2]), abs(c[1, 2])) < 0.06


@pytest.mark.parametrize("n", [10 ** 3, 10 ** 6, 10 ** 9, 10 ** 12])
def test_counts_of_any_size(spark, n):
    """Products of counts pass 64 bits from about 1e9 rows a side on."""
    cells = {"a": (n, n + n // 50), "b": (n, n - n // 50)}
    df = spark.createDataFrame([("x", k, r, c) for k, (r, c) in cells.items()], "column_name string, value string, n_ref long, n_rec long")
    r = D.chi2_from_counts(df, ["column_name"]).first()
    tot, col = 4 * n, 2 * n
    want = Fraction((abs(cells["a"][0] * cells["b"][1] - cells["a"][1] * cells["b"][0]) * 2 - tot) ** 2 * tot, 4 * sum(cells["a"]) * sum(cells["b"]) * col * col)
    assert r.chi2 == pytest.approx(float(want), rel=1e-9) and r.enough_rows
    num = spark.createDataFrame([("x", 1.0, n, n // 2), ("x", 2.0, n, 3 * n // 2)], "column_name string, value double, n_ref long, n_rec long")
    k = D.ks_from_counts(num, ["column_name"]).first()
    assert k.ks_d == pytest.approx(0.25) and k.ks_p < 1e-9


def test_few_rows_keep_their_statistics(spark):
    r = D.ks_test(_long(spark, [1, 2, 3], [10, 11]), ["column_name"]).first()
    assert r.ks_d == 1.0 and 0 < r.ks_p < 0.3 and not r.enough_rows
    p = D.psi(_long(spark, range(10), range(5, 15)), ["column_name"]).first()
    assert p.psi > 0 and not p.enough_rows


def test_nan_is_a_missing_value(spark):
    clean, dirty = _long(spark, range(100), range(50)), _long(spark, range(100), [*range(50), *[float("nan")] * 50])
    wide = lambda df: columns.to_long(df.select("role", "value"), ["role"], ["value"], "double", "column_name")
    a, b = (D.ks_test(wide(df), ["column_name"]).first() for df in (clean, dirty))
    assert a == b
    pos = D.positive_ratio(dirty, ["column_name"], "value", threshold=1000).first()
    assert pos.pos_ratio == 0.0


def test_bootstrap_width(spark):
    """The half-width of the mean's interval is near 1.96 standard errors."""
    rng = np.random.default_rng(8)
    x = rng.normal(100, 15, 6000)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)], "g string, k long, v double")
    ci = extras.percentile_ci(extras.bootstrap_means(df, ["g"], "k", "v"), ["g"], "mean").first()
    assert (ci.ci_hi - ci.ci_lo) / 2 == pytest.approx(1.96 * x.std() / math.sqrt(len(x)), rel=0.15)


def test_resource_parse_units(spark):
    df = spark.createDataFrame([("0.00%,117.2MiB / 3.577GiB,3.20%",)], "s string")
    r = df.select(observe.parse_resource(F.col("s")).alias("r")).first().r
    assert (r.cpu_perc, r.mem_used_mb, r.mem_perc) == (0.0, 117.2, 3.2)
    assert r.mem_limit_mb == pytest.approx(3.577 * 1024)


def test_scenario_tag(spark):
    df = spark.createDataFrame([("Drift Run #2",), ("",), (None,)], "s string")
    got = [r.t for r in df.select(observe.scenario_tag(F.col("s")).alias("t")).collect()]
    assert got == ["drift_run_2", "manual", "manual"]


def test_verdict_with_holm_adjustment(spark):
    import datetime as dt
    from driftspark.plans import monitor
    ev = spark.read.parquet(f"{SF}/events.parquet").select("ts", "value", "event_type")
    raw = monitor.cycle_tests(ev, "ts", dt.timedelta(days=1), dt.timedelta(days=1),
                              monitor.MonitorConfig(score_col="value"))["tests"]
    adj = monitor.cycle_tests(ev, "ts", dt.timedelta(days=1), dt.timedelta(days=1),
                              monitor.MonitorConfig(score_col="value", adjust="holm"))["tests"]
    r = {(x.cycle_end, x.column_name): x.p_value for x in raw.collect()}
    a = {(x.cycle_end, x.column_name): (x.p_value, x.p_raw) for x in adj.collect()}
    assert set(r) == set(a)
    for k, (p_adj, p_raw) in a.items():
        assert p_raw == pytest.approx(r[k]) and p_adj >= p_raw - 1e-15 and p_adj <= 1.0
