"""Incomplete gamma and beta templates against high-precision sums."""

import math
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from driftspark.functions import special as S

getcontext().prec = 60


def chi2_tail(x, k):
    """Finite sum for even k in 60 digits."""
    half, term, total = Decimal(str(x)) / 2, Decimal(1), Decimal(0)
    for i in range(k // 2):
        total += term
        term = term * half / (i + 1)
    return float(total * (-half).exp())


def test_chi2_tail_has_no_switch(spark):
    """1e-9 relative on both sides of 1000 degrees of freedom and far beyond, in both tails."""
    cases = []
    for k in (2, 4, 10, 50, 998, 1000, 1002, 10_000, 100_000):
        for z in (-4.0, -1.0, 0.0, 0.3, 2.0, 5.0, 8.0):
            x = max(round(k + z * math.sqrt(2 * k), 6), 0.001)
            cases.append((float(x), k, chi2_tail(x, k)))
    rows = spark.createDataFrame(cases, "x double, k long, want double").withColumn("got", S.chi2_sf("x", "k")).collect()
    for r in rows:
        assert r.got == pytest.approx(r.want, rel=1e-9), (r.x, r.k)


def test_chi2_tail_of_odd_dof_and_monotone(spark):
    one = spark.createDataFrame([(x, 1) for x in (1e-12, 0.01, 1.0, 3.84, 30.0, 200.0)], "x double, k long").withColumn("p", S.chi2_sf("x", "k")).collect()
    for r in one:
        assert r.p == pytest.approx(math.erfc(math.sqrt(r.x / 2)), rel=1e-10)
    around = spark.createDataFrame([(1050.0, k) for k in range(990, 1012)], "x double, k long").withColumn("p", S.chi2_sf("x", "k")).orderBy("k").collect()
    steps = [b.p - a.p for a, b in zip(around, around[1:])]
    assert all(s > 0 for s in steps) and all(abs(b / a - 1) < 0.04 for a, b in zip(steps, steps[1:]))  # smooth across 1000
    big = spark.createDataFrame([(1e9 + 3e4, 10 ** 9), (0.0, 5), (-1.0, 5)], "x double, k long").withColumn("p", S.chi2_sf("x", "k")).collect()
    assert big[0].p == pytest.approx(0.5 * math.erfc(3e4 / math.sqrt(2e9) / math.sqrt(2)), rel=2e-3) and big[1].p == big[2].p == 1.0


def test_clopper_pearson(spark):
    """Closed forms at no hits and hits only; elsewhere the binomial tails are 2.5 %."""
    cases = [(0, 1), (1, 1), (0, 17), (17, 17), (1, 1000), (3, 10), (500, 1000), (999, 1000), (7, 100_000), (0, 10 ** 9)]
    lo, hi = S.clopper_pearson("k", "n")
    rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", lo.alias("lo"), hi.alias("hi")).collect()

    def tail(k, n, p, up):
        i, j = (k, n) if up else (0, k)
        return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p)) for x in range(i, j + 1))

    for r in rows:
        if r.k == 0:
            assert r.lo == 0 and r.hi == pytest.approx(-math.expm1(math.log(0.025) / r.n), rel=1e-9)
        if r.k == r.n:
            assert r.hi == 1 and r.lo == pytest.approx(0.025 ** (1 / r.n), rel=1e-9)
        if 0 < r.k < r.n:
            assert tail(r.k, r.n, r.lo, True) == pytest.approx(0.025, rel=1e-8)
            assert tail(r.k, r.n, r.hi, False) == pytest.approx(0.025, rel=1e-8)
    odd = spark.createDataFrame([(None, 5), (1, None), (1, 0), (3, 2)], "k long, n long").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert all(r.lo is None and r.hi is None for r in odd)


def test_normal_quantile_and_cdf(spark):
    shares = [1e-12, 1e-4, 0.025, 0.3, 0.5, 0.6, 0.975, 0.999999]
    rows = spark.createDataFrame([(p,) for p in shares], "p double").withColumn("z", F.expr(S.normal_quantile("p"))).withColumn("back", F.expr(S.normal_cdf("z"))).collect()
    for r in rows:
        assert r.back == pytest.approx(r.p, rel=1e-9, abs=1e-15)
        assert 0.5 * math.erfc(-r.z / math.sqrt(2)) == pytest.approx(r.p, rel=1e-9)
