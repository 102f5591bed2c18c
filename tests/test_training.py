"""Training, fixed samples, column roles and labelled drift periods."""

import datetime as dt
import math
import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from driftspark.functions.hashing import hash_int
from driftspark.operators import columns, labels, logistic, sampling, windows
from driftspark.plans import monitor, retrain


def _rows(n=600, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.gauss(50_000, 20_000), rng.random() / 10
        z = (a - 60_000) / 15_000 + 20 * (b - 0.05)
        out.append((i, a, b, 7.0, int(rng.random() < 1 / (1 + math.exp(-z))), rng.choice([0.5, 1.0, 3.0])))
    return out


def test_minimum_is_that_of_an_independent_optimiser(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k long, a double, b double, const double, label int, weight double").checkpoint()
    model = logistic.fit(df, ["a", "b", "const"])
    assert model.converged and model.passes <= 12
    total = sum(r[5] for r in rows)
    vec = VectorAssembler(inputCols=["a", "b", "const"], outputCol="features").transform(df)
    other = LogisticRegression(weightCol="weight", regParam=1 / total, elasticNetParam=0.0, standardization=False, maxIter=5000, tol=1e-14).fit(vec)

    def objective(w0, w):
        loss = 0.0
        for _, a, b, c, y, s in rows:
            z = w0 + w[0] * a + w[1] * b + w[2] * c
            loss += s * (max(z, 0) + math.log1p(math.exp(-abs(z))) - y * z)
        return loss + sum(v * v for v in w) / 2

    mine, theirs = objective(model.intercept, model.coefficients), objective(other.intercept, list(other.coefficients))
    assert mine <= theirs * (1 + 1e-9) and mine == pytest.approx(model.loss, rel=1e-9)
    assert model.coefficients[0] == pytest.approx(other.coefficients[0], rel=1e-3)
    # the gradient is zero at the minimum
    for j in range(2):
        for sign in (1, -1):
            moved = list(model.coefficients)
            moved[j] += sign * 1e-4 / model.scales[j]
            assert objective(model.intercept, moved) >= mine


def test_separable_classes_and_a_halved_step(spark):
    df = spark.createDataFrame([(float(i), int(i >= 50), 1.0) for i in range(100)] + [(1e4, 1, 1.0)], "x double, label int, weight double").checkpoint()
    model = logistic.fit(df, ["x"], l2=1e-3)
    assert model.converged and model.coefficients[0] > 0
    assert retrain.score(model, df).first().f1 == 1.0


def test_rows_of_one_key_stay_on_one_side(spark):
    df = spark.createDataFrame([(i // 3, i % 2) for i in range(600)], "k long, label int")
    got = sampling.stratified_split(df, "k", "label").collect()
    sides = {}
    for r in got:
        sides.setdefault((r.label, r.k), set()).add(r.is_test)
    assert len(got) == 600 and all(len(s) == 1 for s in sides.values())
    for y in (0, 1):
        assert 58 <= sum(r.is_test for r in got if r.label == y) <= 60


@pytest.mark.parametrize("n, fraction", [(0, 1.0), (1, 1.0), (137, 1.0), (137, 0.2), (5000, 1.0)])
def test_fixed_sample_is_the_head_of_the_hash_order(spark, n, fraction):
    df = spark.range(2000).withColumnRenamed("id", "k")
    order = [r.k for r in df.where(hash_int(F.col("k"), 42) < int(fraction * (1 << 48))).orderBy(hash_int(F.col("k"), 42)).collect()]
    assert {r.k for r in sampling.sample_fixed(df, "k", n, fraction).collect()} == set(order[:n])


def test_fixed_sample_of_repeated_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0)], "k long, v int")
    assert sampling.sample_fixed(df, "k", 20).count() == 20
    assert sampling.sample_fixed(df.limit(0), "k", 20).count() == 0


def test_roles(spark):
    df = spark.createDataFrame([], "month int, proba double, amount double, flag boolean, label int, city string, id string, score_1 float")
    got = columns.roles(df, {"id"})
    assert got == columns.Roles(("proba", "amount", "label", "score_1"), ("city",), "proba", False, ("label",))
    assert columns.roles(df, {"id"}, "amount").score == "amount"
    assert columns.roles(df.select("amount", "label")) == columns.Roles(("amount", "label"), (), "amount", True, ("label",))
    assert columns.roles(df.select("flag")) == columns.Roles((), (), None, False, ())


def test_table_without_testable_columns_has_no_drift(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1 + i), True) for i in range(9)], "ts timestamp, flag boolean")
    got = monitor.snapshot(df, "ts", "2024-01-09 00:00:00", dt.timedelta(days=3))
    assert got["tests"].count() == 0 and got["psi"] is None
    assert [(r.drift_any, r.should_trigger) for r in got["verdict"].collect()] == [(False, False)]


def test_poll_without_time_column_compares_halves(spark):
    df = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("score"))
    got = monitor.snapshot(df, None, "2024-01-09 00:00:00", dt.timedelta(days=3), key="k")
    r = got["tests"].first()
    assert r.n_ref + r.n_rec == 4000 and not got["verdict"].first().should_trigger
    with pytest.raises(ValueError):
        monitor.snapshot(df, None, "2024-01-09 00:00:00", dt.timedelta(days=3))


def test_cycles_differ_by_their_share_of_a_period(spark):
    days = spark.range(1, 9).select(F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, id)").alias("e"), "id")
    got = {r.id: r.c for r in days.select("id", windows.changed(F.col("e"), dt.timedelta(days=1), [("2024-01-03 00:00:00", "2024-01-05 00:00:00"), ("2024-01-07 06:00:00", "2024-01-07 12:00:00")]).alias("c")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True, 8: True}


def test_split_ranks_one_cell_and_equals_the_whole_order(spark, monkeypatch):
    """The (key hash, key) order by brute force, with repeated and null keys and labels; no sort of all rows."""
    ranked = []
    real = sampling.ranks.cumulative
    monkeypatch.setattr(sampling.ranks, "cumulative", lambda counts, *a, **k: (ranked.append(counts.count()), real(counts, *a, **k))[1])
    data = [(f"k{i // 2}" if i % 50 else None, int(i % 5 > 1) if i % 97 else None, i) for i in range(3000)] + [("same", 2, i) for i in range(9)]
    df = spark.createDataFrame(data, "k string, label int, i int").repartition(4)
    for fraction in (0.0, 0.01, 0.2, 1.0):
        got = {r.i + 10_000 * (r.k == "same"): r.is_test for r in sampling.stratified_split(df, "k", "label", fraction).collect()}
        h = {r.k: r.h for r in df.select("k", hash_int(F.col("k"), 42).alias("h")).distinct().collect()}
        want = {}
        for y in (0, 1, 2):
            order = [((h[k] if k is not None else -1, k or ""), i + 10_000 * (k == "same")) for k, label, i in data if label == y]
            quota = math.ceil(len(order) * fraction)
            want |= {i: sum(o <= at for o, _ in order) <= quota for at, i in order}
        assert got == want, fraction
    assert max(ranked) < 300


def test_class_weights_are_not_worked_out_again_by_readers(spark):
    rows = labels.with_weights(spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "i int, label int"))
    assert "Aggregate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.label, round(r.weight, 9)) for r in rows.collect()} == {(0, 0.75), (1, 1.5)}
