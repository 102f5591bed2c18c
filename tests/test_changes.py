"""Distances, change detectors, exact p-values and selections against plain definitions."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.operators import adaptive, compare, distances, exact, extras, observe, policy, ranks


def _counts(spark, a, b, key="g"):
    rows = [(key, float(v), a.count(v), b.count(v)) for v in sorted({*a, *b})]
    return spark.createDataFrame(rows, "k string, value double, n_ref long, n_rec long")


def test_energy_and_mmd_against_all_pairs(spark):
    rng = random.Random(2)
    a = [round(rng.gauss(0, 1), 2) for _ in range(150)]
    b = [round(rng.gauss(0.8, 1.5), 2) for _ in range(90)]
    counts = _counts(spark, a, b).unionByName(_counts(spark, a, a, "same")).unionByName(_counts(spark, a, [], "empty"))
    mean = lambda f, x, y: sum(f(p, q) for p in x for q in y) / (len(x) * len(y))
    gap = lambda p, q: abs(p - q)
    want = 2 * mean(gap, a, b) - mean(gap, a, a) - mean(gap, b, b)
    got = {r.k: r for r in distances.energy_from_counts(counts, ["k"]).collect()}
    assert got["g"].energy == pytest.approx(want, rel=1e-9) and got["same"].energy == pytest.approx(0, abs=1e-12) and got["empty"].energy is None
    shifted = counts.where("k = 'g'").withColumn("value", F.col("value") + 1e9)
    assert distances.energy_from_counts(shifted, ["k"]).first().energy == pytest.approx(want, rel=1e-5)
    m = {r.k: r for r in distances.mmd_from_counts(counts, ["k"]).collect()}
    sigma = np.std(a + b)
    kernel = lambda p, q: math.exp(-((p - q) / sigma) ** 2 / 2)
    true = mean(kernel, a, a) + mean(kernel, b, b) - 2 * mean(kernel, a, b)
    assert m["g"].sigma == pytest.approx(sigma) and abs(m["g"].mmd2 - true) < 4 * m["g"].mmd2_se and m["g"].mmd2_se < true
    assert m["same"].mmd2 == pytest.approx(0, abs=1e-12) and m["empty"].mmd2 is None


def plain_eddm(errors):
    out, last, d, top = [], 0, [], None
    for i, e in enumerate(errors, 1):
        if not e:
            continue
        d.append(i - last)
        last = i
        level = np.mean(d) + 2 * np.std(d)
        if len(d) >= adaptive.LEAST_ERRORS:
            top = level if top is None else max(top, level)
        ratio = None if top is None else level / top
        out.append((i, len(d), level, ratio, None if ratio is None else "drift" if ratio < 0.9 else "warning" if ratio < 0.95 else "stable"))
    return out


def test_eddm_equals_plain_fold_at_any_chunking(spark):
    rng = random.Random(7)
    errors = {k: [rng.random() < (0.05 if i < n // 2 else 0.3) for i in range(n)] for k, n in (("a", 1500), ("b", 400))}
    rows = [(k, i, e) for k, es in errors.items() for i, e in enumerate(es)] + [("c", 0, None), ("c", 1, False)]
    df = spark.createDataFrame(rows, "k string, at long, e boolean").repartition(5)
    for parts in (2, 7):
        got = adaptive.eddm(df, ["k"], ["at"], "e", partitions=parts).collect()
        assert {r.k for r in got} == {"a", "b"}
        for k, es in errors.items():
            mine = sorted((r.position, r.n_errors, r.level, r.ratio, r.zone) for r in got if r.k == k)
            for g, w in zip(mine, plain_eddm(es), strict=True):
                assert g[:2] == w[:2] and g[4] == w[4] and g[2] == pytest.approx(w[2], rel=1e-9)
    assert any(w[4] == "drift" for w in plain_eddm(errors["a"]))


def test_adwin_batch_and_stream_equal_a_plain_fold(spark, tmp_path):
    from driftspark.streaming import watch
    rng = random.Random(5)
    values = {k: [round(rng.gauss(0.2 if i < 150 else m, 0.1), 4) for i in range(260)] for k, m in (("a", 0.8), ("b", 0.2))}
    want = {}
    for k, xs in values.items():
        window = adaptive.Adwin(0.002)
        for i, x in enumerate(xs):
            want[k, i] = window.add(x)
        n = sum(b[1] for b in window.buckets)
        assert len(window.buckets) <= (adaptive.BUCKETS + 1) * (1 + math.log2(n))
    rows = [(k, i, x) for k, xs in values.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame([*rows, ("a", 1000, None), ("a", 1001, float("nan"))], "key string, at long, value double").repartition(4)
    batch = {(r.key, r.at): (r.width, r.mean, r.n_cut) for r in adaptive.adwin(df, ["key"], "at", "value").collect()}
    assert batch == want
    cuts = {k: [i for i in range(260) if want[k, i][2]] for k in "ab"}
    assert cuts["a"] and 150 <= cuts["a"][0] <= 170 and not cuts["b"]
    for part, (lo, hi) in enumerate([(0, 100), (100, 180), (180, 260)]):  # three micro-batches
        df.where(F.col("at").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if part == 2:  # and a late value
            spark.createDataFrame([("b", 5, 9.0)], "key string, at long, value double").write.mode("append").parquet(f"{tmp_path}/in")
        with watch._rocksdb(spark):
            watch._run(adaptive.adwin_stream(spark.readStream.schema("key string, at long, value double").parquet(f"{tmp_path}/in")),
                       lambda b, e: b.write.mode("overwrite").parquet(f"{tmp_path}/out/epoch={e}"), f"{tmp_path}/ck", "update")
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.key, r.at): (r.width, r.mean, r.n_cut) for r in out if r.width is not None} == want
    assert [(r.key, r.at) for r in out if r.width is None] == [("b", 5)]


def brute_exact(a, b):
    """p of U and D over all arrangements of the ranks."""
    n, m, both = len(a), len(b), sorted(a + b)
    def stats(first):
        second = [x for x in both if x not in first]
        u = sum(x > y for x in first for y in second)
        d = max(abs(sum(x <= t for x in first) * m - sum(y <= t for y in second) * n) for t in both)
        return min(u, n * m - u), d
    u0, d0 = stats(set(a))
    every = [stats(set(c)) for c in itertools.combinations(both, n)]
    low = sum(sum(x > y for x in c for y in both if y not in c) <= u0 for c in map(set, itertools.combinations(both, n)))
    return min(1.0, 2 * low / len(every)), sum(d >= d0 for _, d in every) / len(every)


def test_exact_p_values_over_all_arrangements(spark):
    rng = random.Random(3)
    groups = {f"g{i}": (rng.sample(range(100), n + m)[:n], None, n, m) for i, (n, m) in enumerate([(1, 1), (2, 3), (3, 3), (4, 6), (5, 4), (1, 9), (6, 6)])}
    rows, want = [], {}
    for k, (_, _, n, m) in groups.items():
        xs = rng.sample(range(100), n + m)
        a, b = xs[:n], xs[n:]
        want[k] = brute_exact(a, b)
        rows += [(k, float(v), 1, 0) for v in a] + [(k, float(v), 0, 1) for v in b]
    rows += [("tied", 1.0, 1, 1), ("tied", 2.0, 1, 2), ("one", 1.0, 3, 0)]
    big = rng.sample(range(1000), 60)
    rows += [("big", float(v), int(i < 20), int(i >= 20)) for i, v in enumerate(big)] + [("wide", float(v), int(i < 3), int(i >= 3)) for i, v in enumerate(big)]
    got = {r.k: r for r in exact.two_sample(spark.createDataFrame(rows, "k string, value double, n_a long, n_b long"), ["k"]).collect()}
    for k, (u, d) in want.items():
        assert got[k].mw_exact == pytest.approx(u, rel=1e-12) and got[k].ks_exact == pytest.approx(d, rel=1e-9), k
    assert got["tied"].mw_exact is None and got["tied"].mw_asymptotic is not None and got["one"].u_stat is None and got["one"].ks_exact is None
    assert got["big"].mw_exact is None and got["wide"].mw_exact is not None
    assert abs(got["big"].ks_exact - got["big"].ks_asymptotic) < 0.05


def test_hodges_lehmann_is_the_median_of_all_pairs(spark):
    rng = random.Random(11)
    data = {"even": [round(rng.gauss(5, 40), 2) for _ in range(40)], "odd": [round(rng.gauss(-3, 9), 2) for _ in range(37)],
            "tied": [rng.choice([1.0, 1.5, 7.25]) for _ in range(50)], "one": [-4.25], "two": [1.0, 2.01]}
    df = spark.createDataFrame([(k, x) for k, xs in data.items() for x in xs] + [("one", None)], "k string, x double").repartition(3)
    want = {k: float(np.median([(xs[i] + xs[j]) / 2 for i in range(len(xs)) for j in range(i, len(xs))])) for k, xs in data.items()}
    got = {r.k: r for r in extras.hodges_lehmann(df, ["k"], "x", pivots=8, partitions=3).collect()}
    assert {k: r.n for k, r in got.items()} == {k: len(xs) for k, xs in data.items()}
    for k, w in want.items():
        assert got[k].estimate == pytest.approx(w, abs=1e-9), k
    whole = extras.hodges_lehmann(df.where("k = 'odd'").drop("k"), [], "x").first()
    assert whole.estimate == pytest.approx(want["odd"], abs=1e-9)


@pytest.mark.parametrize("cell_rows", [3, 17, 1000])
def test_hodges_lehmann_by_cells(spark, cell_rows, monkeypatch):
    """Large groups, cut into cells, against all pairs: heavy ties, outliers, gaps, null keys; rows are not dealt out once a probe."""
    rng = np.random.default_rng(cell_rows)
    monkeypatch.setattr(extras, "MARKS", 8)
    data = {"tails": (rng.standard_cauchy(150) * 100).round(2), "ties": np.concatenate([np.full(90, 5.0), rng.normal(0, 1, 60).round(2)]),
            "gap": np.concatenate([rng.normal(-1e6, 3, 50), rng.normal(1e6, 3, 50)]).round(2), None: rng.exponential(30, 121).round(2),
            "step": np.arange(140) * 0.01, "halves": np.repeat([-1.0, 1.0], 20), "outlier": np.append(rng.normal(0, 1, 99).round(2), 1e9)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs], "k string, x double").repartition(3)
    scanned, real = [], extras.ranks.scan
    monkeypatch.setattr(extras.ranks, "scan", lambda rows, *a, **k: (scanned.append(rows.count()), real(rows, *a, **k))[1])
    got = {r.k: r for r in extras.hodges_lehmann(df, ["k"], "x", pivots=5, partitions=3, cell_rows=cell_rows).collect()}
    for k, xs in data.items():
        cents = np.rint(xs * 100).astype(int)
        i, j = np.triu_indices(len(xs))
        assert got[k].n == len(xs) and got[k].estimate == float(np.median(cents[i] + cents[j])) / 200, k
    assert sum(scanned) <= sum(map(len, data.values()))


def test_row_bootstrap_and_bca(spark):
    """Against a brute-force row bootstrap with the same weights, and its BCa in NumPy."""
    import hashlib
    rng = np.random.default_rng(4)
    xs = rng.exponential(10, 60).round(3)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(xs)] + [("a", 99, None)], "g string, k long, v double").repartition(3)
    reps = extras.bootstrap_means(df, ["g"], "k", "v", b=301)
    got = np.array([r.mean for r in reps.orderBy("rep").collect()])
    cuts = extras.poisson_cuts()
    def weight(k, rep):
        h = hashlib.md5(f"{k}:{(rep - 1) // 2}:11".encode()).hexdigest()
        u = int(h[12 * ((rep - 1) % 2):][:12], 16) / 2 ** 48
        return next((c for c, p in cuts if u < p), len(cuts))
    w = np.array([[weight(k, rep) for k in range(60)] for rep in range(1, 302)])
    assert len(got) == 301 and got == pytest.approx((w @ xs) / w.sum(axis=1), rel=1e-12)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and len(cuts) > 14
    assert got.std() == pytest.approx(xs.std() / math.sqrt(60), rel=0.15)
    r = extras.bca_ci(df, reps, ["g"], "v").first()
    jack = np.array([np.delete(xs, i).mean() for i in range(60)])
    off = jack.mean() - jack
    accel = (off ** 3).sum() / (6 * (off ** 2).sum() ** 1.5)
    from statistics import NormalDist
    nd = NormalDist()
    z0 = nd.inv_cdf((got < xs.mean()).mean())
    at = [nd.cdf(z0 + (z0 + z) / (1 - accel * (z0 + z))) for z in (nd.inv_cdf(0.025), nd.inv_cdf(0.975))]
    assert r.accel == pytest.approx(accel, rel=1e-9) and r.z0 == pytest.approx(z0, abs=1e-7)
    assert [r.bca_lo, r.bca_hi] == pytest.approx(np.quantile(got, at).tolist(), rel=1e-7)


def test_scan_equals_a_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), i, rng.randint(-9, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, at long, x long")
    for reverse, exclusive in itertools.product((False, True), (False, True)):
        got = ranks.scan(df, ["k"], ["at"], {"s": ("x", "sum"), "hi": ("x", "max"), "lo": ("x", "min")}, exclusive, reverse, partitions=6).collect()
        assert len(got) == 200
        for r in got:
            own = [x for k, i, x in rows if k == r.k and ((i > r["at"] if reverse else i < r["at"]) or (not exclusive and i == r["at"]))]
            assert (r.s, r.hi, r.lo) == ((sum(own), max(own), min(own)) if own else (None, None, None))


def test_many_tests_have_no_one_task_window(spark):
    rng = random.Random(6)
    ps = [rng.random() ** 3 for _ in range(60)] + [None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i long, pvalue double")
    pf = sorted((1.0 if p is None else p, i) for i, p in enumerate(ps))
    m, low, bh, high, holm = len(pf), 1.0, {}, 0.0, {}
    for rank in range(m, 0, -1):
        low = min(low, pf[rank - 1][0] * m / rank)
        bh[pf[rank - 1][1]] = low
    for rank in range(1, m + 1):
        high = max(high, (m - rank + 1) * pf[rank - 1][0])
        holm[pf[rank - 1][1]] = min(high, 1.0)
    got = {r.i: r.pvalue_fdr for r in compare.bh_adjust(df, order=["i"]).collect()}
    assert got == pytest.approx(bh)
    assert {r.i: r.pvalue_holm for r in compare.holm_adjust(df, order=["i"]).collect()} == pytest.approx(holm)


def test_policy_tree_of_chunks(spark):
    """Chunks of 4 cycles in groups of 4 make a tree of three levels."""
    import datetime as dt
    rng = random.Random(9)
    xs = [rng.random() < 0.3 for _ in range(300)]
    df = spark.createDataFrame([("m", i * 60, x) for i, x in enumerate(xs)], "model string, s long, x boolean").select("model", F.timestamp_seconds("s").alias("t"), "x")
    out = policy.apply_policy(df, ["model"], "t", "x", dt.timedelta(seconds=60), cooldown=dt.timedelta(seconds=300), chunk=4).orderBy("t").collect()
    want = policy.policy_fold_reference(xs, cooldown_cycles=5)
    assert [(r.should_trigger, r.attempted, r.suppressed, r.alert, r.clear_streak, r.trigger_count) for r in out] == want


@pytest.mark.parametrize("kind", ["long", "decimal(12,2)", "double"])
def test_trailing_sums_against_plain_windows(spark, kind):
    """Gaps, null keys, null values, negative values, repeated cycles and an hour of six cycles."""
    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(300), rng.choice([None, *range(-4, 9)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "m string, i long, v long").select(
        "m", F.timestamp_seconds(F.col("i") * 600).alias("cycle_end"), F.col("v").cast(kind).alias("v"))
    got = observe.trailing(df, ["m"], "cycle_end", dt.timedelta(minutes=10), dt.timedelta(hours=1), "v")
    got = {(r.m, r.i): r.sum_v for r in got.select("m", (F.unix_seconds("cycle_end") / 600).cast("long").alias("i"), "sum_v").collect()}
    want = {}
    for m, i, _ in rows:
        inside = [v for n, j, v in rows if n == m and i - 6 < j <= i and v is not None]
        want[m, i] = sum(inside) if inside else None
    assert {k: None if v is None else float(v) for k, v in got.items()} == {k: None if v is None else float(v) for k, v in want.items()}
    none = observe.trailing(df.where("false"), ["m"], "cycle_end", dt.timedelta(minutes=10), dt.timedelta(hours=1), "v")
    assert none.count() == 0


def test_bootstrap_of_odd_keys_and_many_groups(spark, monkeypatch):
    """Keys of all lengths, repeated and null ones, null groups; rows do not fan out to the replicates."""
    import hashlib
    monkeypatch.setattr(extras, "BOOT_GROUPS", 2)
    keys = ["", "a", "é" * 9, "x" * 51, "x" * 52, "y" * 64, "z" * 130, "a", None, *map(str, range(95, 120))]
    rows = [(g, k, float(len(k or "12") + i)) for i, k in enumerate(keys) for g in ("a", None, "b", "c") if i % 4 or g == "a"] + [("b", "q", None)]
    df = spark.createDataFrame(rows, "g string, k string, v double").repartition(3)
    reps = extras.bootstrap_means(df, ["g"], "k", "v", b=25)
    assert "Generate" not in reps._jdf.queryExecution().optimizedPlan().toString()
    cuts = extras.poisson_cuts()
    def weight(k, rep):
        h = hashlib.md5(f"{k}:{(rep - 1) // 2}:11".encode()).hexdigest()
        u = int(h[12 * ((rep - 1) % 2):][:12], 16) / 2 ** 48
        return next((c for c, p in cuts if u < p), len(cuts)) if k is not None else len(cuts)
    want = {}
    for g in ("a", None, "b", "c"):
        for rep in range(1, 26):
            w = [(weight(k, rep), v) for h, k, v in rows if h == g and v is not None]
            want[g, rep] = sum(a * v for a, v in w) / sum(a for a, _ in w)
    got = {(r.g, r.rep): r.mean for r in reps.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_paired_draws_are_those_of_the_column(spark):
    from driftspark.functions.hashing import hash_digits, paired_hash_ints
    heads, tails = [f"{10 ** (i % 9) + i}" for i in range(200)], [f":{j}:7" for j in range(120)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(heads)], "i int, h string").crossJoin(spark.createDataFrame([(j, x) for j, x in enumerate(tails)], "j int, t string"))
    digest = F.md5(F.concat("h", "t").cast("binary"))
    want = {(r.i, r.j): (r.a, r.b) for r in df.select("i", "j", hash_digits(digest, 0).alias("a"), hash_digits(digest, 1).alias("b")).collect()}
    got = {(int(i), int(j)): (int(a[y, x]), int(b[y, x])) for rows, cols, a, b in paired_hash_ints([x.encode() for x in heads], [x.encode() for x in tails])
           for y, i in enumerate(rows) for x, j in enumerate(cols)}
    assert got == want
