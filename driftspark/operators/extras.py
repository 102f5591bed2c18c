"""Second-tier statistics described in the text.

All are grouped aggregates or built on the two-phase running counts; none enumerates
pairs of rows. Holm (Y1) lives in ``compare``, Cramer's V (Y2) and KL (Y16) in
``detectors``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.functions import pvalues as pv
from driftspark.functions import special
from driftspark.functions.hashing import SPAN, paired_hash_ints
from driftspark.operators import ranks
from driftspark.session import work_dir

# Bound of the groups whose replicate sums a task holds: 32 MB at B = 1000.
BOOT_GROUPS = 2000
# Hodges-Lehmann: distinct values that one task takes at once, and running counts for first brackets.
CELL_ROWS, MARKS = 100_000, 1024
# Two-sided 95 % normal quantile; PSI band edges.
Z95 = 1.959963984540054
PSI_BANDS_A = ((0.1, "stable"), (0.25, "moderate"), (None, "significant"))
PSI_BANDS_B = ((0.2, "ok"), (0.3, "alert"), (None, "severe"))


def psi_band(psi: Column, bands=PSI_BANDS_A) -> Column:
    """Label by upper band edges (value < edge)."""
    out = None
    for edge, name in bands:
        if edge is None:
            out = out.otherwise(F.lit(name)) if out is not None else F.lit(name)
        else:
            cond = psi < F.lit(edge)
            out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return F.when(psi.isNull(), F.lit(None)).otherwise(out)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval for a proportion k/n."""
    p = k / n
    z2 = z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = (F.lit(z) / (1 + z2 / n)) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return centre - half, centre + half


def cohens_d(long: DataFrame, pairs: DataFrame, scenario: str) -> DataFrame:
    """(mean_A - mean_B) / pooled sample sd per pair and metric."""
    s = long.groupBy("metric", scenario).agg(F.count("value").alias("n"), F.avg("value").alias("m"),
                                            F.var_samp("value").alias("v"))
    a = s.select("metric", F.col(scenario).alias("A"), F.col("n").alias("na"), F.col("m").alias("ma"),
                 F.col("v").alias("va"))
    b = s.select("metric", F.col(scenario).alias("B"), F.col("n").alias("nb"), F.col("m").alias("mb"),
                 F.col("v").alias("vb"))
    j = pairs.join(a, "A").join(b, ["B", "metric"])
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb"))
                    / (F.col("na") + F.col("nb") - 2))
    return j.select("metric", "A", "B", ((F.col("ma") - F.col("mb")) / pooled).alias("cohens_d"))


def auc_delong(df: DataFrame, keys: Sequence[str], score: str, label: str, z: float = Z95,
               partitions: int | None = None) -> DataFrame:
    """AUC = U/(n_pos n_neg) with the DeLong standard error.

    Placement of a positive x: (#neg < x + half #neg = x) / n_neg; of a negative y:
    (#pos > y + half #pos = y) / n_pos. Var = var(pos placements)/n_pos +
    var(neg placements)/n_neg (sample variances). All from per-value counts.
    """
    keys = list(keys)
    y = F.col(label).cast("int")
    counts = (df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(*keys, score)
              .agg(F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg")))
    cum = ranks.cumulative(counts, keys, score, ["n_pos", "n_neg"], partitions)
    npos, nneg = F.col("tot_n_pos"), F.col("tot_n_neg")
    v10 = (F.col("cum_n_neg") - F.col("n_neg") + 0.5 * F.col("n_neg")) / nneg       # positives' placement
    v01 = (npos - F.col("cum_n_pos") + 0.5 * F.col("n_pos")) / npos                 # negatives' placement
    g = cum.groupBy(*keys).agg(
        F.max(npos).alias("n_pos"), F.max(nneg).alias("n_neg"),
        F.sum(F.col("n_pos") * v10).alias("_s10"), F.sum(F.col("n_pos") * v10 * v10).alias("_q10"),
        F.sum(F.col("n_neg") * v01).alias("_s01"), F.sum(F.col("n_neg") * v01 * v01).alias("_q01"))
    m, n = F.col("n_pos"), F.col("n_neg")
    auc = F.col("_s10") / m
    var10 = (F.col("_q10") - m * auc * auc) / (m - 1)
    auc01 = F.col("_s01") / n
    var01 = (F.col("_q01") - n * auc01 * auc01) / (n - 1)
    se = F.sqrt(var10 / m + var01 / n)
    return g.select(*keys, "n_pos", "n_neg", auc.alias("auc"), se.alias("auc_se"),
                    F.greatest(auc - z * se, F.lit(0.0)).alias("auc_lo"),
                    F.least(auc + z * se, F.lit(1.0)).alias("auc_hi"))


def per_class_scores(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support for each class."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    cells = pred.select(y.alias("y"), p.alias("p")).groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))
    classes = cells.select(F.col("y").alias("cls")).union(cells.select(F.col("p").alias("cls"))).distinct()
    tp = cells.where(F.col("y") == F.col("p")).select(F.col("y").alias("cls"), F.col("n").alias("tp"))
    sup = cells.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("support"))
    predn = cells.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = classes.join(tp, "cls", "left").join(sup, "cls", "left").join(predn, "cls", "left").fillna(0)
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return j.select(F.col("cls").alias("class"), prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    F.col("support").cast("long").alias("support"))


def poisson_cuts() -> list[tuple[int, float]]:
    """(k, P(X <= k)) of Poisson(1), up to where it is 1 in double precision."""
    cuts, cdf, term, k = [], 0.0, math.exp(-1.0), 0
    while cdf + term > cdf:
        cdf += term
        cuts.append((k, cdf))
        k += 1
        term /= k
    return cuts


class PoissonWeights:
    """Poisson(1) weights by inverse CDF of 48-bit draws, to the draws' own resolution."""

    def __init__(self):
        cuts = poisson_cuts()
        # a draw d is below a share c where d < c * 2^48, and that product is exact
        self.bounds = np.array([math.ceil(c * SPAN) for _, c in cuts], dtype=np.uint64)
        self.largest = cuts[-1][0] + 1
        # the leading 16 bits settle a draw unless a bound lies in their cell (-1)
        cells = np.arange(1 << 16, dtype=np.uint64) << np.uint64(32)
        first, last = (np.searchsorted(self.bounds, c, side="right") for c in (cells, cells + np.uint64((1 << 32) - 1)))
        self.table = np.where(first == last, first, -1).astype(np.float64)

    def __call__(self, draws: np.ndarray) -> np.ndarray:
        out = self.table[draws >> np.uint64(32)]
        unsettled = np.nonzero(out < 0)
        out[unsettled] = np.searchsorted(self.bounds, draws[unsettled], side="right")
        return out


def _bootstrap_sums(n_keys: int, b: int, seed: int, held: int):
    """(keys..., rep, sum of weight x value, sum of weights) of a task's rows, for each group."""

    def run(batches):
        weights, tails = PoissonWeights(), [f":{j}:{seed}".encode() for j in range((b + 1) // 2)]
        sums, kinds = {}, None

        def flush():
            for keys, total in sums.values():
                cols = [pa.array([k] * b, type=t) for k, t in zip(keys, kinds[:n_keys])]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(1, b + 1, dtype=np.int32)), pa.array(total[0, :b]), pa.array(total[1, :b].astype(np.int64))],
                                                 names=[*[f"_k{i}" for i in range(n_keys)], "rep", "s", "n"])
            sums.clear()

        for whole in batches:
            kinds = [c.type for c in whole.columns]
            for at in range(0, whole.num_rows, 2048):
                some = whole.slice(at, 2048)
                groups = list(zip(*(c.to_pylist() for c in some.columns[:n_keys]))) if n_keys else [()] * some.num_rows
                names = [repr(g) for g in groups]
                key, x = some.column(n_keys).to_pylist(), some.column(n_keys + 1).to_numpy(zero_copy_only=False)
                for name, g in zip(names, groups):
                    if name not in sums:
                        sums[name] = (g, np.zeros((2, 2 * len(tails))))
                # rows of a group, and of a length of key, lie together
                order = sorted(range(len(key)), key=lambda i: (key[i] is None, len(key[i] or ""), names[i]))
                known = [i for i in order if key[i] is not None]
                for i in order[len(known):]:  # without a key there is no draw: the last weight
                    sums[names[i]][1][:] += np.array([[weights.largest * x[i]], [weights.largest]])
                rows = np.array(known, dtype=np.int64)
                for part, cols, *draws in paired_hash_ints([key[i].encode() for i in known], tails):
                    at_row = rows[part]
                    starts = [k for k in range(len(part)) if k == 0 or names[at_row[k]] != names[at_row[k - 1]]]
                    for i in (0, 1):
                        w = weights(draws[i])
                        both = np.add.reduceat(w * x[at_row, None], starts, axis=0), np.add.reduceat(w, starts, axis=0)
                        for k, start in enumerate(starts):
                            total = sums[names[at_row[start]]][1]
                            total[0, 2 * cols + i] += both[0][k]
                            total[1, 2 * cols + i] += both[1][k]
                if len(sums) > held:
                    yield from flush()
        yield from flush()

    return run


def bootstrap_means(long: DataFrame, keys: Sequence[str], key: str, value: str, b: int = 1000,
                    seed: int = 11) -> DataFrame:
    """Poisson bootstrap replicates of the mean over rows: keys..., rep, mean.

    Every row has its own Poisson(1) weight in every replicate, drawn from a hash of its
    ``key`` (unique per row) and the replicate, so a lost task draws the same again. One
    pass: a task draws the weights of its rows in blocks (one digest serves two replicates)
    and holds B sums per group, at most BOOT_GROUPS groups at a time; only those sums are
    shuffled. Null values take no part.
    """
    keys = list(keys)
    rows = long.where(F.col(value).isNotNull()).select(*keys, F.col(key).cast("string").alias("_k"), F.col(value).cast("double").alias("_x"))
    # rows are dealt out first: a table of one file would be one task otherwise
    rows = rows.repartition(int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_k")
    schema = "".join(f"_k{i} {long.schema[k].dataType.simpleString()}, " for i, k in enumerate(keys)) + "rep int, s double, n long"
    sums = rows.mapInArrow(_bootstrap_sums(len(keys), b, seed, BOOT_GROUPS), schema)
    sums = sums.groupBy(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "rep").agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"))
    return sums.select(*keys, "rep", F.try_divide("_s", "_n").alias("mean"))


def percentile_ci(reps: DataFrame, keys: Sequence[str], stat: str, level: float = 0.95) -> DataFrame:
    """Percentile interval over replicates (groups of at most B values)."""
    a = (1 - level) / 2
    return reps.groupBy(*keys).agg(F.percentile(stat, a).alias("ci_lo"), F.percentile(stat, 1 - a).alias("ci_hi"),
                                   F.count(stat).alias("n_reps"))


def bca_ci(long: DataFrame, reps: DataFrame, keys: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Bias-corrected and accelerated interval of the mean: keys..., z0, accel, bca_lo, bca_hi.

    z0 comes from the share of replicates below the sample's mean (half of those equal to
    it). The acceleration is the jackknife's; for a mean its leave-one-out values are a
    function of the row, so it is sum (x - m)^3 / (6 (sum (x - m)^2)^1.5) from two grouped
    passes. The replicates of a group (at most B values) are one sorted array.
    """
    keys = list(keys)
    x = long.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    mean = x.groupBy(*keys).agg(F.avg("_x").alias("_m"))
    off = F.col("_x") - F.col("_m")
    moments = x.join(mean, keys).groupBy(*keys).agg(F.max("_m").alias("_m"), F.sum(off * off).alias("_m2"), F.sum(off * off * off).alias("_m3"))
    a = F.coalesce(F.try_divide(F.col("_m3"), 6 * F.pow("_m2", F.lit(1.5))), F.lit(0.0))
    g = reps.join(moments.select(*keys, "_m", a.alias("accel")), keys).groupBy(*keys).agg(
        F.max("accel").alias("accel"), F.sort_array(F.collect_list("mean")).alias("_all"),
        ((F.count_if(F.col("mean") < F.col("_m")) + 0.5 * F.count_if(F.col("mean") == F.col("_m"))) / F.count("mean")).alias("_below"))
    g = g.withColumn("z0", F.expr(special.normal_quantile("_below")))
    for name, share in (("lo", (1 - level) / 2), ("hi", (1 + level) / 2)):
        z = F.col("z0") + F.expr(special.normal_quantile(f"{share!r}D"))
        g = g.withColumn("_z", F.col("z0") + z / (1 - F.col("accel") * z)).withColumn("_p", F.expr(special.normal_cdf("_z")))
        g = g.withColumn("_at", F.col("_p") * (F.size("_all") - 1))
        lower = F.element_at("_all", F.floor("_at").cast("int") + 1)
        upper = F.element_at("_all", F.ceil("_at").cast("int") + 1)
        g = g.withColumn(f"bca_{name}", lower + (upper - lower) * (F.col("_at") - F.floor("_at")))
    return g.select(*keys, "z0", "accel", "bca_lo", "bca_hi")


def _weighted(w: np.ndarray, f: np.ndarray) -> tuple[int, int]:
    """The sum of products of two arrays of counts as (high, low) with high * 2^24 + low, each within 64 bits."""
    return int((w * (f >> 24)).sum()), int((w * (f & 0xFFFFFF)).sum())


def _middle(pairs: int) -> tuple[int, int]:
    """Places of the two middle ones of ``pairs`` (the same place twice, if odd)."""
    return (pairs + 1) // 2, (pairs + 2) // 2


def _least(fits, lo: int, hi: int) -> int:
    """The least s in (lo, hi] that fits; hi fits, and all after the least one."""
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    return hi


def _group_median(n_keys: int):
    """keys..., n and the sum of the two middle pair sums of one group of (v, w), by bisection."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        v, w = (table.column(c).to_numpy() for c in ("v", "w"))
        order = np.argsort(v)
        v, w = v[order], w[order]
        cum = np.concatenate([[0], np.cumsum(w)])
        n = int(cum[-1])

        def twice_upto(s):  # ordered pairs, and each row with itself
            high, low = _weighted(w, cum[np.searchsorted(v, s - v, side="right")])
            return (high << 24) + low + int(cum[np.searchsorted(v, s // 2, side="right")])

        first, second = _middle(n * (n + 1) // 2)
        low, top = 2 * int(v[0]) - 1, 2 * int(v[-1])
        at = _least(lambda s: twice_upto(s) >= 2 * first, low, top)
        both = at + (at if twice_upto(at) >= 2 * second else _least(lambda s: twice_upto(s) >= 2 * second, at, top))
        return pa.table([*(pa.array([k.as_py()], type=k.type) for k in key[:n_keys]), pa.array([n], pa.int64()), pa.array([both], pa.int64())],
                        names=[*[f"k{i}" for i in range(n_keys)], "n", "both"])

    return run


def _first_brackets(cell_rows: int):
    """Of a large group's marks: n, (lo, hi] of either middle sum, and the edges of its cells.

    The rows up to a mark are known exactly, so counts of pairs have a lower and an upper bound
    for every sum. Cells end at marks and at what marks are to the bracket's middle: then a cell
    and the rows that its rows meet there are few alike.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        v, w, before = (table.column(c).to_numpy() for c in ("v", "w", "before"))
        order = np.argsort(v)
        v, w, before = v[order], w[order], before[order]
        upto = before + w
        n, rows = int(upto[-1]), table.column("rows")[0].as_py()
        floor, ceiling = np.concatenate([[0], upto]), np.concatenate([before, [n]])
        inside = np.diff(floor)

        def twice_upto(s, bound, ends):
            high, low = _weighted(inside, bound[np.searchsorted(v, s - ends, side="right")])
            return (high << 24) + low + int(bound[np.searchsorted(v, s // 2, side="right")])

        after = np.concatenate([[v[0]], v[:-1] + 1])  # the least value an interval may hold
        low, top = 2 * int(v[0]) - 1, 2 * int(v[-1])
        brackets = []
        for place in _middle(n * (n + 1) // 2):
            hi = _least(lambda s: twice_upto(s, floor, v) >= 2 * place, low, top)
            lo = _least(lambda s: twice_upto(s, ceiling, after) >= 2 * place, low, hi) - 1
            brackets += [lo, hi]
        marks = v[::max(1, len(v) * cell_rows // rows)]
        edges = np.unique(np.concatenate([marks, (brackets[0] + brackets[3]) // 2 - marks]))
        return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "brackets": pa.array([brackets], pa.list_(pa.int64())),
                         "edges": pa.array([edges], pa.list_(pa.int64()))})

    return run


def _to_cells(jobs: list[tuple[int, int, int]], edges: dict[int, np.ndarray]):
    """Rows to the cells that count with them: each to its own (``v``, ``w``), and to every cell
    with a row that reaches it, or the gap before it, with a sum of a bracket (``v``, ``upto``, ``before``)."""

    def run(batches):
        for batch in batches:
            g, v, w, before = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            start = batch.column(4).is_null().to_numpy(zero_copy_only=False)
            prev = batch.column(4).fill_null(0).to_numpy(zero_copy_only=False)
            for job, (group, lo, hi) in enumerate(jobs):
                at = np.flatnonzero(g == group)
                if not len(at):
                    continue
                e = edges[group]
                first = np.searchsorted(e, lo - v[at])
                count = np.where(start[at], len(e), np.searchsorted(e, hi - prev[at])) - first + 1
                row = np.repeat(at, count)
                cell = np.repeat(first, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                cells, mine = np.concatenate([np.searchsorted(e, v[at]), cell]), np.arange(len(at) + len(row)) < len(at)
                rows = np.concatenate([at, row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), job)), pa.array(cells), pa.array(mine), pa.array(v[rows]), pa.array(w[rows]), pa.array(before[rows])],
                    names=["job", "cell", "mine", "v", "w", "before"])

    return run


def _cell_counts(probes: list[np.ndarray], totals: list[int]):
    """Of one cell, for every probe s of its job: ordered pairs with a sum of at most s whose first row lies there (high, low), and rows with 2 v <= s."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        job = key[0].as_py()
        mine = table.column("mine").to_numpy(zero_copy_only=False)
        v, w, before = (table.column(c).to_numpy() for c in ("v", "w", "before"))
        met = np.flatnonzero(~mine)
        met = met[np.argsort(v[met])]
        u, upto = v[met], (before + w)[met]
        # nothing to meet: every row lies at or below all that is asked for
        upto = np.concatenate([before[met[:1]], upto]) if len(met) else np.array([totals[job]])
        x = np.flatnonzero(mine)
        x = x[np.argsort(-v[x])]
        v, w = v[x], w[x]
        got = [(*_weighted(w, upto[np.searchsorted(u, s - v, side="right")]), int(w[2 * v <= s].sum())) for s in probes[job].tolist()]
        return pa.table({"job": pa.array([job] * len(got), pa.int64()), "s": pa.array(probes[job], pa.int64()),
                         **{c: pa.array(list(col), pa.int64()) for c, col in zip(("high", "low", "own"), zip(*got))}})

    return run


def hodges_lehmann(df: DataFrame, keys: Sequence[str], value: str, decimals: int = 2, pivots: int = 64,
                   partitions: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Hodges-Lehmann estimate, the median of all pairwise means (x_i + x_j) / 2, i <= j.

    Selection without pairs. Values are integers in units of 10^-decimals (rounded to them);
    sums of two are integers too. A group of at most ``cell_rows`` distinct values is one task's
    bisection. A larger one is cut into cells of about that many: its middle sums (two, if the
    pairs are even) are bracketed by MARKS exact running counts first; then each pass counts, for
    ``pivots`` sums s of a bracket, the pairs with a sum of at most s. For that a row goes to
    its own cell and to those whose rows it meets at a sum of the bracket, which is one or two, so
    a pass shuffles a small multiple of the rows, whatever ``pivots`` is. Each pass cuts
    the bracket by pivots + 1. The driver holds brackets and edges of the large groups, at most
    two numbers for ``cell_rows`` values.
    """
    keys = list(keys)
    if not keys:
        one = hodges_lehmann(df.withColumn("_all", F.lit(1)), ["_all"], value, decimals, pivots, partitions, cell_rows)
        return one.agg(F.max("n").alias("n"), F.max("estimate").alias("estimate"))
    spark, scale = df.sparkSession, 10 ** decimals
    v = F.round(F.col(value).cast("double") * scale).cast("long")
    work_dir(spark)
    x = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], v.alias("v"))
    names = [f"k{i}" for i in range(len(keys))]
    x = x.groupBy(*names, "v").agg(F.count(F.lit(1)).alias("w")).checkpoint(eager=True)
    sizes = x.groupBy(*names).agg(F.count(F.lit(1)).alias("rows"), F.sum("w").alias("n")).where(F.col("rows") > cell_rows)
    large = sizes.select(F.monotonically_increasing_id().alias("g"), "rows", "n", *[F.col(k).alias(f"_{k}") for k in names]).checkpoint(eager=True)
    same = F.lit(True)
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    types = "".join(f"{k} {df.schema[c].dataType.simpleString()}, " for k, c in zip(names, keys))
    found = x.join(F.broadcast(large), same, "left_anti").groupBy(*names).applyInArrow(_group_median(len(names)), types + "n long, both long")
    if not large.isEmpty():
        some = x.join(F.broadcast(large), same).select("g", "rows", "n", "v", "w")
        some = ranks.scan(some, ["g"], ["v"], {"before": ("w", "sum"), "prev": ("v", "max")}, exclusive=True, partitions=partitions)
        some = some.select("g", "v", "w", F.coalesce("before", F.lit(0).cast("long")).alias("before"), "prev", "rows", "n").checkpoint(eager=True)
        mark = F.expr(f"(before + w) * {MARKS} div n > before * {MARKS} div n") | F.col("prev").isNull()
        began = some.where(mark).groupBy("g").applyInArrow(_first_brackets(cell_rows), "g long, n long, brackets array<long>, edges array<long>").collect()
        edges = {r.g: np.array(r.edges) for r in began}
        brackets = {r.g: [tuple(r.brackets[:2]), tuple(r.brackets[2:])] for r in began}
        totals = {r.g: r.n for r in began}
        some = some.select("g", "v", "w", "before", "prev")
        while jobs := sorted({(g, *b) for g, both in brackets.items() for b in both if b[1] - b[0] > 1}):
            probes = [np.array(sorted({lo + (hi - lo) * i // (pivots + 1) for i in range(1, pivots + 1)} - {lo})) for _, lo, hi in jobs]
            cells = some.mapInArrow(_to_cells(jobs, edges), "job long, cell long, mine boolean, v long, w long, before long")
            counts = cells.groupBy("job", "cell").applyInArrow(_cell_counts(probes, [totals[g] for g, _, _ in jobs]), "job long, s long, high long, low long, own long")
            total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
            twice = {(r.job, r.s): (int(r.high) << 24) + int(r.low) + int(r.own) for r in counts.groupBy("job", "s").agg(*[total(c) for c in ("high", "low", "own")]).collect()}
            for job, (g, lo, hi) in enumerate(jobs):
                for i, place in enumerate(_middle(totals[g] * (totals[g] + 1) // 2)):
                    if brackets[g][i] == (lo, hi):
                        below = [s for s in probes[job].tolist() if twice[job, s] < 2 * place]
                        above = [s for s in probes[job].tolist() if twice[job, s] >= 2 * place]
                        brackets[g][i] = max(below, default=lo), min(above, default=hi)
        ends = spark.createDataFrame([(g, both[0][1] + both[1][1]) for g, both in brackets.items()], "g long, both long")
        found = found.unionByName(large.join(F.broadcast(ends), "g").select(*[F.col(f"_{k}").alias(k) for k in names], "n", "both"))
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "n", (F.col("both") / F.lit(4.0 * scale)).alias("estimate"))


def signed_rank(d: DataFrame, keys: Sequence[str], diff: str,
                partitions: int | None = None) -> DataFrame:
    """Wilcoxon signed-rank on paired differences (zeros dropped, mid-ranks of
    |d|, tie-corrected normal approximation without continuity correction)."""
    keys = list(keys)
    x = d.where(F.col(diff).isNotNull() & (F.col(diff) != 0)).select(
        *keys, F.abs(diff).alias("_a"), (F.col(diff) > 0).alias("_pos"))
    counts = x.groupBy(*keys, "_a").agg(F.count_if("_pos").alias("n_pos"), F.count_if(~F.col("_pos")).alias("n_neg"))
    cum = ranks.cumulative(counts, keys, "_a", ["n_pos", "n_neg"], partitions)
    t = (F.col("n_pos") + F.col("n_neg")).cast("double")  # its cube may pass 64 bits
    before = F.col("cum_n_pos") + F.col("cum_n_neg") - t
    midrank = before + (t + 1) / 2.0
    g = cum.groupBy(*keys).agg(F.sum(F.col("n_pos") * midrank).alias("w_plus"), F.sum(t).alias("n"),
                               F.sum(t * t * t - t).alias("_ties"))
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4.0
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0)
    g = g.withColumn("_z", (F.col("w_plus") - mean) / sd)
    return g.select(*keys, F.col("n").cast("long").alias("n"), "w_plus", "_z",
                    F.when(F.col("_z").isNull(), F.lit(None)).otherwise(pv.normal_two_sided("_z")).alias("pvalue")
                    ).drop("_z")
