"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each statement is written directly against the given tables, without our Spark
operators: KS by a window over all values of the group, chi-squared through expected
counts per cell, PSI through ``quantile_cont`` and list functions. DuckDB has neither erf
nor the chi-squared, beta or normal distributions. The chi-squared tail here is the finite
sum of integer degrees of freedom (the Spark side: continued fractions), Clopper-Pearson
bounds bisect sums of binomial terms, energy distance takes all pairs, exact p-values come
from recursions over counts, ADWIN is a recursive fold. Kolmogorov and normal tails come
from the same templates as the Spark side (``functions.pvalues``), which tests hold against
``math.erfc``.
"""

from __future__ import annotations

import math
import re

from driftspark.functions import pvalues as pv
from driftspark.functions.hashing import hash_int_sql, uniform_sql

D = pv.DUCKDB
LN_SQRT_PI = 0.5723649429247001


def chi2_finite_sql(x: str, k: str) -> str:
    """Upper tail of chi-squared by the finite sums of integer degrees of freedom, in logs:
    exp(-x/2) sum (x/2)^i / i! for even k, erfc and a sum over half-integers for odd k."""
    half, m = f"(({x}) / 2.0e0)", f"floor(({k}) / 2)"
    even = D.fold(D.seq("0", f"{m} - 1"), D.struct(lt=f"-{half} - ln({half})", s="0.0e0"), "acc", "i",
                  D.struct(lt=f"acc.lt + ln({half}) - ln(greatest(i, 1))", s=f"acc.s + exp(acc.lt + ln({half}) - ln(greatest(i, 1)))")) + ".s"
    odd = D.fold(D.keep(D.seq("0", m), "i", "i >= 1"), D.struct(lt=f"-{half} - 0.5e0 * ln({half}) - {LN_SQRT_PI!r}e0", s="0.0e0"), "acc", "i",
                 D.struct(lt=f"acc.lt + ln({half}) - ln(i - 0.5e0)", s=f"acc.s + exp(acc.lt + ln({half}) - ln(i - 0.5e0))")) + ".s"
    return (f"(CASE WHEN ({x}) IS NULL OR ({k}) IS NULL OR ({k}) < 1 THEN NULL WHEN ({x}) <= 0 THEN 1.0e0 "
            f"WHEN ({k}) % 2 = 0 THEN least(greatest({even}, 0.0e0), 1.0e0) "
            f"ELSE least(greatest(({pv.erfc_sql(f'sqrt({half})', D)} + {odd}), 0.0e0), 1.0e0) END)")

EVENTS_PAIR = ("SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-24 00:00:00' THEN 'rec' ELSE 'ref' END AS role "
               "FROM events WHERE ts >= TIMESTAMP '2024-01-17 00:00:00'")
LI_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_PAIR = ("SELECT *, CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' THEN 'rec' ELSE 'ref' END "
                 "AS role FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00'")
LABELS_HALF = (f"SELECT *, CASE WHEN {uniform_sql('doc_id', 13)} < 0.5e0 THEN 'ref' ELSE 'rec' END AS role "
               "FROM labels")


def long_sql(src: str, cols, vtype: str) -> str:
    parts = [f"SELECT role, '{c}' AS column_name, CAST({c} AS {vtype}) AS value FROM ({src}) s "
             f"WHERE {c} IS NOT NULL" for c in cols]
    return " UNION ALL ".join(parts)


def _k(keys, prefix=""):
    return ", ".join(f"{prefix}{k}" for k in keys)


def ks_sql(long: str, keys=("column_name",)) -> str:
    kk = _k(keys)
    lam = "((sqrt(n_ref * n_rec / (n_ref + n_rec)) + 0.12e0 + 0.11e0 / sqrt(n_ref * n_rec / (n_ref + n_rec))) * ks_d)"
    return f"""
WITH long AS ({long}),
c AS (SELECT {kk}, value, count(*) FILTER (WHERE role = 'ref') AS a,
             count(*) FILTER (WHERE role = 'rec') AS b FROM long GROUP BY ALL),
cum AS (SELECT {kk}, value,
               sum(a) OVER (PARTITION BY {kk} ORDER BY value ROWS UNBOUNDED PRECEDING) AS ca,
               sum(b) OVER (PARTITION BY {kk} ORDER BY value ROWS UNBOUNDED PRECEDING) AS cb,
               sum(a) OVER (PARTITION BY {kk}) AS na, sum(b) OVER (PARTITION BY {kk}) AS nb
        FROM c),
g AS (SELECT {kk}, CAST(max(na) AS DOUBLE) AS n_ref, CAST(max(nb) AS DOUBLE) AS n_rec,
             max(abs(ca / nullif(na, 0) - cb / nullif(nb, 0))) AS ks_d FROM cum GROUP BY ALL)
SELECT {kk}, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_rec AS BIGINT) AS n_rec,
       round(ks_d, 6) AS ks_d,
       round({pv.kolmogorov_sf_sql(lam, D)}, 6) AS ks_p, n_ref >= 20 AND n_rec >= 20 AS enough_rows,
       ks_d AS ks_d_raw,
       CASE WHEN n_ref < 20 OR n_rec < 20 THEN 1.0e0 ELSE {pv.kolmogorov_sf_sql(lam, D)} END AS ks_p_raw
FROM g"""


def chi2_sql(long: str, min_n: int = 20, keys=("column_name",)) -> str:
    kk = _k(keys)
    def cell(o, e):
        return (f"CASE WHEN k = 2 THEN power(abs({o} - {e}) - least(0.5e0, abs({o} - {e})), 2) / {e} "
                f"ELSE power({o} - {e}, 2) / {e} END")
    return f"""
WITH long AS ({long}),
cc AS (SELECT {kk}, value, count(*) FILTER (WHERE role = 'ref') AS a,
              count(*) FILTER (WHERE role = 'rec') AS b FROM long GROUP BY ALL),
t AS (SELECT {kk}, count(*) AS k, CAST(sum(a) AS DOUBLE) AS na, CAST(sum(b) AS DOUBLE) AS nb
      FROM cc GROUP BY ALL),
e AS (SELECT {_k(keys, 'cc.')}, t.k, t.na, t.nb, CAST(cc.a AS DOUBLE) AS a, CAST(cc.b AS DOUBLE) AS b,
             (cc.a + cc.b) * t.na / (t.na + t.nb) AS ea, (cc.a + cc.b) * t.nb / (t.na + t.nb) AS eb
      FROM cc JOIN t USING ({kk})),
s AS (SELECT {kk}, max(k) AS k, max(na) AS na, max(nb) AS nb,
             sum({cell('a', 'ea')} + {cell('b', 'eb')}) AS stat FROM e GROUP BY ALL),
g AS (SELECT *, (na < {min_n} OR nb < {min_n} OR k < 2) AS small, CAST(k - 1 AS BIGINT) AS dof FROM s)
SELECT {kk}, CAST(k AS BIGINT) AS n_categories, CAST(na AS BIGINT) AS n_ref, CAST(nb AS BIGINT) AS n_rec,
       round(CASE WHEN k >= 2 AND na > 0 AND nb > 0 THEN stat END, 6) AS chi2, dof, na >= {min_n} AND nb >= {min_n} AS enough_rows,
       round(CASE WHEN k >= 2 AND na > 0 AND nb > 0 THEN {chi2_finite_sql('stat', 'dof')} END, 6) AS chi2_p,
       round(sqrt(stat / (na + nb)), 6) AS cramers_v,
       round(sqrt(stat / ((na + nb) * (k - 1))), 6) AS cramers_v_text,
       CASE WHEN small THEN 1.0e0 ELSE {chi2_finite_sql('stat', 'dof')} END AS chi2_p_raw
FROM g"""


def psi_sql(long: str, extend: bool = False, bins: int = 10, eps: float = 1e-6, min_n: int = 50,
            keys=("column_name",)) -> str:
    kk = _k(keys)
    probs = ", ".join(f"{i / bins!r}e0" for i in range(bins + 1))
    edges = (f"CASE WHEN len(u) < 3 THEN list_concat(list_transform(range(0, {bins}), "
             f"lambda i: lo + (hi - lo) / {float(bins)!r}e0 * i), [hi]) ELSE u END")
    if extend:
        edges = (f"list_concat([CAST('-inf' AS DOUBLE)], ({edges})[2:len({edges}) - 1], "
                 f"[CAST('inf' AS DOUBLE)])")
    return f"""
WITH long AS ({long}),
q AS (SELECT {kk}, quantile_cont(value, [{probs}]) AS qs FROM long WHERE role = 'ref' GROUP BY ALL),
u AS (SELECT {kk}, list_sort(list_distinct(qs)) AS u, qs[1] AS lo, qs[{bins + 1}] AS hi FROM q),
e AS (SELECT {kk}, {edges} AS edges FROM u),
b AS (SELECT {_k(keys, 'l.')}, l.role,
             CASE WHEN l.value = e.edges[len(e.edges)] THEN len(e.edges) - 2
                  ELSE len(list_filter(e.edges, lambda x: x <= l.value)) - 1 END AS bin
      FROM long l JOIN e USING ({kk})
      WHERE l.value >= e.edges[1] AND l.value <= e.edges[len(e.edges)]),
h AS (SELECT {kk}, bin, count(*) FILTER (WHERE role = 'ref') AS hr,
             count(*) FILTER (WHERE role = 'rec') AS hc FROM b GROUP BY ALL),
grid AS (SELECT {kk}, unnest(range(0, len(edges) - 1)) AS bin FROM e),
f AS (SELECT {_k(keys, 'g.')}, g.bin, coalesce(h.hr, 0) AS hr, coalesce(h.hc, 0) AS hc
      FROM grid g LEFT JOIN h USING ({kk}, bin)),
p AS (SELECT {kk},
             greatest(hr / greatest(sum(hr) OVER (PARTITION BY {kk}), 1), {eps!r}) AS r,
             greatest(hc / greatest(sum(hc) OVER (PARTITION BY {kk}), 1), {eps!r}) AS c FROM f),
s AS (SELECT {kk}, sum((r - c) * ln(r / c)) AS psi, sum(r * ln(r / c)) AS kl_rc, sum(c * ln(c / r)) AS kl_cr
      FROM p GROUP BY ALL),
n AS (SELECT {kk}, count(*) FILTER (WHERE role = 'ref') AS n_ref,
             count(*) FILTER (WHERE role = 'rec') AS n_rec FROM long GROUP BY ALL)
SELECT {_k(keys, 'n.')}, n_ref, n_rec,
       round(psi, 6) AS psi, round(kl_rc, 6) AS kl_ref_rec, round(kl_cr, 6) AS kl_rec_ref,
       n_ref >= {min_n} AND n_rec >= {min_n} AS enough_rows,
       CASE WHEN n_ref < {min_n} OR n_rec < {min_n} OR psi IS NULL THEN 0.0e0 ELSE psi END AS psi_raw
FROM n LEFT JOIN s USING ({kk})"""


def ks_cols(sql: str, cols: str = "column_name, n_ref, n_rec, ks_d, ks_p, enough_rows") -> str:
    return f"SELECT {cols} FROM ({sql}) z"


def chi_cols(sql: str) -> str:
    return ks_cols(sql, "column_name, n_categories, n_ref, n_rec, chi2, dof, chi2_p, cramers_v, enough_rows")


def psi_cols(sql: str) -> str:
    return ks_cols(sql, "column_name, n_ref, n_rec, psi, enough_rows")


def _verdict_sql() -> str:
    ks = ks_sql(long_sql(EVENTS_PAIR, ["value"], "DOUBLE"))
    ch = chi2_sql(long_sql(EVENTS_PAIR, ["event_type"], "VARCHAR"))
    ps = psi_sql(long_sql(EVENTS_PAIR, ["value"], "DOUBLE"))
    # the Spark side keeps full precision until the end; compare on rounded p-values
    return f"""
WITH ks AS ({ks}), ch AS ({ch}), ps AS ({ps}),
p AS (SELECT ks_p AS p FROM ks UNION ALL SELECT chi2_p AS p FROM ch)
SELECT bool_or(p < 0.01) AS drift_any, round(min(p), 6) AS p_min,
       round(avg(CASE WHEN p < 0.01 THEN 1.0e0 ELSE 0.0e0 END), 6) AS reject_share,
       CAST(count(*) AS BIGINT) AS n_tests, (SELECT round(psi_raw, 6) FROM ps) AS psi,
       bool_or(p < 0.01) OR (SELECT psi_raw FROM ps) > 0.2 AS should_trigger
FROM p"""


SCEN = """
rk AS (SELECT s, row_number() OVER (ORDER BY f, s) AS r
       FROM (SELECT o_orderpriority AS s, min(o_orderkey) AS f FROM orders GROUP BY 1) t),
pairs AS (SELECT a.s AS A, b.s AS B, a.r AS a_rank, b.r AS b_rank FROM rk a JOIN rk b ON a.r < b.r)"""


def _mw_sql() -> str:
    z = "z"
    return f"""
WITH {SCEN},
u AS (SELECT p.A, p.B, p.a_rank, p.b_rank, o.o_orderpriority = p.A AS is_a, o.o_totalprice AS v
      FROM pairs p JOIN orders o ON o.o_orderpriority IN (p.A, p.B) WHERE o.o_totalprice IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY A, B ORDER BY v)
                + (count(*) OVER (PARTITION BY A, B, v) - 1) / 2.0e0 AS mr FROM u),
g AS (SELECT A, B, a_rank, b_rank, CAST(count(*) FILTER (WHERE is_a) AS DOUBLE) AS nA,
             CAST(count(*) FILTER (WHERE NOT is_a) AS DOUBLE) AS nB, sum(mr) FILTER (WHERE is_a) AS ra
      FROM r GROUP BY 1, 2, 3, 4),
t AS (SELECT A, B, sum(CAST(c AS DOUBLE) * c * c - c) AS ties
      FROM (SELECT A, B, v, count(*) AS c FROM u GROUP BY 1, 2, 3) x GROUP BY 1, 2),
s AS (SELECT g.*, t.ties, ra - nA * (nA + 1) / 2.0e0 AS u1 FROM g JOIN t USING (A, B)),
zz AS (SELECT *, (greatest(u1, nA * nB - u1) - nA * nB / 2.0e0 - 0.5e0)
                 / sqrt(nA * nB / 12.0e0 * ((nA + nB + 1) - ties / ((nA + nB) * (nA + nB - 1)))) AS z FROM s)
SELECT 'o_totalprice' AS metric, A, B, a_rank, b_rank, CAST(nA AS BIGINT) AS nA, CAST(nB AS BIGINT) AS nB,
       u1 AS u_stat,
       CASE WHEN z IS NULL OR z <= 0 THEN 1.0e0 ELSE {pv.normal_two_sided_sql(z, D)} END AS pvalue,
       (2.0e0 * u1 - nA * nB) / (nA * nB) AS cliffs_delta
FROM zz"""


def _summary_sql() -> str:
    return """
SELECT 'o_totalprice' AS metric, scope AS summary_scope, count(*) AS summary_n,
       round(avg(v), 6) AS summary_mean, round(stddev_pop(v), 6) AS summary_std, round(min(v), 6) AS summary_min,
       round(quantile_cont(v, 0.25), 6) AS summary_p25, round(quantile_cont(v, 0.5), 6) AS summary_median,
       round(quantile_cont(v, 0.75), 6) AS summary_p75, round(max(v), 6) AS summary_max
FROM (SELECT 'global' AS scope, o_totalprice AS v FROM orders WHERE o_totalprice IS NOT NULL
      UNION ALL SELECT 'scenario:' || o_orderpriority, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL) x
GROUP BY 1, 2"""


def _report_sql() -> str:
    return f"""
WITH mw AS ({_mw_sql()}),
bh AS (SELECT *, row_number() OVER (ORDER BY coalesce(pvalue, 1.0e0), a_rank, b_rank) AS k,
              count(*) OVER () AS m FROM mw),
adj AS (SELECT *, least(min(coalesce(pvalue, 1.0e0) * m / k) OVER (ORDER BY k
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0e0) AS pvalue_fdr FROM bh),
summ AS ({_summary_sql()})
SELECT metric, A, B, nA, nB, round(pvalue, 6) AS pvalue, round(cliffs_delta, 6) AS cliffs_delta,
       'mannwhitney' AS row_type, round(pvalue_fdr, 6) AS pvalue_fdr, CAST(NULL AS VARCHAR) AS summary_scope,
       CAST(NULL AS BIGINT) AS summary_n, CAST(NULL AS DOUBLE) AS summary_mean, CAST(NULL AS DOUBLE) AS summary_std,
       CAST(NULL AS DOUBLE) AS summary_min, CAST(NULL AS DOUBLE) AS summary_p25,
       CAST(NULL AS DOUBLE) AS summary_median, CAST(NULL AS DOUBLE) AS summary_p75,
       CAST(NULL AS DOUBLE) AS summary_max
FROM adj
UNION ALL
SELECT metric, summary_scope, '', summary_n, CAST(0 AS BIGINT), NULL, NULL, 'summary', NULL, summary_scope,
       summary_n, summary_mean, summary_std, summary_min, summary_p25, summary_median, summary_p75, summary_max
FROM summ"""


HOURLY = "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) + 1 AS i, avg(value) > 55.0e0 AS x FROM events GROUP BY 1"


def _policy_sql(mode: str = "edge", streak: str = "cumulative", k: int = 3, n: int = 3, verdicts: str = HOURLY, step: int = 3600) -> str:
    can = f"(least(r.c + 1, {k}) >= {k})"
    c1 = f"least(r.c + 1, {k})"
    if mode == "level":
        att, sup = f"(g.x AND {can})", f"(g.x AND NOT {can})"
        alert, clr = "false", "0"
    else:
        rising = "(g.x AND NOT r.alert)"
        att, sup = f"({rising} AND {can})", f"({rising} AND NOT {can})"
        keep = "0" if streak == "consecutive" else "r.clr"
        alert = (f"CASE WHEN {rising} THEN true WHEN g.x THEN r.alert "
                 f"WHEN r.alert AND r.clr + 1 >= {n} THEN false ELSE r.alert END")
        clr = (f"CASE WHEN {rising} THEN 0 WHEN g.x THEN {keep} WHEN r.alert AND r.clr + 1 >= {n} THEN 0 "
               f"WHEN r.alert THEN r.clr + 1 ELSE 0 END")
    return f"""
WITH RECURSIVE v AS ({verdicts}),
grid AS (SELECT g.i, coalesce(v.x, false) AS x
         FROM (SELECT unnest(range(min(i), max(i) + 1)) AS i FROM v) g LEFT JOIN v USING (i)),
r AS (SELECT min(i) - 1 AS i, false AS x, false AS att, false AS sup, false AS alert, 0 AS clr, {k} AS c,
             CAST(0 AS BIGINT) AS total FROM grid
      UNION ALL
      SELECT g.i, g.x, {att}, {sup}, {alert}, {clr},
             CASE WHEN {att} THEN 0 ELSE {c1} END, r.total + CAST({att} AS BIGINT)
      FROM r JOIN grid g ON g.i = r.i + 1)
SELECT 'fraud' AS model, make_timestamp(i * {step} * 1000000) AS cycle_end, x AS should_trigger,
       att AS attempted, sup AS suppressed, alert, CAST(clr AS INTEGER) AS clear_streak, total AS trigger_count
FROM r WHERE i >= (SELECT min(i) FROM grid)"""


LINEITEM_RULE = """SELECT CASE WHEN l_discount >= 0.08e0 OR l_extendedprice >= (SELECT quantile_cont(l_extendedprice, 0.95e0)
    FROM lineitem WHERE l_extendedprice IS NOT NULL) THEN 1 ELSE 0 END AS label FROM lineitem
    WHERE l_extendedprice IS NOT NULL AND l_discount IS NOT NULL AND l_quantity IS NOT NULL AND l_tax IS NOT NULL"""


LOGREG_FEATURES = ("l_extendedprice", "l_discount", "l_quantity", "l_tax")
LOGREG_PASSES = 20


def _nested(inner: str, steps) -> str:
    """One subselect a step, each adding a named column."""
    for name, expr in steps:
        inner = f"SELECT *, {expr} AS {name} FROM ({inner}) q_{name}"
    return inner


def _logreg_with() -> str:
    """Label, split and plain Newton steps as a recursive statement (the Spark side halves steps and
    stops by the decrement); the linear system of a step by an LDL' factorisation, column by column."""
    f, d = LOGREG_FEATURES, len(LOGREG_FEATURES)
    key = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
    size = range(d + 1)
    x = ["1.0e0", *[f"t.x{j}" for j in range(1, d + 1)]]
    z = " + ".join(f"n.b{j} * {x[j]}" for j in size)
    sums = [f"sum(t.w * (p - t.y) * {x[i]}) + any_value({f't.r{i} * b{i}' if i else '0.0e0'}) AS g{i}" for i in size]
    sums += [f"sum(t.w * p * (1.0e0 - p) * {x[i]} * {x[j]}){f' + any_value(t.r{i})' if i == j and i else ''} AS a{i}{j}"
             for i in size for j in range(i + 1)]
    inner = f"SELECT it, {', '.join(f'any_value(b{j}) AS b{j}' for j in size)}, {', '.join(sums)} FROM (SELECT n.*, t.*, 1.0e0 / (1.0e0 + exp(-({z}))) AS p FROM newton n, tr t WHERE n.it < {LOGREG_PASSES}) t GROUP BY it"
    steps = []
    for j in size:
        steps.append((f"d{j}", f"a{j}{j}" + "".join(f" - l{j}{k} * l{j}{k} * d{k}" for k in range(j))))
        steps += [(f"l{i}{j}", f"(a{i}{j}" + "".join(f" - l{i}{k} * l{j}{k} * d{k}" for k in range(j)) + f") / d{j}") for i in range(j + 1, d + 1)]
    steps += [(f"z{i}", f"g{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i))) for i in size]
    steps += [(f"s{i}", f"z{i} / d{i}" + "".join(f" - l{k}{i} * s{k}" for k in range(i + 1, d + 1))) for i in reversed(size)]
    return f"""WITH RECURSIVE cut AS (SELECT quantile_cont(l_extendedprice, 0.95e0) AS q FROM lineitem WHERE l_extendedprice IS NOT NULL),
    lab AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in f)}, {key} AS k, {hash_int_sql(key, 42)} AS h,
            CASE WHEN l_discount >= 0.08e0 OR l_extendedprice >= q THEN 1 ELSE 0 END AS y FROM lineitem, cut
            WHERE {' AND '.join(f'{c} IS NOT NULL' for c in f)}),
    sp AS (SELECT *, count(*) OVER (PARTITION BY y ORDER BY h, k RANGE UNBOUNDED PRECEDING)
                     <= ceil(count(*) OVER (PARTITION BY y) * 0.2e0) AS is_test FROM lab),
    wt AS (SELECT *, count(*) OVER () / (2.0e0 * count(*) OVER (PARTITION BY y)) AS w FROM sp WHERE NOT is_test),
    mean AS (SELECT {', '.join(f'sum(w * {c}) / sum(w) AS m{j}' for j, c in enumerate(f, 1))} FROM wt),
    dev AS (SELECT {', '.join(f'sqrt(sum(w * ({c} - m{j}) * ({c} - m{j})) / sum(w)) AS v{j}' for j, c in enumerate(f, 1))} FROM wt, mean),
    tr AS MATERIALIZED (SELECT y, w, {', '.join(f'({c} - m{j}) / v{j} AS x{j}, 1.0e0 / (v{j} * v{j}) AS r{j}' for j, c in enumerate(f, 1))} FROM wt, mean, dev),
    newton AS (SELECT 0 AS it, {', '.join(f'0.0e0 AS b{j}' for j in size)} UNION ALL
               SELECT it + 1, {', '.join(f'b{j} - s{j}' for j in size)} FROM ({_nested(inner, steps)}) q),
    best AS (SELECT * FROM newton WHERE it = {LOGREG_PASSES})"""


def _logreg_f1_sql() -> str:
    z = "b0 + " + " + ".join(f"b{j} * ({c} - m{j}) / v{j}" for j, c in enumerate(LOGREG_FEATURES, 1))
    return f"""{_logreg_with()},
    pr AS (SELECT y, ({z}) > 0 AS p FROM sp, best, mean, dev WHERE is_test),
    n AS (SELECT count(*) AS total_rows, count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) AS negatives FROM lab)
    SELECT 'synthetic_rule_risk_or_p95' AS label_strategy, total_rows, positives, negatives, 'logreg' AS model,
           round(2.0e0 * count(*) FILTER (WHERE p AND y = 1)
                 / (count(*) FILTER (WHERE p) + count(*) FILTER (WHERE y = 1)), 6) AS f1
    FROM pr, n GROUP BY total_rows, positives, negatives"""


def _logreg_coefficients_sql() -> str:
    z = "b0 + " + " + ".join(f"b{j} * x{j}" for j in range(1, len(LOGREG_FEATURES) + 1))
    ridge = " + ".join(f"any_value(r{j} * b{j} * b{j})" for j in range(1, len(LOGREG_FEATURES) + 1))
    raw = "b0 - " + " - ".join(f"b{j} * m{j} / v{j}" for j in range(1, len(LOGREG_FEATURES) + 1))
    terms = [f"SELECT 'intercept' AS term, {raw} AS c FROM best, mean, dev"]
    terms += [f"SELECT '{c}', b{j} FROM best" for j, c in enumerate(LOGREG_FEATURES, 1)]
    return f"""{_logreg_with()},
    fin AS (SELECT count(*) AS n_train, (sum(w * ln(1.0e0 + exp(CASE WHEN y = 1 THEN -z ELSE z END))) + 0.5e0 * ({ridge})) / count(*) AS loss
            FROM (SELECT *, {z} AS z FROM tr, best) q)
    SELECT term, round(c, 6) AS coefficient, n_train, round(loss, 6) AS mean_loss, true AS converged
    FROM ({' UNION ALL '.join(terms)}) t, fin"""


def _obs_cycles_sql() -> str:
    return """SELECT CAST(floor(epoch(ts) / 600) AS BIGINT) + 1 AS i, avg(value) AS avg_value,
                     avg(value) > 60.0e0 AS x FROM events GROUP BY 1"""


def _policy_grid_sql(k: int = 3, n: int = 3, step: int = 600) -> str:
    """Edge policy on the 10-minute cycles (recursive), returning i, att."""
    can = f"(least(r.c + 1, {k}) >= {k})"
    rising = "(g.x AND NOT r.alert)"
    return f"""
v AS ({_obs_cycles_sql()}),
grid AS (SELECT g.i, coalesce(v.x, false) AS x
         FROM (SELECT unnest(range(min(i), max(i) + 1)) AS i FROM v) g LEFT JOIN v USING (i)),
r AS (SELECT min(i) - 1 AS i, false AS x, false AS att, false AS alert, 0 AS clr, {k} AS c FROM grid
      UNION ALL
      SELECT g.i, g.x, {rising} AND {can},
             CASE WHEN {rising} THEN true WHEN g.x THEN r.alert WHEN r.alert AND r.clr + 1 >= {n} THEN false
                  ELSE r.alert END,
             CASE WHEN {rising} THEN 0 WHEN g.x THEN r.clr WHEN r.alert AND r.clr + 1 >= {n} THEN 0
                  WHEN r.alert THEN r.clr + 1 ELSE 0 END,
             CASE WHEN {rising} AND {can} THEN 0 ELSE least(r.c + 1, {k}) END
      FROM r JOIN grid g ON g.i = r.i + 1),
pol AS (SELECT i, att FROM r WHERE i >= (SELECT min(i) FROM grid))"""


def _trailing_sql() -> str:
    return f"""
WITH RECURSIVE {_policy_grid_sql()},
t AS (SELECT i, CAST(sum(CAST(att AS BIGINT)) OVER (ORDER BY i RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT)
             AS triggers_1h FROM pol),
q AS (SELECT i, quantile_cont(avg_value, 0.95e0) OVER (ORDER BY i RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)
             AS p95 FROM v)
SELECT 'fraud' AS model, make_timestamp(t.i * 600 * 1000000) AS cycle_end, triggers_1h,
       round(q.p95, 6) AS p95_value_1h
FROM t LEFT JOIN q USING (i)"""


STAGE = ("CASE WHEN event_type IN ('view', 'click') THEN 'pre' "
         "WHEN event_type IN ('purchase', 'signup') THEN 'post' END")
PRE_POST = f"""SELECT user_id, CAST(ts AS DATE) AS day, min(ts) FILTER (WHERE {STAGE} = 'pre') AS pre,
    max(ts) FILTER (WHERE {STAGE} = 'post') AS post FROM events WHERE {STAGE} IS NOT NULL GROUP BY 1, 2"""


def _resource_sql() -> str:
    sample = ("printf('%.2f%%,%.2fMiB / %.3fGiB,%.2f%%', value % 100.0e0, value, "
              "CAST(((user_id % 4) + 4) % 4 + 1 AS DOUBLE), CAST(((user_id % 100) + 100) % 100 AS DOUBLE))")
    num = "CAST(regexp_extract({x}, '([0-9.]+)', 1) AS DOUBLE)"
    return f"""
WITH s AS (SELECT event_id, {sample} AS s FROM events)
SELECT event_id,
       round({num.format(x="split_part(s, ',', 1)")}, 6) AS cpu_perc,
       round({num.format(x="split_part(split_part(s, ',', 2), '/', 1)")}, 6) AS mem_used_mb,
       round({num.format(x="split_part(split_part(s, ',', 2), '/', 2)")} * 1024.0e0, 6) AS mem_limit_mb,
       round({num.format(x="split_part(s, ',', 3)")}, 6) AS mem_perc
FROM s"""


def _long_pair(a: str, b: str, col: str) -> str:
    return (f"SELECT 'ref' AS role, '{col}' AS column_name, CAST({a} AS DOUBLE) AS value FROM orders "
            f"UNION ALL SELECT 'rec', '{col}', CAST({b} AS DOUBLE) FROM orders")


CYCLE_FAN = ("SELECT make_timestamp((CAST(floor(epoch(ts) / 86400) AS BIGINT) + o) * 86400 * 1000000) AS cycle_end, "
             "CASE WHEN o = 1 THEN 'rec' ELSE 'ref' END AS role, value, event_type "
             "FROM events, (VALUES (1), (2)) t(o)")
CK = ("cycle_end", "column_name")


def _cycle_parts():
    num = (f"SELECT cycle_end, role, 'value' AS column_name, CAST(value AS DOUBLE) AS value FROM ({CYCLE_FAN}) f "
           "WHERE value IS NOT NULL")
    cat = (f"SELECT cycle_end, role, 'event_type' AS column_name, CAST(event_type AS VARCHAR) AS value "
           f"FROM ({CYCLE_FAN}) f WHERE event_type IS NOT NULL")
    return ks_sql(num, CK), chi2_sql(cat, keys=CK), psi_sql(num, keys=CK)


def _cycle_with() -> str:
    ks, ch, ps = _cycle_parts()
    return f"ks AS ({ks}), ch AS ({ch}), ps AS ({ps})"


CYCLE_SUMMARY = f"""WITH {_cycle_with()},
    p AS (SELECT cycle_end, ks_p_raw AS p, 'ks' AS test FROM ks UNION ALL SELECT cycle_end, chi2_p_raw, 'chi2' FROM ch),
    c AS (SELECT cycle_end, min(p) AS p_min, min(CASE WHEN test = 'ks' THEN p END) AS p_ks FROM p GROUP BY 1)
    SELECT c.*, ps.psi_raw AS psi FROM c LEFT JOIN ps USING (cycle_end)"""

PERIODS = (("2024-01-08 00:00:00", "2024-01-11 00:00:00"), ("2024-01-18 00:00:00", "2024-01-20 00:00:00"),
           ("2024-01-25 00:00:00", "2024-01-26 12:00:00"))


def _threshold_rates_sql() -> str:
    """The daily cycles over raised values; a cycle has drifted if its two days differ in the seconds of a period."""
    inside = " OR ".join(f"(ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}')" for a, b in PERIODS)
    lap = lambda off, a, b: (f"greatest(0, epoch(least(cycle_end - INTERVAL {off} DAY, TIMESTAMP '{b}')) "  # noqa: E731
                             f"- epoch(greatest(cycle_end - INTERVAL {off + 1} DAY, TIMESTAMP '{a}')))")
    truth = " OR ".join(f"{lap(0, a, b)} <> {lap(1, a, b)}" for a, b in PERIODS)
    cycles = re.sub(r"\bevents\b", "raised", CYCLE_SUMMARY)
    return f"""WITH raised AS (SELECT * REPLACE (value * CASE WHEN {inside} THEN 1.25e0 ELSE 1.0e0 END AS value) FROM events),
        c AS (SELECT *, {truth} AS truth FROM ({cycles}) x),
        g AS (SELECT a.alpha, t.tau FROM (VALUES (0.05e0), (0.01e0), (0.001e0)) a(alpha), (VALUES (0.1e0), (0.2e0), (0.3e0)) t(tau)),
        h AS (SELECT *, p_min < alpha OR coalesce(psi, 0.0e0) > tau AS alert FROM c, g)
        SELECT alpha, tau, count(*) AS n_cycles, count(*) FILTER (WHERE truth) AS n_drifted,
               round(avg(CASE WHEN alert THEN 1.0e0 ELSE 0.0e0 END) FILTER (WHERE truth), 6) AS tpr,
               round(avg(CASE WHEN alert THEN 1.0e0 ELSE 0.0e0 END) FILTER (WHERE NOT truth), 6) AS fpr FROM h GROUP BY 1, 2"""


def _poisson_sql(u: str) -> str:
    """Poisson(1) by the inverse of its distribution function, summed here term by term."""
    cuts, cdf, term = [], 0.0, math.exp(-1)
    for k in range(30):
        if cdf + term == cdf:
            break
        cdf, term = cdf + term, term / (k + 1)
        cuts.append(f"WHEN {u} < {cdf!r}e0 THEN {k}")
    return f"CASE {' '.join(cuts)} ELSE {len(cuts)} END"


def _boot_sql() -> str:
    """Row bootstrap: each row's weight in each replicate from twelve digits of a digest."""
    u = "CAST('0x' || substr(h, CAST(1 + 12 * ((rep - 1) % 2) AS INTEGER), 12) AS BIGINT) / 281474976710656.0e0"
    return f"""SELECT o_orderpriority, rep, sum(w * x) / sum(w) AS mean FROM (
        SELECT o_orderpriority, rep, x, {_poisson_sql('u')} AS w FROM (
        SELECT o_orderpriority, rep, x, {u} AS u FROM (
        SELECT o_orderpriority, rep, o_totalprice AS x, md5(CAST(o_orderkey AS VARCHAR) || ':' || ((rep - 1) // 2) || ':11') AS h
        FROM orders, generate_series(1, 1000) g(rep) WHERE o_totalprice IS NOT NULL) a) b) c GROUP BY 1, 2"""


def _phi_sql(z: str) -> str:
    return (f"(CASE WHEN {z} < 0 THEN 0.5e0 * {pv.erfc_sql(f'(abs({z}) / sqrt(2.0e0))', D)} "
            f"ELSE 1.0e0 - 0.5e0 * {pv.erfc_sql(f'(abs({z}) / sqrt(2.0e0))', D)} END)")


def _quantile_at(values: str, p: str) -> str:
    at = f"({p} * (len({values}) - 1))"
    lo, hi = (f"{values}[CAST({f}({at}) AS INTEGER) + 1]" for f in ("floor", "ceil"))
    return f"({lo} + ({hi} - {lo}) * ({at} - floor({at})))"


def _bootstrap_sql() -> str:
    """z0 by bisection of the normal distribution function; the jackknife value by value."""
    return f"""
WITH RECURSIVE r AS ({_boot_sql()}),
s AS (SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS t, avg(o_totalprice) AS m FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1),
j AS (SELECT o_orderpriority, (t - o_totalprice) / (n - 1) AS left_out FROM orders JOIN s USING (o_orderpriority) WHERE o_totalprice IS NOT NULL),
c AS (SELECT o_orderpriority, avg(left_out) AS jm FROM j GROUP BY 1),
a AS (SELECT o_orderpriority, sum(power(jm - left_out, 3)) / (6 * power(sum(power(jm - left_out, 2)), 1.5e0)) AS accel FROM j JOIN c USING (o_orderpriority) GROUP BY 1),
g AS (SELECT o_orderpriority, count(*) AS n_reps, list_sort(list(mean)) AS v, quantile_cont(mean, 0.025e0) AS ci_lo, quantile_cont(mean, 0.975e0) AS ci_hi,
      (count(*) FILTER (WHERE mean < m) + 0.5e0 * count(*) FILTER (WHERE mean = m)) / count(*) AS below FROM r JOIN s USING (o_orderpriority) GROUP BY 1),
b(o_orderpriority, lo, hi, i) AS (SELECT o_orderpriority, -9.0e0, 9.0e0, 0 FROM g UNION ALL
      SELECT b.o_orderpriority, CASE WHEN {_phi_sql('((lo + hi) / 2)')} < below THEN (lo + hi) / 2 ELSE lo END,
             CASE WHEN {_phi_sql('((lo + hi) / 2)')} < below THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM b JOIN g USING (o_orderpriority) WHERE i < 60),
z AS (SELECT o_orderpriority, (lo + hi) / 2 AS z0 FROM b WHERE i = 60),
p AS (SELECT *, z0 + (z0 - 1.959963984540054e0) / (1 - accel * (z0 - 1.959963984540054e0)) AS zl,
             z0 + (z0 + 1.959963984540054e0) / (1 - accel * (z0 + 1.959963984540054e0)) AS zh FROM g JOIN a USING (o_orderpriority) JOIN z USING (o_orderpriority)),
q AS (SELECT *, {_phi_sql('zl')} AS pl, {_phi_sql('zh')} AS ph FROM p)
SELECT o_orderpriority, n_reps, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, round(accel, 6) AS accel, round(z0, 6) AS z0,
       round({_quantile_at('v', 'pl')}, 6) AS bca_lo, round({_quantile_at('v', 'ph')}, 6) AS bca_hi FROM q"""


def _clopper_sql() -> str:
    """Bounds where a binomial tail is 2.5 %: bisection of sums of binomial terms."""
    def tail(lo: str, hi: str) -> str:
        term = "exp(lgamma(n + 1.0e0) - lgamma(i + 1.0e0) - lgamma(n - i + 1.0e0) + i * ln(m) + (n - i) * ln(1 - m))"
        return f"list_sum(list_transform(range(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT)), lambda i: {term}))"
    return f"""
WITH RECURSIVE g AS (SELECT event_type, count(*) FILTER (WHERE value >= 50.0e0) AS k, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1),
l(event_type, lo, hi, s) AS (SELECT event_type, 0.0e0, 1.0e0, 0 FROM g UNION ALL
  SELECT event_type, CASE WHEN t < 0.025e0 THEN m ELSE lo END, CASE WHEN t < 0.025e0 THEN hi ELSE m END, s + 1
  FROM (SELECT *, {tail('k', 'n + 1')} AS t FROM (SELECT l.*, k, n, (lo + hi) / 2 AS m FROM l JOIN g USING (event_type) WHERE s < 50))),
u(event_type, lo, hi, s) AS (SELECT event_type, 0.0e0, 1.0e0, 0 FROM g UNION ALL
  SELECT event_type, CASE WHEN t > 0.025e0 THEN m ELSE lo END, CASE WHEN t > 0.025e0 THEN hi ELSE m END, s + 1
  FROM (SELECT *, {tail('0', 'k + 1')} AS t FROM (SELECT u.*, k, n, (lo + hi) / 2 AS m FROM u JOIN g USING (event_type) WHERE s < 50)))
SELECT event_type, k, n, round(CASE WHEN k = 0 THEN 0.0e0 ELSE (l.lo + l.hi) / 2 END, 9) AS rate_lo, round(CASE WHEN k = n THEN 1.0e0 ELSE (u.lo + u.hi) / 2 END, 9) AS rate_hi
FROM g JOIN l USING (event_type) JOIN u USING (event_type) WHERE l.s = 50 AND u.s = 50"""


PRICE_GAPS = """SELECT o_orderkey, o_orderpriority, round(o_totalprice - items, 2) AS d FROM orders JOIN
    (SELECT l_orderkey, sum(l_extendedprice) AS items FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey"""


def _pair_long() -> str:
    return (long_sql(EVENTS_PAIR, ["value"], "DOUBLE") + " UNION ALL " + long_sql(LINEITEM_PAIR, ["l_quantity", "l_discount", "l_tax"], "DOUBLE"))


def _energy_sql() -> str:
    """All pairs of values, weighted by their counts."""
    return f"""
WITH c AS (SELECT column_name, value, CAST(count(*) FILTER (WHERE role = 'ref') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE role = 'rec') AS DOUBLE) AS b
           FROM ({_pair_long()}) l GROUP BY ALL),
n AS (SELECT column_name, sum(a) AS n, sum(b) AS m FROM c GROUP BY 1),
e AS (SELECT x.column_name, sum(x.a * y.b * abs(x.value - y.value)) AS xy, sum(x.a * y.a * abs(x.value - y.value)) AS xx, sum(x.b * y.b * abs(x.value - y.value)) AS yy
      FROM c x JOIN c y USING (column_name) GROUP BY 1)
SELECT column_name, CAST(n AS BIGINT) AS n_ref, CAST(m AS BIGINT) AS n_rec, round(greatest(2 * xy / (n * m) - xx / (n * n) - yy / (m * m), 0.0e0), 6) AS energy
FROM e JOIN n USING (column_name)"""


def _mmd_sql() -> str:
    """The same frequencies, the features of every row averaged per side."""
    w = f"sqrt(-2.0e0 * ln(1.0e0 - {uniform_sql('j', 101)})) * cos(2 * pi() * {uniform_sql('j', 102)})"
    return f"""
WITH l AS ({_pair_long()}),
s AS (SELECT column_name, count(*) FILTER (WHERE role = 'ref') AS n_ref, count(*) FILTER (WHERE role = 'rec') AS n_rec, avg(value) AS mu, stddev_pop(value) AS sigma FROM l GROUP BY 1),
f AS (SELECT j, {w} AS w FROM generate_series(1, 128) g(j)),
d AS (SELECT column_name, j, power(avg(cos(z * w)) FILTER (WHERE role = 'ref') - avg(cos(z * w)) FILTER (WHERE role = 'rec'), 2)
             + power(avg(sin(z * w)) FILTER (WHERE role = 'ref') - avg(sin(z * w)) FILTER (WHERE role = 'rec'), 2) AS d
      FROM (SELECT column_name, role, (value - mu) / sigma AS z FROM l JOIN s USING (column_name)) x, f GROUP BY 1, 2)
SELECT column_name, n_ref, n_rec, round(sigma, 6) AS sigma, round(avg(d), 9) AS mmd2, round(stddev_samp(d) / sqrt(count(*)), 9) AS mmd2_se
FROM d JOIN s USING (column_name) GROUP BY ALL"""


def _eddm_sql() -> str:
    order = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, e"
    return f"""
WITH x AS (SELECT l_linestatus, row_number() OVER (PARTITION BY l_linestatus ORDER BY {order}) AS p, e FROM
      (SELECT *, (l_discount >= 0.05e0) <> (l_returnflag = 'R') AS e FROM lineitem)),
d AS (SELECT l_linestatus, p, CAST(p - coalesce(lag(p) OVER w, 0) AS DOUBLE) AS d, row_number() OVER w AS k FROM x WHERE e WINDOW w AS (PARTITION BY l_linestatus ORDER BY p)),
m AS (SELECT l_linestatus, p, k, avg(d) OVER w AS mean, avg(d * d) OVER w AS sq FROM d WINDOW w AS (PARTITION BY l_linestatus ORDER BY p ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, mean + 2 * sqrt(greatest(sq - mean * mean, 0.0e0)) AS level FROM m),
t AS (SELECT *, level / max(CASE WHEN k >= 30 THEN level END) OVER (PARTITION BY l_linestatus ORDER BY p ROWS UNBOUNDED PRECEDING) AS ratio FROM v)
SELECT l_linestatus, max(k) AS n_errors, max(p) AS last_error, round(arg_max(mean, p), 6) AS mean_distance, round(arg_max(ratio, p), 6) AS ratio, round(min(ratio), 6) AS least_ratio,
       count(*) FILTER (WHERE ratio >= 0.9e0 AND ratio < 0.95e0) AS n_warning, count(*) FILTER (WHERE ratio < 0.9e0) AS n_drift, min(p) FILTER (WHERE ratio < 0.9e0) AS first_drift
FROM t GROUP BY 1"""


def _adwin_sql(delta: str = "0.3e0") -> str:
    """One value per step: add a bucket, merge level by level, drop the oldest while a cut is found."""
    level = """CASE WHEN len(list_filter(s, lambda b: b.lv = l)) <= 5 THEN s ELSE
      list_concat(list_concat(list_filter(s, lambda b: b.lv > l),
        [{'lv': l + 1, 'n': list_sum(list_transform(list_filter(s, lambda b: b.lv = l)[1:2], lambda b: b.n)), 'x': list_sum(list_transform(list_filter(s, lambda b: b.lv = l)[1:2], lambda b: b.x)),
          'q': list_sum(list_transform(list_filter(s, lambda b: b.lv = l)[1:2], lambda b: b.q))}]),
        list_concat(list_filter(s, lambda b: b.lv = l)[3:], list_filter(s, lambda b: b.lv < l))) END"""
    total = lambda f, a="s": f"list_sum(list_transform({a}, lambda b: b.{f}))"
    bound = (f"(sqrt(2 * (1 / {{n0}} + 1 / ({total('n')} - {{n0}})) * greatest({total('q')} / {total('n')} - power({total('x')} / {total('n')}, 2), 0.0e0) * ln(2 * ln({total('n')}) / {delta})) "
             f"+ 2.0e0 / 3 * (1 / {{n0}} + 1 / ({total('n')} - {{n0}})) * ln(2 * ln({total('n')}) / {delta}))")
    n0, x0 = total("n", "s[1:c]"), total("x", "s[1:c]")
    found = (f"{total('n')} >= 10 AND len(list_filter(range(1, len(s)), lambda c: {n0} >= 5 AND {total('n')} - {n0} >= 5 AND "
             f"abs({x0} / {n0} - ({total('x')} - {x0}) / ({total('n')} - {n0})) > {bound.replace('{n0}', n0)})) > 0")
    return f"""
WITH RECURSIVE panes AS (SELECT event_type, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS pane, (CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) // count(*)) / 10000.0e0 AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY pane) AS i FROM panes),
w(event_type, i, stage, s, n_cut) AS (
  SELECT event_type, CAST(0 AS BIGINT), 0, CAST([] AS STRUCT(lv BIGINT, n DOUBLE, x DOUBLE, q DOUBLE)[]), 0.0e0 FROM (SELECT DISTINCT event_type FROM o)
  UNION ALL
  SELECT event_type, CASE WHEN stage = 0 THEN i + 1 ELSE i END, CASE WHEN stage = 0 THEN 1 WHEN cut THEN 1 ELSE 0 END,
    CASE WHEN stage = 0 THEN s WHEN cut THEN s[2:] ELSE s END, CASE WHEN stage = 0 THEN 0.0e0 WHEN cut THEN n_cut + s[1].n ELSE n_cut END
  FROM (SELECT event_type, i, stage, s, n_cut, stage = 1 AND {found} AS cut FROM (
    SELECT w.event_type, w.i, w.stage, w.n_cut, CASE WHEN w.stage = 1 THEN w.s ELSE
      list_reduce(range(0, 12), lambda s, l: {level}, list_append(w.s, {{'lv': CAST(0 AS BIGINT), 'n': 1.0e0, 'x': o.value, 'q': o.value * o.value}})) END AS s
    FROM w LEFT JOIN o ON o.event_type = w.event_type AND o.i = w.i + 1 WHERE w.stage = 1 OR o.i IS NOT NULL)))
SELECT o.event_type, o.pane, o.value, CAST({total('n', 'w.s')} AS BIGINT) AS width, round({total('x', 'w.s')}, 4) AS total, CAST(w.n_cut AS BIGINT) AS n_cut, w.n_cut > 0 AS drift
FROM w JOIN o USING (event_type, i) WHERE w.stage = 0"""


def _exact_sql() -> str:
    """Counts of arrangements by recursion on the last row: f(n, m, u) = f(n-1, m, u-m) + f(n, m-1, u); lattice paths step by step."""
    return f"""
WITH RECURSIVE o AS (SELECT o_custkey, o_totalprice AS v, o_orderpriority IN ('1-URGENT', '2-HIGH') AS a FROM orders WHERE o_totalprice IS NOT NULL),
c AS (SELECT o_custkey, v, count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE NOT a) AS b FROM o GROUP BY 1, 2),
q AS (SELECT *, sum(a) OVER p AS ca, sum(b) OVER p AS cb, sum(a) OVER (PARTITION BY o_custkey) AS n, sum(b) OVER (PARTITION BY o_custkey) AS m FROM c WINDOW p AS (PARTITION BY o_custkey ORDER BY v ROWS UNBOUNDED PRECEDING)),
g AS (SELECT o_custkey, CAST(max(n) AS BIGINT) AS n_a, CAST(max(m) AS BIGINT) AS n_b, CAST(sum(a * (cb - b / 2.0e0)) AS DOUBLE) AS u, CAST(sum(power(a + b, 3) - (a + b)) AS DOUBLE) AS ties,
             CAST(max(abs(ca * m - cb * n)) AS BIGINT) AS h FROM q GROUP BY 1 HAVING max(n) > 0 AND max(m) > 0),
size AS (SELECT max(n_a + n_b) AS top, max(least(n_a, n_b)) AS low FROM g),
f(n, m, u, c) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 1.0e0 UNION ALL
  SELECT n, m, u, sum(c) FROM (SELECT n + 1 AS n, m, u + m AS u, c FROM f WHERE n < 8 UNION ALL SELECT n, m + 1, u, c FROM f) x, size WHERE n + m <= top GROUP BY n, m, u),
e AS (SELECT n, m, u, sum(c) OVER (PARTITION BY n, m ORDER BY u) / sum(c) OVER (PARTITION BY n, m) AS cdf FROM f),
k AS (SELECT DISTINCT n_a AS n, n_b AS m, h FROM g),
p(n, m, h, i, j, c) AS (SELECT n, m, h, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 1.0e0 FROM k UNION ALL
  SELECT n, m, h, i, j, sum(c) FROM (SELECT n, m, h, i + 1 AS i, j, c FROM p WHERE i < n UNION ALL SELECT n, m, h, i, j + 1, c FROM p WHERE j < m) x
  WHERE abs(i * m - j * n) < h GROUP BY n, m, h, i, j),
ways AS (SELECT k.n, k.m, k.h, 1 - coalesce(p.c, 0) / exp(lgamma(k.n + k.m + 1.0e0) - lgamma(k.n + 1.0e0) - lgamma(k.m + 1.0e0)) AS ks_exact
         FROM k LEFT JOIN p ON p.n = k.n AND p.m = k.m AND p.h = k.h AND p.i = k.n AND p.j = k.m),
z AS (SELECT *, (greatest(u, n_a * n_b - u) - n_a * n_b / 2.0e0 - 0.5e0) / sqrt(n_a * n_b / 12.0e0 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1.0e0)))) AS z,
             h / CAST(n_a * n_b AS DOUBLE) AS d, sqrt(n_a * n_b / CAST(n_a + n_b AS DOUBLE)) AS ne FROM g)
SELECT o_custkey, n_a, n_b, round(z.u, 6) AS u_stat, round(CASE WHEN z IS NULL OR isnan(z) OR z <= 0 THEN 1.0e0 ELSE {pv.normal_two_sided_sql('z.z', D)} END, 6) AS mw_asymptotic,
       round(CASE WHEN ties = 0 AND least(n_a, n_b) <= 8 THEN least(1.0e0, 2 * e.cdf) END, 6) AS mw_exact, round(d, 6) AS ks_d,
       round({pv.kolmogorov_sf_sql('((ne + 0.12e0 + 0.11e0 / ne) * d)', D)}, 6) AS ks_asymptotic, round(greatest(ways.ks_exact, 0.0e0), 6) AS ks_exact
FROM z LEFT JOIN e ON e.n = least(n_a, n_b) AND e.m = greatest(n_a, n_b) AND e.u = least(z.u, n_a * n_b - z.u)
JOIN ways ON ways.n = z.n_a AND ways.m = z.n_b AND ways.h = z.h"""


def _loop_metrics_sql() -> str:
    return f"""
WITH {_cycle_with()},
p AS (SELECT cycle_end, 'value' AS column_name, ks_p_raw AS p FROM ks UNION ALL SELECT cycle_end, 'event_type', chi2_p_raw FROM ch),
r AS (SELECT cycle_end, avg(CASE WHEN value >= 50.0e0 THEN 1.0e0 ELSE 0.0e0 END) FILTER (WHERE role = 'rec') AS pos FROM ({CYCLE_FAN}) f WHERE value IS NOT NULL GROUP BY 1),
m AS (SELECT cycle_end, 'pvalue' AS metric, column_name, p AS value FROM p UNION ALL SELECT cycle_end, 'drift_detected', column_name, CASE WHEN p < 0.01 THEN 1.0e0 ELSE 0.0e0 END FROM p
      UNION ALL SELECT cycle_end, 'psi', 'value', psi_raw FROM ps UNION ALL SELECT cycle_end, 'pos_ratio', 'value', pos FROM r)
SELECT cycle_end, 'fraud' AS model, metric, column_name AS "column", round(value, 6) AS value FROM m"""


def _loop_alerts_sql() -> str:
    verdicts = f"""WITH {_cycle_with()}, p AS (SELECT cycle_end, ks_p_raw AS p FROM ks UNION ALL SELECT cycle_end, chi2_p_raw FROM ch)
        SELECT CAST(epoch(p.cycle_end) / 86400 AS BIGINT) AS i, bool_or(p < 0.2) OR max(coalesce(ps.psi_raw, 0.0e0)) > 0.2 AS x
        FROM p LEFT JOIN ps USING (cycle_end) GROUP BY 1"""
    return _policy_sql("edge", k=3, n=2, verdicts=verdicts, step=86400)


ORACLES = {
    "enrich_fx": """WITH x AS (SELECT ['USD', 'EUR', 'GBP', 'COP'][CAST(((c_nationkey % 4) + 4) % 4 + 1 AS INTEGER)] AS currency,
        CAST(round(CAST(l_extendedprice * l_tax AS DECIMAL(24, 6)), 2) AS DOUBLE) AS fee, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey),
        y AS (SELECT *, CASE currency WHEN 'USD' THEN 1.0e0 WHEN 'EUR' THEN 1.08e0 WHEN 'GBP' THEN 1.27e0
                                      WHEN 'COP' THEN 0.00026e0 END AS fx FROM x)
        SELECT currency, count(*) AS n_items, round(sum(fee), 2) AS fee,
               round(sum(CAST(round(CAST((l_extendedprice - fee) * fx AS DECIMAL(24, 6)), 2) AS DOUBLE)), 2) AS amount_usd,
               CAST(sum(CAST(l_extendedprice > 50000 AS INTEGER)) AS BIGINT) AS n_large FROM y GROUP BY 1""",
    "window_role_counts": f"""SELECT role, count(*) AS n_rows, round(sum(value), 6) AS sum_value,
        count(DISTINCT user_id) AS n_users FROM ({EVENTS_PAIR}) p GROUP BY role""",
    "window_pair_filter": f"SELECT event_id, role FROM ({EVENTS_PAIR}) p",
    "ks_value": ks_cols(ks_sql(long_sql(EVENTS_PAIR, ["value"], "DOUBLE"))),
    "ks_all_numeric": ks_cols(ks_sql(long_sql(LINEITEM_PAIR, LI_MEASURES, "DOUBLE"))),
    "chi2_event_type": chi_cols(chi2_sql(long_sql(EVENTS_PAIR, ["event_type"], "VARCHAR"))),
    "chi2_all_strings": chi_cols(chi2_sql(long_sql(LINEITEM_PAIR, ["l_returnflag", "l_linestatus"], "VARCHAR"))),
    "chi2_yates_2x2": chi_cols(chi2_sql(long_sql(
        "SELECT *, CASE WHEN quality = 1 THEN 'rec' ELSE 'ref' END AS role FROM labels", ["toxic"], "VARCHAR"))),
    "psi_value": psi_cols(psi_sql(long_sql(EVENTS_PAIR, ["value"], "DOUBLE"))),
    "psi_extend": psi_cols(psi_sql(long_sql(LINEITEM_PAIR, ["l_extendedprice", "l_quantity"], "DOUBLE"), extend=True)),
    "psi_degenerate_edges": psi_cols(psi_sql(long_sql(LABELS_HALF, ["toxic", "quality"], "DOUBLE"))),
    "positive_ratio": f"""SELECT round(avg(CASE WHEN value >= 50.0e0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS pos_ratio
        FROM ({EVENTS_PAIR}) p WHERE role = 'rec' AND value IS NOT NULL""",
    "binary_domain": f"""SELECT round(CASE WHEN bool_and(quality IN (0, 1))
        THEN avg(CASE WHEN quality = 1 THEN 1.0e0 ELSE 0.0e0 END) END, 6) AS pos_ratio
        FROM ({LABELS_HALF}) p WHERE role = 'rec' AND quality IS NOT NULL""",
    "drift_verdict": _verdict_sql(),
    "scenario_pairs": f"WITH {SCEN} SELECT A, B, a_rank, b_rank FROM pairs",
    "mannwhitney": f"""SELECT metric, A, B, nA, nB, round(u_stat, 6) AS u_stat, round(pvalue, 6) AS pvalue
        FROM ({_mw_sql()}) m""",
    "cliffs_delta": f"""SELECT metric, A, B, round(cliffs_delta, 6) AS cliffs_delta,
        CASE WHEN abs(cliffs_delta) < 0.147 THEN 'negligible' WHEN abs(cliffs_delta) < 0.33 THEN 'small'
             WHEN abs(cliffs_delta) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude
        FROM ({_mw_sql()}) m""",
    "bh_adjust": f"""WITH mw AS ({_mw_sql()}),
        bh AS (SELECT *, row_number() OVER (ORDER BY coalesce(pvalue, 1.0e0), a_rank, b_rank) AS k,
                      count(*) OVER () AS m FROM mw)
        SELECT metric, A, B, round(pvalue, 6) AS pvalue,
               round(least(min(coalesce(pvalue, 1.0e0) * m / k) OVER (ORDER BY k
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0e0), 6) AS pvalue_fdr FROM bh""",
    "summary_scopes": _summary_sql(),
    "scenario_report": _report_sql(),
    "policy_edge": _policy_sql("edge"),
    "policy_level": _policy_sql("level"),
    "policy_streak_consecutive": _policy_sql("edge", "consecutive"),
    "label_existing": """SELECT 'existing_is_suspicious' AS label_strategy, count(*) AS total_rows,
        count(*) FILTER (WHERE quality = 1) AS positives, count(*) FILTER (WHERE quality = 0) AS negatives
        FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL""",
    "label_rule_p95": f"""SELECT 'synthetic_rule_risk_or_p95' AS label_strategy, label, count(*) AS n_rows
        FROM ({LINEITEM_RULE}) x GROUP BY label""",
    "logreg_f1": _logreg_f1_sql(),
    "logreg_coefficients": _logreg_coefficients_sql(),
    "retrain_skipped": """SELECT 'one_class' AS scenario, 'synthetic_rule_risk_or_p95' AS label_strategy, count(*) AS total_rows,
        CAST(0 AS BIGINT) AS positives, count(*) AS negatives, 'logreg' AS model, CAST(NULL AS DOUBLE) AS f1 FROM orders
        WHERE o_totalprice IS NOT NULL UNION ALL SELECT 'no_rows', NULL, 0, 0, 0, 'logreg', NULL""",
    "p95_approx_bound": """SELECT count(l_extendedprice) AS n, quantile_cont(l_extendedprice, 0.94) AS p94,
        quantile_cont(l_extendedprice, 0.96) AS p96, quantile_cont(l_extendedprice, 0.95) BETWEEN p94 AND p96 AS within_bound FROM lineitem""",
    "class_counts": """SELECT count(*) FILTER (WHERE toxic = 1) AS positives, count(*) FILTER (WHERE toxic = 0)
        AS negatives, count(*) AS total_rows FROM labels WHERE toxic IS NOT NULL""",
    "class_weights": """SELECT quality, count(*) AS n_class,
        round((SELECT count(*) FROM labels WHERE quality IS NOT NULL) / (2.0e0 * count(*)), 6) AS weight
        FROM labels WHERE quality IS NOT NULL GROUP BY quality""",
    "split_stratified": f"""SELECT doc_id, quality, row_number() OVER (PARTITION BY quality
        ORDER BY {hash_int_sql('doc_id', 42)}, doc_id)
        <= ceil(count(*) OVER (PARTITION BY quality) * 0.2e0) AS is_test
        FROM labels WHERE quality IS NOT NULL""",
    "sample_hash": f"""SELECT o_orderkey, o_orderpriority FROM orders WHERE {uniform_sql('o_orderkey', 42)} < 0.2e0""",
    "split_half": f"""SELECT o_orderkey, CASE WHEN {uniform_sql('o_orderkey', 13)} < 0.5e0 THEN 'ref' ELSE 'rec' END
        AS role FROM orders""",
    "sample_fixed": f"""SELECT o_orderkey, o_orderpriority FROM orders WHERE {uniform_sql('o_orderkey', 42)} < 0.2e0
        ORDER BY {hash_int_sql('o_orderkey', 42)}, o_orderkey LIMIT 1000""",
    "split_roles": f"""SELECT role, count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS sum_keys, 'events' AS source FROM ({EVENTS_PAIR}) e GROUP BY 1
        UNION ALL SELECT role, count(*), CAST(sum(doc_id) AS BIGINT), 'labels' FROM ({LABELS_HALF}) h GROUP BY 1""",
    "scenario_header": f"""SELECT metric, A, B, nA, nB, pvalue, pvalue_fdr FROM ({_report_sql()}) r WHERE row_type = 'mannwhitney'""",
    "threshold_rates": _threshold_rates_sql(),
    "season_class": """SELECT CASE WHEN day(o_orderdate) BETWEEN 5 AND 10 THEN 'days_5_10'
        WHEN day(o_orderdate) BETWEEN 20 AND 25 THEN 'days_20_25' ELSE 'other' END AS season,
        count(*) AS n_orders, round(sum(o_totalprice), 6) AS sum_price FROM orders GROUP BY 1""",
    "partition_values": """SELECT strftime(l_shipdate, '%Y-%m-%d') AS dt, strftime(l_shipdate, '%H') AS hour,
        count(*) AS n_rows FROM lineitem GROUP BY 1, 2""",
    "resource_parse": _resource_sql(),
    "sink_partitioned_roundtrip": """SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority,
        count(*) AS n_orders, round(sum(o_totalprice), 6) AS sum_price FROM orders GROUP BY 1, 2""",
    "csv_roundtrip": "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    "log_append_long": """SELECT o_orderpriority AS scenario, 'n_orders' AS metric, round(CAST(count(*) AS DOUBLE), 6)
        AS value FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 'avg_price', round(avg(o_totalprice), 6)
        FROM orders GROUP BY 1""",
    "scenario_normalise": """SELECT CASE WHEN trim(coalesce(source, '')) = '' THEN 'default' ELSE coalesce(source, '')
        END AS scenario, count(*) AS n_docs FROM documents GROUP BY 1""",
    "scenario_tag": """SELECT CASE WHEN coalesce(regexp_replace(replace(lower(source), ' ', '_'), '[^a-z0-9._-]', '',
        'g'), '') = '' THEN 'manual' ELSE regexp_replace(replace(lower(source), ' ', '_'), '[^a-z0-9._-]', '', 'g')
        END AS tag, count(*) AS n_docs FROM documents GROUP BY 1""",
    "coerce_numeric": """SELECT count(TRY_CAST(props AS DOUBLE)) AS n_raw_numeric,
        count(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS n_k_numeric,
        round(sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS sum_k FROM events""",
    "except_distinct": """SELECT o_custkey AS custkey FROM orders EXCEPT
        SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""",
    "union_widen": """SELECT o_orderpriority AS scenario, o_totalprice AS f1 FROM orders
        UNION ALL BY NAME SELECT c_mktsegment AS scenario, c_acctbal AS psi FROM customer""",
    "trailing_hour": _trailing_sql(),
    "max_triggers_hour": f"SELECT 'fraud' AS model, max(triggers_1h) AS max_triggers_1h FROM ({_trailing_sql()}) t",
    "first_detection": f"""WITH v AS ({_obs_cycles_sql()})
        SELECT 'fraud' AS model, make_timestamp(i * 600 * 1000000) AS cycle_end,
               make_timestamp(min(CASE WHEN x THEN i END) OVER (ORDER BY i RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING)
                              * 600 * 1000000) AS first_detection FROM v""",
    "pivot_pre_post": f"""SELECT user_id, day, pre, post,
        round((epoch_us(post) - epoch_us(pre)) / 1e6, 6) AS duration_s, pre IS NOT NULL AND post IS NULL AS failed
        FROM ({PRE_POST}) p""",
    "ttfd_ttr": f"""WITH l AS (SELECT ts, event_type, lag(event_type) OVER w AS pe, lag(ts) OVER w AS pt FROM events
                WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        g AS (SELECT (epoch_us(ts) - epoch_us(pt)) / 1e6 AS gap FROM l WHERE pe = 'view' AND event_type = 'purchase'),
        d AS (SELECT (epoch_us(post) - epoch_us(pre)) / 1e6 AS dur FROM ({PRE_POST}) p WHERE post IS NOT NULL
              AND pre IS NOT NULL)
        SELECT (SELECT count(*) FROM g) AS n_transitions, (SELECT round(quantile_cont(gap, 0.5), 6) FROM g)
               AS ttfd_median_s, round(quantile_cont(dur, 0.5), 6) AS ttr_median_s, round(min(dur), 6) AS ttr_min_s,
               round(max(dur), 6) AS ttr_max_s FROM d""",
    "stream_windows": """WITH p AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS pane, count(*) AS n,
        sum(value) AS v FROM events GROUP BY 1),
        c AS (SELECT pane + 1 AS e, 'rec' AS role, n, v FROM p UNION ALL SELECT pane + 2, 'ref', n, v FROM p)
        SELECT make_timestamp(e * 86400 * 1000000) AS cycle_end, role, CAST(sum(n) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_late,
               round(sum(v), 6) AS sum_value,
               make_timestamp(e * 86400 * 1000000) <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS closed
        FROM c GROUP BY ALL""",
    "stream_policy": _policy_sql('edge'),
    "cycle_tests_daily": f"""WITH {_cycle_with()}
        SELECT cycle_end, column_name, 'ks' AS test, n_ref, n_rec, round(ks_d_raw, 6) AS stat, round(ks_p_raw, 6) AS p_value FROM ks
        UNION ALL SELECT cycle_end, column_name, 'chi2', n_ref, n_rec, chi2, round(chi2_p_raw, 6) FROM ch""",
    "cycle_verdict_daily": f"""WITH {_cycle_with()},
        p AS (SELECT cycle_end, ks_p_raw AS p FROM ks UNION ALL SELECT cycle_end, chi2_p_raw FROM ch)
        SELECT p.cycle_end, bool_or(p < 0.01) AS drift_any, round(min(p), 6) AS p_min,
               round(avg(CASE WHEN p < 0.01 THEN 1.0e0 ELSE 0.0e0 END), 6) AS reject_share, count(*) AS n_tests,
               round(max(ps.psi_raw), 6) AS psi, bool_or(p < 0.01) OR max(ps.psi_raw) > 0.2 AS should_trigger
        FROM p LEFT JOIN ps USING (cycle_end) GROUP BY p.cycle_end""",
    "metrics_wide_daily": f"""WITH {_cycle_with()}
        SELECT ks.cycle_end, round(max(ch.chi2_p_raw), 6) AS p_event_type, round(max(ks.ks_p_raw), 6) AS p_value,
               round(max(ps.psi_raw), 6) AS psi
        FROM ks JOIN ch USING (cycle_end) LEFT JOIN ps USING (cycle_end) GROUP BY ks.cycle_end""",
    "stream_drift": f"""WITH {_cycle_with()},
        p AS (SELECT cycle_end, ks_p_raw AS p FROM ks UNION ALL SELECT cycle_end, chi2_p_raw FROM ch)
        SELECT p.cycle_end, bool_or(p < 0.01) AS drift_any, round(min(p), 6) AS p_min,
               round(avg(CASE WHEN p < 0.01 THEN 1.0e0 ELSE 0.0e0 END), 6) AS reject_share, count(*) AS n_tests,
               round(max(ps.psi_raw), 6) AS psi, bool_or(p < 0.01) OR max(ps.psi_raw) > 0.2 AS should_trigger
        FROM p LEFT JOIN ps USING (cycle_end) GROUP BY p.cycle_end""",
    "threshold_sweep": f"""WITH c AS ({CYCLE_SUMMARY}),
        g AS (SELECT a.alpha, t.tau FROM (VALUES (0.05e0), (0.01e0), (0.001e0)) a(alpha),
              (VALUES (0.1e0), (0.2e0), (0.3e0)) t(tau))
        SELECT alpha, tau, count(*) AS n_cycles, round(avg(CASE WHEN p_min < alpha OR coalesce(psi, 0.0e0) > tau
               THEN 1.0e0 ELSE 0.0e0 END), 6) AS alert_rate FROM c, g GROUP BY 1, 2""",
    "ablation": f"""WITH c AS ({CYCLE_SUMMARY})
        SELECT 'full' AS variant, count(*) AS n_cycles, round(avg(CASE WHEN p_min < 0.01 OR coalesce(psi, 0.0e0) > 0.2
               THEN 1.0e0 ELSE 0.0e0 END), 6) AS alert_rate FROM c
        UNION ALL SELECT 'no_psi', count(*), round(avg(CASE WHEN p_min < 0.01 THEN 1.0e0 ELSE 0.0e0 END), 6) FROM c
        UNION ALL SELECT 'no_chi2', count(*), round(avg(CASE WHEN p_ks < 0.01 OR coalesce(psi, 0.0e0) > 0.2
               THEN 1.0e0 ELSE 0.0e0 END), 6) FROM c""",
    "holm": f"""WITH mw AS ({_mw_sql()}),
        h AS (SELECT *, row_number() OVER (ORDER BY coalesce(pvalue, 1.0e0), a_rank, b_rank) AS k,
                     count(*) OVER () AS m FROM mw)
        SELECT metric, A, B, round(pvalue, 6) AS pvalue,
               round(least(max((m - k + 1) * coalesce(pvalue, 1.0e0)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING),
                     1.0e0), 6) AS pvalue_holm FROM h""",
    "cramers_v": f"""SELECT column_name, cramers_v, cramers_v_text FROM ({chi2_sql(long_sql(EVENTS_PAIR, ["event_type"],
        "VARCHAR"))}) a UNION ALL SELECT column_name, cramers_v, cramers_v_text FROM ({chi2_sql(long_sql(LINEITEM_PAIR,
        ["l_returnflag", "l_linestatus"], "VARCHAR"))}) b""",
    "dkw": f"""SELECT column_name, round(ks_d_raw, 6) AS ks_d, round(e, 6) AS dkw_eps, ks_d_raw > e AS dkw_exceeds
        FROM (SELECT *, sqrt(ln(2.0e0 / 0.05e0) / (2.0e0 * (n_ref * n_rec / (n_ref + n_rec)))) AS e
              FROM ({ks_sql(long_sql(LINEITEM_PAIR, LI_MEASURES, "DOUBLE"))}) k) z""",
    "wilson": f"""WITH pol AS ({_policy_sql('edge')}),
        g AS (SELECT count(*) AS n_cycles, count(*) FILTER (WHERE attempted) AS n_triggers,
                     count(*) FILTER (WHERE should_trigger) AS n_drift FROM pol),
        r AS (SELECT *, CAST(n_drift AS DOUBLE) / n_cycles AS p, 1.959963984540054e0 AS z, CAST(n_cycles AS DOUBLE) AS n
              FROM g)
        SELECT n_cycles, n_triggers, n_drift, round(p, 6) AS rate,
               round((p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n)
                     * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 6) AS rate_lo,
               round((p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n)
                     * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 6) AS rate_hi FROM r""",
    "cohens_d": f"""WITH {SCEN},
        s AS (SELECT o_orderpriority AS sc, count(o_totalprice) AS n, avg(o_totalprice) AS m,
                     var_samp(o_totalprice) AS v FROM orders GROUP BY 1)
        SELECT 'o_totalprice' AS metric, p.A, p.B,
               round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS cohens_d
        FROM pairs p JOIN s a ON a.sc = p.A JOIN s b ON b.sc = p.B""",
    "auc": """WITH c AS (SELECT l_discount AS v, count(*) FILTER (WHERE l_returnflag = 'R') AS np,
                     count(*) FILTER (WHERE l_returnflag <> 'R') AS nn FROM lineitem
                     WHERE l_discount IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1),
        w AS (SELECT *, sum(nn) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) - nn AS nn_below,
                     sum(np) OVER (ORDER BY v ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS np_above,
                     sum(np) OVER () AS tp, sum(nn) OVER () AS tn FROM c),
        pl AS (SELECT *, (nn_below + 0.5e0 * nn) / tn AS v10, (coalesce(np_above, 0) + 0.5e0 * np) / tp AS v01 FROM w),
        g AS (SELECT max(tp) AS m, max(tn) AS n, sum(np * v10) / max(tp) AS auc,
                     (sum(np * v10 * v10) - max(tp) * power(sum(np * v10) / max(tp), 2)) / (max(tp) - 1) AS var10,
                     (sum(nn * v01 * v01) - max(tn) * power(sum(nn * v01) / max(tn), 2)) / (max(tn) - 1) AS var01
              FROM pl)
        SELECT CAST(m AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg, round(auc, 6) AS auc,
               round(sqrt(var10 / m + var01 / n), 6) AS auc_se,
               round(greatest(auc - 1.959963984540054e0 * sqrt(var10 / m + var01 / n), 0.0e0), 6) AS auc_lo,
               round(least(auc + 1.959963984540054e0 * sqrt(var10 / m + var01 / n), 1.0e0), 6) AS auc_hi FROM g""",
    "kl": f"""SELECT column_name, psi, kl_ref_rec, kl_rec_ref FROM ({psi_sql(long_sql(EVENTS_PAIR, ["value"], "DOUBLE"))}) p""",
    "psi_band": f"""SELECT column_name, psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate'
        ELSE 'significant' END AS band, CASE WHEN psi < 0.2 THEN 'ok' WHEN psi < 0.3 THEN 'alert' ELSE 'severe' END
        AS alert_band FROM (SELECT column_name, psi_raw, round(psi_raw, 6) AS psi
        FROM ({psi_sql(long_sql(LINEITEM_PAIR, LI_MEASURES, "DOUBLE"))}) q) p""",
    "precision_recall": """WITH x AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST(l_discount >= 0.05 AS INTEGER) AS p
            FROM lineitem),
        cls AS (SELECT y AS c FROM x WHERE y IS NOT NULL UNION SELECT p FROM x WHERE p IS NOT NULL),
        s AS (SELECT c, count(*) FILTER (WHERE x.y = c AND x.p = c) AS tp, count(*) FILTER (WHERE x.y = c) AS sup,
                     count(*) FILTER (WHERE x.p = c) AS pred FROM cls, x GROUP BY c)
        SELECT c AS class, round(CASE WHEN pred > 0 THEN tp / pred ELSE 0 END, 6) AS precision,
               round(CASE WHEN sup > 0 THEN tp / sup ELSE 0 END, 6) AS recall,
               round(CASE WHEN tp > 0 THEN 2 * (tp / pred) * (tp / sup) / ((tp / pred) + (tp / sup)) ELSE 0 END, 6)
               AS f1, sup AS support FROM s""",
    "bootstrap_ci": _bootstrap_sql(),
    "noninferiority": f"""WITH {SCEN}, r AS ({_boot_sql()}),
        d AS (SELECT p.A, p.B, (a.mean - b.mean) / b.mean AS rd FROM pairs p
              JOIN r a ON a.o_orderpriority = p.A JOIN r b ON b.o_orderpriority = p.B AND b.rep = a.rep)
        SELECT A, B, round(quantile_cont(rd, 0.025e0), 6) AS ci_lo, round(quantile_cont(rd, 0.975e0), 6) AS ci_hi,
               quantile_cont(rd, 0.025e0) > -0.02e0 AS noninferior FROM d GROUP BY 1, 2""",
    "wilcoxon": f"""WITH d AS (SELECT round(o.o_totalprice - l.items, 2) AS d FROM orders o JOIN
            (SELECT l_orderkey, sum(l_extendedprice) AS items FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey),
        x AS (SELECT abs(d) AS a, d > 0 AS pos FROM d WHERE d IS NOT NULL AND d <> 0),
        r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0e0 AS mr FROM x),
        t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT a, count(*) AS c FROM x GROUP BY 1) q),
        g AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(mr) FILTER (WHERE pos) AS wp FROM r),
        z AS (SELECT g.*, (wp - n * (n + 1) / 4.0e0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0e0 - t.ties / 48.0e0) AS z
              FROM g, t)
        SELECT CAST(n AS BIGINT) AS n, round(wp, 6) AS w_plus, round({pv.normal_two_sided_sql('z', D)}, 6) AS pvalue
        FROM z""",
    "clopper_pearson": _clopper_sql(),
    "hodges_lehmann": f"""WITH d AS (SELECT *, row_number() OVER () AS i FROM ({PRICE_GAPS}) g WHERE d IS NOT NULL)
        SELECT a.o_orderpriority, (SELECT count(*) FROM d c WHERE c.o_orderpriority = a.o_orderpriority) AS n,
               round(quantile_cont((a.d + b.d) / 2, 0.5e0), 6) AS estimate
        FROM d a JOIN d b ON a.o_orderpriority = b.o_orderpriority AND a.i <= b.i GROUP BY 1""",
    "energy_distance": _energy_sql(),
    "mmd": _mmd_sql(),
    "eddm": _eddm_sql(),
    "adwin": _adwin_sql(),
    "two_sample_exact": _exact_sql(),
    "loop_metrics": _loop_metrics_sql(),
    "loop_alerts": _loop_alerts_sql(),
    "stage_stats": """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean,
        round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM events GROUP BY 1""",
}

