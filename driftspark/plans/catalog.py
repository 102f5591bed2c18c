"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

The parameters of the monitored table are mapped onto the given tables:
``events.ts`` is the ingest time (30 days), ``lineitem.l_shipdate`` a long history
split by year, ``labels`` the binary label table and ``orders`` the scenario log
(scenario = order priority, metric = total price, run order = order key).

Every computed column is rounded to 6 decimals and aliased, so the oracle SQL in
``oracle_sql.py`` can name the same columns.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.operators import detectors as D
from driftspark.functions import expressions as X
from driftspark.functions import special
from driftspark.operators import adaptive, compare, distances, exact, extras, labels, observe, policy, ranks, sampling, windows
from driftspark.plans import monitor, report, retrain
from driftspark.session import prepare, scratch_path
from driftspark.sources import io
from driftspark.streaming import watch as stream

# Query parameters shared with the oracle SQL.
EVENTS_NOW = "2024-01-31 00:00:00"
EVENTS_WIDTH = dt.timedelta(days=7)
LINEITEM_NOW = "1999-01-01 00:00:00"
LINEITEM_WIDTH = dt.timedelta(days=365)
LINEITEM_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINEITEM_FLAGS = ("l_returnflag", "l_linestatus")
EVENTS_THRESHOLD = 50.0
LABEL_SPLIT_SEED = 13
DRIFT_PERIODS = (("2024-01-08 00:00:00", "2024-01-11 00:00:00"), ("2024-01-18 00:00:00", "2024-01-20 00:00:00"),
                 ("2024-01-25 00:00:00", "2024-01-26 12:00:00"))
DRIFT_FACTOR = 1.25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


def _events_pair(spark, sf) -> DataFrame:
    return windows.window_pair(table(spark, sf, "events"), "ts", EVENTS_NOW, EVENTS_WIDTH)


def _lineitem_pair(spark, sf) -> DataFrame:
    return windows.window_pair(table(spark, sf, "lineitem"), "l_shipdate", LINEITEM_NOW, LINEITEM_WIDTH)


def _ks_out(ks: DataFrame) -> DataFrame:
    return ks.select("column_name", "n_ref", "n_rec", r6("ks_d").alias("ks_d"), r6("ks_p").alias("ks_p"),
                     "enough_rows")


def _chi_out(ch: DataFrame) -> DataFrame:
    return ch.select("column_name", F.col("n_categories").cast("long").alias("n_categories"),
                     "n_ref", "n_rec", r6("chi2").alias("chi2"), "dof", r6("chi2_p").alias("chi2_p"),
                     r6("cramers_v").alias("cramers_v"), "enough_rows")


def _psi_out(p: DataFrame) -> DataFrame:
    return p.select("column_name", F.col("n_ref").cast("long").alias("n_ref"),
                    F.col("n_rec").cast("long").alias("n_rec"), r6("psi").alias("psi"), "enough_rows")


def _long(df: DataFrame, cols, vtype: str) -> DataFrame:
    return monitor.C.to_long(df, ["role"], cols, vtype, "column_name", "value")


# --- P5 / T2: windows -------------------------------------------------------------

def q_window_role_counts(spark, sf):
    p = _events_pair(spark, sf)
    return p.groupBy("role").agg(F.count(F.lit(1)).alias("n_rows"),
                                 r6(F.sum("value")).alias("sum_value"),
                                 F.countDistinct("user_id").alias("n_users"))


def q_window_pair_filter(spark, sf):
    return _events_pair(spark, sf).select("event_id", "role")


# --- K1 KS ------------------------------------------------------------------------

def q_ks_value(spark, sf):
    return _ks_out(D.ks_test(_long(_events_pair(spark, sf), ["value"], "double"), ["column_name"]))


def q_ks_all_numeric(spark, sf):
    long = _long(_lineitem_pair(spark, sf), list(LINEITEM_MEASURES), "double")
    return _ks_out(D.ks_test(long, ["column_name"]))


# --- K2 chi-squared ---------------------------------------------------------------

def q_chi2_event_type(spark, sf):
    return _chi_out(D.chi2_test(_long(_events_pair(spark, sf), ["event_type"], "string"), ["column_name"]))


def q_chi2_all_strings(spark, sf):
    long = _long(_lineitem_pair(spark, sf), list(LINEITEM_FLAGS), "string")
    return _chi_out(D.chi2_test(long, ["column_name"]))


def q_chi2_yates_2x2(spark, sf):
    lab = table(spark, sf, "labels")
    roled = lab.withColumn("role", F.when(F.col("quality") == 1, F.lit("rec")).otherwise(F.lit("ref")))
    return _chi_out(D.chi2_test(_long(roled, ["toxic"], "string"), ["column_name"]))


# --- K3 PSI -----------------------------------------------------------------------

def q_psi_value(spark, sf):
    return _psi_out(D.psi(_long(_events_pair(spark, sf), ["value"], "double"), ["column_name"]))


def q_psi_extend(spark, sf):
    long = _long(_lineitem_pair(spark, sf), ["l_extendedprice", "l_quantity"], "double")
    return _psi_out(D.psi(long, ["column_name"], out_of_range="extend"))


def q_psi_degenerate_edges(spark, sf):
    lab = sampling.split_half(table(spark, sf, "labels"), "doc_id", seed=LABEL_SPLIT_SEED)
    return _psi_out(D.psi(_long(lab, ["toxic", "quality"], "double"), ["column_name"]))


# --- K4 positive ratio ------------------------------------------------------------

def q_positive_ratio(spark, sf):
    pr = D.positive_ratio(_events_pair(spark, sf).withColumn("_k", F.lit(1)), ["_k"], "value",
                          threshold=EVENTS_THRESHOLD)
    return pr.select(r6("pos_ratio").alias("pos_ratio"))


def q_binary_domain(spark, sf):
    lab = sampling.split_half(table(spark, sf, "labels"), "doc_id", seed=LABEL_SPLIT_SEED)
    lab = lab.withColumnRenamed("quality", "label").withColumn("_k", F.lit(1))
    pr = D.positive_ratio(lab, ["_k"], None, binary_cols=["prediction", "label"][1:])
    return pr.select(r6("pos_ratio").alias("pos_ratio"))


# --- K5 verdict -------------------------------------------------------------------

def q_drift_verdict(spark, sf):
    ev = table(spark, sf, "events").select("ts", "value", "event_type")
    cfg = monitor.MonitorConfig(score_col="value")
    fr = monitor.snapshot(ev, "ts", EVENTS_NOW, EVENTS_WIDTH, cfg)
    v = fr["verdict"]
    return v.select("drift_any", r6("p_min").alias("p_min"), r6("reject_share").alias("reject_share"),
                    F.col("n_tests").cast("long").alias("n_tests"), r6("psi").alias("psi"),
                    "should_trigger")


# --- K6-K12 scenario comparison on orders ----------------------------------------

SCENARIO_COL, METRIC_COLS, ORDINAL_COL = "o_orderpriority", ("o_totalprice",), "o_orderkey"


def _orders_runs(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select(ORDINAL_COL, SCENARIO_COL, *METRIC_COLS)
    return compare.normalise_scenario(o, SCENARIO_COL)


def _mw(spark, sf):
    runs = _orders_runs(spark, sf)
    order = compare.scenario_order(runs, SCENARIO_COL, ORDINAL_COL)
    pairs = compare.scenario_pairs(order, SCENARIO_COL)
    long = compare.to_long_metrics(runs, SCENARIO_COL, METRIC_COLS)
    return compare.mann_whitney(long, pairs, SCENARIO_COL, METRIC_COLS), long, order


def q_scenario_pairs(spark, sf):
    order = compare.scenario_order(_orders_runs(spark, sf), SCENARIO_COL, ORDINAL_COL)
    return compare.scenario_pairs(order, SCENARIO_COL).select(
        "A", "B", F.col("a_rank").cast("long").alias("a_rank"), F.col("b_rank").cast("long").alias("b_rank"))


def q_mannwhitney(spark, sf):
    mw, _, _ = _mw(spark, sf)
    return mw.select("metric", "A", "B", "nA", "nB", r6("u_stat").alias("u_stat"), r6("pvalue").alias("pvalue"))


def q_cliffs_delta(spark, sf):
    mw, _, _ = _mw(spark, sf)
    return mw.select("metric", "A", "B", r6("cliffs_delta").alias("cliffs_delta"),
                     compare.cliff_magnitude(F.col("cliffs_delta")).alias("magnitude"))


def q_bh_adjust(spark, sf):
    mw, _, _ = _mw(spark, sf)
    mw = mw.withColumn("metric_ord", F.lit(0))
    out = compare.bh_adjust(mw)
    return out.select("metric", "A", "B", r6("pvalue").alias("pvalue"), r6("pvalue_fdr").alias("pvalue_fdr"))


def q_summary_scopes(spark, sf):
    runs = _orders_runs(spark, sf)
    long = compare.to_long_metrics(runs, SCENARIO_COL, METRIC_COLS)
    s = compare.summaries_from_counts(compare.value_counts_by_scenario(long, SCENARIO_COL), SCENARIO_COL)
    return s.select("metric", "summary_scope", F.col("summary_n").cast("long").alias("summary_n"),
                    *[r6(c).alias(c) for c in ("summary_mean", "summary_std", "summary_min", "summary_p25",
                                               "summary_median", "summary_p75", "summary_max")])


def q_scenario_report(spark, sf):
    rep = report.scenario_report(_orders_runs(spark, sf), SCENARIO_COL, METRIC_COLS, ORDINAL_COL)
    dbl = {"pvalue", "cliffs_delta", "pvalue_fdr", "summary_mean", "summary_std", "summary_min",
           "summary_p25", "summary_median", "summary_p75", "summary_max"}
    return rep.select(*[r6(c).alias(c) if c in dbl else F.col(c) for c in rep.columns])


def q_scenario_header(spark, sf):
    """The same tests from a table whose scenario column has an upper-case header."""
    runs = _orders_runs(spark, sf).withColumnRenamed(SCENARIO_COL, SCENARIO_COL.upper())
    rep = report.scenario_report(runs, SCENARIO_COL, METRIC_COLS, ORDINAL_COL)
    return rep.where("row_type = 'mannwhitney'").select("metric", "A", "B", "nA", "nB", r6("pvalue").alias("pvalue"), r6("pvalue_fdr").alias("pvalue_fdr"))


# --- T4 policy over hourly cycles of events ----------------------------------------

POLICY_STEP = dt.timedelta(hours=1)
POLICY_COOLDOWN = dt.timedelta(hours=3)
POLICY_CLEAR = 3
POLICY_LEVEL = 55.0


def _hourly_verdicts(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events").select("ts", "value")
    idx = windows.pane_index(F.col("ts"), POLICY_STEP) + 1
    return (ev.groupBy(idx.alias("_e")).agg((F.avg("value") > POLICY_LEVEL).alias("should_trigger"))
              .select(F.lit("fraud").alias("model"),
                      F.timestamp_seconds(F.col("_e") * int(POLICY_STEP.total_seconds())).alias("cycle_end"),
                      "should_trigger"))


def _policy(spark, sf, **kw):
    out = policy.apply_policy(_hourly_verdicts(spark, sf), ["model"], "cycle_end", "should_trigger",
                              POLICY_STEP, cooldown=POLICY_COOLDOWN, clear_streak=POLICY_CLEAR, **kw)
    return out.select("model", F.col("cycle_end").cast("timestamp_ntz").alias("cycle_end"), "should_trigger",
                      "attempted", "suppressed", "alert", "clear_streak", "trigger_count")


def q_policy_edge(spark, sf):
    return _policy(spark, sf, mode="edge")


def q_policy_level(spark, sf):
    return _policy(spark, sf, mode="level")


def q_policy_streak_consecutive(spark, sf):
    return _policy(spark, sf, mode="edge", streak="consecutive")


# --- labels, class statistics, sampling, training ----------------------------------

LINEITEM_RISK_CUT = 0.08
LINEITEM_FEATURES = ("l_extendedprice", "l_discount", "l_quantity", "l_tax")


def _lineitem_labeled(spark, sf, keep=()):
    li = table(spark, sf, "lineitem")
    return labels.ensure_label(li, LINEITEM_FEATURES, existing_label="is_suspicious", risk="l_discount",
                               amount="l_extendedprice", risk_cut=LINEITEM_RISK_CUT, p95_method="exact",
                               keep=keep)


def q_label_existing(spark, sf):
    lab = labels.ensure_label(table(spark, sf, "labels"), ["toxic"], existing_label="quality",
                              risk="_none", amount="_none")
    return lab.groupBy("label_strategy").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(F.col("label") == 0).alias("negatives"))


def q_label_rule_p95(spark, sf):
    lab = _lineitem_labeled(spark, sf)
    return lab.groupBy("label_strategy", "label").agg(F.count(F.lit(1)).alias("n_rows"))


def q_p95_approx_bound(spark, sf):
    li = table(spark, sf, "lineitem").select("l_extendedprice").where(F.col("l_extendedprice").isNotNull())
    approx = labels.amount_p95(li, "l_extendedprice", "approx").scalar()
    exact = ranks.exact_quantiles(li, [], "l_extendedprice", [0.94, 0.96])
    inside = approx.between(F.col("q94"), F.col("q96"))
    return exact.select("n", F.col("q94").alias("p94"), F.col("q96").alias("p96"), inside.alias("within_bound"))


def q_class_counts(spark, sf):
    return labels.class_counts(table(spark, sf, "labels").where(F.col("toxic").isNotNull()), "toxic")


def q_class_weights(spark, sf):
    lab = table(spark, sf, "labels").where(F.col("quality").isNotNull())
    return labels.class_weights(lab, "quality").select("quality", "n_class", r6("weight").alias("weight"))


def q_split_stratified(spark, sf):
    lab = table(spark, sf, "labels").where(F.col("quality").isNotNull()).select("doc_id", "quality")
    return sampling.stratified_split(lab, "doc_id", "quality", 0.2, seed=42)


def q_sample_hash(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.sample_hash(o, "o_orderkey", 0.2, seed=42)


def q_sample_fixed(spark, sf):
    """M1 and M2: a fifth of the orders, cut to a thousand rows."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.sample_fixed(o, "o_orderkey", 1000, 0.2, seed=42)


def q_split_roles(spark, sf):
    """Events by their time column, labels (which have none) by the hash of their key."""
    parts = [windows.split_roles(table(spark, sf, name), "ts", EVENTS_NOW, EVENTS_WIDTH, key).groupBy("role")
             .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(key).alias("sum_keys")).withColumn("source", F.lit(name))
             for name, key in (("events", "event_id"), ("labels", "doc_id"))]
    return io.stack_by_name(*parts)


def q_split_half(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return sampling.split_half(o, "o_orderkey", seed=13)


def _lineitem_keyed(spark, sf):
    """Line items with a row key of four columns; rows that share it share a side of the split."""
    li = table(spark, sf, "lineitem")
    return li.withColumn("row_key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


def q_logreg_f1(spark, sf):
    log = retrain.train_run(_lineitem_keyed(spark, sf), "row_key", LINEITEM_FEATURES, risk="l_discount",
                            amount="l_extendedprice", risk_cut=LINEITEM_RISK_CUT, p95_method="exact")
    return log.select("label_strategy", "total_rows", "positives", "negatives", "model", r6("f1").alias("f1"))


def q_logreg_coefficients(spark, sf):
    """L3: the fitted model itself, per deviation of a feature, with its loss."""
    lab = labels.ensure_label(_lineitem_keyed(spark, sf), LINEITEM_FEATURES, risk="l_discount", amount="l_extendedprice",
                              risk_cut=LINEITEM_RISK_CUT, p95_method="exact", keep=["row_key"])
    model, split = retrain.split_and_fit(lab, "row_key", LINEITEM_FEATURES)
    n = split.agg(F.count_if(~F.col("is_test")).alias("n")).scalar()
    return retrain.coefficients(model, spark).select(
        "term", r6(F.coalesce("scaled", "coefficient")).alias("coefficient"), n.alias("n_train"),
        r6(F.lit(model.loss) / n).alias("mean_loss"), F.lit(model.converged).alias("converged"))


def q_retrain_skipped(spark, sf):
    """A run on rows of one class and a run without rows are recorded, not trained."""
    o = table(spark, sf, "orders")
    runs = {"one_class": o, "no_rows": o.where(F.col("o_totalprice") < 0)}
    logs = [retrain.train_run(df, "o_orderkey", ("o_totalprice",), risk="_none", amount="_none", scenario=name)
            for name, df in runs.items()]
    return io.stack_by_name(*logs).select("scenario", "label_strategy", "total_rows", "positives", "negatives", "model", "f1")


# --- X1, X2, X4, X7, X9 expressions ---------------------------------------

def q_enrich_fx(spark, sf):
    """X1, X4, X9 on line items: currency by the customer's nation, fee from the tax rate."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_tax")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    fee = X.money(F.col("l_extendedprice") * F.col("l_tax"))
    x = x.select(X.currency_of(F.col("c_nationkey")).alias("currency"), fee.alias("fee"), "l_extendedprice")
    usd = X.converted_amount(F.col("l_extendedprice"), F.col("fee"), X.fx_rate(F.col("currency")))
    return x.groupBy("currency").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.sum("fee"), 2).alias("fee"),
                                     F.round(F.sum(usd), 2).alias("amount_usd"),
                                     F.sum(X.flag01(F.col("l_extendedprice") > 50000)).alias("n_large"))


def q_season_class(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(X.season_class(F.col("o_orderdate")).alias("season")).agg(
        F.count(F.lit(1)).alias("n_orders"), r6(F.sum("o_totalprice")).alias("sum_price"))


def q_partition_values(spark, sf):
    li = table(spark, sf, "lineitem")
    d, h = X.partition_values(F.col("l_shipdate"))
    return li.groupBy(d.alias("dt"), h.alias("hour")).agg(F.count(F.lit(1)).alias("n_rows"))


def q_resource_parse(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value", "user_id")
    sample = F.format_string("%.2f%%,%.2fMiB / %.3fGiB,%.2f%%", F.pmod("value", F.lit(100.0)), F.col("value"),
                             (F.pmod("user_id", F.lit(4)) + 1).cast("double"),
                             F.pmod("user_id", F.lit(100)).cast("double"))
    p = ev.select("event_id", observe.parse_resource(sample).alias("r"))
    return p.select("event_id", *[r6(f"r.{c}").alias(c) for c in
                                  ("cpu_perc", "mem_used_mb", "mem_limit_mb", "mem_perc")])


# --- S2/S3/S6-S9 sinks ----------------------------------------------------------------

def q_sink_partitioned_roundtrip(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.date_format("o_orderdate", "yyyy"))
    path = scratch_path(spark, "orders_by_year")
    io.write_partitioned(o.select("o_orderkey", "o_totalprice", "year", "o_orderpriority"), path,
                         ["year", "o_orderpriority"], mode="overwrite")
    back = io.read_table(spark, path)
    return back.groupBy(F.col("year").cast("long").alias("year"), "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_orders"), r6(F.sum("o_totalprice")).alias("sum_price"))


CSV_SCHEMA = "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"


def q_csv_roundtrip(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = scratch_path(spark, "orders_csv")
    io.write_csv(o, path)
    return io.read_csv(spark, path, CSV_SCHEMA)


def q_log_append_long(spark, sf):
    o = table(spark, sf, "orders")
    path = scratch_path(spark, "metrics_log")
    first = o.groupBy(F.col("o_orderpriority").alias("scenario")).agg(
        F.count(F.lit(1)).cast("double").alias("value")).withColumn("metric", F.lit("n_orders"))
    second = o.groupBy(F.col("o_orderpriority").alias("scenario")).agg(
        F.avg("o_totalprice").alias("value")).withColumn("metric", F.lit("avg_price"))
    io.append_log(first.select("scenario", "metric", "value"), path)
    io.append_log(second.select("scenario", "metric", "value"), path)
    back = io.read_table(spark, path, "scenario string, metric string, value double")
    return back.select("scenario", "metric", r6("value").alias("value"))


# --- P14-P16 text normalisation, U1/U2 set operations -----------------------------------

def q_scenario_normalise(spark, sf):
    d = compare.normalise_scenario(table(spark, sf, "documents").select("source"), "source")
    return d.groupBy(F.col("source").alias("scenario")).agg(F.count(F.lit(1)).alias("n_docs"))


def q_scenario_tag(spark, sf):
    d = table(spark, sf, "documents").select("source")
    return d.groupBy(observe.scenario_tag(F.col("source")).alias("tag")).agg(F.count(F.lit(1)).alias("n_docs"))


def q_coerce_numeric(spark, sf):
    ev = table(spark, sf, "events").select("props")
    raw = observe.coerce_numeric(F.col("props"))
    k = observe.coerce_numeric(F.get_json_object("props", "$.k"))
    return ev.agg(F.count(raw).alias("n_raw_numeric"), F.count(k).alias("n_k_numeric"),
                  r6(F.sum(k)).alias("sum_k"))


def q_except_distinct(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"))
    c = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING") \
        .select(F.col("c_custkey").alias("custkey"))
    return sampling.except_distinct(o, c)


def q_union_widen(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("scenario"), F.col("o_totalprice").alias("f1"))
    b = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("scenario"), F.col("c_acctbal").alias("psi"))
    return io.stack_by_name(a, b)


# --- J5, O1-O7 observability -------------------------------------------------------------

OBS_STEP = dt.timedelta(minutes=10)
OBS_LEVEL = 60.0
OBS_COOLDOWN = dt.timedelta(minutes=30)
HOUR = dt.timedelta(hours=1)


def _stage(c):
    return (F.when(F.col(c).isin("view", "click"), F.lit("pre"))
            .when(F.col(c).isin("purchase", "signup"), F.lit("post")))


def _obs_cycles(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events").select("ts", "value")
    idx = windows.pane_index(F.col("ts"), OBS_STEP) + 1
    return (ev.groupBy(idx.alias("_e")).agg(F.avg("value").alias("avg_value"))
              .select(F.lit("fraud").alias("model"),
                      F.timestamp_seconds(F.col("_e") * int(OBS_STEP.total_seconds())).alias("cycle_end"),
                      "avg_value", (F.col("avg_value") > OBS_LEVEL).alias("should_trigger")))


def _obs_trailing(spark, sf) -> DataFrame:
    cyc = _obs_cycles(spark, sf)
    pol = policy.apply_policy(cyc, ["model"], "cycle_end", "should_trigger", OBS_STEP,
                              cooldown=OBS_COOLDOWN, clear_streak=POLICY_CLEAR)
    trig = observe.trailing(pol.withColumn("_a", F.col("attempted").cast("long")), ["model"], "cycle_end",
                            OBS_STEP, HOUR, "_a", "sum", out="triggers_1h")
    p95 = observe.trailing(cyc, ["model"], "cycle_end", OBS_STEP, HOUR, "avg_value", "percentile", 0.95,
                           out="p95_value_1h")
    return trig.join(p95, on=["model", "cycle_end"], how="left")


def q_trailing_hour(spark, sf):
    t = _obs_trailing(spark, sf)
    return t.select("model", F.col("cycle_end").cast("timestamp_ntz").alias("cycle_end"),
                    F.col("triggers_1h").cast("long").alias("triggers_1h"), r6("p95_value_1h").alias("p95_value_1h"))


def q_max_triggers_hour(spark, sf):
    t = _obs_trailing(spark, sf)
    return t.groupBy("model").agg(F.max("triggers_1h").cast("long").alias("max_triggers_1h"))


def q_first_detection(spark, sf):
    cyc = _obs_cycles(spark, sf)
    f = observe.first_detection(cyc, ["model"], "cycle_end", "should_trigger", OBS_STEP, OBS_STEP)
    return f.select("model", F.col("cycle_end").cast("timestamp_ntz").alias("cycle_end"),
                    F.col("first_detection").cast("timestamp_ntz").alias("first_detection"))


def q_pivot_pre_post(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_type")
    ev = ev.withColumn("day", F.to_date("ts")).withColumn("stage", _stage("event_type"))
    p = observe.pre_post(ev, ["user_id", "day"], "stage", "ts")
    return p.select("user_id", "day", "pre", "post", r6("duration_s").alias("duration_s"), "failed")


def q_ttfd_ttr(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    gaps = observe.transitions(ev, ["user_id"], ["ts", "event_id"], "ts", "event_type", "view", "purchase")
    gaps = gaps.select((F.col("gap_us") / 1e6).alias("gap_s"), F.lit(1).alias("_k"))
    ttfd = ranks.exact_quantiles(gaps, ["_k"], "gap_s", [0.5], ["ttfd_median_s"])
    pp = observe.pre_post(ev.withColumn("day", F.to_date("ts")).withColumn("stage", _stage("event_type")),
                          ["user_id", "day"], "stage", "ts").where(F.col("duration_s").isNotNull())
    pp = pp.select("duration_s", F.lit(1).alias("_k"))
    ttr = ranks.exact_quantiles(pp, ["_k"], "duration_s", [0.5], ["ttr_median_s"])
    rng = pp.agg(F.min("duration_s").alias("ttr_min_s"), F.max("duration_s").alias("ttr_max_s"))
    # three one-row results side by side: scalar subqueries rather than a join on a constant
    return ttfd.select(F.col("n").alias("n_transitions"), r6("ttfd_median_s").alias("ttfd_median_s"),
                       r6(ttr.select("ttr_median_s").scalar()).alias("ttr_median_s"),
                       r6(rng.select("ttr_min_s").scalar()).alias("ttr_min_s"),
                       r6(rng.select("ttr_max_s").scalar()).alias("ttr_max_s"))


def q_stage_stats(spark, sf):
    ev = table(spark, sf, "events").select("event_type", "value")
    s = observe.stage_stats(ev, ["event_type"], "value")
    return s.select("event_type", "n", r6("mean").alias("mean"), r6("p95").alias("p95"), r6("max").alias("max"))


# --- T1-T7 streaming -------------------------------------------------------------------

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
STREAM_STEP = dt.timedelta(days=1)
STREAM_DELAY = dt.timedelta(hours=1)


def _events_stream(spark, sf):
    prepare(spark)
    return stream.table_stream(spark, f"{sf.rstrip('/')}/events.parquet", EVENTS_SCHEMA, max_files=1)


def q_stream_windows(spark, sf):
    """All daily cycles of the stream; ``closed`` once the watermark passed their end,
    ``n_late`` rows that came after it had passed their pane (they are in ``n_rows`` too)."""
    out, ck = stream.new_paths(spark, "cycles")
    panes, arrivals = stream.run_pane_sink(_events_stream(spark, sf), out, ck, "ts", STREAM_STEP, STREAM_DELAY, value="value")
    cyc = stream.read_cycles(panes, arrivals, STREAM_STEP, STREAM_STEP)
    return cyc.select(F.col("cycle_end").cast("timestamp_ntz").alias("cycle_end"), "role",
                      F.col("n_rows").cast("long").alias("n_rows"), F.col("n_late").cast("long").alias("n_late"),
                      r6("sum_value").alias("sum_value"), "closed")


def q_stream_policy(spark, sf):
    out, ck = stream.new_paths(spark, "panes")
    panes, _ = stream.run_pane_sink(_events_stream(spark, sf), out, ck, "ts", POLICY_STEP, STREAM_DELAY, value="value")
    verdicts = panes.read().select(
        F.lit("fraud").alias("model"), F.timestamp_seconds((F.col("_pane") + 1) * int(POLICY_STEP.total_seconds())).alias("cycle_end"),
        (F.col("sum_value") / F.col("n") > POLICY_LEVEL).alias("should_trigger"))
    vt, _ = stream.new_paths(spark, "verdicts")
    verdicts.write.parquet(vt)
    vstream = spark.readStream.schema("model string, cycle_end timestamp, should_trigger boolean").parquet(vt)
    pol = stream.policy_stream(vstream, POLICY_STEP, POLICY_COOLDOWN, POLICY_CLEAR)
    pt, pck = stream.new_paths(spark, "policy")
    stream.run_to_table(pol, pt, pck)
    out = spark.read.schema(stream.POLICY_OUT).parquet(pt)
    return out.select("model", F.col("cycle_end").cast("timestamp_ntz").alias("cycle_end"), "should_trigger",
                      "attempted", "suppressed", "alert", "clear_streak", "trigger_count")


# --- T2 replay of the loop over daily cycles; Y1-Y16 second tier ----------------------

DAY = dt.timedelta(days=1)
SWEEP_ALPHAS = (0.05, 0.01, 0.001)
SWEEP_TAUS = (0.1, 0.2, 0.3)


def _daily(spark, sf, value=None):
    ev = table(spark, sf, "events").select("ts", "value", "event_type")
    if value is not None:
        ev = ev.withColumn("value", value)
    return monitor.cycle_tests(ev, "ts", DAY, DAY, monitor.MonitorConfig(score_col="value"))


def q_cycle_tests_daily(spark, sf):
    t = _daily(spark, sf)["tests"]
    return t.select(F.col("cycle_end").cast("timestamp_ntz").alias("cycle_end"), "column_name", "test",
                    "n_ref", "n_rec", r6("stat").alias("stat"), r6("p_value").alias("p_value"))


def q_cycle_verdict_daily(spark, sf):
    v = _daily(spark, sf)["verdict"]
    return v.select(F.col("cycle_end").cast("timestamp_ntz").alias("cycle_end"), "drift_any",
                    r6("p_min").alias("p_min"), r6("reject_share").alias("reject_share"),
                    F.col("n_tests").cast("long").alias("n_tests"), r6("psi").alias("psi"), "should_trigger")


def _cycle_summary(spark, sf, value=None):
    fr = _daily(spark, sf, value)
    per = fr["tests"].groupBy("cycle_end").agg(
        F.min("p_value").alias("p_min"), F.min(F.when(F.col("test") == "ks", F.col("p_value"))).alias("p_ks"))
    return per.join(fr["psi"].select("cycle_end", "psi"), "cycle_end", "left")


def q_metrics_wide_daily(spark, sf):
    """T6 + S7: the per-cycle metric rows in long form, shown one row per cycle with
    ``p_<column>`` columns (sorted) and the PSI of the score column."""
    fr = _daily(spark, sf)
    long = monitor.metrics_long(fr["tests"], fr["psi"], ["cycle_end"])
    wide = io.wide_view(long, ["cycle_end"])
    psi = long.where(F.col("metric") == "psi").select("cycle_end", F.col("value").alias("psi"))
    out = wide.join(psi, "cycle_end", "left")
    return out.select(F.col("cycle_end").cast("timestamp_ntz").alias("cycle_end"),
                      r6("p_event_type").alias("p_event_type"), r6("p_value").alias("p_value"), r6("psi").alias("psi"))


def _swept(cycles):
    """Cycles x thresholds with the ``alert`` of each pair."""
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(t).alias("tau"))
                               for a in SWEEP_ALPHAS for t in SWEEP_TAUS])).alias("g")
    x = cycles.select("*", grid).select(*cycles.columns, "g.alpha", "g.tau")
    return x, (F.col("p_min") < F.col("alpha")) | (F.coalesce(F.col("psi"), F.lit(0.0)) > F.col("tau"))


def q_threshold_rates(spark, sf):
    """Y12 with truth: in the labelled periods the value is raised, so cycles whose windows
    differ in their share of a period have drifted. False alerts and hits per threshold."""
    raised = F.col("value") * F.when(windows.in_period(F.col("ts"), DRIFT_PERIODS), DRIFT_FACTOR).otherwise(F.lit(1.0))
    x, alert = _swept(_cycle_summary(spark, sf, raised))
    truth = windows.changed(F.col("cycle_end"), DAY, DRIFT_PERIODS)
    x = x.select("alpha", "tau", alert.alias("alert"), truth.alias("truth"))
    hit, false = F.count_if(F.col("alert") & F.col("truth")), F.count_if(F.col("alert") & ~F.col("truth"))
    drifted = F.count_if("truth")
    return x.groupBy("alpha", "tau").agg(
        F.count(F.lit(1)).alias("n_cycles"), drifted.alias("n_drifted"), r6(F.try_divide(hit, drifted)).alias("tpr"),
        r6(F.try_divide(false, F.count(F.lit(1)) - drifted)).alias("fpr"))


def q_threshold_sweep(spark, sf):
    x, alert = _swept(_cycle_summary(spark, sf))
    return x.groupBy("alpha", "tau").agg(F.count(F.lit(1)).alias("n_cycles"),
                                         r6(F.avg(alert.cast("double"))).alias("alert_rate"))


def q_ablation(spark, sf):
    c = _cycle_summary(spark, sf)
    psi_hit = F.coalesce(F.col("psi"), F.lit(0.0)) > D.PSI_ALERT
    variants = F.explode(F.array(
        F.struct(F.lit("full").alias("variant"), ((F.col("p_min") < D.ALPHA) | psi_hit).alias("alert")),
        F.struct(F.lit("no_psi").alias("variant"), (F.col("p_min") < D.ALPHA).alias("alert")),
        F.struct(F.lit("no_chi2").alias("variant"), ((F.col("p_ks") < D.ALPHA) | psi_hit).alias("alert")),
    )).alias("v")
    x = c.select(variants).select("v.variant", "v.alert")
    return x.groupBy("variant").agg(F.count(F.lit(1)).alias("n_cycles"),
                                    r6(F.avg(F.col("alert").cast("double"))).alias("alert_rate"))


def q_holm(spark, sf):
    mw, _, _ = _mw(spark, sf)
    out = compare.holm_adjust(mw.withColumn("metric_ord", F.lit(0)))
    return out.select("metric", "A", "B", r6("pvalue").alias("pvalue"), r6("pvalue_holm").alias("pvalue_holm"))


def q_cramers_v(spark, sf):
    ch = D.chi2_test(_long(_events_pair(spark, sf), ["event_type"], "string"), ["column_name"])
    ch2 = D.chi2_test(_long(_lineitem_pair(spark, sf), list(LINEITEM_FLAGS), "string"), ["column_name"])
    both = ch.unionByName(ch2)
    n = F.col("n_ref") + F.col("n_rec")
    return both.select("column_name", r6("cramers_v").alias("cramers_v"),
                       r6(F.sqrt(F.col("cramers_v") * F.col("cramers_v") * n / (n * (F.col("n_categories") - 1))))
                       .alias("cramers_v_text"))


def q_dkw(spark, sf):
    ks = D.ks_test(_long(_lineitem_pair(spark, sf), list(LINEITEM_MEASURES), "double"), ["column_name"])
    d = D.dkw_band(ks, 0.05)
    return d.select("column_name", r6("ks_d").alias("ks_d"), r6("dkw_eps").alias("dkw_eps"), "dkw_exceeds")


def q_wilson(spark, sf):
    pol = _policy(spark, sf, mode="edge")
    g = pol.agg(F.count(F.lit(1)).alias("n_cycles"), F.count_if("attempted").alias("n_triggers"),
                F.count_if("should_trigger").alias("n_drift"))
    lo, hi = extras.wilson(F.col("n_drift"), F.col("n_cycles"))
    return g.select("n_cycles", "n_triggers", "n_drift", r6(F.col("n_drift") / F.col("n_cycles")).alias("rate"),
                    r6(lo).alias("rate_lo"), r6(hi).alias("rate_hi"))


def q_cohens_d(spark, sf):
    runs = _orders_runs(spark, sf)
    order = compare.scenario_order(runs, SCENARIO_COL, ORDINAL_COL)
    pairs = compare.scenario_pairs(order, SCENARIO_COL)
    long = compare.to_long_metrics(runs, SCENARIO_COL, METRIC_COLS)
    return extras.cohens_d(long, pairs, SCENARIO_COL).select("metric", "A", "B", r6("cohens_d").alias("cohens_d"))


def q_auc(spark, sf):
    li = table(spark, sf, "lineitem").select("l_discount", (F.col("l_returnflag") == "R").alias("y"))
    a = extras.auc_delong(li.withColumn("_k", F.lit(1)), ["_k"], "l_discount", "y")
    return a.select("n_pos", "n_neg", r6("auc").alias("auc"), r6("auc_se").alias("auc_se"),
                    r6("auc_lo").alias("auc_lo"), r6("auc_hi").alias("auc_hi"))


def q_kl(spark, sf):
    p = D.psi(_long(_events_pair(spark, sf), ["value"], "double"), ["column_name"])
    return p.select("column_name", r6("psi").alias("psi"), r6("kl_ref_rec").alias("kl_ref_rec"),
                    r6("kl_rec_ref").alias("kl_rec_ref"))


def q_psi_band(spark, sf):
    p = D.psi(_long(_lineitem_pair(spark, sf), list(LINEITEM_MEASURES), "double"), ["column_name"])
    return p.select("column_name", r6("psi").alias("psi"), extras.psi_band(F.col("psi")).alias("band"),
                    extras.psi_band(F.col("psi"), extras.PSI_BANDS_B).alias("alert_band"))


def q_precision_recall(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"),
                                             (F.col("l_discount") >= 0.05).cast("int").alias("p"))
    return extras.per_class_scores(li, "y", "p").select(
        "class", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


BOOT_B = 1000


def _boot_rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", SCENARIO_COL, "o_totalprice")


def _boot(spark, sf):
    return extras.bootstrap_means(_boot_rows(spark, sf), [SCENARIO_COL], "o_orderkey", "o_totalprice", BOOT_B)


def q_bootstrap_ci(spark, sf):
    """Percentile and BCa intervals of the mean, from one set of replicates."""
    reps = _boot(spark, sf).checkpoint(eager=True)  # B rows per scenario, used twice
    ci = extras.percentile_ci(reps, [SCENARIO_COL], "mean")
    bca = extras.bca_ci(_boot_rows(spark, sf), reps, [SCENARIO_COL], "o_totalprice")
    return ci.join(bca, SCENARIO_COL).select(
        SCENARIO_COL, "n_reps", *[r6(c).alias(c) for c in ("ci_lo", "ci_hi", "accel", "z0", "bca_lo", "bca_hi")])


NONINF_MARGIN = 0.02


def q_noninferiority(spark, sf):
    reps = _boot(spark, sf).checkpoint(eager=True)  # B rows per scenario, used twice
    order = compare.scenario_order(_orders_runs(spark, sf), SCENARIO_COL, ORDINAL_COL)
    pairs = compare.scenario_pairs(order, SCENARIO_COL)
    a = reps.select(F.col(SCENARIO_COL).alias("A"), "rep", F.col("mean").alias("ma"))
    b = reps.select(F.col(SCENARIO_COL).alias("B"), "rep", F.col("mean").alias("mb"))
    d = (pairs.join(a, "A").join(b, ["B", "rep"])
         .select("A", "B", "rep", ((F.col("ma") - F.col("mb")) / F.col("mb")).alias("rel_diff")))
    ci = extras.percentile_ci(d, ["A", "B"], "rel_diff")
    return ci.select("A", "B", r6("ci_lo").alias("ci_lo"), r6("ci_hi").alias("ci_hi"),
                     (F.col("ci_lo") > -NONINF_MARGIN).alias("noninferior"))


def q_clopper_pearson(spark, sf):
    """Exact interval of the share of events at or above the threshold, per event type."""
    ev = table(spark, sf, "events").where(F.col("value").isNotNull())
    g = ev.groupBy("event_type").agg(F.count_if(F.col("value") >= EVENTS_THRESHOLD).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = special.clopper_pearson("k", "n")
    return g.select("event_type", "k", "n", F.round(lo, 9).alias("rate_lo"), F.round(hi, 9).alias("rate_hi"))


def q_hodges_lehmann(spark, sf):
    """Median of the pairwise means of order price less the sum of its items, per priority."""
    d = _price_gaps(spark, sf, SCENARIO_COL)
    return extras.hodges_lehmann(d, [SCENARIO_COL], "d", decimals=2).select(SCENARIO_COL, "n", r6("estimate").alias("estimate"))


def _pair_counts(spark, sf):
    """(column_name, value, n_ref, n_rec) of events and of three small-domain line item measures."""
    long = _long(_events_pair(spark, sf), ["value"], "double").unionByName(
        _long(_lineitem_pair(spark, sf), ["l_quantity", "l_discount", "l_tax"], "double"))
    return ranks.value_counts(long, ["column_name"], "value", "role", ["ref", "rec"], ["n_ref", "n_rec"])


def q_energy_distance(spark, sf):
    """2.14: energy distance of the two windows, from weighted prefix sums."""
    return distances.energy_from_counts(_pair_counts(spark, sf), ["column_name"]).select("column_name", "n_ref", "n_rec", r6("energy").alias("energy"))


def q_mmd(spark, sf):
    """2.14: squared MMD of the two windows by random Fourier features, with its standard error."""
    m = distances.mmd_from_counts(_pair_counts(spark, sf), ["column_name"])
    return m.select("column_name", "n_ref", "n_rec", r6("sigma").alias("sigma"), F.round("mmd2", 9).alias("mmd2"), F.round("mmd2_se", 9).alias("mmd2_se"))


def q_eddm(spark, sf):
    """2.14: EDDM over the errors of a threshold rule on line items, per line status."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    li = table(spark, sf, "lineitem").select("l_linestatus", *order, ((F.col("l_discount") >= 0.05) != (F.col("l_returnflag") == "R")).alias("error"))
    e = adaptive.eddm(li, ["l_linestatus"], order, "error")
    return e.groupBy("l_linestatus").agg(
        F.max("n_errors").cast("long").alias("n_errors"), F.max("position").cast("long").alias("last_error"), r6(F.max_by("mean_distance", "position")).alias("mean_distance"),
        r6(F.max_by("ratio", "position")).alias("ratio"), r6(F.min("ratio")).alias("least_ratio"),
        F.count_if(F.col("zone") == "warning").alias("n_warning"), F.count_if(F.col("zone") == "drift").alias("n_drift"),
        F.min(F.when(F.col("zone") == "drift", F.col("position"))).cast("long").alias("first_drift"))


ADWIN_STEP = dt.timedelta(hours=6)
ADWIN_DELTA = 0.3


def _adwin_panes(spark, sf):
    ev = table(spark, sf, "events").where(F.col("value").isNotNull())
    pane = windows.pane_index(F.col("ts"), ADWIN_STEP)
    # whole hundredths, so that the means do not depend on the order of a sum
    mean = F.expr("sum(cast(round(value * 100) as bigint)) div count(1)") / F.lit(10000.0)
    return ev.groupBy("event_type", pane.cast("long").alias("pane")).agg(mean.alias("value"))


def q_adwin(spark, sf):
    """2.14: adaptive windows over the six-hourly means of each event type."""
    a = adaptive.adwin(_adwin_panes(spark, sf), ["event_type"], "pane", "value", ADWIN_DELTA)
    return a.select("event_type", "pane", r6("value").alias("value"), "width", F.round(F.col("mean") * F.col("width"), 4).alias("total"), "n_cut", "drift")


def q_two_sample_exact(spark, sf):
    """K1, K6 at small sizes: each customer's urgent orders against the others, both forms."""
    o = table(spark, sf, "orders").where(F.col("o_totalprice").isNotNull())
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    counts = o.groupBy("o_custkey", F.col("o_totalprice").alias("value")).agg(F.count_if(urgent).alias("n_a"), F.count_if(~urgent).alias("n_b"))
    t = exact.two_sample(counts, ["o_custkey"])
    return t.where(F.col("u_stat").isNotNull()).select("o_custkey", "n_a", "n_b", *[r6(c).alias(c) for c in ("u_stat", "mw_asymptotic", "mw_exact", "ks_d", "ks_asymptotic", "ks_exact")])


def _price_gaps(spark, sf, *keep):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("items"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", *keep)
    # prices carry 2 decimals; rounding the difference removes float noise from the sum order
    return o.join(li, o.o_orderkey == li.l_orderkey).select(F.round(F.col("o_totalprice") - F.col("items"), 2).alias("d"), *keep)


def q_wilcoxon(spark, sf):
    w = extras.signed_rank(_price_gaps(spark, sf).withColumn("_k", F.lit(1)), ["_k"], "d")
    return w.select("n", r6("w_plus").alias("w_plus"), r6("pvalue").alias("pvalue"))


def _verdict_columns(v):
    return v.select(F.col("cycle_end").cast("timestamp_ntz").alias("cycle_end"), "drift_any",
                    r6("p_min").alias("p_min"), r6("reject_share").alias("reject_share"),
                    F.col("n_tests").cast("long").alias("n_tests"), r6("psi").alias("psi"), "should_trigger")


# A loop sensitive enough to alert on the given events, and its policy.
LOOP_ALPHA = 0.2
LOOP_COOLDOWN = dt.timedelta(days=3)
LOOP_CLEAR = 2
LOOP_HORIZON = dt.timedelta(days=90)


def _loop(spark, sf, cfg, **kw):
    path, ck = stream.new_paths(spark, "loop")
    return stream.run_loop(_events_stream(spark, sf), path, ck, "ts", DAY, DAY, STREAM_DELAY, ["value"], ["event_type"], "value", cfg, **kw)


def q_stream_drift(spark, sf):
    """The daily-cycle detector as a stream; verdicts of all cycles."""
    return _verdict_columns(_loop(spark, sf, monitor.MonitorConfig(score_col="value")).current("verdicts"))


def q_loop_metrics(spark, sf):
    """What the running loop publishes per cycle, positive ratio included."""
    loop = _loop(spark, sf, monitor.MonitorConfig(score_col="value", positive_threshold=EVENTS_THRESHOLD))
    return loop.current("metrics").select(F.col("cycle_end").cast("timestamp_ntz").alias("cycle_end"), "model", "metric", "column", r6("value").alias("value"))


def q_loop_alerts(spark, sf):
    """T3-T6 as one loop: panes, verdicts, then the policy as a stream over the verdict table."""
    loop = _loop(spark, sf, monitor.MonitorConfig(score_col="value", alpha=LOOP_ALPHA))
    _, ck = stream.new_paths(spark, "alerts")
    stream.run_alerts(loop, ck, DAY, LOOP_COOLDOWN, LOOP_HORIZON, clear_streak=LOOP_CLEAR)
    return loop.current("alerts").select("model", F.col("cycle_end").cast("timestamp_ntz").alias("cycle_end"), "should_trigger",
                                         "attempted", "suppressed", "alert", "clear_streak", "trigger_count")


QUERIES = {
    "window_role_counts": q_window_role_counts,
    "window_pair_filter": q_window_pair_filter,
    "ks_value": q_ks_value,
    "ks_all_numeric": q_ks_all_numeric,
    "chi2_event_type": q_chi2_event_type,
    "chi2_all_strings": q_chi2_all_strings,
    "chi2_yates_2x2": q_chi2_yates_2x2,
    "psi_value": q_psi_value,
    "psi_extend": q_psi_extend,
    "psi_degenerate_edges": q_psi_degenerate_edges,
    "positive_ratio": q_positive_ratio,
    "binary_domain": q_binary_domain,
    "drift_verdict": q_drift_verdict,
    "scenario_pairs": q_scenario_pairs,
    "mannwhitney": q_mannwhitney,
    "cliffs_delta": q_cliffs_delta,
    "bh_adjust": q_bh_adjust,
    "summary_scopes": q_summary_scopes,
    "scenario_report": q_scenario_report,
    "scenario_header": q_scenario_header,
    "policy_edge": q_policy_edge,
    "policy_level": q_policy_level,
    "policy_streak_consecutive": q_policy_streak_consecutive,
    "label_existing": q_label_existing,
    "label_rule_p95": q_label_rule_p95,
    "p95_approx_bound": q_p95_approx_bound,
    "class_counts": q_class_counts,
    "class_weights": q_class_weights,
    "split_stratified": q_split_stratified,
    "sample_hash": q_sample_hash,
    "sample_fixed": q_sample_fixed,
    "split_half": q_split_half,
    "split_roles": q_split_roles,
    "logreg_f1": q_logreg_f1,
    "logreg_coefficients": q_logreg_coefficients,
    "retrain_skipped": q_retrain_skipped,
    "enrich_fx": q_enrich_fx,
    "season_class": q_season_class,
    "partition_values": q_partition_values,
    "resource_parse": q_resource_parse,
    "sink_partitioned_roundtrip": q_sink_partitioned_roundtrip,
    "csv_roundtrip": q_csv_roundtrip,
    "log_append_long": q_log_append_long,
    "scenario_normalise": q_scenario_normalise,
    "scenario_tag": q_scenario_tag,
    "coerce_numeric": q_coerce_numeric,
    "except_distinct": q_except_distinct,
    "union_widen": q_union_widen,
    "trailing_hour": q_trailing_hour,
    "max_triggers_hour": q_max_triggers_hour,
    "first_detection": q_first_detection,
    "pivot_pre_post": q_pivot_pre_post,
    "ttfd_ttr": q_ttfd_ttr,
    "stage_stats": q_stage_stats,
    "stream_windows": q_stream_windows,
    "stream_policy": q_stream_policy,
    "stream_drift": q_stream_drift,
    "cycle_tests_daily": q_cycle_tests_daily,
    "cycle_verdict_daily": q_cycle_verdict_daily,
    "metrics_wide_daily": q_metrics_wide_daily,
    "threshold_sweep": q_threshold_sweep,
    "threshold_rates": q_threshold_rates,
    "ablation": q_ablation,
    "holm": q_holm,
    "cramers_v": q_cramers_v,
    "dkw": q_dkw,
    "wilson": q_wilson,
    "cohens_d": q_cohens_d,
    "auc": q_auc,
    "kl": q_kl,
    "psi_band": q_psi_band,
    "precision_recall": q_precision_recall,
    "bootstrap_ci": q_bootstrap_ci,
    "noninferiority": q_noninferiority,
    "wilcoxon": q_wilcoxon,
    "clopper_pearson": q_clopper_pearson,
    "hodges_lehmann": q_hodges_lehmann,
    "energy_distance": q_energy_distance,
    "mmd": q_mmd,
    "eddm": q_eddm,
    "adwin": q_adwin,
    "two_sample_exact": q_two_sample_exact,
    "loop_metrics": q_loop_metrics,
    "loop_alerts": q_loop_alerts,
}
