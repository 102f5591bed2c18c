"""Label derivation and class statistics.

The label strategy is decided inside the plan: the class counts of the existing label
and the 95th percentile of the amount are scalar subqueries (``DataFrame.scalar``),
so there is no driver round trip and the choice is exact for the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.operators import ranks
from driftspark.operators.columns import existing
from driftspark.session import work_dir

# Feature candidates and the rule label parameters.
FEATURE_CANDIDATES = ("amount", "fee", "amount_usd", "risk_score")
RISK_CUT = 0.80
AMOUNT_QUANTILE = 0.95
P95_MISSING = 1e9
STRATEGY_EXISTING = "existing_is_suspicious"
STRATEGY_RULE = "synthetic_rule_risk_or_p95"


def amount_p95(df: DataFrame, amount: str, method: str = "approx",
               q: float = AMOUNT_QUANTILE) -> DataFrame:
    """One-row frame with ``_p95`` (A2): ``percentile_approx`` or the exact linear
    quantile from the running counts. Null (no rows) becomes 1e9."""
    if method == "approx":
        one = df.agg(F.percentile_approx(amount, q).cast("double").alias("_p95"))
    elif method == "exact":
        q1 = ranks.exact_quantiles(df.withColumn("_k", F.lit(1)), ["_k"], amount, [q], ["_p95"])
        one = df.sparkSession.range(1).select(q1.select("_p95").scalar().alias("_p95"))
    else:
        raise ValueError(method)
    return one.select(F.coalesce(F.col("_p95"), F.lit(P95_MISSING)).alias("_p95"))


def ensure_label(df: DataFrame, features: Sequence[str] = FEATURE_CANDIDATES,
                 existing_label: str = "is_suspicious", risk: str = "risk_score",
                 amount: str = "amount_usd", risk_cut: float = RISK_CUT,
                 p95_method: str = "approx", keep: Sequence[str] = ()) -> DataFrame:
    """Features that exist + ``label`` (int 0/1) + ``label_strategy``.

    The existing boolean/0-1 label is used when both classes occur among complete
    rows; otherwise the rule ``risk >= 0.8 OR amount >= p95(amount)`` (P8), where an
    absent column drops out of the rule. Rows with a null in the selected columns are
    removed (P4). Missing feature columns are tolerated on both paths (G10).
    ``keep`` columns (e.g. a row key) are carried along without null filtering.
    """
    keep = [c for c in keep if c not in features]
    cols = set(df.columns)
    feats = existing(df, features)
    rule = F.lit(False)
    base = df
    if risk in cols:
        rule = rule | (F.col(risk) >= F.lit(risk_cut))
    if amount in cols:
        rule = rule | (F.col(amount) >= amount_p95(df, amount, p95_method).scalar())
    rule_label = F.when(rule, F.lit(1)).otherwise(F.lit(0))
    if existing_label not in cols:
        out = base.select(*keep, *feats, rule_label.alias("label")).dropna(subset=[*feats, "label"])
        return out.withColumn("label_strategy", F.lit(STRATEGY_RULE))
    ex = F.col(existing_label).cast("int")  # cast before comparing (G9)
    complete = df.select(*feats, ex.alias("_y")).dropna()
    classes = complete.agg(F.count_if(F.col("_y") == 1).alias("_pos"),
                           F.count_if(F.col("_y") == 0).alias("_neg"))
    use_existing = classes.select(((F.col("_pos") > 0) & (F.col("_neg") > 0)).alias("_use")).scalar()
    both = base.select(*keep, *feats, ex.alias("_y"), rule_label.alias("_rule"))
    both = both.where(~use_existing | F.col("_y").isNotNull())
    return both.select(
        *keep, *feats,
        F.when(use_existing, F.col("_y")).otherwise(F.col("_rule")).alias("label"),
        F.when(use_existing, F.lit(STRATEGY_EXISTING)).otherwise(F.lit(STRATEGY_RULE)).alias("label_strategy"),
    ).dropna(subset=[*feats, "label"])


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """A1: positives, negatives and total in one aggregate (label cast to int first)."""
    y = F.col(label).cast("int")
    return df.agg(F.count_if(y == 1).alias("positives"), F.count_if(y == 0).alias("negatives"),
                  F.count(F.lit(1)).alias("total_rows"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """L2: balanced weight n / (2 n_c) per class (as the 'balanced' class weight)."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    tot = df.agg(F.count(F.lit(1)).alias("n_total")).scalar()
    return per.select(label, "n_class", (tot / (F.lit(2.0) * F.col("n_class"))).alias("weight"))


def with_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Rows with their class weight; the weight table has one row per class (two). It is worked
    out once and kept, so that readers of the result scan the rows once a pass, not three times."""
    work_dir(df.sparkSession)
    w = class_weights(df, label).select(label, F.col("weight").alias(out)).checkpoint(eager=True)
    return df.join(F.broadcast(w), on=label, how="inner")


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Tp, fp, fn, tn, precision, recall and F1 of the positive class."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    g = pred.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                 F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select(
        "tp", "fp", "fn", "tn",
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0)).alias("recall"),
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0)).alias("f1"),
    )
