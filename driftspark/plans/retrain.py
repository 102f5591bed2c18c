"""Retraining run (section 3.2, L1-L6): label → split → weighted LR → F1 → log row.

The model is a ridge logistic regression (C = 1, balanced class weights, penalty on the
coefficients only, raw features), fitted by ``operators.logistic`` to its minimum.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.operators import labels as L
from driftspark.operators import logistic, sampling
from driftspark.session import work_dir
from driftspark.sources import io

TEST_FRACTION = 0.2
SPLIT_SEED = 42

LOG_SCHEMA = ("timestamp string, scenario string, run_id string, label_strategy string, total_rows long, "
              "positives long, negatives long, model string, f1 double")


def train_run(df: DataFrame, key: str, features=L.FEATURE_CANDIDATES, existing_label: str = "is_suspicious",
              risk: str = "risk_score", amount: str = "amount_usd", scenario: str = "",
              p95_method: str = "approx", risk_cut: float = L.RISK_CUT) -> DataFrame:
    """One ``training_log`` row (S8/L6), built from a Python row under a fixed schema.
    ``key`` is the row id that the split draws by; rows that share it share a side.

    Reads a few scalars (class counts, training size) to parameterise the model; no
    row data goes to the driver.
    """
    spark = df.sparkSession
    base = df
    if key not in df.columns:
        raise ValueError(f"key column {key!r} missing")
    stamp0 = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    if io.is_empty(df):  # S12: nothing to train on, record the run
        return spark.createDataFrame([(stamp0, scenario, uuid.uuid4().hex, None, 0, 0, 0, "logreg", None)],
                                     LOG_SCHEMA)
    lab = L.ensure_label(base, features, existing_label, risk, amount, risk_cut=risk_cut,
                         p95_method=p95_method, keep=[key])
    feats = [c for c in lab.columns if c in features]
    counts = lab.groupBy("label_strategy").agg(
        F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"),
        F.count(F.lit(1)).alias("total_rows")).first()
    run_id = uuid.uuid4().hex
    stamp = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    if counts is None:
        return spark.createDataFrame([(stamp, scenario, run_id, None, 0, 0, 0, "logreg", None)], LOG_SCHEMA)
    pos, neg, total, strategy = counts.positives, counts.negatives, counts.total_rows, counts.label_strategy
    if pos == 0 or neg == 0 or not feats:  # L5: record and skip
        return spark.createDataFrame([(stamp, scenario, run_id, strategy, total, pos, neg, "logreg", None)],
                                     LOG_SCHEMA)
    model, split = split_and_fit(lab, key, feats)
    f1 = score(model, split.where("is_test")).first().f1
    return spark.createDataFrame([(stamp, scenario, run_id, strategy, total, pos, neg, "logreg", float(f1))],
                                 LOG_SCHEMA)


def split_and_fit(lab: DataFrame, key: str, feats, test_fraction: float = TEST_FRACTION,
                  seed: int = SPLIT_SEED) -> tuple[logistic.Model, DataFrame]:
    """The model of the training part and the split rows (L3).

    The split is written once to the shared checkpoint folder: the fit makes one pass an
    iteration, and a lost executor then re-reads that copy instead of recomputing the
    labelling and the split.
    """
    work_dir(lab.sparkSession)
    split = sampling.stratified_split(lab, key, "label", test_fraction, seed).select("label", "is_test", *feats)
    split = split.checkpoint(eager=True)
    return logistic.fit(L.with_weights(split.where(~F.col("is_test"))), feats), split


def score(model: logistic.Model, rows: DataFrame) -> DataFrame:
    """Confusion counts, precision, recall and F1 of the rows' predictions."""
    return L.confusion(rows.withColumn("prediction", (model.margin() > 0).cast("int")))


def coefficients(model: logistic.Model, spark) -> DataFrame:
    """(term, coefficient, scaled): raw coefficients, and those per deviation of the feature."""
    rows = [("intercept", model.intercept, None)]
    rows += [(f, b, b * s) for f, b, s in zip(model.features, model.coefficients, model.scales)]
    return spark.createDataFrame(rows, "term string, coefficient double, scaled double")
