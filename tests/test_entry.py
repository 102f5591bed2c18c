"""Driver contract: the flagship query and a sample of queries against their oracles."""

import duckdb
import pytest

import __spark_entry__ as E
from driftspark.plans import catalog
from driftspark.session import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = ["ks_all_numeric", "chi2_all_strings", "psi_extend", "mannwhitney", "scenario_report", "policy_edge",
          "split_stratified", "label_rule_p95", "trailing_hour", "ttfd_ttr", "auc", "wilcoxon", "logreg_f1", "logreg_coefficients", "retrain_skipped", "sample_fixed", "threshold_rates"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert set(df.columns) >= {"drift_any", "psi", "should_trigger"}


def test_every_query_has_an_oracle_or_is_declared():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(catalog.QUERIES) <= set(o)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    return f"{round(v, 6):.6f}" if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    order = sorted(df.columns)
    got = sorted("|".join(_norm(r[c]) for c in order) for r in df.collect())
    idx = [ocols.index(c) for c in order]
    want = sorted("|".join(_norm(r[i]) for i in idx) for r in cur.fetchall())
    assert got == want
