import duckdb
import pytest

from driftspark.llm.oracle import ORACLES
from driftspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = sorted(tuple(clean(r[i]) for i in at) for r in want.fetchall())
    got = QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(tuple(map(clean, r)) for r in got) == rows


def test_all_are_registered():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, len(QUERIES) + 1)]
