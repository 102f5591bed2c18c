import binascii

import duckdb
import numpy as np

from driftspark.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = Q.op10_query(spark, SF).collect()
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.predicted == label[r.doc_id] for r in rows if r.held_out and r.doc_id in label]
    assert len(held) > 50 and np.mean(held) > 0.97


def test_labels_decide_only_through_learnt_rows(table):
    """Flipping the labels of held-out rows changes no score; input order changes none either."""
    good, bad = "the quick fox saw a dog. ", "BUY!! NOW!! | "
    docs = [(i, (good if i % 2 else bad) * (1 + i % 5)) for i in range(60)]
    frame, again = table(docs, "doc_id long, text string"), table(docs[::-1], "doc_id long, text string", 5)
    label = lambda flip: [(i, (i % 2) ^ (flip and binascii.crc32(str(i).encode()) % 3 == 1)) for i in range(60)]
    scores = [{r.doc_id: r.score for r in Q.score(f, Q.quality_model(f, table(label(flip), "doc_id long, quality int"))).collect()} for f, flip in ((frame, 0), (again, 1))]
    assert scores[0] == scores[1]
    assert all((scores[0][i] >= 0.5) == bool(i % 2) for i in range(60))


def test_edges(table):
    docs = table([(1, None, "x"), (2, "", "x"), (None, "text " * 100000, "x"), (2, "", "x")], "doc_id long, text string, score string")
    none = Q.score(docs, Q.quality_model(docs, table([], "doc_id long, quality int")))
    assert none.columns == ["doc_id", "text", "score"] and [r.score for r in none.collect()] == [0.5] * 4
    one = Q.score(docs, Q.quality_model(docs, table([(1, 1), (2, 1), (3, None), (4, 7)], "doc_id long, quality int")))
    assert all(r.score > 0.9 for r in one.collect())
    assert Q.score(table([], "doc_id long, text string"), Q.quality_model(docs, table([(1, 1)], "doc_id long, quality int"))).count() == 0


def test_dual_descent_separates():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 200)
    features = [np.unique(np.concatenate([rng.integers(0, 50, 8), [100 + c]])) for c in y]
    ratio = Q.log_ratio(features, y)
    m = Q.margins(features, ratio, *Q.dual_descent(features, y, ratio))
    assert ((m > 0) == (y == 1)).all()
