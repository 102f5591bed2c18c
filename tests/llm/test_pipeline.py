import binascii

import duckdb
import pytest

import corpus_pipeline as C
from driftspark.llm import shared
from test_decontaminate import brute as leaked
from test_jaccard_join import brute as components
from test_substring_dedup import brute as deduped

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    kept = [docs]
    for i, (_, stage) in enumerate(C.STAGES):
        kept.append(shared.staged(stage(spark, kept[-1], SF), f"test{i}"))
    rows = [{r.doc_id: r.text for r in df.collect()} for df in kept[:-1]]
    assert all(df.columns == list(C.COLUMNS) for df in kept[:-1])
    good = [d in rows[1] for d, y in label.items() if y == 1]
    assert sum(good) / len(good) > 0.95 and sum(d in rows[1] for d, y in label.items() if y == 0) <= 1
    assert set(rows[2]) == {d for d, _, c in components(rows[1].items()) if d == c}
    want = {d: (kept_text if gone else rows[2][d]) for d, n, gone, kept_text in deduped(rows[2].items()) if n > gone or not gone}
    assert rows[3] == want
    assert set(rows[4]) == set(rows[3]) - {d for d, _ in leaked(rows[3].items(), items)}
    pieces = kept[-1].collect()
    assert {p.doc_id for p in pieces} == set(rows[4])


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        docs = shared.staged(stage(spark, docs, SF), "none")
        assert docs.count() == 0, name


def _run(spark, table, stage, rows):
    made = table([(*r, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept_text string")
    out = stage(spark, made, SF)
    assert out.columns == list(C.COLUMNS)
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def words_of(tag, n=60):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_near_duplicates_row_by_row(spark, table):
    """One row of each group stays: null ids, repeated rows, shared ids, blanks."""
    a, b, c, d = (words_of(x) for x in "abcd")
    rows = [(5, a), (5, a), (8, a + " more"), (None, a), (None, a + " end"),  # one group
            (6, b), (6, c), (9, c + " more"),  # two texts of one id are one node, with what they link
            (None, d), (None, d), (None, d + " more"),  # no id in the group
            (10, None), (11, ""), (11, ""), (None, None), (None, None), (12, "few words")]
    rows = [(i, t, None, "s", None) for i, t in rows]
    got = _run(spark, table, C.near_duplicates, rows)
    texts_of_6 = [t for i, t in got if i == 6]
    assert len(texts_of_6) == 1 and texts_of_6[0] in (b, c)
    no_id = [t for i, t in got if i is None and t]
    assert len(no_id) == 1 and no_id[0] in (d, d + " more")
    rest = [(i, t) for i, t in got if i != 6 and not (i is None and t)]
    assert rest == sorted([(5, a), (10, None), (11, ""), (None, None), (12, "few words")], key=str)


def test_passages_row_by_row(spark, table):
    a, b = words_of("a", 30), words_of("b", 30)
    rows = [(1, a), (2, f"{a} own  words"), (3, a), (None, f"{a} and  {b}"), (None, f"{b} tail"), (4, None), (5, " \n"), (5, "two  words"), (None, None)]
    got = _run(spark, table, C.repeated_passages, [(i, t, "en", "s", 1) for i, t in rows])
    own = [t for i, t in got if i is None and t]
    # of two rows without id one keeps the passage that only they share
    assert sorted(own) in (sorted([f"and {b}", "tail"]), sorted(["and", f"{b} tail"]))
    assert [x for x in got if not (x[0] is None and x[1])] == sorted([(1, a), (2, "own words"), (4, None), (5, " \n"), (5, "two  words"), (None, None)], key=str)


def test_decontamination_row_by_row(spark, table):
    item = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet' ORDER BY length(text) DESC LIMIT 1").fetchall()[0][0]
    rows = [(1, f"before {item} after"), (1, "clean text of the same id"), (None, f"no id {item}"), (None, "clean text without id"), (None, None), (2, ""), (3, item), (3, item)]
    got = _run(spark, table, C.benchmark_decontamination, [(i, t, "en", "s", 1) for i, t in rows])
    assert got == sorted([(1, "clean text of the same id"), (None, "clean text without id"), (None, None), (2, "")], key=str)


def test_quality_and_packing_keep_rows(spark, table):
    rows = [(1, "x", "en", "s", 1), (None, "x", None, None, None), (1, "x", "en", "s", 1), (2, None, None, None, None)]
    made = table(rows, "doc_id long, text string, lang string, source string, n_chars long")
    pieces = C.packing_stage(spark, made, SF).collect()
    assert sorted(((p.doc_id, p.doc_tokens) for p in pieces), key=str) == sorted([(1, 2), (1, 2), (None, 2), (2, 1)], key=str)
    kept = _run(spark, table, C.quality_classifier, rows)
    assert len({(i is None, t) for i, t in kept}) <= 3 and kept == sorted(kept, key=str)


def test_stages_that_end_in_python_write_small_batches(spark, batch_sizes):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    C.quality_classifier(spark, docs, SF)
    C.repeated_passages(spark, docs, SF)
    assert max(batch_sizes["scored"], batch_sizes["cut"]) <= 8 << 20
