import binascii
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from driftspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute_tree(leaves, fan=2):
    """Root and each leaf's path as (left siblings, right siblings) per level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // fan * fan:a // fan * fan + fan]
            paths[i].append(("".join(run[:a % fan]), "".join(run[a % fan + 1:])))
        level, at = [H(*level[j:j + fan]) for j in range(0, len(level), fan)], [a // fan for a in at]
    return level[0], paths


def brute(rows, fan=2):
    """Rows of op13 by plain recursion."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        groups.setdefault(lang, []).append((doc_id, brute_leaf(doc_id, source, lang, n_chars, text), (source, lang, n_chars, text)))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        below[g] = brute_tree([r[1] for r in groups[g]], fan)
    root, over = brute_tree([below[g][0] for g in langs], fan)
    out = []
    for g, rest in zip(langs, over):
        for (doc_id, leaf, (source, lang, n_chars, text)), path in zip(groups[g], below[g][1]):
            hit = doc_id is not None and binascii.crc32(str(doc_id).encode()) % 7 == 0
            fold = brute_leaf(doc_id, source, lang, None if n_chars is None else n_chars + 1, text) if hit else leaf
            for left, right in path + rest:
                fold = H(left, fold, right)
            out.append((doc_id, leaf, below[g][0], root, H(*(x + y for x, y in path + rest)), fold, fold == root))
    return sorted(out, key=repr)


def query(spark, rows, tmp_path, extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        df = df.withColumn("g", F.lit(1)).withColumn("p", F.lit("x")).withColumn("leaf", F.lit(0)).withColumn("rank", F.lit(0))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = merkle.op13_query(spark, str(tmp_path))
    return sorted(map(tuple, out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_nulls_ties_repeats_and_clashing_names(spark, tmp_path):
    rows = [(i, f"text {i} é", "en" if i % 3 else "de", "s", i) for i in range(40)]
    rows += [(None, None, None, None, None), (None, "x", None, "s", 3), (7, "again", "en", None, None), (7, "again", "en", None, None),
             (99, "", "", "", 0), (100, "word " * 300_000, "zz", "s", 1_500_000), (-5, "ü", "É", "s", 1)]
    got = query(spark, rows, tmp_path, extra=True)
    assert got == brute(rows)
    assert any(not r[-1] for r in got)


def test_empty_table_and_one_row(spark, tmp_path):
    assert query(spark, [], tmp_path / "none") == []
    got = query(spark, [(5, "a", "en", "s", 1)], tmp_path / "one")
    assert got == brute([(5, "a", "en", "s", 1)]) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == H("")


@pytest.mark.parametrize("fan,depth", [(2, 2), (3, 1), (4, 2)])
def test_blocks_and_wider_runs(table, fan, depth):
    """Groups of many blocks, with ragged ends, at several widths."""
    rows = [(i, str(i % 11), "abcd"[min(i % 7, 3)], "s", i) for i in range(150)]
    docs = table(rows, SCHEMA)
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    m = merkle.manifest(docs, "doc_id", "lang", [F.col(c) for c in names], fan=fan, depth=depth)
    got = m.select("id", "leaf", "subroot", "root", merkle.digest(merkle.proof(F.col("path"))), merkle.fold(F.col("path"), F.col("leaf"))).collect()
    want = {r[0]: r for r in brute(rows, fan)}
    assert len(got) == 150 and all(tuple(r)[:5] == want[r.id][:5] and r[5] == r.root for r in got)


def test_a_hot_group_is_dealt_over_blocks(table):
    """No window partition holds a group: its block is part of the key."""
    docs = table([(i, "same", "en", "s", 4) for i in range(64)], SCHEMA)
    nodes = docs.select(F.lit("g").alias("g"), F.lit(64).cast("long").alias("n"), F.col("doc_id").alias("p"), F.lit("00").alias("h"))
    blocks = merkle._block(nodes, 2, 3)
    assert blocks.groupBy("block").count().where("count = 8").count() == 8
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
