import random

import pytest

from driftspark.llm import substring_dedup as S


def brute(rows, n=13):
    parts = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in parts:
        for i in range(len(w) - n + 1):
            key = tuple(w[i:i + n])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in parts:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < d:
                gone[i:i + n] = [True] * n
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, table, monkeypatch, seed):
    monkeypatch.setattr(S, "PIECE_WORDS", 500)
    rng = random.Random(seed)
    passages = [" ".join(f"p{rng.randint(0, 99)}" for _ in range(rng.randint(10, 40))) for _ in range(4)]
    rows = []
    for i in range(120):
        own = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(0, 30))) for _ in range(3)]
        text = " ".join([own[0], rng.choice(passages), own[1], rng.choice(passages + [""]), own[2]])
        rows.append((i * 7 % 120, rng.choice([text, text, text.upper(), "same words " * 20, None, passages[0], "é\t\n" + text])))
    got = S.substring_dedup(table(rows, "doc_id long, text string", 5)).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_edges(table):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(3, long, 1, "x"), (1, long, 2, "x"), (None, long, 3, "x"), (2, None, 4, "x"), (5, "", 5, "x"), (1, long, 2, "x"), (9, "a " * 13, 6, "x")]
    out = S.substring_dedup(table(rows, "doc_id long, text string, n_words int, marks string"))
    assert out.columns == ["doc_id", "text", "marks", "kept_text", "n_words", "n_removed"]
    got = sorted(((r.doc_id or 99, r.n_words, r.n_removed) for r in out.collect()))
    assert got == [(1, 5000, 0), (1, 5000, 0), (2, 0, 0), (3, 5000, 5000), (5, 0, 0), (9, 13, 0), (99, 5000, 5000)]
    assert S.substring_dedup(table([], "doc_id long, text string")).count() == 0


def test_texts_go_to_workers_in_small_batches(spark, batch_sizes, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(40))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in S.op8_query(spark, str(tmp_path)).collect()}
    assert got == {i: (40, 40 * (i % 2)) for i in range(60)}
    assert {batch_sizes[x] <= 8 << 20 for x in ("anchors", "repeats", "digests")} == {True}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_a_piece_goes_before_the_next_is_built(peak_bytes):
    """Sending blocks and probes takes memory by the piece, and not of two pieces at a time."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9999, 500)) for _ in range(7000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 500), pa.int64()), pa.array(texts[a:a + 500])], names=["k", "t"]) for a in range(0, 7000, 500)]
    list(S._anchors(7, 4)(batches[:1]))  # tables of powers are kept
    assert peak_bytes(S._anchors(7, 4)(batches)) < 100 * S.PIECE_WORDS
