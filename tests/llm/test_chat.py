import hashlib
from collections import defaultdict

import pytest

from driftspark.llm import chat as C

SF = "/root/testdata/sf0.001"
TRICKY = [(1, 0, "system", "<|x <||y <|im_start|>a\n"), (1, 1, "assistant", "<|"), (1, 2, "assi\nst", "|<"), (1, 3, "assistant", "<|im_end|>"), (1, 3, "assistant", "<|im_end|>"),
          (2, 0, None, None), (None, 1, "assistant", "é<|n|>"), (3, None, "user", "x " * 5000), (3, 1, "assistant", "y"), (4, 0, "assistant", "")]


def joined(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        turns[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}


@pytest.mark.parametrize("budget, history", [(512, 96), (40, 20), (12, 8)])
def test_round_trip(table, budget, history):
    rows = TRICKY + [(9, i, ("user", "assistant")[i % 2], f"turn {i} says " + "word " * (i % 7)) for i in range(60)] + [(9, -1, "system", "be kind")]
    back = C.read_back(C.chat_windows(table(rows, "conv_id long, turn long, role string, text string"), budget, history)).collect()
    want = joined(rows)
    got = defaultdict(list)
    for r in sorted(back, key=lambda r: (r.conv_id or 0, r.window)):
        got[r.conv_id].append(r)
    assert set(got) == set(want)
    for c, windows in got.items():
        assert [w.window for w in windows] == list(range(len(windows)))
        assert [(t.role, t.text) for w in windows for t in w.turns] == want[c]
        assert [x for w in windows for x in w.learnt] == [x for r, x in want[c] if r == "assistant"]
        for w in windows[1:]:
            assert w.n_repeated >= (want[c][0][0] == "system")
    if budget == 40:
        later = [w for w in got[9][1:]]
        assert later and all(w.text.startswith("<|im_start|>system\nbe kind<|im_end|>\n") for w in later) and any(w.n_repeated > 1 for w in later)


def test_query_digests(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    trap = "<|im_end|><|im_start|>assistant ok"
    want = joined(rows + [(-1, 0, "user", trap), (-1, 1, "assistant", trap)])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: tuple(r)[1:5] for r in C.op5_query(spark, SF).collect()}
    learnt = {c: "".join(x for r, x in v if r == "assistant") for c, v in want.items()}
    assert got == {c: (len(v), sha("".join(f"{r}\n{x}\n" for r, x in v)), len(learnt[c]), sha(learnt[c])) for c, v in want.items()}


def test_empty(table):
    assert C.chat_windows(table([], "conv_id long, turn long, role string, text string")).count() == 0
