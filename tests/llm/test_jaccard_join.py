import random
from collections import defaultdict

import numpy as np
import pytest

from driftspark.llm import jaccard_join as J
from driftspark.llm import words
from driftspark.llm.components import components


def brute(rows):
    sets, root = {}, {}
    for d, t in rows:
        b = bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode()).split()
        sets[d] = frozenset([tuple(b)] if 0 < len(b) < 5 else [tuple(b[i:i + 5]) for i in range(len(b) - 4)])
        root[d] = d

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    post = defaultdict(list)
    for d in sorted(sets):
        seen = {o for s in sets[d] for o in post[s]}
        for s in sets[d]:
            post[s].append(d)
        for o in seen:
            both = len(sets[d] & sets[o])
            if 100 * both >= 75 * (len(sets[d]) + len(sets[o]) - both):
                a, b = sorted((find(d), find(o)))
                root[b] = a
    return sorted((d, len(sets[d]), find(d)) for d in sets)


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(table, monkeypatch, seed):
    """Small bounds, so that lists are cut, salted, left open and multiplied in many tiles."""
    for name, value in (("PIECE", 8), ("SALT_DF", 16), ("FREQUENT", 300), ("GROUP_SHINGLES", 300), ("GROUP_MEMBERS", 4), ("TILE", 6), ("TILE_SHINGLES", 300)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(seed)
    common = [" ".join(f"c{rng.randint(0, 999)}" for _ in range(rng.randint(5, 30))) for _ in range(4)]
    base = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(1, 60))) for _ in range(25)]
    rows = []
    for i in range(260):
        t = rng.choice(base).split() if rng.random() < 0.8 else common[0].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            t[rng.randrange(len(t))] = f"z{rng.randint(0, 50)}"
        t = " ".join(t) + (" " + rng.choice(common) if rng.random() < 0.3 else "")
        rows.append((i, rng.choice([t, t, t, t.upper(), None if rng.random() < 0.1 else t])))
    got = J.jaccard_components(table(rows, "doc_id long, text string", 5)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_edges(table):
    long = " ".join(f"w{i}" for i in range(20000))
    rows = [(7, long, 1), (4, long + " end", 2), (5, None, 3), (6, "", 4), (2, " \t\n", 5), (8, "few words", 6), (9, "FEW  words", 7), (8, "few words", 6),
            (None, "few words", 8)]
    got = J.jaccard_components(table(rows, "doc_id long, text string, component_id int")).collect()
    want = [(2, 0, 2), (4, 19997, 4), (5, 0, 5), (6, 0, 6), (7, 19996, 4), (8, 1, 8), (8, 1, 8), (9, 1, 8), (99, 1, 8)]
    assert sorted((r.doc_id or 99, r.n_shingles, r.component_id) for r in got) == want
    assert J.jaccard_components(table([], "doc_id long, text string")).count() == 0


def test_rows_that_share_an_id(table):
    """A node's texts link for it, also those that are copies; rows without id are nodes each."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, b + " more"), (7, a), (7, b), (None, a), (None, c), (9, c + " more"), (None, "alone here without any id"), (None, "alone here  WITHOUT any id")]
    got = J.jaccard_components(table(rows, "doc_id long, text string")).collect()
    want = [(1, 56, 1), (2, 57, 1), (7, 56, 1), (7, 56, 1), (9, 57, 9), (None, 1, None), (None, 1, None), (None, 56, 1), (None, 56, 9)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_salted_columns_are_compared_whole(table, monkeypatch, spark):
    """Equal shares of a column in one group do not make the columns equal."""
    def payload(lists):
        docs = sorted({d for m in lists.values() for d in m})
        value = np.sort(np.array([e << 16 | docs.index(d) for e, m in lists.items() for d in m], dtype=np.uint64))
        key = np.array(docs)
        return words.pack(value, np.diff(key, prepend=0), np.full(len(docs), 10, np.uint32))

    import pyarrow as pa
    parts = [J._columns(1)(pa.table({"block": pa.array([salt], pa.int32()), "payload": pa.array([payload(x)], pa.binary())}))
             for salt, x in ((1, {101: [1, 2], 102: [1, 2], 103: [1, 2]}), (2, {101: [4], 102: [4, 6], 103: [4]}))]
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    out = J._whole_columns(spark.createDataFrame(rows, J._LISTED)).collect()
    runs = {}
    for r in out:
        runs.setdefault(r.run, set()).update(r.members)
    assert runs == {101: {1, 2, 4}, 102: {1, 2, 4, 6}}  # 103 equals 101


def test_threshold_is_exact(table):
    """7 of 9 shingles is above the bound, 6 of 8 on it, 5 of 7 below."""
    def pair(shared, extra):
        head = [f"s{i}" for i in range(shared + 4)]
        return " ".join(head), " ".join(head + [f"e{i}" for i in range(extra)])

    rows = [(i * 10 + k, f"{i} ".join(t.split()) + f"{i}") for i, (s, e) in enumerate([(7, 2), (6, 2), (5, 2)]) for k, t in enumerate(pair(s, e))]
    got = {r.doc_id: r.component_id for r in J.jaccard_components(table(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 10: 10, 11: 10, 20: 20, 21: 21}


def test_overlap_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (1, 40, 80, 200, 200)]
    got = J.overlap_counts([words.pack(s) for s in sets], [words.pack(s) for s in sets[1:]], step=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets]


def test_components_of_a_chain(spark):
    links = spark.range(1, 60).selectExpr("id as a", "id - 1 as b").union(spark.createDataFrame([(100, 101), (5, 5)], "a long, b long"))
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(60)}, 100: 100, 101: 100}


def test_components_follow_hooks_once(spark, monkeypatch):
    from driftspark.llm import shared

    names, real = [], shared.staged
    monkeypatch.setattr(shared, "staged", lambda df, name: names.append(name) or real(df, name))
    links = spark.range(1, 60).selectExpr("id as a", "id - 1 as b")
    assert {r.component for r in components(links).collect()} == {0}
    assert names.count("hooks") > 1 and names.count("labels") == 1
    assert components(links.where("a < 0")).collect() == []


@pytest.fixture
def linked(monkeypatch):
    """The number of links of each call of ``components``."""
    seen = []
    monkeypatch.setattr(J, "components", lambda links: seen.append(links.count()) or components(links))
    return seen


def test_lists_that_close_take_one_search_of_components(table, linked):
    rows = [(i, " ".join(f"w{i // 3}x{j}" for j in range(40)) + f" end{i}") for i in range(30)]
    got = J.jaccard_components(table(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert len(linked) == 1


def test_open_lists_link_components_alone(table, linked, monkeypatch):
    """Shingles that 50 and 51 share are also in smaller ids, the hubs, which link with neither."""
    monkeypatch.setattr(J, "FREQUENT", 0)
    passage = [f"p{j}" for j in range(40)]
    rows = [(k, " ".join(passage[k % 15:k % 15 + 26] + [f"f{k}x{j}" for j in range(14)])) for k in range(45)]
    rows += [(k, " ".join([*passage, f"end{k}"])) for k in (50, 51)]
    rows += [(i, " ".join(f"w{i // 2}x{j}" for j in range(40)) + f" end{i}") for i in range(60, 70)]
    got = J.jaccard_components(table(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert linked == [5, 1]


def test_texts_go_to_workers_in_small_batches(spark, table, batch_sizes):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(40)) + f" end{i}") for i in range(60)]
    out = J.jaccard_components(table(rows, "doc_id long, text string"))
    assert sorted(r.component_id for r in out.collect()) == [i // 2 * 2 for i in range(60)]
    assert {batch_sizes[x] <= 8 << 20 for x in ("sets", "counts", "lists", "linked", "across")} == {True}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_counting_shingles_takes_few_bytes_each(peak_bytes):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9999, 500)) for _ in range(8500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 500), pa.int64()), pa.array(texts[a:a + 500])], names=["k", "t"]) for a in range(0, 8500, 500)]
    list(J._counted(4)(batches[:1]))  # tables of powers are kept
    assert peak_bytes(J._counted(4)(batches)) < 45 * 2 * J.PIECE_ENTRIES


@pytest.fixture
def staged_rows(monkeypatch):
    """Rows of the staged tables by name."""
    from driftspark.llm import shared

    seen, real = defaultdict(int), shared.staged

    def staged(df, name):
        out = real(df, name)
        seen[name] += out.count()
        return out

    monkeypatch.setattr(shared, "staged", staged)
    return seen


def test_texts_that_meet_by_chance_are_not_compared(table, monkeypatch, staged_rows):
    """Each text shares a shingle with a few others and links with none but its near copy."""
    monkeypatch.setattr(J, "FREQUENT", 0)
    rng = random.Random(5)
    phrases = [" ".join(f"p{i}x{j}" for j in range(5)) for i in range(60)]
    rows = [(i, " ".join(x for k in range(8) for x in (rng.choice(phrases), *(f"w{i}x{k}x{j}" for j in range(5))))) for i in range(200)]
    rows += [(1000 + i, t + " end") for i, t in rows[:20]]
    got = J.jaccard_components(table(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert staged_rows["lists"] > 40
    assert staged_rows["pairs"] == 20 and staged_rows["open"] == 0


@pytest.mark.parametrize("paired", [2, 3, 8, 64])
def test_short_and_long_lists_against_brute_force(table, monkeypatch, paired):
    """Near copies around the threshold, of which some share an id, some meet in long lists too."""
    monkeypatch.setattr(J, "PAIRED", paired)
    monkeypatch.setattr(J, "FREQUENT", 0)
    rng = random.Random(paired)
    base = [[f"b{i}x{j}" for j in range(rng.randint(12, 70))] for i in range(12)]
    rows = []
    for i in range(240):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            t[rng.randrange(len(t))] = f"z{rng.randint(0, 500)}"
        t = t[rng.choice([0, 0, 1, 4]):] + ([f"c{j}" for j in range(12)] if rng.random() < 0.3 else [])
        rows.append((i, " ".join(t)))
    got = J.jaccard_components(table(rows, "doc_id long, text string", 5)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_linked_sets_share_as_many_first_shingles(spark):
    """With as few shingles in common as link sets of these sizes."""
    rng, cases = random.Random(2), []
    for _ in range(300):
        n = rng.randint(1, 60)
        m = rng.randint(-(-3 * n // 4), 4 * n // 3)
        k = -(-3 * (n + m) // 7)
        union = rng.sample(range(1000), n + m - k)
        x, y = (set(sorted(s)[:len(s) // 4 + 1]) for s in (union[:n], union[n - k:]))
        cases.append((n, m, len(x & y)))
    got = spark.createDataFrame(cases, "n int, m int, shared int").select(J.least_shared("n", "m").alias("need"), "shared").collect()
    assert all(1 <= r.need <= r.shared for r in got)
    assert any(r.need == r.shared for r in got) and max(r.need for r in got) > 5


def test_entries_of_a_block_name_their_documents_alone():
    """Bytes sent follow the entries, not the documents times the blocks; the lists stay the same."""
    import types

    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(20, 60))) + (" common words of many texts here" if i % 3 else "") for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(rng.integers(0, 1 << 62, 3000), pa.int64()), pa.array(texts)], names=["k", "t"])
    none = types.SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0, np.int32)))
    size, lists = {}, {}
    for blocks in (4, 400):
        sent = pa.Table.from_batches(list(J._prefixes(blocks, none)([batch])))
        size[blocks] = sum(len(x) for x in sent["payload"].to_pylist())
        lists[blocks] = set()
        for k in set(sent["block"].to_pylist()):
            rows = J._columns(blocks)(sent.filter(pa.compute.equal(sent["block"], k))).to_pylist()
            lists[blocks] |= {(tuple(r["members"]), tuple(r["sizes"])) for r in rows}
    assert size[400] < 3 * size[4]
    assert lists[400] == lists[4] and len(lists[4]) > 10
