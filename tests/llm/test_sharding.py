import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from driftspark.llm import sharding as S


@pytest.mark.parametrize("n, bits", [(2, 4), (3, 3)])
def test_curve_visits_every_cell_by_single_steps(spark, n, bits):
    dims = [F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for i in range(n)]
    rows = spark.range(1 << (n * bits)).select(*[d.alias(f"d{i}") for i, d in enumerate(dims)], S.hilbert(dims, bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << (n * bits)))
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def test_rows_law(table):
    rows = [(i if i % 17 else None, None if i % 13 == 0 else f"text {i % 60}é", "en" if i % 2 else None, f"s{i % 3}") for i in range(203)] * 2
    got = S.shard_rows(table(rows, "doc_id long, text string, lang string, source string")).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {len(v) for v in slots.values()} == {25, 26}
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)
    runs = [r.text_crc32 for i, r in enumerate(order) if not i or order[i - 1].text_crc32 != r.text_crc32]
    assert len(runs) == len(set(runs))  # equal texts lie next to each other


def test_few_rows_and_none(table):
    schema = "doc_id long, text string, lang string, source string, curve string, size string"
    got = S.shard_rows(table([(1, "a", "x", "y", "c", "d"), (2, "b", "x", "y", "c", "d")], schema)).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (1, 0)]
    assert S.shard_rows(table([], schema)).count() == 0


def test_codes_keep_order_and_share_rows_evenly(table):
    rng = random.Random(5)
    values = [None] * 50 + ["en"] * 700 + [f"s{rng.randrange(3000):04d}" for _ in range(2250)]
    rows = table([(v,) for v in values], "v string").select(S.sortable(F.col("v")).alias("v"))
    got = rows.select("v", S.code_of(F.col("v"), S.first_values(rows, ["v"])[0]).alias("c")).collect()
    by = sorted({(r.v, r.c) for r in got})
    below = Counter(r.v for r in got)
    assert len(by) == len(below) and [c for _, c in by] == sorted(c for _, c in by)
    done = 0
    for v, c in by:
        assert c == 256 * done // len(values)
        done += below[v]
    sizes = table([(9,), (10,), (100,), (1 << 40,), (None,)], "v long").orderBy(S.sortable(F.col("v"), True)).collect()
    assert [r.v for r in sizes] == [None, 9, 10, 100, 1 << 40]


def test_shards_are_skipped_by_the_range_of_each_dimension(table):
    """Rows of four languages (one of half the rows), twenty sources and three orders of size: a
    reader of one value opens the shards whose smallest and largest value enclose it."""
    rng = random.Random(11)
    rows = [(i, "x" * int(10 ** rng.uniform(1, 3)) + str(i), rng.choice(["de", "en", "en", "en", "es", "fr"]), f"src{rng.randrange(20):02d}") for i in range(3000)]
    got = {r.doc_id: r for r in S.shard_rows(table(rows, "doc_id long, text string, lang string, source string")).collect()}
    opened = {}
    for name, of in (("lang", lambda r: r[2]), ("source", lambda r: r[3]), ("size", lambda r: len(r[1]))):
        held = defaultdict(list)
        for r in rows:
            held[got[r[0]].shard].append(of(r))
        spans = [(min(v), max(v)) for v in held.values()]
        asked = sorted(of(r) for r in rows)[::100]
        opened[name] = sum(sum(lo <= v <= hi for lo, hi in spans) for v in asked) / len(asked)
    print(opened)
    assert all(n <= 10 for n in opened.values()), opened
