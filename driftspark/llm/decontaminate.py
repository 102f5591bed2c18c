"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

Words are lower-cased runs between white space (0x20, 0x09-0x0D); shingles are 5 words. A document leaks an
item if a window of the item's number of words (or the whole document, where it is shorter)
has a weighted Jaccard similarity of at least 0.75 to it: the sum of the smaller counts of
each shingle over the sum of the larger.

1. Positions of every document whose shingle is some item's. Windows below are placed where
   these are dense enough: with all other positions counted as misses, a window with fewer
   than 6/7 of its shingles among them cannot reach the bound. No window that could is left
   out, and none is made elsewhere.
2. SimHash. Each window and item gets a 60-bit fingerprint of its words: five 12-bit lanes
   in each of 12 integers count the words' hash bits, and the majority decides. Items of
   more than PART words and their windows take two 30-bit lanes in each of 30 integers.
3. Multi-index search. With four blocks of 15 bits, fingerprints within RADIUS = 15 agree in
   some block up to 3 bits. The index holds all values within 3 bits of each item's blocks
   (2304 rows an item), so an equality join finds every fingerprint within the radius.
4. Exact similarity of the candidates decides. RADIUS is above three standard deviations for
   copies with 6 % of words changed and above two at the bound itself.

The item index and the item shingles are broadcast only under a counted bound; beyond it
the same joins are shuffled. An item of any length is searched and judged as a whole; the
work on a document that holds it grows with the square of the item's length.

Defined results: null texts and texts or items of fewer than 5 words match nothing; rows
that repeat an id are searched each, and give one row per id and item; a null id is kept;
ties go to the first window; extra columns are not carried; empty tables give no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.llm import shared

SIZE, PART, RADIUS = 5, 1000, 15
LANES, LANE, LONGS = 5, 12, 12
WIDE = 2, 30, 30  # lanes for texts of more than PART words
BLOCKS, BLOCK_BITS, NEAR = 4, 15, 3


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def shingles(words: str) -> Column:
    """Hashes of all 5-word runs of an array column of at least 5 words."""
    at = ", ".join(f"{words}[i + {k}]" for k in range(SIZE))
    return F.expr(f"transform(sequence(0, size({words}) - {SIZE}), i -> xxhash64({at}))")


def _hashed(words: str) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x)).alias(words)


def fingerprints(rows: DataFrame, keys: list[str], words: Column, lanes: int = LANES, lane: int = LANE, longs: int = LONGS) -> DataFrame:
    """SimHash of an array of words per row: a bit is set where more than half of the words
    set it. ``keys`` tell rows apart and are what stays, with ``fp``."""
    ones = sum(1 << (lane * i) for i in range(lanes))
    top = (1 << (lane - 1)) - 1
    each = rows.select(*keys, F.explode(words).alias("_w"))
    sums = [F.sum(F.xxhash64("_w", F.lit(k)).bitwiseAND(F.lit(ones))).alias(f"_x{k}") for k in range(longs)]
    counted = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *sums)
    bits = []
    for k in range(longs):
        over = F.col(f"_x{k}") + F.lit(ones) * (top - F.floor(F.col("_n") / 2))
        bits += [F.shiftright(over, lane * (i + 1) - 1).bitwiseAND(F.lit(1)) * (1 << (lanes * k + i)) for i in range(lanes)]
    return counted.select(*keys, sum(bits[1:], bits[0]).alias("fp"))


def _by_length(rows: DataFrame, keys: list[str], words: Column, sizes: list[int]) -> DataFrame:
    """Fingerprints of items or windows in lanes that hold their item's ``size``."""
    out = fingerprints(rows.where(F.col("size") <= PART), keys, words)
    return out.unionByName(fingerprints(rows.where(F.col("size") > PART), keys, words, *WIDE)) if max(sizes, default=0) > PART else out


def block_value(fp: str, b: int) -> Column:
    return F.shiftright(F.col(fp), b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def near_masks() -> list[int]:
    """All differences of a block in at most NEAR bits."""
    return [sum(1 << i for i in c) for k in range(NEAR + 1) for c in combinations(range(BLOCK_BITS), k)]


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, start, words, similarity): the best window of each document and item."""
    parts = items.select(F.col(item_id).alias("item"), word_array(F.col(item_text)).alias("w"))
    # rows that repeat an item are one; two texts of one id are told apart by their hash
    parts = parts.where(F.size("w") >= SIZE).withColumn("text", F.xxhash64("w")).dropDuplicates(["item", "text"])
    parts = shared.staged(parts.select("item", "text", _hashed("w"), F.size("w").alias("size"), shingles("w").alias("shingles")), "items")
    sizes = [r["size"] for r in parts.select("size").distinct().collect()]  # one number per length
    marked = _by_length(parts, ["item", "text", "size"], F.col("w"), sizes)

    known = parts.select(F.explode("shingles").alias("h")).distinct()
    known = F.broadcast(known) if shared.small(known) else known
    key = F.xxhash64(F.col(id_col), F.col(text_col)).alias("key")
    rows = docs.select(key, word_array(F.col(text_col)).alias("w")).where(F.size("w") >= SIZE)
    hits = rows.select("key", F.posexplode(shingles("w")).alias("p", "h")).join(known, "h")
    hits = shared.staged(hits.groupBy("key").agg(F.sort_array(F.collect_set("p")).alias("hits")), "hits")

    source = docs.select(F.col(id_col).alias("id"), key, F.col(text_col).alias("text"))
    near = shared.on_ids(source, hits, "key", "left_semi").join(hits, "key").select("id", "key", "hits", word_array(F.col("text")).alias("w")).dropDuplicates(["key"])
    near = near.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    near = shared.staged(near.select("id", "key", "hits", _hashed("w"), shingles("w").alias("shingles")), "near")

    spans = near.select("key", "w", F.explode(_spans(sizes)).alias("x")).select("key", "w", "x.size", "x.words", F.explode("x.starts").alias("start"))
    window = _by_length(spans, ["key", "size", "words", "start"], F.expr("slice(w, start + 1, words)"), sizes)
    blocks = F.array(*[F.struct(F.lit(b).alias("b"), block_value("fp", b).alias("v")) for b in range(BLOCKS)])
    index = marked.select("item", "text", "size", F.col("fp").alias("item_fp"), F.explode(blocks).alias("x"))
    index = index.select("item", "text", "size", "item_fp", "x.b", F.explode(F.transform(F.array(*map(F.lit, near_masks())), lambda m: F.col("x.v").bitwiseXOR(m))).alias("v"))
    index = shared.staged(index, "index")
    probes = window.withColumn("x", F.explode(blocks)).select("key", "size", "words", "start", "fp", "x.b", "x.v")
    met = probes.join(F.broadcast(index) if shared.small(index) else index, ["size", "b", "v"])
    met = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    # a pair that meets in several blocks goes on from the first of them
    first = F.coalesce(*[F.when(F.bit_count(block_value("fp", b).bitwiseXOR(block_value("item_fp", b))) <= NEAR, F.lit(b)) for b in range(BLOCKS)])
    met = shared.staged(met.where(F.col("b") == first).select("key", "start", "words", "item", "text"), "candidates")

    texts = parts.select("item", "text", F.col("shingles").alias("its"))
    light = shared.small(texts, 20_000) and (parts.agg(F.sum("size")).first()[0] or 0) <= 20_000 * PART
    met = met.join(F.broadcast(texts) if light else texts, ["item", "text"])
    met = met.join(near.select("id", "key", "shingles"), "key").select("id", "item", "start", "words", "its", F.expr("slice(shingles, start + 1, words - 4)").alias("ws"))
    once = lambda c: F.size(F.array_distinct(c)) == F.size(c)
    count = lambda a, v: F.size(F.filter(a, lambda y: y == v))
    counted = F.aggregate(F.array_distinct("ws"), F.lit(0), lambda a, v: a + F.least(count(F.col("ws"), v), count(F.col("its"), v)))
    both = F.when(once("ws") | once("its"), F.size(F.array_intersect("ws", "its"))).otherwise(counted)
    met = met.withColumn("both", both).where("4 * both >= 3 * (size(ws) + size(its) - both)")
    found = F.col("both") / (F.size("ws") + F.size("its") - F.col("both"))
    best = met.groupBy("id", "item").agg(F.min(F.struct((-found).alias("s"), "start", "words")).alias("x"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "x.start", "x.words", F.round(-F.col("x.s"), 9).alias("similarity"))


def _spans(sizes: list[int]) -> Column:
    """For each item size, the starts of windows dense in hits: at a hit (or as late as the text
    allows), with enough further hits inside."""
    table = F.array(*[F.struct(F.lit(n).alias("size"), F.lit(n - SIZE + 1).alias("s")) for n in sorted(sizes)]) if sizes else F.array().cast("array<struct<size:int,s:int>>")
    sized = F.transform(table, lambda x: F.struct(x.size.alias("size"), F.least(x.size, F.size("w")).alias("words"),
                                                  F.least(x.s, F.size("w") - (SIZE - 1)).alias("s"),
                                                  F.when(F.size("w") >= x.size, F.ceil(x.s * 6 / 7)).otherwise(F.ceil(x.s * 3 / 4)).cast("int").alias("need")))
    sized = F.filter(sized, lambda x: (x.need <= x.s) & (F.size("hits") >= x.need))

    def starts(x: Column) -> Column:
        def from_hit(k: Column) -> Column:
            start = F.least(F.col("hits")[k], F.size("w") - x.words)
            return F.when(F.col("hits")[k + x.need - 1] < start + x.s, start)

        found = F.transform(F.sequence(F.lit(0), F.size("hits") - x.need), from_hit)
        return F.array_distinct(F.filter(found, lambda st: st.isNotNull()))

    return F.transform(sized, lambda x: F.struct(x.size.alias("size"), x.words.alias("words"), starts(x).alias("starts")))


def op4_query(spark, sf_dir: str) -> DataFrame:
    path = sf_dir.rstrip("/")
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text"))
