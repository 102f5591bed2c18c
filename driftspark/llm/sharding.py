"""Sharding along a Hilbert curve, in DataFrame functions only.

Several metadata dimensions (categories and the size) are quantised to BITS bits each: a value's
code is the share of rows with smaller values, so codes keep the order of values and every
step of a code holds about as many rows as any other. Their point's place on the Hilbert curve (Skilling's
transform) orders the rows, and the order is cut into runs, one per shard. Rows near in all
dimensions so share a shard, and a reader prunes shards by the smallest and largest value of
any of them (16 shards and three dimensions: each is halved once or twice).

Codes come from counts per distinct value and running sums on range partitions, so neither a
hot value nor a dimension with millions of values is in one task; what rows look up is at
most 2^BITS first values a dimension.

Equal texts are one group: they take the point of the group's first row, so copies lie
next to each other and a cut divides a group only where the law of equal counts makes it.
The order is exact: a range shuffle on (place, text hash, id) deals rows out, each row's
number inside its range is written with it, and range totals (a row per range) give the
global number. No group, source or curve cell is held by one task.

Law ``rows``: counts of shards are at most one apart. Defined results: null text has size 1
and the check sum of an empty text; null dimensions are a value of their own, before all others; repeated rows
get slots each; with fewer rows than shards the first shards get one each; an empty table
gives an empty one. Columns other than the named ones are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm import shared
from driftspark.operators import ranks

BITS = 8


def sortable(value: Column, number: bool = False) -> Column:
    """A text that orders as the value does (numbers: not negative), null first."""
    text = F.lpad(value.cast("string"), 19, "0") if number else value.cast("string")
    return F.coalesce(F.concat(F.lit("1"), text), F.lit("0"))


def first_values(rows: DataFrame, names: list[str], bits: int = BITS) -> list[list[tuple[str, int]]]:
    """Per dimension the smallest value of each code in use, (value, code) in ascending order: at
    most 2^bits entries whatever the number of rows. A code is floor(2^bits x share of rows before)."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(c).alias("value")) for i, c in enumerate(names)])).alias("c")
    counts = rows.select(cells).groupBy("c.dim", "c.value").agg(F.count(F.lit(1)).alias("n"))
    run = ranks.cumulative(counts, ["dim"], "value", ["n"])
    code = F.floor((F.col("cum_n") - F.col("n")) / F.col("tot_n") * (1 << bits)).cast("int")
    firsts = shared.staged(run.groupBy("dim", code.alias("code")).agg(F.min("value").alias("value")), "codes")
    found = sorted((r.dim, r.value, r.code) for r in firsts.collect())
    return [[(value, code) for dim, value, code in found if dim == i] for i in range(len(names))]


def code_of(value: Column, firsts: list[tuple[str, int]], bits: int = BITS) -> Column:
    """The code of a value: a binary search for the last first value that is not larger."""
    if not firsts:
        return F.lit(0)
    values, codes = (F.array(*[F.lit(x) for x in xs]) for xs in zip(*firsts))
    steps = F.array(*[F.lit(1 << b) for b in range(bits, -1, -1)])
    at = F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.get(values, i + s - 1) <= value, i + s).otherwise(i))
    return F.get(codes, at - 1)


def hilbert(dimensions: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of the point with these ``bits``-bit coordinates."""
    n = len(dimensions)
    top = 1 << (bits - 1)

    def turn(x: Column, step: Column) -> Column:
        q = F.element_at(F.array(*[F.lit(top >> b) for b in range(bits)]), (step / n).cast("int") + 1)
        i, p = step % n, q - 1
        own, first = F.element_at(x, i + 1), F.element_at(x, 1)
        swap = first.bitwiseXOR(own).bitwiseAND(p)
        return F.when(own.bitwiseAND(q) != 0, F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(p)).otherwise(v))).otherwise(
            F.transform(x, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v)))

    turned = F.aggregate(F.sequence(F.lit(0), F.lit((bits - 1) * n - 1)), F.array(*dimensions), turn)
    gray = F.transform(turned, lambda v, j: F.aggregate(F.slice(turned, 1, j + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))

    def finished(x: Column) -> Column:
        last = F.element_at(x, n)
        flip = F.aggregate(F.array(*[F.lit(top >> b) for b in range(bits - 1)]), F.lit(0),
                           lambda a, q: F.when(last.bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a))

        def bit(b: int) -> Column:
            return F.transform(x, lambda v: F.shiftright(v.bitwiseXOR(flip), b).bitwiseAND(F.lit(1)))

        digits = F.flatten(F.array(*[bit(b) for b in range(bits - 1, -1, -1)]))
        return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 2 + d)

    return F.element_at(F.transform(F.array(gray), finished), 1)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``rank``: each row's exact number from 0 in the order of the columns."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    serial = F.monotonically_increasing_id()
    ranged = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_s", serial)
              .withColumn("_range", F.shiftright("_s", 33)).withColumn("_at", F.col("_s").bitwiseAND(F.lit((1 << 33) - 1))).drop("_s"))
    ranged = shared.staged(ranged, name)
    totals = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range of the shuffle, whatever the number of rows
    bases = F.broadcast(totals.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")))
    return ranged.join(bases, "_range").withColumn("rank", F.col("_base") + F.col("_at")).drop("_range", "_at", "_base")


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
               categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, size, text_crc32, curve, shard, slot) of every row, under the law ``rows``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("copy"),
                       *[sortable(F.col(c)).alias(f"c{i}") for i, c in enumerate(categories)], sortable(size, True).alias(f"c{len(categories)}"))
    rows = shared.staged(rows, "rows")
    names = [f"c{i}" for i in range(len(categories) + 1)]
    point = F.min(F.struct("id", *names)).alias("p")
    codes = [code_of(F.col(f"p.{c}"), f) for c, f in zip(names, first_values(rows, names))]
    groups = rows.groupBy("copy").agg(point).select("copy", hilbert(codes).alias("curve"))
    # written, so that both sides of the join are plain shuffles and a group of copies can be split
    groups = shared.staged(groups, "groups")
    placed = numbered(rows.join(groups, "copy").select("id", "size", "crc", "copy", "curve"), ["curve", "copy", "id", "size"], "curve")
    total = rows.count()
    q, r = total // shards, total % shards
    rank, long = F.col("rank"), r * (q + 1)
    shard = F.when(rank < long, F.floor(rank / (q + 1))).otherwise(r + F.floor((rank - long) / max(q, 1))).cast("int")
    start = F.when(F.col("shard") < r, F.col("shard") * (q + 1)).otherwise(long + (F.col("shard") - r) * q).cast("long")
    return (placed.withColumn("shard", shard).withColumn("slot", rank - start)
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "curve", "shard", "slot"))


def op3_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return shard_rows(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                   F.lit(None).cast("int").alias("grown_shard"), "curve")
