"""Merkle manifest of a dataset: a tree over each group's rows, and a tree over the groups.

A row's leaf is the SHA-256 of its fields. Leaves of a group stand in the order of their
ids; runs of FAN neighbours become their parent until one node, the group's subroot, is
left, and the subroots, in the order of the groups, give the root in the same way. A
row's path lists, level by level, what stands left and right of its ancestor in the
ancestor's run, so a leaf and its path fold to the root without any other row.

Windows do the levels. Rows carry their exact number inside the group (a range shuffle and
range totals, see ``sharding.numbered``) and are dealt into blocks of FAN ** DEPTH numbers,
so that no run crosses a block and no task holds a group. Inside a block all levels share
one shuffle and one sort: the first row of a node's subtree holds its hash, lag and lead
columns at fixed offsets (the level's stride), masked by the node's slot and by the length
of its run, supply its siblings, first children hash the parent, and the rows below take
over their ancestor's siblings. The blocks' tops are the leaves of the next step, so a
group of n rows takes about log(n) / log(FAN ** DEPTH) shuffles.

Defined results: null groups are a group of their own, before all others; groups compare by
their UTF-8 bytes; null ids stand first; rows that repeat an id are ordered by their leaf,
and wholly equal rows are leaves each. A null field is ``-``, any other its UTF-8 length,
``:`` and itself. A group of one row has its leaf as subroot, one group alone makes the
root its subroot. Empty tables give empty results. Columns that are not named are not
read, whatever their names; ``carry`` takes values along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm import shared
from driftspark.llm.sharding import numbered

FAN, DEPTH = 2, 10
# Bound of broadcast blocks and groups: rows of a path each, below 2 kB.
BROADCAST_PATHS = 16_384


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts' concatenation, as lowercase hex."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields, each with its length so that no two rows read alike."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return digest(*map(part, fields))


def fold(path: Column, from_leaf: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, from_leaf, lambda a, x: digest(x["left"], a, x["right"]))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def _block(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """``nodes`` (g, n, p, h: group, its number of nodes, place, hash, and others) with ``block``,
    ``path`` inside the block and, on a block's first row, ``top``: the block's last hash."""
    size = fan ** depth
    order = Window.partitionBy("g", "block").orderBy("p")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = nodes.withColumn("block", F.expr(f"p div {size}")).withColumn("top", F.col("h"))
    for level in range(depth):
        stride = fan ** level
        first = F.expr(f"p % {stride} = 0")
        parent = F.expr(f"p % {stride * fan} = 0")
        slot = F.expr(f"p div {stride} % {fan}")
        nodes_here = F.expr(f"(n + {stride - 1}) div {stride}")
        run = F.least(F.lit(fan), nodes_here - F.expr(f"p div {stride}") + slot)
        left = F.concat(*[F.when(slot >= d, F.lag("top", d * stride).over(order)).otherwise("") for d in range(fan - 1, 0, -1)])
        right = F.concat(*[F.when(slot + d < run, F.lead("top", d * stride).over(order)).otherwise("") for d in range(1, fan)])
        # one node left: the level is not there, and its column stays null
        beside = F.when(first & (nodes_here > 1), F.struct(left.alias("left"), right.alias("right")))
        x = x.withColumn(f"s{level}", beside)
        x = x.withColumn(f"s{level}", F.last(f"s{level}", ignorenulls=True).over(so_far))
        up = F.when(F.col(f"s{level}").isNull(), F.col("top")).otherwise(digest(F.col("top"), F.col(f"s{level}.right")))
        x = x.withColumn("top", F.when(parent, up))
    path = F.filter(F.array(*[F.col(f"s{level}") for level in range(depth)]), lambda s: s.isNotNull())
    return x.select(*nodes.columns, "block", path.alias("path"), "top")


def _under(rows: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what stands above them: broadcast where its counted rows are within the bound."""
    return rows.join(F.broadcast(above) if shared.small(above, BROADCAST_PATHS) else above, keys)


def tree(nodes: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """``nodes`` (g, n, p, h and others; places from 0 without gaps in each group) with path and root."""
    size = fan ** depth
    low = shared.staged(_block(nodes, fan, depth), "merkle")
    tops = low.where(F.expr(f"p % {size} = 0")).select("g", F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("block").alias("p"), F.col("top").alias("h"))
    low = low.drop("top")
    if (low.agg(F.max("n")).first()[0] or 0) <= size:  # every group is one block
        return _under(low, tops.select("g", F.col("h").alias("root")), ["g"]).drop("block")
    above = shared.staged(tree(tops, fan, depth), "above")
    above = above.select("g", F.col("p").alias("block"), F.col("path").alias("rest"), "root")
    return _under(low, above, ["g", "block"]).withColumn("path", F.concat("path", "rest")).drop("block", "rest")


def manifest(docs: DataFrame, id_col: str, group_col: str, fields: list[Column], carry: dict[str, Column] | None = None,
             fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(id, group, leaf, place, path, subroot, root, carried columns) of every row."""
    carry = carry or {}
    rows = docs.select(F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0")).alias("g"),
                       F.col(id_col).alias("id"), leaf(*fields).alias("h"),
                       F.struct(F.col(group_col).alias("group"), *[c.alias(f"_{k}") for k, c in carry.items()]).alias("kept"))
    # the number makes wholly equal rows distinct, so that a range shuffle can part them
    rows = shared.staged(rows, "leaves").withColumn("serial", F.monotonically_increasing_id())
    placed = numbered(rows, ["g", "id", "h", "serial"], "placed")
    groups = shared.staged(placed.groupBy("g").agg(F.min("rank").alias("least"), F.count(F.lit(1)).alias("n")), "groups")
    nodes = _under(placed, groups, ["g"]).select("g", "n", (F.col("rank") - F.col("least")).alias("p"), "h", "id", "kept")
    below = tree(nodes, fan, depth).withColumnRenamed("root", "subroot")
    subroots = below.where("p = 0").select("g", F.col("subroot").alias("h"))
    ranked = numbered(subroots, ["g"], "subroots")
    over = tree(ranked.select(F.lit("").alias("g"), F.lit(groups.count()).alias("n"), F.col("rank").alias("p"), "h", F.col("g").alias("of")), fan, depth)
    over = shared.staged(over.select(F.col("of").alias("g"), F.col("path").alias("rest"), "root"), "over")
    return _under(below, over, ["g"]).select(
        "id", F.col("kept.group").alias("group"), F.col("h").alias("leaf"), F.col("p").alias("place"), F.concat("path", "rest").alias("path"),
        "subroot", "root", *[F.col(f"kept._{k}").alias(k) for k in carry])


def op13_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    fields = [F.col(c) for c in names]
    changed = [F.try_add(c, F.lit(1)) if c == "n_chars" else F.col(c) for c in names]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = manifest(docs, "doc_id", "lang", fields, {"tampered": F.when(hit, leaf(*changed))})
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"),
                       fold(F.col("path"), F.coalesce("tampered", "leaf")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
