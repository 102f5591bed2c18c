"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Documents link when their sets of distinct 5-word shingles have a Jaccard similarity of at
least 0.75, decided by the integers ``100 * intersection >= 75 * union``.

1. Sets. One row per document: size and a signature of the set. Equal sets are one node of
   the product, named after its smallest document id.
2. Frequencies. Shingles are counted by 32-bit hash. The most frequent ones (as many as fit
   the documented bound) go last in the order of every set, rarest classes first. Any order
   common to all sets gives exact results; this one keeps passages that many documents share
   out of the blocks.
3. Blocks. With the threshold 0.75, two linked sets share one of the first ``n // 4 + 1``
   shingles in that order. These entries meet in blocks of the hash range. A column of
   the block is the list of documents that hold a shingle; it is cut where sizes leave
   the bound ``min size >= 0.75 * max size``, and equal lists are kept once. A shingle more
   frequent than SALT_DF is dealt over several groups, each with a share of its column:
   equal shares of a group are stored once, but every shingle names its shares, and only
   columns whose shares are equal in all groups count as equal.
4. Counts. Two linked sets share not one of those entries but a number of them that their
   sizes give. So the lists of up to PAIRED members are counted pair by pair, with the number
   of entries that each stands for; a pair that has too few, also if all entries were shared
   that either has in longer lists, cannot link and its texts are not read. Documents
   that meet by chance, whose pairs grow with the square of the table, end here as numbers.
5. Products. Each list is first tested against one hub (its smallest id). Lists that this
   leaves in several components, of short ones the members that still may link with another
   component, are multiplied in tiles of TILE by TILE sets: the product
   of the incidence matrices accumulates all overlaps of a tile, pairs below the bound are
   dropped there, and a tile gives no more links than connect what it found connected. So
   a group of copies costs rows by its members, not by its pairs, and no link between
   components is missed. Sets are recomputed from the texts that take part.

Lists are kept in pieces of PIECE members, so no group is collected into one task.

Defined results: null or blank text has an empty set, linked with nothing, and is its own
component. Rows that share an id are one node, whatever their texts: what one of them links
with, all do. Rows without id are no node together: each of their texts is one, larger than
all ids (ids are taken to be below NO_ID = 2^62), and a component of such rows alone is
null. Very long texts are read piece by piece; an empty table gives an empty one; columns
other than id and text are not carried, so their names may be any. Hashes have 64 bits for
set sizes and for the texts that stand for rows without id, 48 bits inside a pair's overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm import shared, words
from driftspark.llm.components import components

SIZE = 5
NO_ID = 1 << 62  # keys from here on are texts without id
# Bounds: entries of the list of frequent shingles (12 bytes each in a broadcast), input
# bytes a block, entries sent at a time, members of a piece, members of a list whose pairs
# are counted, and postings of a group.
FREQUENT = 1_000_000
BLOCK_BYTES = 18_000_000
PIECE_ENTRIES = 2_000_000
PIECE = 4096
PAIRED = 64
SALT_DF = 1 << 18
GROUP_SHINGLES, GROUP_MEMBERS = 100_000, 128
TILE, TILE_SHINGLES = 256, 200_000
_KEY, _TAG = "_jj_key", "_jj_tag"


def row_key(id_col: str, text_col: str) -> F.Column:
    """A row's node: its id, or where that is null a number of its text beyond all ids."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID))


def row_tag(key: F.Column, text_col: str) -> F.Column:
    """What tells a node's texts apart."""
    return F.xxhash64(key, F.col(text_col))


def doc_sets(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one text after the other, and their numbers."""
    g, row, _ = words.ngrams(h, counts, SIZE)
    starts = np.cumsum(counts) - counts
    for i in np.flatnonzero((counts > 0) & (counts < SIZE)):
        one = np.zeros(1, dtype=np.uint64)
        for x in h[starts[i]:starts[i] + counts[i]]:
            one = one * np.uint64(words.BASE) + x
        at = np.searchsorted(row, i)
        g, row = np.insert(g, at, words.mix(one + np.uint64(counts[i]))), np.insert(row, at, i)
    edge = np.searchsorted(row, np.arange(len(counts) + 1))
    for a, b in zip(edge[:-1], edge[1:]):
        g[a:b].sort()
    first = np.ones(len(g), dtype=bool)
    first[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[first], np.diff(np.concatenate([[0], np.cumsum(first)])[edge])


def _sets(batch, keys: int = 0, texts: int = 1):
    """(keys, shingles, sizes) of each slice of a batch."""
    key = batch.column(keys).to_numpy(zero_copy_only=False)
    for lo, hi, data, offsets in words.slices(batch.column(texts)):
        g, n = doc_sets(*words.text_hashes(data, offsets, lower=True))
        yield lo, hi, key[lo:hi], g, n


def _summaries(batches):
    for batch in batches:
        for lo, hi, _, g, n in _sets(batch):
            total = np.concatenate([[np.uint64(0)], np.cumsum(words.mix(g), dtype=np.uint64)])
            end = np.cumsum(n)
            sig = words.mix((total[end] - total[end - n]) ^ n.astype(np.uint64)).view(np.int64)
            rest = [batch.column(i).slice(lo, hi - lo) for i in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(sig)], names=[_KEY, _TAG, "id", "n", "sig"])


def _sent(block, payload) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(payload, pa.binary())], names=["block", "payload"])


def _counted(blocks: int):
    """Map side of step 2: 32-bit shingle hashes with their counts."""

    def rows(parts):
        value = np.concatenate(parts)
        parts.clear()
        value.sort()
        start = np.flatnonzero(np.append(True, value[1:] != value[:-1])[:len(value)])
        bucket = value[start]
        count = np.diff(start, append=len(value))
        value = start = None
        count = np.minimum(count, 65535).astype(np.uint16)
        bucket = bucket.astype(np.uint64)
        out = [(k, words.pack(bucket[a:b], count[a:b])) for k, a, b in words.by_block(bucket, blocks, 32)]
        return _sent([k for k, _ in out], [p for _, p in out])

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            for *_, g, _ in _sets(batch):
                parts.append((g >> np.uint64(32)).astype(np.uint32))
                n += len(g)
                if n >= 2 * PIECE_ENTRIES:
                    yield rows(parts)
                    parts, n = [], 0
        if n:
            yield rows(parts)

    return run


def _frequent(table: pa.Table) -> pa.Table:
    """Reduce side of step 2: (bucket, base-2 logarithm of its count) from four documents on."""
    buckets, counts = [], []
    for blob in table.column("payload"):
        bucket, count = words.unpack(blob.as_py())
        buckets.append(bucket.astype(np.uint32))
        counts.append(count)
    bucket, count = np.concatenate(buckets), np.concatenate(counts)
    buckets, counts = None, None
    order = np.argsort(bucket, kind="stable")
    bucket, count = bucket[order], count[order]
    start = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] ^ np.uint32(1)))
    total = np.add.reduceat(count, start, dtype=np.int64)
    keep = total >= 4
    return pa.table({"bucket": pa.array(bucket[start][keep].astype(np.int64)), "level": pa.array(np.log2(total[keep]).astype(np.int32))})


def _ranked(g: np.ndarray, n: np.ndarray, buckets: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First ``n // 4 + 1`` shingles of each set, rare ones first, and their levels."""
    level = np.zeros(len(g), dtype=np.uint64)
    if len(buckets):
        at = np.minimum(np.searchsorted(buckets, g >> np.uint64(32)), len(buckets) - 1)
        level = np.where(buckets[at] == g >> np.uint64(32), levels[at], 0).astype(np.uint64)
    value = level << np.uint64(58) | g >> np.uint64(6)
    end = np.cumsum(n)
    seen = np.concatenate([[0], np.cumsum(level > 0)])
    for a, b in zip((end - n)[seen[end] > seen[end - n]], end[seen[end] > seen[end - n]]):
        value[a:b].sort()
    pos = np.arange(len(g)) - np.repeat(end - n, n)
    keep = pos < np.repeat(n // 4 + 1, n)
    value = value[keep]
    return (value & np.uint64((1 << 58) - 1)) >> np.uint64(10), value >> np.uint64(58)


def _prefixes(blocks: int, frequent):
    """Map side of step 3: (hash of 48 bits, document) entries by block and salt."""

    def rows(parts):
        key = np.concatenate([p[0] for p in parts])
        size = np.concatenate([p[1] for p in parts])
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        order = np.argsort(key, kind="stable")
        place = np.empty(len(key), dtype=np.uint64)
        place[order] = np.arange(len(key), dtype=np.uint64)
        key, size = key[order], size[order].astype(np.uint32)
        value = np.concatenate([p[2] << np.uint64(16) | place[p[3] + x] for p, x in zip(parts, base)])
        salt = np.concatenate([p[4] for p in parts])
        parts.clear()

        def packed(v):  # with the documents that are in it: all of them in each block would grow with its square
            which = (v & np.uint64(0xFFFF)).astype(np.int64)
            used = np.zeros(len(key), dtype=bool)
            used[which] = True
            at = np.cumsum(used, dtype=np.uint64) - np.uint64(1)
            return words.pack(v & ~np.uint64(0xFFFF) | at[which], np.diff(key[used], prepend=0), size[used])

        out, salts = [], np.unique(salt)
        for s in salts:
            v = value[salt == s] if len(salts) > 1 else value
            v.sort()
            out += [(k + int(s) * blocks, packed(v[a:b])) for k, a, b in words.by_block(v, blocks, 64)]
        return _sent([k for k, _ in out], [p for _, p in out])

    def run(batches):
        buckets, levels = frequent.value
        parts, n, docs = [], 0, 0
        for batch in batches:
            for _, _, key, g, size in _sets(batch):
                entry, level = _ranked(g, size, buckets, levels)
                doc = np.repeat(np.arange(len(size), dtype=np.int32), np.where(size > 0, size // 4 + 1, 0))
                groups = np.maximum(1, (np.int64(1) << np.minimum(level.astype(np.int64), 62)) // SALT_DF)
                salt = np.where(groups > 1, 1 + (words.mix(key[doc].astype(np.uint64)) % groups.astype(np.uint64)).astype(np.int32), np.int32(0))
                if parts and (n >= PIECE_ENTRIES or docs + len(size) > 65535):
                    yield rows(parts)
                    parts, n, docs = [], 0, 0
                parts.append((key, size, entry, doc, salt))
                n, docs = n + len(entry), docs + len(size)
        if parts:
            yield rows(parts)

    return run


def _columns(blocks: int):
    """Reduce side of step 3: lists of documents that share an entry and may link by size."""

    def run(table: pa.Table) -> pa.Table:
        entries, keys, sizes = [], [], []
        salted = table.column("block")[0].as_py() >= blocks if len(table) else False
        for blob in table.column("payload").to_pylist():
            value, known, size = words.unpack(blob)
            which = (value & np.uint64(0xFFFF)).astype(np.int64)
            entries.append(value >> np.uint64(16))
            keys.append(np.cumsum(known.astype(np.int64))[which])
            sizes.append(size[which])
        entry, key, size = (np.concatenate(x) for x in (entries, keys, sizes))
        order = np.argsort(entry, kind="stable")
        e = entry[order]
        new = np.append(True, e[1:] != e[:-1])
        many = np.diff(np.append(np.flatnonzero(new), len(e))) > 1
        order = order[(many | salted)[np.cumsum(new) - 1]]  # most entries are alone
        order = order[np.lexsort((key[order], size[order], entry[order]))]
        e, k, n = entry[order], key[order], size[order].astype(np.int64)
        distinct = np.ones(len(e), dtype=bool)
        distinct[1:] = (e[1:] != e[:-1]) | (k[1:] != k[:-1]) | (n[1:] != n[:-1])
        e, k, n = e[distinct], k[distinct], n[distinct]
        cut = np.ones(len(e), dtype=bool)
        cut[1:] = (e[1:] != e[:-1]) | (4 * n[:-1] < 3 * n[1:])
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(e)))
        sign = np.add.reduceat(words.mix(k.astype(np.uint64) ^ words.mix(n.astype(np.uint64))), start) if len(start) else np.zeros(0, np.uint64)
        sign = sign ^ words.mix(length.astype(np.uint64))
        _, once, times = np.unique(sign, return_index=True, return_counts=True)
        out, keep = [], (length[once] > 1) | salted
        for i, alike in zip(once[keep].tolist(), times[keep].tolist()):
            lo, hi = int(start[i]), int(start[i] + length[i])
            long = hi - lo > PIECE
            share = int(sign[i].view(np.int64)) if salted else None
            run_id = None if salted else int((e[lo] if long else sign[i]).view(np.int64))
            out += [(run_id, salted or long, share, k[a:min(a + PIECE, hi)], n[a:min(a + PIECE, hi)], alike) for a in range(lo, hi, PIECE)]
        if salted:  # which shares a column has in this group
            out += [(int(e[start[i]].view(np.int64)), True, int(sign[i].view(np.int64)), None, None, None) for i in range(len(start))]
        block = table.column("block")[0].as_py() if len(table) else 0
        return pa.table({"block": pa.array([block] * len(out), pa.int32()), "run": pa.array([x[0] for x in out], pa.int64()), "many": pa.array([x[1] for x in out], pa.bool_()),
                         "share": pa.array([x[2] for x in out], pa.int64()), "members": pa.array([x[3] for x in out], pa.list_(pa.int64())), "sizes": pa.array([x[4] for x in out], pa.list_(pa.int64())),
                         "times": pa.array([x[5] for x in out], pa.int64())})

    return run


_LISTED = "block int, run long, many boolean, share long, members array<long>, sizes array<long>, times long"


def _whole_columns(listed: DataFrame) -> DataFrame:
    """(run, many, members, sizes, times) of ``listed``, where salted columns have been put together
    from their shares and of equal ones the smallest is left."""
    plain = listed.where("share is null").select("run", "many", "members", "sizes", "times")
    names = listed.where("share is not null and members is null").select("run", "block", "share").distinct()
    if names.isEmpty():
        return plain
    names = shared.staged(names, "shares")
    part = F.struct("block", "share")
    alike = names.groupBy("run").agg(F.bit_xor(F.xxhash64(part)).alias("x"), F.bit_xor(F.xxhash64(part, F.lit(1))).alias("y"), F.count(F.lit(1)).alias("k"))
    first = alike.groupBy("x", "y", "k").agg(F.min("run").alias("run")).select("run")
    stored = listed.where("members is not null and share is not null").select("block", "share", "members", "sizes")
    salted = names.join(first, "run", "left_semi").join(stored, ["block", "share"]).select("run", F.lit(True).alias("many"), "members", "sizes", F.lit(1).cast("long").alias("times"))
    return shared.staged(plain.unionByName(salted), "lists")


def _short() -> F.Column:
    return ~F.col("many") & (F.size("members") <= PAIRED)


def _members() -> F.Column:
    return F.arrays_zip(F.col("members").alias("id"), F.col("sizes").alias("n"))


def least_shared(n: str, m: str) -> F.Column:
    """How many of their first ``size // 4 + 1`` shingles two linked sets of these sizes share.

    Of n and m shingles at least k = ceil(3 (n + m) / 7) are common, so n - k and m - k at most
    are not. Where the first ones of the set that ends sooner in the common order are in the
    other set at all, they are among its first ones.
    """
    return F.expr(f"least({n} div 4 + 1 - {n}, {m} div 4 + 1 - {m}) + (3 * ({n} + {m}) + 6) div 7")


def _alike(lists: DataFrame) -> DataFrame:
    """(a, b, n, hub): the pairs of the short lists that share enough entries to link, with the
    size of b, and whether a is the smallest id of a list with b."""
    some = lists.where(_short()).select("times", F.sort_array(_members()).alias("l"))
    some = some.select("times", "l", F.posexplode("l").alias("at", "x"))
    some = some.select("times", (F.col("x.id") == F.col("l")[0]["id"]).alias("hub"), "x", F.explode(F.expr("slice(l, at + 2, size(l))")).alias("y"))
    some = some.select("times", "hub", F.col("x.id").alias("a"), F.col("x.n").alias("m"), F.col("y.id").alias("b"), F.col("y.n").alias("n"))
    pairs = (some.where("a <> b and 4 * least(m, n) >= 3 * greatest(m, n)").groupBy("a", "m", "b", "n")
             .agg(F.sum("times").alias("times"), F.max("hub").alias("hub")).withColumn("need", least_shared("m", "n")))
    # entries in longer lists count as shared; lists in pieces stand for any number of them
    entries = F.when(F.col("many"), F.lit(1 << 31)).otherwise(F.col("times"))
    longer = lists.where(~_short()).select(entries.alias("k"), F.explode("members").alias("id")).groupBy("id").agg(F.sum("k").alias("k"))
    for side in ("a", "b"):
        pairs = pairs.join(longer.select(F.col("id").alias(side), F.col("k").alias(f"{side}_more")), side, "left")
    pairs = pairs.where("times + least(coalesce(a_more, 0), coalesce(b_more, 0)) >= need")
    return shared.staged(pairs.select("a", "b", "n", "hub"), "alike")


def _requested(batches):
    """Each text's packed set, once for each group of pairs that wants it."""
    for batch in batches:
        hubs, groups, roles = (batch.column(i).to_pylist() for i in (2, 3, 4))
        for lo, _, key, g, n in _sets(batch):
            end = np.cumsum(n)
            rows, size = [], 0
            for i in range(len(n)):
                blob = words.pack(np.unique(g[end[i] - n[i]:end[i]] >> np.uint64(16)))
                for hub, group, role in zip(hubs[lo + i], groups[lo + i], roles[lo + i]):
                    rows.append((hub, group, role, int(key[i]), int(n[i]), blob))
                    size += len(blob)
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_pylist([dict(zip(_ASKED.names, r)) for r in rows], schema=_ASKED)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(_ASKED.names, r)) for r in rows], schema=_ASKED)


_ASKED = pa.schema([("hub", pa.int64()), ("grp", pa.int64()), ("role", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])


def _overlaps(batches):
    """Rows come sorted by (hub, group, role): the hub's set, then the members to test."""
    now, sets = None, []
    for batch in batches:
        a, b = [], []
        for hub, group, role, key, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if (hub, group) != now:
                now, sets = (hub, group), []
            own = words.unpack(blob)[0]
            if role == 0:
                sets.append((n, own))
                continue
            for m, other in sets:
                if 4 * min(n, m) >= 3 * max(n, m):
                    few, more = (own, other) if len(own) < len(other) else (other, own)
                    at = np.minimum(np.searchsorted(more, few), len(more) - 1)
                    both = int((more[at] == few).sum())
                    if 100 * both >= 75 * (n + m - both):
                        a.append(hub)
                        b.append(key)
                        break
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verified(pairs_of: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b, n) whose whole sets link. ``n`` is the size of b."""
    pairs = shared.staged(pairs_of.groupBy("a", "b").agg(F.max("n").alias("n")), "pairs")
    work = pairs.groupBy("a").agg((1 + F.floor(F.greatest(F.sum("n") / GROUP_SHINGLES, F.count(F.lit(1)) / GROUP_MEMBERS))).cast("long").alias("groups"))
    asked = pairs.join(work, "a").select("a", "b", F.expr("pmod(xxhash64(b), groups)").alias("grp"))
    member = asked.select(F.col("b").alias(_KEY), F.struct(F.col("a").alias("hub"), "grp", F.lit(1).alias("role")).alias("want"))
    hub = asked.select("a", "grp").distinct().select(F.col("a").alias(_KEY), F.struct(F.col("a").alias("hub"), "grp", F.lit(0).alias("role")).alias("want"))
    wants = shared.staged(hub.unionByName(member).groupBy(_KEY).agg(F.collect_list("want").alias("want"))
                          .select(_KEY, *[F.col(f"want.{c}").alias(c) for c in ("hub", "grp", "role")]), "wants")
    texts = shared.on_ids(docs, wants, _KEY, "left_semi").join(wants, _KEY).select(_KEY, "text", "hub", "grp", "role")
    sets = texts.mapInArrow(_requested, "hub long, grp long, role int, id long, n long, shingles binary")
    links = sets.repartition("hub", "grp").sortWithinPartitions("hub", "grp", "role").mapInArrow(_overlaps, "a long, b long")
    return shared.staged(links.distinct(), "linked")


_PLACED = pa.schema([("tile", pa.int64()), ("side", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("component", pa.int64()), ("shingles", pa.binary())])


def _placed(batches):
    """Each text's packed set, once for each tile that it is a row or a column of."""
    for batch in batches:
        tiles, sides, component = (batch.column(i).to_pylist() for i in (2, 3, 4))
        for lo, _, key, g, n in _sets(batch):
            end = np.cumsum(n)
            for i in range(len(n)):
                blob = words.pack(np.unique(g[end[i] - n[i]:end[i]] >> np.uint64(16)))
                step = max(1, (1 << 24) // len(blob))
                for at in range(0, len(tiles[lo + i]), step):
                    some = tiles[lo + i][at:at + step]
                    k = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sides[lo + i][at:at + step], pa.int32()), pa.array([int(key[i])] * k, pa.int64()),
                                                      pa.array([int(n[i])] * k, pa.int64()), pa.array([component[lo + i]] * k, pa.int64()), pa.array([blob] * k, pa.binary())], schema=_PLACED)


def _incidence(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sets = [words.unpack(x)[0] for x in blobs]
    return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])


def overlap_counts(left: list[bytes], right: list[bytes], step: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two blocks of sets: the product of their incidence
    matrices, accumulated over blocks of the shingles that both sides hold."""
    (a, row), (b, column) = _incidence(left), _incidence(right)
    both = np.intersect1d(a, b)
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    at_a, at_b = np.searchsorted(both, a), np.searchsorted(both, b)
    in_a = both[np.minimum(at_a, len(both) - 1)] == a if len(both) else np.zeros(len(a), bool)
    in_b = both[np.minimum(at_b, len(both) - 1)] == b if len(both) else np.zeros(len(b), bool)
    for lo in range(0, len(both), step):
        x, y = (np.zeros((len(side), step), dtype=np.float32) for side in (left, right))
        some_a, some_b = in_a & (at_a >= lo) & (at_a < lo + step), in_b & (at_b >= lo) & (at_b < lo + step)
        x[row[some_a], at_a[some_a] - lo] = 1
        y[column[some_b], at_b[some_b] - lo] = 1
        total += x @ y.T
    return total.astype(np.int64)


def spanning(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As many of the pairs as connect what they connect."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for a, b in pairs:
        if (x := find(a)) != (y := find(b)):
            root[y] = x
            out.append((a, b))
    return out


def _tile_links(rows: list[tuple]) -> list[tuple[int, int]]:
    """Components that links of one tile join. Rows are (side, n, component, shingles)."""
    left = [r for r in rows if r[0] == 0]
    right = [r for r in rows if r[0] == 1] or left
    if not left or len({r[2] for r in rows}) < 2:
        return []  # one component, or guests only
    n, m = (np.array([r[1] for r in side])[:, None] for side in (left, right))
    c, d = (np.array([r[2] for r in side])[:, None] for side in (left, right))
    both = overlap_counts([r[3] for r in left], [r[3] for r in right])
    i, j = np.nonzero((c != d.T) & (100 * both >= 75 * (n + m.T - both)) & (both > 0))
    return spanning(sorted(set(zip(c[i, 0].tolist(), d[j, 0].tolist()))))


def _tiles(batches):
    """Rows come sorted by tile; each tile's product is taken when it is complete."""
    now, rows = None, []
    for batch in batches:
        out = []
        for tile, *rest in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
            if tile != now:
                out += _tile_links(rows)
                now, rows = tile, []
            rows.append(rest)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
    if out := _tile_links(rows):
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _across(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between components that lists leave open. ``members``: (run, id, n, component).

    A document's group is the longest open list that it is in, so that lists with nearly the
    same members are one group. Groups that meet in a list are multiplied block by block.
    """
    members = shared.staged(members.distinct(), "open")
    if members.isEmpty():  # else seven queries are planned over nothing
        return shared.staged(members.select(F.col("id").alias("a"), F.col("component").alias("b")), "across")
    sized = members.groupBy("run").agg(F.count(F.lit(1)).alias("size"))
    grouped = shared.staged(members.join(sized, "run").groupBy("id").agg(F.max(F.struct("size", "run"))["run"].alias("grp"), F.max("n").alias("n"), F.first("component").alias("component")), "groups")
    parts = lambda n, size: (1 + F.floor(F.greatest(n / TILE, size / TILE_SHINGLES))).cast("int")
    blocks = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    blocks = shared.staged(blocks.withColumn("blocks", parts(F.col("members"), F.col("shingles"))), "blocks")
    met = members.select("run", "id").join(grouped.select("id", "grp"), "id").select("run", "grp").distinct()
    ranked = blocks.select("grp", F.struct("members", "grp", "shingles", "blocks", "lo", "hi").alias("g"))
    met = met.join(ranked, "grp").select("run", "g")
    pairs = met.join(met.select("run", F.col("g").alias("h")), "run").where("g >= h").select("g", "h").distinct()
    pairs = shared.staged(pairs.where("least(g.lo, h.lo) <> greatest(g.hi, h.hi)"), "meetings")
    alone = pairs.where("g = h").select(F.col("g.grp").alias("grp"), F.col("g.blocks").alias("blocks"))
    # a larger group hosts all smaller ones that it meets; their members share its columns
    hosts = pairs.where("g > h").groupBy(F.col("g.grp").alias("host"), F.col("g.blocks").alias("blocks")).agg(parts(F.sum("h.members"), F.sum("h.shingles")).alias("bundles"))
    hosts = shared.staged(hosts, "hosts")
    guests = pairs.where("g > h").select(F.col("h.grp").alias("grp"), F.col("g.grp").alias("host")).join(hosts, "host")
    place = lambda n: F.expr(f"cast(pmod(xxhash64(id), {n}) as int)")
    some = grouped.select("id", "component", "grp")
    tile = F.xxhash64("kind", "grp", "b1", "b2").alias("tile")
    own = some.join(alone, "grp").withColumn("b", place("blocks"))
    want = [own.select("id", "component", F.lit(0).alias("kind"), "grp", F.col("b").alias("b1"), F.explode(F.expr("sequence(b, blocks - 1)")).alias("b2"), F.lit(0).alias("side")),
            own.where("b > 0").select("id", "component", F.lit(0).alias("kind"), "grp", F.explode(F.expr("sequence(0, b - 1)")).alias("b1"), F.col("b").alias("b2"), F.lit(1).alias("side")),
            some.join(hosts.withColumnRenamed("host", "grp"), "grp").select("id", "component", F.lit(1).alias("kind"), "grp", place("blocks").alias("b1"), F.explode(F.expr("sequence(0, bundles - 1)")).alias("b2"), F.lit(0).alias("side")),
            some.join(guests, "grp").select("id", "component", F.lit(1).alias("kind"), F.col("host").alias("grp"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("b1"), place("bundles").alias("b2"), F.lit(1).alias("side"))]
    rows, columns = want[0].unionByName(want[1]), want[2].unionByName(want[3])
    wants = rows.unionByName(columns).select("id", "component", F.struct(tile, "side").alias("want"))
    wants = shared.staged(wants.groupBy(F.col("id").alias(_KEY)).agg(F.first("component").alias("component"), F.collect_list("want").alias("want"))
                          .select(_KEY, F.col("want.tile").alias("tile"), F.col("want.side").alias("side"), "component"), "wants")
    texts = shared.on_ids(docs, wants, _KEY, "left_semi").join(wants, _KEY).select(_KEY, "text", "tile", "side", "component")
    sets = texts.mapInArrow(_placed, "tile long, side int, id long, n long, component long, shingles binary")
    return shared.staged(sets.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles, "a long, b long").distinct(), "across")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nodes_too: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``; with ``nodes_too`` also the
    row's node, its tag and its component's smallest node, which may be a text without id."""
    with shared.arrow_batches(docs.sparkSession):  # every step in Python is staged in it
        out = _components_of(docs, id_col, text_col)
    return out if nodes_too else out.select(id_col, "n_shingles", "component_id")


def _components_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    keyed = docs.select(row_key(id_col, text_col).alias(_KEY), F.col(text_col).alias("text"))
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BLOCK_BYTES + 1)
    tagged = keyed.withColumn(_TAG, row_tag(F.col(_KEY), "text"))

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    read = read.select(row_key("id", "text").alias(_KEY), "text", row_tag(row_key("id", "text"), "text").alias(_TAG), "id")
    sums = shared.staged(read.mapInArrow(_summaries, f"{_KEY} long, {_TAG} long, id long, n long, sig long"), "sets")
    some = sums.where("n > 0")
    heads = shared.staged(some.groupBy("sig").agg(F.min(_KEY).alias("head")), "heads")
    copied = some.join(heads, "sig").where(F.col(_KEY) != F.col("head"))
    copies = shared.staged(copied.select(_TAG, _KEY, "head").distinct(), "copies")
    nodes = shared.on_ids(tagged, copies, _TAG, "left_anti").select(_KEY, "text")
    # a node with several sets is linked with what each of them copies
    several = some.groupBy(_KEY).agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select(_KEY)
    kept_by_copy = copies.join(several, _KEY, "left_semi").select(F.col("head").alias("a"), F.col(_KEY).alias("b"))

    counts = shared.staged(nodes.mapInArrow(_counted(blocks), "block int, payload binary")
                           .groupBy("block").applyInArrow(_frequent, "bucket long, level int"), "counts")
    left, least = FREQUENT, 64
    for level, n in sorted(((r["level"], r["count"]) for r in counts.groupBy("level").count().collect()), reverse=True):
        if (left := left - n) < 0:
            break
        least = level
    frequent = counts.where(F.col("level") >= least).orderBy("bucket").toArrow()
    table = spark.sparkContext.broadcast((frequent["bucket"].to_numpy().astype(np.uint64), frequent["level"].to_numpy().astype(np.int32)))

    listed = (nodes.mapInArrow(_prefixes(blocks, table), "block int, payload binary").groupBy("block")
              .applyInArrow(_columns(blocks), _LISTED))
    piece = F.when(F.col("many"), F.xxhash64("members")).otherwise(F.lit(0))
    place = F.when(F.col("share").isNotNull(), F.col("block"))  # lists of several blocks are one unless salted
    listed = listed.groupBy("run", "many", "share", place.alias("block"), piece.alias("piece")).agg(F.first(F.struct("members", "sizes")).alias("x"), F.sum("times").alias("times"))
    lists = _whole_columns(shared.staged(listed.select("block", "run", "many", "share", "x.members", "x.sizes", "times"), "lists"))

    alike = _alike(lists)
    member = F.explode(_members())
    hubbed = lists.where(~_short()).select(F.array_min("members").alias("hub"), member.alias("m"))
    stars = hubbed.select(F.col("hub").alias("a"), F.col("m.id").alias("b"), F.col("m.n").alias("n")).unionByName(alike.where("hub").select("a", "b", "n"))
    hubs = lists.where("many").groupBy("run").agg(F.min(F.array_min("members")).alias("a"))
    stars = stars.unionByName(lists.where("many").select("run", F.array_min("members").alias("b"), F.lit(1).cast("long").alias("n"))
                              .join(hubs, "run").select("a", "b", "n")).where("a <> b")
    links = _verified(stars, nodes).unionByName(kept_by_copy)
    found = shared.staged(components(links), "components")

    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    apart = (alike.where("not hub").join(of("a"), "a", "left").join(of("b"), "b", "left")
             .where("coalesce(a_component, a) <> coalesce(b_component, b)").select(F.explode(F.array("a", "b")).alias("id")))
    rest = (lists.where("many or size(members) > 2").select("run", _short().alias("short"), member.alias("m"))
            .select("run", "short", "m.id", "m.n").join(of("id"), "id", "left").join(apart.distinct().withColumn("open", F.lit(True)), "id", "left")
            .where("open or not short").select("run", "id", "n", F.coalesce("id_component", "id").alias("component")))
    rest = shared.staged(rest, "labelled")
    open_runs = rest.groupBy("run").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("run")
    more = _across(rest.join(open_runs, "run", "left_semi"), nodes)

    labels = heads.join(found, heads["head"] == found["node"], "left").select("sig", F.coalesce("component", "head").alias("component"))
    if not more.isEmpty():  # these links join components, so only components are linked again
        wider = shared.staged(components(more), "wider").select("node", F.col("component").alias("wider"))
        labels = labels.join(wider, labels["component"] == wider["node"], "left").select("sig", F.coalesce("wider", "component").alias("component"))
    least = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col(_KEY)).alias("least")
    out = sums.join(labels, "sig", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), least, F.col(_KEY).alias("node"), F.col(_TAG).alias("tag"))
    return out.withColumn("component_id", F.when(F.col("least") < NO_ID, F.col("least")))


def op6_query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "text"))
