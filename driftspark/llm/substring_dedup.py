"""Substring dedup with fixed-block anchors.

Every word that lies in a window of ``n`` consecutive words which also starts in a
document with a smaller id is removed. Windows are judged on the input.

1. Anchors. Each document's words at positions 0, b, 2b, ... start non-overlapping
   blocks of b = (n + 1) // 2 words. Any n-word window of a document holds one of its
   blocks whole, so a window that repeats elsewhere shows up there as a rolling b-word
   probe that equals a block. Blocks and probes meet by hash range.
2. Extension. Only windows that hold such a hit are looked at again: their n-word hashes
   meet by hash range, and the smallest document id of each decides. Adjacent and
   overlapping repeated windows together cover the maximal repeats.

What is shuffled are sorted hash arrays, one row for each piece of input and hash range.
Within a piece, windows shared by many documents are settled at once and only one or two
of them travel on, so that a passage or a copy group that fills a third of the table adds
two entries a piece, not one a document. Hits and repeats go back to the documents as
(id, hashes) rows, and texts are shuffled only for documents that have any.

Defined results: null text has no words; a null id counts as larger than all others; rows
that repeat an id are judged each by its own text; an empty table gives an empty one.
Input columns named like an output column (``kept_text``, ``n_words``, ``n_removed``) are
replaced. Hashes have 64 bits at the decision (40 while searching).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.llm import shared, words

LAST = np.iinfo(np.int64).max
PIECE_WORDS = 1_500_000
BLOCK_BYTES = 12_000_000
_KEY, _MARKS = "_sd_key", "_sd_marks"
_SENT = "block int, settled boolean, payload binary"


def _rows(block: list[int], settled: bool, payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([settled] * len(block), pa.bool_()), pa.array(payload, pa.binary())],
                                      names=["block", "settled", "payload"])


def _settled(values: np.ndarray, ids: np.ndarray, blocks: int, width: int) -> pa.RecordBatch:
    """Marks (document, hash) that a piece could settle itself, by the hash's block."""
    order = np.argsort(values, kind="stable")
    values, ids = values[order], ids[order]
    out = [(k, words.pack(values[a:b], ids[a:b])) for k, a, b in words.by_block(values, blocks, width)]
    return _rows([k for k, _ in out], True, [p for _, p in out])


def _spread(ids: np.ndarray, values: np.ndarray, buckets: int) -> pa.Table:
    """Marks by bucket of the document id: a row per bucket, not one per document."""
    bucket = words.mix(ids.view(np.uint64)) % np.uint64(buckets)
    order = np.lexsort((values, ids.view(np.uint64), bucket))
    bucket, ids, values = bucket[order], ids[order], values[order]
    start, _ = _runs(bucket)
    stop = np.append(start[1:], len(bucket))
    return pa.table({"bucket": pa.array(bucket[start].astype(np.int32)),
                     "payload": pa.array([words.pack(ids[a:b].view(np.uint64), values[a:b]) for a, b in zip(start, stop)], pa.binary())})


def _gather(table: pa.Table) -> pa.Table:
    """One row per document of a bucket: its marks as bytes of 64-bit hashes."""
    parts = [words.unpack(x) for x in table.column("payload").to_pylist()]
    ids, values = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.lexsort((values, ids))
    ids, values = ids[order], values[order]
    start, _ = _runs(ids)
    stop = np.append(start[1:], len(ids))
    return pa.table({_KEY: pa.array(ids[start].view(np.int64)), _MARKS: pa.array([values[a:b].tobytes() for a, b in zip(start, stop)], pa.binary())})


def _met(table: pa.Table, settled: bool) -> list[bytes]:
    chosen = table.column("settled").to_numpy(zero_copy_only=False) == settled
    return table.column("payload").filter(pa.array(chosen)).to_pylist()


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal values and the run of each value."""
    new = np.ones(len(sorted_values), dtype=bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    run = np.cumsum(new, dtype=np.int32 if len(new) < 1 << 31 else np.int64)
    run -= 1
    return np.flatnonzero(new), run


def _pieces(batches: Iterator[pa.RecordBatch], hashed) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, entry's row, entry's value) of about PIECE_WORDS entries at a time."""
    ids, rows, values, n, base = [], [], [], 0, 0

    def piece():
        for parts in (ids, rows, values):  # the parts go as soon as they are put together
            whole = np.concatenate(parts)
            parts.clear()
            yield whole

    for batch in batches:
        key = batch.column(0).cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in words.slices(batch.column(1)):
            v, r = hashed(batch, lo, hi, *words.text_hashes(data, offsets))
            ids.append(key[lo:hi])
            rows.append((r + base).astype(np.int32))
            values.append(v)
            n, base = n + len(v), base + hi - lo
            if n >= PIECE_WORDS or base >= 1 << 30:
                yield tuple(piece())
                n, base = 0, 0
    if n:
        yield tuple(piece())


def _anchor_rows(entry: np.ndarray, docs: np.ndarray, at: int, blocks: int) -> list[pa.RecordBatch]:
    """What a piece settles itself, and what of it travels on. ``entry`` is sorted in place."""
    entry.sort()
    # one entry for each hash and document, the one at a block's place if any
    entry = entry[np.append(entry[1:] >> np.uint64(1) != entry[:-1] >> np.uint64(1), True)] if len(entry) else entry
    start, of = _runs(entry >> np.uint64(24))
    shared_here = (np.diff(np.append(start, len(entry))) > 1)[of]
    aligned = np.bitwise_or.reduceat(entry & np.uint64(1), start) if len(start) else entry
    mark = entry[shared_here]
    doc = ((mark & np.uint64(0xFFFFFE)) >> np.uint64(1)).astype(np.int64) + at
    settled = _settled(mark >> np.uint64(24), docs[doc], blocks, 40)
    mark = doc = None
    first = np.ones(len(entry), dtype=bool)
    first[2:] = of[2:] != of[:-2]  # the first two of a run
    sent = np.where(shared_here, entry | aligned[of], entry)[first]
    out = [(k, words.pack(sent[lo:hi], np.diff(docs[at:at + (1 << 22)], prepend=0).astype(np.int64)))
           for k, lo, hi in words.by_block(sent, blocks, 64)]
    return [settled, _rows([k for k, _ in out], False, [p for _, p in out])]


def _anchors(b: int, blocks: int):
    """Map side of step 1: (hash of 40 bits, document, whether at a block's place)."""

    def hashed(batch, lo, hi, h, counts):
        g, row, pos = words.ngrams(h, counts, b)
        return (g & ~np.uint64(0xFFFFFF)) | (pos % b == 0), row

    def run(batches):
        for ids, row, value in _pieces(batches, hashed):
            docs, rank = np.unique(ids, return_inverse=True)
            doc_of = rank.astype(np.uint64)[row]
            row = None
            for at in range(0, len(docs), 1 << 22):  # 22 bits number a document in its piece
                inside = (doc_of >= at) & (doc_of < at + (1 << 22)) if len(docs) > 1 << 22 else slice(None)
                entry = value[inside] | ((doc_of[inside] - np.uint64(at)) << np.uint64(1))  # a value is its hash and the last bit
                if at + (1 << 22) >= len(docs):
                    value = doc_of = inside = None
                out = _anchor_rows(entry, docs, at, blocks)
                entry = None
                yield from out

    return run


def _done(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Marks that the pieces had settled: hashes and documents."""
    found = [words.unpack(x) for x in _met(table, True)]
    return [np.zeros(0, np.uint64), *(x[0] for x in found)], [np.zeros(0, np.int64), *(x[1].view(np.int64) for x in found)]


def _meet_anchors(table: pa.Table, buckets: int) -> pa.Table:
    """Reduce side of step 1: hashes in two documents or more, at a block's place in one."""
    marks, ids = _done(table)
    values, docs = [], []
    for blob in _met(table, False):
        entry, known = words.unpack(blob)
        known = np.cumsum(known.astype(np.int64))
        values.append((entry >> np.uint64(24)) << np.uint64(1) | (entry & np.uint64(1)))
        docs.append(known[((entry & np.uint64(0xFFFFFE)) >> np.uint64(1)).astype(np.int64)])
    if values:
        value, doc = np.concatenate(values), np.concatenate(docs)
        order = np.argsort(value >> np.uint64(1), kind="stable")
        value, doc = value[order], doc[order]
        start, of = _runs(value >> np.uint64(1))
        hit = (np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start)) & np.bitwise_or.reduceat(value & np.uint64(1), start).astype(bool)
        marks.append(value[hit[of]] >> np.uint64(1))
        ids.append(doc[hit[of]])
    return _spread(np.concatenate(ids), np.concatenate(marks), buckets)


def _hashes(marks: bytes | None) -> np.ndarray:
    return np.frombuffer(marks or b"", dtype=np.uint64)


def _window_rows(ids: np.ndarray, row: np.ndarray, value: np.ndarray, blocks: int) -> list[pa.RecordBatch]:
    """What a piece settles itself, and the window's smallest document here, which travels on."""
    docs, rank = np.unique(ids, return_inverse=True)
    doc = rank[row]
    order = np.lexsort((doc, value))
    value, doc = value[order], doc[order]
    order = None
    start, of = _runs(value)
    later = doc > doc[start][of]
    settled = _settled(value[later], docs[doc[later]], blocks, 64)
    sent, first = value[start], docs[doc[start]]
    out = [(k, words.pack(sent[lo:hi], *_coded(first[lo:hi]))) for k, lo, hi in words.by_block(sent, blocks, 64)]
    return [settled, _rows([k for k, _ in out], False, [p for _, p in out])]


def _windows(b: int, n: int, blocks: int):
    """Map side of step 2: the n-word windows that hold a hit."""

    def hashed(batch, lo, hi, h, counts):
        g, row, pos = words.ngrams(h, counts, b)
        w, wrow, wpos = words.ngrams(h, counts, n)
        starts = np.cumsum(counts) - counts
        hit = np.zeros(len(h) + n, dtype=np.int64)
        marks = batch.column(2)
        first = np.searchsorted(row, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            s = slice(first[i], first[i + 1])
            hit[starts[i] + pos[s]] = np.isin(g[s] >> np.uint64(24), _hashes(marks[lo + i].as_py()))
        total = np.concatenate([[0], np.cumsum(hit)])
        at = starts[wrow] + wpos
        held = total[at + n - b + 1] > total[at]
        return w[held], wrow[held]

    def run(batches):
        for piece in _pieces(batches, hashed):
            out = _window_rows(*piece, blocks)
            piece = None
            yield from out

    return run


def _coded(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, which = np.unique(ids, return_inverse=True)
    return np.diff(known, prepend=0), which.astype(np.uint32)


def _meet_windows(table: pa.Table, buckets: int) -> pa.Table:
    """Reduce side of step 2: windows that start in a document with a smaller id."""
    marks, ids = _done(table)
    values, docs = [], []
    for blob in _met(table, False):
        value, known, which = words.unpack(blob)
        values.append(value)
        docs.append(np.cumsum(known.astype(np.int64))[which])
    if values:
        value, doc = np.concatenate(values), np.concatenate(docs)
        order = np.argsort(value, kind="stable")
        value, doc = value[order], doc[order]
        start, of = _runs(value)
        later = doc > np.minimum.reduceat(doc, start)[of]
        marks.append(value[later])
        ids.append(doc[later])
    return _spread(np.concatenate(ids), np.concatenate(marks), buckets)


def _cut(text: str, hashes: np.ndarray, n: int) -> tuple[str, int, int]:
    """The text without the words that repeated windows cover."""
    parts = text.encode().split()
    if not len(hashes) or len(parts) < n:
        return b" ".join(parts).decode(), len(parts), 0
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    h, counts = words.text_hashes(data, np.array([0, len(data)]))
    w, _, pos = words.ngrams(h, counts, n)
    repeated = pos[np.isin(w, hashes)]
    cover = np.zeros(len(parts) + 1, dtype=np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + n, -1)
    gone = np.cumsum(cover[:-1]) > 0
    kept = [x for x, g in zip(parts, gone.tolist()) if not g]
    return b" ".join(kept).decode(), len(parts), int(gone.sum())


def _finish(text_at: int, marks_at: int | None, n: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            texts = batch.column(text_at)
            marks = batch.column(marks_at) if marks_at is not None else None
            for lo in range(0, len(texts), 500):
                part = texts.slice(lo, 500).to_pylist()
                done = [_cut(x or "", _hashes(marks[lo + i].as_py()) if marks is not None else _hashes([]), n) for i, x in enumerate(part)]
                columns = [c.slice(lo, 500) for i, c in enumerate(batch.columns) if i != marks_at]
                columns += [pa.array([x[i] for x in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _exchange(rows: DataFrame, meet, buckets: int, name: str) -> DataFrame:
    """Hash ranges meet, marks are gathered per document id and written once."""
    met = rows.groupBy("block").applyInArrow(lambda table: meet(table, buckets), "bucket int, payload binary")
    return shared.staged(met.groupBy("bucket").applyInArrow(_gather, f"{_KEY} long, {_MARKS} binary"), name)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 13) -> DataFrame:
    """``docs`` plus ``kept_text`` (kept words joined by one space), ``n_words``, ``n_removed``.

    The texts are cut when the caller reads the result; ``shared.arrow_batches`` around that
    read bounds its batches too."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    docs = docs.drop(*[c for c in ("kept_text", "n_words", "n_removed") if c not in (id_col, text_col)])
    b = (n + 1) // 2
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BLOCK_BYTES + 1)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST)))
    pairs = docs.select(key.alias(_KEY), F.col(text_col).alias("_sd_text"))

    with shared.arrow_batches(spark):
        hits = _exchange(pairs.mapInArrow(_anchors(b, blocks), _SENT), _meet_anchors, blocks, "anchors")
        near = shared.on_ids(pairs, hits, _KEY, "left_semi").join(hits, _KEY)
        repeats = _exchange(near.mapInArrow(_windows(b, n, blocks), _SENT), _meet_windows, blocks, "repeats")

    keyed = docs.withColumn(_KEY, key)
    out = T.StructType([*docs.schema.fields, T.StructField("kept_text", T.StringType()),
                        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    arrow = to_arrow_schema(out)
    at = docs.columns.index(text_col)
    whole = shared.on_ids(keyed, repeats, _KEY, "left_anti").select(*docs.columns)
    cut = shared.on_ids(keyed, repeats, _KEY, "left_semi").join(repeats, _KEY).select(*docs.columns, _MARKS)
    return (whole.mapInArrow(_finish(at, None, n, arrow), out)
            .unionByName(cut.mapInArrow(_finish(at, len(docs.columns), n, arrow), out)))


def op8_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    with shared.arrow_batches(spark):
        return shared.staged(out, "digests")
