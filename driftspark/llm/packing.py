"""Packing by concatenate and cut.

Pass 1 tokenises every text once and writes the ids (with the end id after each document)
together with running offsets inside its input partition. The partitions' token totals
(one row per partition) are summed up to global offsets. Pass 2 adds them and cuts the one
long stream into windows of ``length`` ids. A document that crosses a window's end gives a
boundary record per window, so every id lies in exactly one piece and only the last
sequence needs padding. Nothing is shuffled but the totals.

Ids are those of the tokenizer file on the whole text. A space that a non-space follows
always begins a pre-token of the byte-level pattern, so texts are cut there and the ids of
each distinct part are computed once per task (a bounded cache) and joined. Where the file
is a byte-level BPE with ids in the order of its merges, a rank-based encoder computes the
same ids faster; tests hold them against the tokenizer itself. Texts that hold the string
of an added token (the end-of-text mark, say) go through the tokenizer itself, which gives
such a string its own id.

Defined results: null and empty texts are the end id alone; rows that repeat an id are
packed each; an empty table gives an empty one; columns other than the id are not carried.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm import shared

LENGTH, END_ID = 2048, 1
# Bounds of the cache of parts: entries, and characters of a part that is kept.
CACHE_PARTS, CACHE_CHARS = 100_000, 40
# Bound of a batch of texts that goes to a worker, in bytes.
BATCH_BYTES = 4 << 20
_CUT = re.compile(r" (?=\S)")
# Fixed value: the pre-token pattern of byte-level files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes to ids of a byte-level BPE file whose ids are in the order of its merges,
    which is all that a byte-pair encoder needs; None for any other kind of file."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not model.get("ignore_merges") and not model.get("byte_fallback") and spec.get("normalizer") is None
    if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}


class PartEncoder:
    """Ids of texts, through the ids of their parts: those of the tokenizer file, computed
    by the faster of two public byte-pair encoders where the file allows it."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.tokenizer = path, None
        ranks = merge_ranks(spec)
        if ranks:
            coder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.ids_of = lambda text: coder.encode_to_numpy(text, disallowed_special=())
        self.ranks = ranks
        added = sorted({t["content"] for t in spec.get("added_tokens", [])}, key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.width = width_of(path)
        if ranks:
            self.bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            self.bytes[list(ranks.values())] = [len(x) for x in ranks]
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        """Ids by the tokenizer itself, which is read when a text first needs it."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, parts: list[str]) -> None:
        """Put the ids of parts into the cache. They are encoded many as one text, each after
        a space, and the ids are dealt back by the bytes that each stands for."""
        for at in range(0, len(parts), 4000):
            some = parts[at:at + 4000]
            ids = self.ids_of(" " + " ".join(some)).astype(self.width)
            ends = np.cumsum([len(x.encode()) + 1 for x in some])
            cut = ((np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1) * ids.itemsize).tolist()
            data = ids.tobytes()
            self.cache.update(zip(some, (data[a:b] for a, b in zip([0, *cut], cut))))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.ranks:
            return [self.whole(x).astype(self.width).tobytes() for x in texts]
        odd = [bool(self.added and self.added.search(x)) for x in texts]
        plain = iter(self._encode([x for x, o in zip(texts, odd) if not o]))
        return [self.whole(x).astype(self.width).tobytes() if o else next(plain) for x, o in zip(texts, odd)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens."""
        split = [x.split(" ") for x in texts]
        missing = set().union(*split).difference(self.cache)
        odd = {x for x in missing if not x or x[0].isspace()}
        if odd:  # more than one space in a row: cut such texts only before a non-space
            split = [x if odd.isdisjoint(x) else _CUT.split(t) for x, t in zip(split, texts)]
        if len(self.cache) > CACHE_PARTS:
            self.cache.clear()
        missing = list(set().union(*(x[1:] for x in split)).difference(self.cache))
        self._learn(missing)
        out = [self.ids_of(x[0]).astype(self.width).tobytes() + b"".join(map(self.cache.__getitem__, x[1:])) for x in split]
        for x in missing:
            if len(x) > CACHE_CHARS:
                del self.cache[x]
        return out


def width_of(path: str) -> type:
    """Unsigned integers that hold every id of the file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = [*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))] if isinstance(spec["model"]["vocab"], dict) else [len(spec["model"]["vocab"])]
    return np.uint16 if max(ids) < 1 << 16 else np.uint32


def _tokenise(path: str, end_id: int):
    """Pass 1: (part, id, tokens, offset in the part, ids)."""

    def run(batches):
        encoder, part, at = PartEncoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=encoder.width).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                ids = [x + end for x in encoder.encode([t or "" for t in some.column(1).to_pylist()])]
                n = np.array([len(x) for x in ids], dtype=np.int64) // encoder.width().itemsize
                offset = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), some.column(0), pa.array(n), pa.array(offset), pa.array(ids, pa.binary())],
                                                 names=["part", "id", "tokens", "at", "ids"])

    return run


def _cut(length: int, width: str):
    """Pass 2: a record for each document and window."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                n, at = (some.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                first, last = at // length, (at + n - 1) // length
                count = last - first + 1
                row = np.repeat(np.arange(len(n)), count)
                window = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = np.maximum(at[row], window * length)
                stop = np.minimum((at + n)[row], (window + 1) * length)
                ids = [np.frombuffer(x, dtype=width).astype("<u4") for x in some.column(3).to_pylist()]
                piece = [ids[r][a:b].tobytes() for r, a, b in zip(row.tolist(), (start - at[row]).tolist(), (stop - at[row]).tolist())]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row)), pa.array(start - at[row]), pa.array(stop - start), pa.array(n[row]),
                                                  pa.array(window), pa.array(start - window * length), pa.array(piece, pa.binary())],
                                                 names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset and ``ids``
    (little-endian unsigned 32-bit)."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with shared.arrow_batches(docs.sparkSession, BATCH_BYTES):
        tokens = shared.staged(source.mapInArrow(_tokenise(tokenizer_path, end_id), f"part int, id {kind}, tokens long, at long, ids binary"), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = shared.staged(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "bases")
    bases = F.broadcast(bases) if shared.small(bases) else bases
    placed = tokens.join(bases, "part").select("id", "tokens", (F.col("at") + F.col("base")).alias("at"), "ids")
    width = f"<u{width_of(tokenizer_path)().itemsize}"
    out = placed.mapInArrow(_cut(length, width), f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """The padded sequences themselves: sequence_id, ids (array of ``length``), n_tokens."""
    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("offset").to_numpy())
        blobs = table.column("ids").to_pylist()
        ids = np.frombuffer(b"".join(blobs[i] for i in order), dtype="<u4").astype(np.int32)
        padded = np.full(length, pad_id, dtype=np.int32)
        padded[:len(ids)] = ids
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([padded], pa.list_(pa.int32())),
                         "n_tokens": pa.array([len(ids)], pa.int32())})

    return pieces.groupBy("sequence_id").applyInArrow(one, "sequence_id long, ids array<int>, n_tokens int")


def op1_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "text")
    return (pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
            .withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
