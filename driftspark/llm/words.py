"""Word and n-gram hashes of Arrow text batches, vectorised over the UTF-8 bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D. A word's hash is a
polynomial of its bytes modulo 2^64 with a fixed odd base, mixed together with its length, so equal
words have equal hashes anywhere in the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

# Odd multipliers of the hashes and the bytes handled at a time.
BASE = 0x9E3779B97F4A7C55
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
STEP = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.full(n - 1, b, dtype=np.uint64)]).cumprod(dtype=np.uint64)
                      for b in (BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def _hash_piece(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of one piece and each word's start. ``first``: positions that begin a text."""
    space = _SPACE[data]
    cut = np.ones(len(data) + 1, dtype=bool)
    cut[1:-1] = space[:-1]
    cut[first] = True
    starts = np.flatnonzero(~space & cut[:-1])
    last = cut[1:].copy()
    last[:-1] |= space[1:]
    ends = np.flatnonzero(~space & last) + 1
    up, down = _powers(max(len(data), STEP))
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(MIX[1]))), starts


def text_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of consecutive texts, and each text's number of words.

    ``offsets`` are the byte bounds of the texts in ``data`` (one more than texts).
    Work goes piece by piece, cut at white space or a text's end, so that memory follows
    STEP (or one longer word) and the words, not the length of a text.
    """
    data = data[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    bounds = offsets[:-1][np.diff(offsets) > 0]
    hashes, where, at = [], [], 0
    while at < len(data):
        to = min(at + STEP, len(data))
        if to < len(data):
            space = np.flatnonzero(_SPACE[data[at:to]])
            begun = np.searchsorted(bounds, to, side="right")
            text = int(bounds[begun - 1]) if begun else 0
            cut = max(at + int(space[-1]) + 1 if len(space) else at, text)
            while cut <= at:  # a word longer than a step
                ahead = np.flatnonzero(_SPACE[data[to:to + STEP]])
                after = np.searchsorted(bounds, to)
                end = int(bounds[after]) if after < len(bounds) else len(data)
                stop = to + int(ahead[0]) if len(ahead) else to + STEP
                cut, to = (min(stop, end), to) if len(ahead) or stop >= end else (at, to + STEP)
            to = cut
        piece = data[at:to]
        inside = bounds[np.searchsorted(bounds, at):np.searchsorted(bounds, to)] - at
        h, s = _hash_piece(_LOWER[piece] if lower else piece, inside)
        hashes.append(h)
        where.append(s + at)
        at = to
    h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    s = np.concatenate(where) if where else np.zeros(0, dtype=np.int64)
    return h, np.diff(np.searchsorted(s, offsets))


def slices(texts: pa.Array, size: int = 4 * STEP, rows: int = 4095) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow text column into runs of rows of about ``size`` bytes.

    Yields (first row, row after the last, bytes, offsets). Null texts are empty.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), at + rows, len(texts))
        yield at, to, data, offsets[at:to + 1]
        at = to


def ngrams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside a text, with text number and position."""
    starts = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(len(hashes)) - starts[text]
    keep = pos + n <= counts[text]
    out = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64)
    for i in range(n):
        out *= np.uint64(BASE)
        out += hashes[i:i + len(out)]
    keep = keep[:len(out)]
    return mix(out[keep]), text[:len(out)][keep], pos[:len(out)][keep]


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def pack(sorted_values: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted uint64 values as differences, then other arrays, byte plane by byte plane, zstd."""
    first = np.diff(sorted_values, prepend=np.uint64(0))
    parts = [first, *more]
    head = np.array([len(parts), *(v for x in parts for v in (len(x), x.dtype.itemsize))], dtype=np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(map(_planes, parts)))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``, each as unsigned integers of the width it had."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    head, at, out = raw[8:8 + 16 * n].view(np.int64), 8 + 16 * n, []
    for length, width in head.reshape(-1, 2):
        planes = raw[at:at + length * width].reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).view(f"u{width}").reshape(-1))
        at += int(length * width)
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def by_block(sorted_values: np.ndarray, blocks: int, shift: int) -> list[tuple[int, int, int]]:
    """(block, from, to) of the runs of sorted values whose top bits (after ``shift`` of
    64 are dropped from the value's width) fall into each of ``blocks`` equal ranges."""
    edges = (np.arange(1, blocks, dtype=object) * (1 << shift)) // blocks
    at = np.searchsorted(sorted_values, np.array(edges, dtype=np.uint64)) if blocks > 1 else np.zeros(0, np.int64)
    bounds = [0, *map(int, at), len(sorted_values)]
    return [(b, lo, hi) for b, (lo, hi) in enumerate(zip(bounds, bounds[1:])) if hi > lo]
