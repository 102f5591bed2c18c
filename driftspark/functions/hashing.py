"""Deterministic per-row uniforms from a key.

Spark's ``rand(seed)`` depends on partitioning and DuckDB's ``hash`` differs from
Spark's ``xxhash64``, so draws use the leading 48 bits of ``md5(key ':' seed)``, which
both engines compute alike. Draws of different seeds and of neighbouring or strided keys
are independent, and keys of any size differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Hexadecimal digits taken from the digest, and the range they span.
DIGITS = 12
SPAN = 1 << 48


def hash_int(key: Column, seed: int = 0) -> Column:
    """Integer in [0, 2^48) from a key."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def hash_digits(digest: Column, number: int) -> Column:
    """Integer in [0, 2^48) from the ``number``-th twelve digits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1 + DIGITS * number, DIGITS), 16, 10).cast("long")


def uniform(key: Column, seed: int = 0) -> Column:
    """Double in [0, 1) from a key."""
    return hash_int(key, seed) / F.lit(float(SPAN))


def hash_int_sql(key: str, seed: int = 0) -> str:
    """The same draw as DuckDB SQL text."""
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, {DIGITS}) AS BIGINT)"


def uniform_sql(key: str, seed: int = 0) -> str:
    return f"({hash_int_sql(key, seed)} / {float(SPAN)!r}e0)"


# The additive constants, rotations and start of md5 (RFC 1321).
_ADD = (np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32).astype(np.uint32)
_ROTATE = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
# Digests worked on at once: the arrays of a block stay in a core's cache.
BLOCK = 32768


def _digests(heads: list[bytes], tails: list[bytes]) -> list[np.ndarray]:
    """The four words of md5(head + tail), heads of one length by tails of one length."""
    h, t = len(heads[0]), len(tails[0])
    blocks = (h + t + 8) // 64 + 1
    end = b"\x80".ljust(64 * blocks - h - t - 8, b"\0") + (8 * (h + t)).to_bytes(8, "little")
    row = np.frombuffer(b"".join(x.ljust(64 * blocks, b"\0") for x in heads), dtype="<u4").reshape(len(heads), -1)
    col = np.frombuffer(b"".join(bytes(h) + x + end for x in tails), dtype="<u4").reshape(len(tails), -1)
    state = [np.full((1, 1), x, dtype=np.uint32) for x in _START]
    for block in range(blocks):
        # words of heads alone or tails alone stay one column or one row, and so do the first rounds
        words = [row[:, w:w + 1] if 4 * w + 4 <= h else col[None, :, w] if 4 * w >= h else row[:, w:w + 1] | col[None, :, w]
                 for w in range(16 * block, 16 * block + 16)]
        a, b, c, d = state
        for i in range(64):
            kind, w = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
            if kind == 0:
                f = d ^ (b & (c ^ d))
                f = f + a + (words[w] + _ADD[i])
            else:  # every word has been met, so all arrays have the block's full shape
                f = b ^ c if kind < 3 else ~d
                if kind == 1:
                    f &= d
                    f ^= c
                elif kind == 2:
                    f ^= d
                else:
                    f |= b
                    f ^= c
                f += a
                f += words[w] + _ADD[i]
            s = np.uint32(_ROTATE[kind][i % 4])
            up = f << s
            f >>= np.uint32(32) - s
            f |= up
            a, d, c, b = d, c, b, f + b
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    return state


def paired_hash_ints(heads: list[bytes], tails: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, tail numbers, first, second): the first two ``hash_digits`` of md5(head + tail)
    as heads x tails blocks, the same draws as the column expressions, many at a time."""
    by_length = lambda xs: [np.flatnonzero(n == k) for n in [np.array([len(x) for x in xs])] for k in np.unique(n)]
    for cols in by_length(tails):
        some_tails = [tails[i] for i in cols]
        step = max(1, BLOCK // len(cols))
        for rows in by_length(heads):
            for lo in range(0, len(rows), step):
                part = rows[lo:lo + step]
                a, b, c = (x.byteswap().astype(np.uint64) for x in _digests([heads[i] for i in part], some_tails)[:3])
                yield part, cols, a << np.uint64(16) | b >> np.uint64(16), (b & np.uint64(0xFFFF)) << np.uint64(32) | c
