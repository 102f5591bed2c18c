"""Nearest neighbours by a block matrix join with quantised tiles.

Queries and candidates are dealt into a grid of tiles: every query block meets every
candidate block once, each by the shuffle of its tile's key, so no side is broadcast. Unit
vectors are rounded to int8 with a scale per vector; a tile's products of these integers
are exact, and the lengths of the rounding remainders bound how far each is from the true
cosine. Pairs whose upper bound reaches the k-th best lower bound survive; they are
recomputed in double precision on the original vectors, and heaps keep k per query and
tile, which are merged per query. The result is exact.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do rows without id; vectors of another length than the query's are not
its candidates. Rows that repeat id and vector are one row; a row with the query's id is
not its candidate. Ties go to the smaller id. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows of a tile's sides. A tile holds both sides and one strip of products.
QUERY_BLOCK, CANDIDATE_BLOCK, STRIP = 2048, 8192, 256


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors (as float32, in which products of tiles are exact up
    to 1040 dimensions), scales, lengths of the coded vectors and of the remainders."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = code * scale[:, None]
    rest = unit - coded
    return code, scale, np.sqrt((coded * coded).sum(axis=1)), np.sqrt((rest * rest).sum(axis=1))


def tile_best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> list[tuple[int, int, int, float]]:
    """(query's place, query id, row id, cosine): the k best of one tile, exactly."""
    # beyond 1040 dimensions a float32 no longer holds every integer product
    kind = np.float32 if queries.shape[1] <= 1040 else np.float64
    qc, qs, ql, qr = quantised(queries)
    rc, rs, rl, rr = quantised(rows)
    rc = rc.astype(kind).T
    qn, rn = (np.sqrt((x * x).sum(axis=1)) for x in (queries, rows))
    out = []
    for at in range(0, len(queries), STRIP):
        s = slice(at, at + STRIP)
        product = (qc[s].astype(kind) @ rc).astype(np.float64) * qs[s, None] * rs[None, :]
        error = ql[s, None] * rr[None, :] + qr[s, None] * (rl + rr)[None, :] + 1e-9
        own = query_ids[s, None] == row_ids[None, :]
        low = np.where(own, -np.inf, product - error)
        high = np.where(own, -np.inf, product + error)
        count = low.shape[1]
        floor = np.partition(low, count - k, axis=1)[:, count - k] if count > k else np.full(len(low), -np.inf)
        for i in range(len(low)):
            left = np.flatnonzero((high[i] >= floor[i]) & ~own[i])
            # row by row sums, so that equal vectors give equal scores in every tile
            exact = (rows[left] * queries[at + i]).sum(axis=1) / (rn[left] * qn[at + i])
            best = heapq.nsmallest(k, zip((-exact).tolist(), row_ids[left].tolist()))
            out += [(at + i, int(query_ids[at + i]), r, -x) for x, r in best]
    return out


def _tiles(k: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        tag = table.column("tag").to_numpy()
        probe = table.column("probe").to_numpy(zero_copy_only=False).astype(bool)
        lists = table.column("vector").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        first = np.cumsum(size) - size
        out = []
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            vectors = flat[first[at][:, None] + np.arange(d)].astype(np.float64)
            # powers of two leave the cosine as it is and keep squares in range
            vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
            q, r = probe[at], ~probe[at]
            if q.any() and r.any():
                tags = tag[at][q]
                out += [(int(tags[i]), *rest) for i, *rest in tile_best(vectors[q], ids[at][q], vectors[r], ids[at][r], k)]
        return pa.table({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate(
            (("tag", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

    return run


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of largest cosine."""
    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
        return df.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).distinct()

    candidates, queries = usable(candidates), usable(queries)
    rows = max(1, -(-candidates.count() // CANDIDATE_BLOCK))
    columns = max(1, -(-queries.count() // QUERY_BLOCK))
    tag = F.xxhash64("id", "vector")
    place = lambda n: F.pmod(F.xxhash64(tag), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    probes = queries.select("id", "vector", tag.alias("tag"), F.lit(True).alias("probe"), place(columns).alias("c"), every(rows).alias("r"))
    blocks = candidates.select("id", "vector", tag.alias("tag"), F.lit(False).alias("probe"), place(rows).alias("r"), every(columns).alias("c"))
    tiles = probes.unionByName(blocks).groupBy("r", "c").applyInArrow(_tiles(k), "tag long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    return (tiles.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op9_query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
