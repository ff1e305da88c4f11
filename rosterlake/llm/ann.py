"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, then float.

Vectors and queries are dealt into blocks; each pair of a query block and a
vector block is one task, which goes through it in tiles.  In a tile the int8
product gives every inner product up to a bound: with x = s*q + e per vector,
|x.y - s_x s_y q_x.q_y| <= |e_x||y| + |s_x q_x||e_y|.  A pair survives unless its
upper bound is under the k-th best lower bound that its query has met, in this
tile or one before.  Survivors are recomputed in double precision, and heaps
merge the tasks' best.  So the result is exact.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows with a null id; every row is a candidate of
every query but itself, so rows that repeat an id, or a whole row, count each,
and each row that asks gets its own answers; vectors of another length than the
query's are not its candidates; ties go to the smaller id; a query with fewer
candidates gets them all; other columns are dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import cut

#: Rows of a task's blocks: each vector is sent once for QUERY_BLOCK queries, each query once for VECTOR_BLOCK vectors.
QUERY_BLOCK, VECTOR_BLOCK = 16_384, 32_768
#: Rows of a tile: 2048 x 8192 float32 products take 64 MB.
QUERY_TILE, VECTOR_TILE = 2048, 8192


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(key, vec_id, v, copies): the distinct rows that take part, and how often each is there."""
    v = F.col(vec_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(sound)
    return rows.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).select(F.xxhash64("vec_id", "v").alias("key"), "vec_id", "v", "copies")


def _int8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 parts as float32 (their products are exact below 2**24 up to 1,040 components), scales, |s q|, |e|."""
    s = np.abs(x).max(axis=1) / 127.0
    s[s == 0] = 1.0
    q = np.rint(x / s[:, None])
    kept = q * s[:, None]
    return q.astype(np.float32 if x.shape[1] <= 1040 else np.float64), s, np.linalg.norm(kept, axis=1), np.linalg.norm(x - kept, axis=1)


def tile(queries: tuple, vectors: tuple, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row) that survive, and each query's k-th best lower bound so far; ``own``: pairs that don't count."""
    qa, sa, na, ea = queries
    qb, sb, nb, eb = vectors
    dots = (qa @ qb.T).astype(np.float64) * sa[:, None] * sb[None, :]
    bound = (ea[:, None] * (nb + eb)[None, :] + na[:, None] * eb[None, :]) * (1 + 1e-9) + 1e-12 * np.abs(dots)
    low = np.where(own, -np.inf, dots - bound)
    if low.shape[1] >= k:
        floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, -k])
    i, j = np.nonzero(~own & (dots + bound >= floor[:, None]))
    return i, j, floor


def block_best(queries: np.ndarray, q_keys: np.ndarray, vectors: np.ndarray, v_keys: np.ndarray, v_ids: np.ndarray, copies: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of each query's best k rows in a block; a row that is there several times is listed as often, but once less for itself."""
    out = []
    parts = [(low, _int8(vectors[low : low + VECTOR_TILE])) for low in range(0, len(vectors), VECTOR_TILE)]
    for first in range(0, len(queries), QUERY_TILE):
        x = queries[first : first + QUERY_TILE]
        coded, floor, found = _int8(x), np.full(len(x), -np.inf), []
        for low, part in parts:
            same = q_keys[first : first + QUERY_TILE, None] == v_keys[None, low : low + VECTOR_TILE]
            i, j, floor = tile(coded, part, same & (copies[low : low + VECTOR_TILE] == 1)[None, :], floor, k)
            score = np.zeros(len(i))
            for at in range(0, len(i), 1 << 16):  # bounded memory where bounds are loose
                piece = slice(at, at + (1 << 16))
                score[piece] = (x[i[piece]] * vectors[low + j[piece]]).sum(axis=1)
            times = np.minimum(copies[low + j] - same[i, j], k)
            i, j, score = (np.repeat(c, times) for c in (i, j + low, score))
            found.append((i, j, score))
            i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((v_ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            found = [(i[rank < k], j[rank < k], score[rank < k])]
        out.append((found[0][0] + first, *found[0][1:]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by inner product, exact.

    ``is_query`` is a condition on a column vec_id.  The work is n_queries x
    n_vectors products; what is shuffled is each vector once per query block and
    each query once per vector block.
    """
    all_rows = cut(usable(vectors, id_col, vec_col).withColumn("dim", F.size("v")))
    n, nq = all_rows.agg(F.count("*"), F.count_if(is_query)).first()
    b, a = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-nq // QUERY_BLOCK))
    # Small tables still make a task for each core.
    cores = all_rows.sparkSession.sparkContext.defaultParallelism
    b = max(b, min(-(-n // VECTOR_TILE), -(-cores // a)))
    spread = F.xxhash64(F.lit(3), "key")
    left = all_rows.filter(is_query).select(F.col("dim").cast("int"), F.pmod(spread, F.lit(a)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("vb"), "key", "vec_id", "copies", "v")
    right = all_rows.select(F.col("dim").cast("int"), F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("qb"), F.pmod(spread, F.lit(b)).cast("int").alias("vb"), "key", "vec_id", "copies", "v")

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"query": [], "query_id": [], "asked": [], "vec_id": [], "score": []})
        x, y = (np.stack(f["v"].to_numpy()).astype(np.float64) for f in (q, v))
        ids = v["vec_id"].to_numpy()
        i, j, score = block_best(x, q["key"].to_numpy(), y, v["key"].to_numpy(), ids, v["copies"].to_numpy(), k)
        return pd.DataFrame({"query": q["key"].to_numpy()[i], "query_id": q["vec_id"].to_numpy()[i], "asked": q["copies"].to_numpy()[i], "vec_id": ids[j], "score": score})

    keys = ("dim", "qb", "vb")
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query long, query_id long, asked long, vec_id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap, out = None, [], []

        def done() -> None:
            ranked = sorted(heap, key=lambda t: (-t[0], -t[1]))
            out.extend((*now[1:], rank, -v, s) for rank, (s, v) in enumerate(ranked, 1))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "asked", "rank", "vec_id", "score"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("query", "query_id", "asked", "vec_id", "score")]
            for key, query, asked, v, s in zip(*columns, strict=True):
                if now is None or key != now[0]:
                    if now is not None:
                        done()
                    now, heap = (key, query, asked), []
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapq.heapreplace(heap, (s, -v))
            if out:
                yield batch_of()
        if now is not None:
            done()
            yield batch_of()

    merged = best.repartition("query").sortWithinPartitions("query").mapInArrow(merge, "query_id long, asked long, rank int, vec_id long, score double")
    # A row that is there several times asks as often.
    return merged.withColumn("asked", F.explode(F.sequence(F.lit(1).cast("long"), F.col("asked")))).select("query_id", "rank", "vec_id", "score")
