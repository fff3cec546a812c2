"""Exact top-k by inner product with no-random-access aggregation.

A block of vectors is a set of sorted lists, one per dimension, best contribution first: by
descending component where the query's component is positive, ascending where it is negative.
The lists are read from the top in steps.  After a step every vector has a lower bound (components
not yet read count as the worst of their list) and an upper bound (they count as the last value
read), and a vector whose upper bound is below the query's k-th best lower bound cannot qualify.
Reading stops when only few can still qualify; their scores are then resolved.

The k-th best of earlier blocks is the starting bound of the next one.  All queries of a block of
queries advance together, so a step is a few matrix products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Vectors in a block of candidates, and queries in a block of queries, at most.
BLOCK = 8192
QUERIES = 1024
#: Shares of the lists that are read before the bounds are compared.
STEPS = (0.125, 0.25, 0.5)


def exact(q: np.ndarray, c: np.ndarray) -> bool:
    """Whether sums of products of these whole numbers are exact in double precision."""
    if not q.size or not c.size:
        return True
    return float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2.0 ** 53


def best(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int,
         floor: np.ndarray, steps=STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of all that can be among the k best of each query:
    at least its k best here (ties included), of those that reach ``floor``."""
    n, d = c.shape
    if not exact(q, c):  # whole numbers of any size; no lists are cut short
        whole = np.frompyfunc(int, 1, 1)
        score = whole(q) @ whole(c).T
        rows, cols = np.nonzero(qid[:, None] != cid[None, :])
        return rows, cols, np.array([min(max(s, -2 ** 63), 2 ** 63 - 1) for s in score[rows, cols]], np.int64)
    up = np.sort(c, axis=0)  # the lists: ascending from the top, descending from the end
    qp, qn = np.maximum(q, 0.0), np.minimum(q, 0.0)
    own = qid[:, None] == cid[None, :]
    alive = np.arange(n)
    bound = floor.astype(float).copy()
    open_ = np.ones(len(q), bool)
    for share in steps:
        depth = int(n * share)
        if depth < max(2 * k, 16) or not len(alive):
            continue
        last_p, last_n = up[n - depth], up[depth - 1]  # last values read of either kind of list
        x = c[alive]
        seen_p, seen_n = x >= last_p, x <= last_n
        low = qp @ np.where(seen_p, x, up[0]).T + qn @ np.where(seen_n, x, up[-1]).T
        low[own[:, alive]] = -np.inf
        if low.shape[1] > k:
            bound = np.maximum(bound, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
        high = qp @ np.where(seen_p, x, last_p).T + qn @ np.where(seen_n, x, last_n).T
        open_ = (high >= bound[:, None]).any(axis=0)
        alive = alive[open_]
        if len(alive) < max(4 * k, n // 16):
            break
    score = q @ c[alive].T
    score[own[:, alive]] = -np.inf
    if score.shape[1] > k:
        bound = np.maximum(bound, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
    rows, cols = np.nonzero((score >= bound[:, None]) & np.isfinite(score))
    return rows, alive[cols], score[rows, cols].astype(np.int64)


def smallest_ids(rows, ids, scores, k: int) -> np.ndarray:
    """Positions of the k best of each row: higher score first, then smaller id."""
    order = np.lexsort((ids, -scores, rows))
    r = rows[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    rank = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
    return order[rank < k]


def scaled(vectors, scale: int) -> np.ndarray:
    """Whole numbers floor(scale * x) as doubles; rows are given vectors of finite numbers."""
    return np.floor(np.clip(np.stack([np.asarray(v, dtype=np.float64) for v in vectors]), -1e300, 1e300) * scale)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each vector whose id is divisible by ``every`` the
    ``k`` other vectors of highest inner product, ties to the smaller id.

    Components become floor(``scale`` * x).  Rows with a null id, a null vector, or null or
    non-finite components take no part, nor do vectors of another length than the query's.
    Scores beyond a bigint stop at its ends.  Repeated rows are candidates each; a query that is repeated is answered once per different
    vector.  Fewer than ``k`` others give all; an empty table an empty result.

    Candidates are packed into blocks where they are read, without a shuffle, so neither an id nor
    a vector that recurs makes a block large.  Every block of candidates meets every block of
    queries in a task of its own; per pair at most ``k`` rows a query leave it."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & whole) \
        .select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))

    def pack(batches):
        for b in batches:
            b = b.assign(size=[len(x) for x in b["v"]])
            for size, part in b.groupby("size"):
                for s in range(0, len(part), block):
                    p = part.iloc[s:s + block]
                    yield pd.DataFrame({"size": [int(size)], "ids": [p["vec_id"].to_numpy(np.int64).tobytes()],
                                        "data": [scaled(p["v"], scale).tobytes()], "n": [len(p)]})

    packed = "size int, ids binary, data binary, n bigint"
    cands = cut(rows.mapInPandas(pack, packed))
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    asked = cut(queries.withColumn("slot", F.xxhash64("vec_id", "v")))
    n = asked.count()
    slots = -(-n // query_block) or 1

    def pack_queries(key, part):
        out = []
        for size, p in part.groupby(part["v"].map(len)):
            for s in range(0, len(p), query_block):
                q = p.iloc[s:s + query_block]
                out.append((int(size), q["vec_id"].to_numpy(np.int64).tobytes(), scaled(q["v"], scale).tobytes(), len(q)))
        return pd.DataFrame(out, columns=["size", "ids", "data", "n"])

    blocks = asked.withColumn("slot", F.pmod("slot", F.lit(slots))).groupBy("slot").applyInPandas(pack_queries, packed)
    # a number for each block of queries; each block of candidates is dealt to every number
    blocks = cut(blocks.select("size", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"),
                               F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int").alias("slot")))
    lanes = 16
    left = cands.select("size", "ids", "data", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int").alias("lane"),
                        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    right = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    pairs = left.join(right, ["size", "slot", "lane"])

    def search(batches):
        import xxhash

        floors: dict[bytes, np.ndarray] = {}
        for b in batches:
            for size, ids, data, q_ids, q_data in zip(b["size"], b["ids"], b["data"], b["q_ids"], b["q_data"]):
                c, q = (np.frombuffer(x).reshape(-1, size) for x in (data, q_data))
                cid, qid = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                if len(floors) > 64:
                    floors.clear()
                digest = np.array([xxhash.xxh64_intdigest(x.tobytes()) >> 1 for x in q], np.int64)
                floor = floors.get(q_ids)
                if floor is None:
                    floor = floors[q_ids] = np.full(len(q), -np.inf)
                i, j, score = best(q, qid, c, cid, k, floor)
                keep = smallest_ids(i, cid[j], score, k)
                i, j, score = i[keep], j[keep], score[keep]
                got = np.bincount(i, minlength=len(q))
                worst = np.full(len(q), np.inf)
                np.minimum.at(worst, i, score.astype(float))
                floors[q_ids] = np.where(got >= k, np.maximum(floor, worst), floor)
                yield pd.DataFrame({"query_id": qid[i], "query": digest[i], "vec_id": cid[j], "score": score})

    from pyspark.sql.window import Window

    found = pairs.select("size", "ids", "data", "q_ids", "q_data").mapInPandas(
        search, "query_id bigint, query bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
