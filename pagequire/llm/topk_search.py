"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Rows are dealt into blocks of a bounded size. In a block every dimension has its list sorted by value; a round reads the
lists some ranks deeper from both ends, scores the rows met for the first time, and ends for each query whose k-th best
score is above its threshold, the score that a row made of the values at the current depth would have. Queries are
handled in groups of a bounded size, so that the sorted lists of a block serve a whole group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .text import kept

#: Rows of a block, and queries of a group: 64 dimensions take 4 and 8 MB.
BLOCK_ROWS, GROUP_QUERIES = 8192, 16384


def matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int64).reshape(len(blobs), -1)


def threshold_search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query the k best (id, score) of these rows but its own, ties to smaller ids: query index, id, score.
    Scores and ranks are kept in one float64 where that is exact, that is while scores stay below 2**52 over the number of
    rows; else in integers. A score that could leave 64 bits is an error."""
    n, dims = rows.shape
    most = float(np.abs(rows.astype(float)).sum(1).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0))
    if most * n >= 1 << 51:  # near a bound: exactly
        most = max(map(int, np.abs(rows.astype(object)).sum(1)), default=0) * max(abs(int(x)) for x in (queries.max(initial=0), queries.min(initial=0)))
    if most >= 1 << 63:
        raise ValueError("scores do not fit into 64 bits")
    if most * n >= 1 << 52:
        return integer_search(ids, rows.astype(np.int64), query_ids, queries.astype(np.int64), k)
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order].astype(np.float64)
    lists = np.argsort(rows, axis=0, kind="stable")
    values = np.take_along_axis(rows, lists, 0)
    plus, minus = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    whole = queries.astype(np.float64)
    seen, depth, step = np.zeros(n, bool), 0, max(1, n // 64)
    active = np.arange(len(queries))
    best = np.full((len(queries), k), -np.inf)  # score * n + how early the id comes: larger is better, never equal
    own = np.searchsorted(ids, query_ids)
    own = np.where((own < n) & (ids[np.minimum(own, n - 1)] == query_ids), own, -1)
    last = np.searchsorted(ids, query_ids, side="right")
    while len(active) and depth < n:
        reached = min(n, depth + step)
        fresh = np.unique(np.concatenate([lists[depth:reached].ravel(), lists[n - reached : n - depth].ravel()]))
        fresh = fresh[~seen[fresh]]
        seen[fresh] = True
        for lo in range(0, len(active), 512):
            some = active[lo : lo + 512]
            if not len(fresh):
                break
            got = (whole[some] @ rows[fresh].T) * n + (n - 1 - fresh)
            for i in np.flatnonzero(own[some] >= 0):  # its own row, and rows repeated under its id
                got[i, (fresh >= own[some[i]]) & (fresh < last[some[i]])] = -np.inf
            if got.shape[1] > k:
                got = np.partition(got, got.shape[1] - k, axis=1)[:, -k:]
            both = np.concatenate([best[some], got], axis=1)
            best[some] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        depth = reached
        if depth < n:
            bound = plus[active] @ values[n - 1 - depth] + minus[active] @ values[depth]
            kth = best[active].min(axis=1)
            active = active[~(np.floor(kth / n) > bound)]  # at equality an unseen row could still win by its smaller id
        step *= 2
    q, j = np.nonzero(best > -np.inf)
    score = np.floor(best[q, j] / n)
    at = (n - 1 - (best[q, j] - score * n)).astype(np.int64)
    return q, ids[at], score.astype(np.int64)


def integer_search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same in 64-bit integers, query by query: the lists are read deeper until the threshold is below the k-th best."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    lists = np.argsort(rows, axis=0, kind="stable")
    values, n = np.take_along_axis(rows, lists, 0), len(ids)
    out = []
    for i, (own, query) in enumerate(zip(query_ids, queries, strict=True)):
        helps = np.flatnonzero(query)  # of every other list only one end raises the score
        best, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen, depth = np.zeros(n, bool), 0
        seen[ids == own] = True
        while depth < n:
            reached = min(n, max(1, 2 * depth))
            ends = [lists[n - reached : n - depth, d] if query[d] > 0 else lists[depth:reached, d] for d in helps] if len(helps) else [lists[depth:reached, 0]]
            fresh = np.unique(np.concatenate(ends))
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            best, at, depth = np.concatenate([best, rows[fresh] @ query]), np.concatenate([at, fresh]), reached
            first = np.lexsort((at, -best))[:k]
            best, at = best[first], at[first]
            if depth < n and len(best) == k and best[-1] > np.where(query > 0, query * values[n - 1 - depth], query * values[depth]).sum():
                break
        out.append((np.full(len(at), i), ids[at], best))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([empty, *[x[j] for x in out]]).astype(np.int64) for j in range(3))


def top_k(rows: DataFrame, vec_col: str, id_col: str, is_query: Column, k: int, block_rows: int = BLOCK_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """The k best inner products of every query row with every other row.

    `rows`: an id (long) and a vector (array of long). Returns query_id, rank (from 1), the candidate's id and the score,
    ties to the smaller id; all candidates where there are fewer than k. Vectors that are null, hold nulls or are empty
    take no part; nor do those of another length than most (the longest of the most common lengths). Rows that repeat an
    id count as one candidate each, but never as a candidate of that id's query; of query rows that repeat an id one
    gives its answers, the first by its vector's bytes. A score that could leave 64 bits is an error. An empty table gives no rows. Blocks of rows meet groups of queries, both of bounded size; a block sends on
    k rows a query.
    """
    from functools import partial

    ready = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), is_query.alias("query")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.coalesce(F.exists("vec", lambda x: x.isNull()), F.lit(True)))
    lengths = ready.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.count(F.when(F.col("query"), 1)).alias("q"))
    main = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if main is None:
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    n_blocks, n_groups = max(1, -(-main.n // block_rows)), max(1, -(-main.q // group_queries))
    ready = ready.filter(F.size("vec") == main.d)

    def packed(batches):
        for b in batches:
            vec = b.column(1)
            flat = np.ascontiguousarray(vec.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, main.d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in flat], pa.binary()), b.column(2)], names=["id", "blob", "query"])

    # written with their places, by which they are dealt: rows that repeat an id stand in different blocks
    flat = kept(ready.mapInArrow(packed, "id long, blob binary, query boolean").withColumn("place", F.monotonically_increasing_id()))
    here = F.pmod(F.xxhash64("place", F.lit(1)), F.lit(n_blocks)).cast("int")
    side = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(n_groups)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = flat.select("id", "blob", here.alias("block")).select("*", every(n_groups).alias("side"))
    asked = flat.filter("query").groupBy("id").agg(F.min("blob").alias("blob"))
    right = asked.select("id", "blob", side.alias("side")).select("*", every(n_blocks).alias("block"))

    def meet(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        ids, rows = left["id"].to_numpy(), matrix(left["blob"].to_pylist())
        asked, queries = right["id"].to_numpy(), matrix(right["blob"].to_pylist())
        q, found, score = threshold_search(ids, rows, asked, queries, k)
        return pa.table({"query_id": asked[q], "vec": found, "score": score})

    # the function is partial over k only, so that it is shipped by value
    met = left.groupBy("block", "side").cogroup(right.groupBy("block", "side")).applyInArrow(lambda a, b: partial(meet, k=k)(a, b), "query_id long, vec long, score long")
    ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), F.col("vec").alias(id_col), "score")
