"""Hard negatives by per-anchor full score sorts.

Rows are dealt into blocks of a bounded size, anchors into groups. Where a block and a group meet, an anchor's integer
scores with all rows of the block are sorted by score and id; the limits of each positive are found in the sorted scores
by binary search, and the first entries of other labels between them are read. The blocks' first entries are then ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .text import kept, scratch

#: Rows of a block, and anchors of a group: 64 dimensions take 4 and 4 MB.
BLOCK_ROWS, GROUP_ANCHORS = 8192, 8192
#: Anchors whose scores are held at once: 16 MB with a full block.
STEP = 256


def product(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Integer inner products, anchors by rows: by floats where these are exact, else in integers; scores that could leave
    64 bits are an error."""
    most = float(np.abs(rows.astype(float)).sum(1).max(initial=0)) * float(np.abs(anchors.astype(float)).max(initial=0))
    if most < 1 << 52:
        return (anchors.astype(float) @ rows.T.astype(float)).astype(np.int64)
    if most >= 1 << 62:  # near the bound: exactly
        most = max((sum(map(abs, r)) for r in rows.tolist()), default=0) * max((abs(x) for r in anchors.tolist() for x in r), default=0)
        if most >= 1 << 63:
            raise ValueError("scores do not fit into 64 bits")
    return anchors @ rows.T


def sorted_scores(ids: np.ndarray, rows: np.ndarray, anchors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor its number, the order of all rows by falling score, then id, and the scores in that order."""
    for lo in range(0, len(anchors), STEP):
        scores = product(rows, anchors[lo : lo + STEP])
        for i, s in enumerate(scores):
            order = np.lexsort((ids, -s))
            yield lo + i, order, s[order]


def within(score: int, low: tuple[int, int], high: tuple[int, int]) -> tuple[int, int]:
    """The least and the largest integer x with low * score <= x <= high * score, the factors being fractions."""
    return -(-low[0] * score // low[1]), high[0] * score // high[1]


def first_between(ranked: np.ndarray, other: np.ndarray, limits: tuple[int, int], k: int) -> np.ndarray:
    """Of the places `other` in the falling scores the first k whose scores are within the limits."""
    low, high = limits
    if low > high or not len(ranked) or high < int(ranked[-1]) or low > int(ranked[0]):
        return other[:0]
    start = 0 if high >= int(ranked[0]) else len(ranked) - int(np.searchsorted(ranked[::-1], high, "right"))
    some = other[np.searchsorted(other, start) :][:k]
    return some if low <= int(ranked[-1]) else some[ranked[some] >= low]


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blobs = table["blob"].to_pylist()
    return table["id"].to_numpy(), table["label"].to_numpy(), np.frombuffer(b"".join(blobs), np.int64).reshape(len(blobs), -1)


def _positives(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    found: list[tuple] = []
    if left.num_rows and right.num_rows:
        (ids, labels, rows), (anchor_ids, anchor_labels, anchors) = _arrays(left), _arrays(right)
        for label in np.unique(anchor_labels):
            mine, asked = np.flatnonzero(labels == label), np.flatnonzero(anchor_labels == label)
            for i, order, ranked in sorted_scores(ids[mine], rows[mine], anchors[asked]):
                own = anchor_ids[asked[i]]
                at = np.flatnonzero(ids[mine[order]] != own)[:k]
                found += [(own, x, s) for x, s in zip(ids[mine[order[at]]].tolist(), ranked[at].tolist(), strict=True)]
    return pa.table({n: pa.array([x[i] for x in found], pa.int64()) for i, n in enumerate(("anchor_id", "positive_id", "positive_score"))})


def _negatives(left: pa.Table, right: pa.Table, k: int, low: tuple[int, int], high: tuple[int, int]) -> pa.Table:
    found: list[tuple] = []
    if left.num_rows and right.num_rows:
        (ids, labels, rows), (anchor_ids, anchor_labels, anchors) = _arrays(left), _arrays(right)
        wanted = right["scores"].to_pylist()
        for i, order, ranked in sorted_scores(ids, rows, anchors):
            other = np.flatnonzero(labels[order] != anchor_labels[i])
            for score in wanted[i]:
                at = first_between(ranked, other, within(score, low, high), k)
                found += [(anchor_ids[i], score, x, s) for x, s in zip(ids[order[at]].tolist(), ranked[at].tolist(), strict=True)]
    return pa.table({n: pa.array([x[i] for x in found], pa.int64()) for i, n in enumerate(("anchor_id", "positive_score", "negative_id", "negative_score"))})


def hard_negatives(
    rows: DataFrame, vec_col: str, id_col: str, label_col: str, is_anchor: Column, positives: int, negatives: int, low: tuple[int, int], high: tuple[int, int], block_rows: int = BLOCK_ROWS, group_anchors: int = GROUP_ANCHORS
) -> DataFrame:
    """For each anchor and each of its first `positives` rows of the same label the first `negatives` rows of other labels
    whose score is from low to high (fractions) of the positive's.

    `rows`: an id and a label (integers) and a vector (array of long). Returns anchor_id, positive_id, rank (from 1),
    negative_id, positive_score and negative_score (inner products with the anchor). Higher scores come first, ties by
    smaller id; where there are fewer, all are returned, and anchors without positives, or positives without negatives,
    give no rows. A positive of negative score has no negatives where high exceeds low; one of score 0 has those of
    score 0. Rows with a null id, label or vector, an empty one, one that holds nulls, or of another length than most (the longest of the most
    common lengths) take no part. Rows that repeat an id count as one each, but never as positives of that id's anchor;
    of anchors that repeat an id the one of the smallest label, then vector, stands for all. A score that could leave 64
    bits is an error. Other columns are not read; an empty table gives no rows. Blocks of rows meet groups of anchors, both
    bounded and dealt by place, so that neither a label nor repeated rows fill one; a block sends on at most `negatives`
    rows for each of an anchor's positives.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    ready = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    ready = ready.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & ~F.coalesce(F.exists("vec", lambda x: x.isNull()), F.lit(True)))
    sizes = ready.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.count_if("anchor").alias("a"))
    main = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if main is None:
        return rows.sparkSession.createDataFrame([], schema)
    n_blocks, n_groups, d = -(-main.n // block_rows), max(1, -(-main.a // group_anchors)), main.d

    def packed(batches):
        for b in batches:
            flat = np.ascontiguousarray(b.column(2).flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in flat], pa.binary()), b.column(3)], names=["id", "label", "blob", "anchor"])

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    with scratch(rows.sparkSession) as spare:
        # written with their blocks, so that no row changes its block when a task is run again
        flat = spare(ready.filter(F.size("vec") == d).mapInArrow(packed, "id long, label long, blob binary, anchor boolean").withColumn("block", dealt(n_blocks)))
        single = flat.filter("anchor").groupBy("id").agg(F.min(F.struct("label", "blob")).alias("x"))
        anchors = spare(single.select("id", "x.label", "x.blob").withColumn("side", dealt(n_groups)))
        left = flat.select("id", "label", "blob", "block", every(n_groups).alias("side")).groupBy("block", "side")
        # partial() ships the functions by value
        near = left.cogroup(anchors.select("*", every(n_blocks).alias("block")).groupBy("block", "side")).applyInArrow(lambda a, b: partial(_positives, k=positives)(a, b), "anchor_id long, positive_id long, positive_score long")
        nth = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
        best = spare(near.withColumn("nth", nth).filter(F.col("nth") <= positives))
    scores = best.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores"))  # at most `positives` each
    asked = anchors.join(scores, anchors.id == scores.anchor_id).select("id", "label", "blob", "scores", "side", every(n_blocks).alias("block"))
    hard = left.cogroup(asked.groupBy("block", "side")).applyInArrow(lambda a, b: partial(_negatives, k=negatives, low=low, high=high)(a, b), "anchor_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    first = hard.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= negatives)
    return best.join(first, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
