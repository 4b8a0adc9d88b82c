"""Mixing overlapping sources to target weights by min-cost flow.

Documents are counted by membership pattern (the set of sources that hold them). A small flow network routes the token
capacity of the patterns to the quotas of the sources; a pattern's r-th repetition is an arc of cost r, so that costs are
convex and nothing is repeated while fresh text is left. Documents are then taken in a seeded order until their
pattern's flow is used up.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .text import byte_texts, map_rows

#: Sources and patterns are aggregated before they come to the driver; more of them than this is an error, never a cut.
MAX_PATTERNS = 100_000
#: Seeded order is kept in this many ranges of each pattern, so that no task sorts a whole pattern.
BUCKETS = 4096


def shares(sizes: dict[str, int], weights: dict[str, float], total: float, most: float) -> dict[str, float]:
    """Split `total` by weight; a share stops at `most` times its size, and the excess goes to the others by weight."""
    left, targets = {s for s in sizes if weights[s] > 0}, dict.fromkeys(sizes, 0.0)
    rest = float(total)
    while left:
        per = rest / sum(weights[s] for s in sorted(left))
        full = [s for s in sorted(left) if per * weights[s] > most * sizes[s]]
        if not full:
            targets |= {s: per * weights[s] for s in left}
            break
        for s in full:
            targets[s] = most * sizes[s]
            rest -= targets[s]
            left.discard(s)
    return targets


def route(capacity: dict[tuple[str, ...], int], quota: dict[str, int], repeats: int) -> dict[tuple[str, ...], dict[str, int]]:
    """Min-cost flow from patterns to sources. Only the arcs into patterns cost anything (r for the r-th repetition), so
    opening them level by level and augmenting along shortest paths after each level is a least-cost flow."""
    patterns = sorted(capacity)
    flow = {p: dict.fromkeys(p, 0) for p in patterns}
    used, room, need = dict.fromkeys(patterns, 0), dict.fromkeys(patterns, 0), dict(quota)
    holders: dict[str, list[tuple[str, ...]]] = {}
    for p in patterns:
        for s in p:
            holders.setdefault(s, []).append(p)
    for _ in range(repeats):
        for p in patterns:
            room[p] += capacity[p]
        for p in patterns:
            while used[p] < room[p]:
                came: dict = {p: None}
                queue, end = deque([p]), None
                while queue and end is None:  # pattern -> source freely, source -> pattern back along flow
                    x = queue.popleft()
                    if isinstance(x, tuple):
                        for s in x:
                            if s not in came:
                                came[s] = x
                                if need[s] > 0:
                                    end = s
                                    break
                                queue.append(s)
                    else:
                        for q in holders[x]:
                            if q not in came and flow[q][x] > 0:
                                came[q] = x
                                queue.append(q)
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()  # p, s, q, s, ...
                most = min([room[p] - used[p], need[end], *(flow[path[i + 1]][path[i]] for i in range(1, len(path) - 1, 2))])
                for i in range(0, len(path) - 1, 2):
                    flow[path[i]][path[i + 1]] += most
                    if i:
                        flow[path[i]][path[i - 1]] -= most
                used[p] += most
                need[end] -= most
    return flow


def text_sizes(docs: DataFrame, keep: list[str], text_col: str, size_col: str) -> DataFrame:
    """The kept columns and the number of words of each whole text; a null text has none."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{size_col}` long"
    work = lambda b: dict(zip(keep, b.columns)) | {size_col: [len(t.split()) if t else 0 for t in byte_texts(b.column(len(keep)))]}
    return map_rows(docs.select(*keep, text_col), work, schema)


def seeded(seed: int, *cols: Column) -> Column:
    """A reproducible position in 0 .. 2**60 from the seed and the values, by md5, so that other engines can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])), 1, 15), 16, 10).cast("long")


def mix(members: DataFrame, id_col: str, size_col: str, sources: Column, quotas: dict[str, int], max_repeats: int, seed: int) -> DataFrame:
    """Take documents so that each source's quota of tokens is met.

    `members`: rows with an id, a size (long) and, by the expression `sources`, the sorted array of the sources that hold
    the document; `quotas`: tokens wanted of each source. Returns the rows with copies (how often the document is taken)
    and taken (its size times that): whole copies only, at most `max_repeats`, so that a pattern may miss its flow by
    half a document. Column names beginning with two underscores, `copies` and `taken` are reserved.
    Rows with an empty array or of size 0 take 0. Repeated rows with one id stand in the same place of the order; each
    counts by itself. Tables without rows give no rows. What reaches the driver is one row per pattern.
    """
    rows = members.withColumns({"__pattern": F.to_json(sources), "__seed": seeded(seed, F.col(id_col)), "__size": F.coalesce(F.col(size_col).cast("long"), F.lit(0))})
    rows = rows.withColumn("__bucket", F.shiftright("__seed", 48).cast("int"))  # 60 bits: BUCKETS ranges
    sums = rows.groupBy("__pattern", "__bucket").agg(F.sum("__size").alias("__sum"))
    sums = sums.withColumn("__before", F.sum("__sum").over(W.partitionBy("__pattern").orderBy("__bucket")) - F.col("__sum"))
    totals = sums.groupBy("__pattern").agg(F.sum("__sum").alias("n"), F.from_json("__pattern", "array<string>").alias("p")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    capacity = {tuple(r.p): int(r.n) for r in totals if r.p}
    flow = route(capacity, {s: quotas.get(s, 0) for p in capacity for s in p}, max_repeats)
    plan = []
    for r in totals:
        want = sum(flow.get(tuple(r.p), {}).values())
        full, part = divmod(want, r.n) if r.n else (0, 0)
        plan.append((r["__pattern"], min(full, max_repeats), part if full < max_repeats else 0))
    spark = members.sparkSession
    wanted = spark.createDataFrame(plan, "__pattern string, __full long, __part long") if plan else spark.createDataFrame([], "__pattern string, __full long, __part long")
    # ranges of the order: wholly inside the pattern's last partial pass, wholly outside, or the one where it ends
    ranges = sums.join(F.broadcast(wanted), "__pattern").select("__pattern", "__bucket", "__full", "__part", "__before", (F.col("__before") + F.col("__sum")).alias("__after"))
    rows = rows.join(ranges, ["__pattern", "__bucket"], "left")
    edge = (F.col("__before") < F.col("__part")) & (F.col("__after") > F.col("__part"))
    within = F.sum("__size").over(W.partitionBy("__pattern", "__bucket").orderBy("__seed", id_col, "__size").rowsBetween(W.unboundedPreceding, -1))
    ends = rows.filter(edge).withColumn("__more", 2 * (F.col("__before") + F.coalesce(within, F.lit(0))) + F.col("__size") <= 2 * F.col("__part"))  # the nearer side of the quota
    plain = rows.filter(~F.coalesce(edge, F.lit(False))).withColumn("__more", F.coalesce(F.col("__after") <= F.col("__part"), F.lit(False)))
    both = ends.unionByName(plain)
    copies = F.coalesce(F.col("__full"), F.lit(0)) + F.col("__more").cast("long")
    return both.select(*members.columns, copies.cast("int").alias("copies"), (F.col("__size") * copies).alias("taken"))
