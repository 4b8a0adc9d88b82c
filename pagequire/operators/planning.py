"""Plans under size limits: tiles over a height, greedy batches, cut rows, slots along a chapter, balanced lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxes import free_rows


def tile_starts(height: Column, tile: int, overlap: int) -> Column:
    """Starts of tiles that cover a height with an overlap; the last tile ends with it."""
    if tile <= 0 or not 0 <= overlap < tile:
        raise ValueError("the tile must be positive and the overlap smaller than it")
    last = F.greatest(F.lit(0), height - tile).cast("long")
    return F.array_distinct(F.array_append(F.sequence(F.lit(0).cast("long"), last, F.lit(tile - overlap).cast("long")), last))


def batches(rows: DataFrame, group: str, order: list[str], size: Column, most_items: int = 16, most_size: int = 6000) -> DataFrame:
    """Rows with batch, from 0: a new one begins where the next row would break a limit. A single larger row stands alone.

    The sum starts over at each batch, so a group is read in its order, by its batches of rows as they come."""
    schema = rows.withColumn("batch", F.lit(0))

    def deal(group_rows: pd.DataFrame) -> pd.DataFrame:
        group_rows = group_rows.sort_values(order, kind="stable")
        out, n, total, batch = [], 0, 0, 0
        for s in group_rows["__size"]:
            if n and (n >= most_items or total + s > most_size):
                n, total, batch = 0, 0, batch + 1
            n, total = n + 1, total + s
            out.append(batch)
        return group_rows.drop(columns="__size").assign(batch=out)

    return rows.withColumn("__size", size.cast("long")).groupBy(group).applyInPandas(deal, schema.schema)


def best_cuts(scores: DataFrame, targets: DataFrame, avoid: DataFrame, search: int, margin: int = 12) -> DataFrame:
    """The cut row per target (page_key, target): the least score plus distance in the window, the first of equals, off
    the text rows (top, bottom) and their margin; where they fill the window, the nearest free edge of a text row
    between 40 % and 200 % of the target; else the least score regardless.

    scores: page_key, row, score, at least one row on each page."""
    lengths = scores.groupBy("page_key").agg((F.max("row") + 1).alias("__length"))
    asked = targets.join(lengths, "page_key").withColumns({"__low": F.greatest(F.lit(1), F.col("target") - search), "__high": F.least(F.col("__length") - 1, F.col("target") + search)})
    window = asked.filter("__high > __low").join(scores, "page_key").filter((F.col("row") >= F.col("__low")) & (F.col("row") <= F.col("__high")))
    total = F.col("score") + 2.0 * F.abs(F.col("row") - F.col("target")) / max(1, search)
    blocked = avoid.select("page_key", (F.col("top") - margin).alias("__top"), (F.col("bottom") + margin).alias("__bottom"))
    hit = window.join(blocked, "page_key").filter((F.col("row") >= F.col("__top")) & (F.col("row") <= F.col("__bottom"))).select("page_key", "target", "row").distinct().withColumn("__hit", F.lit(True))
    judged = window.join(hit, ["page_key", "target", "row"], "left").withColumn("__total", total)
    free = F.col("__hit").isNull()
    best = judged.groupBy("page_key", "target").agg(F.min(F.when(free, F.struct("__total", "row")))["row"].alias("__free"), F.min(F.struct("__total", "row"))["row"].alias("__any"))
    edges = asked.join(blocked, "page_key").select("page_key", "target", "__length", F.explode(F.array("__top", "__bottom")).alias("edge"))
    edges = edges.filter((F.col("edge") >= 0.4 * F.col("target")) & (F.col("edge") <= F.least(F.col("__length") - 1, 2 * F.col("target"))))
    inside = edges.join(blocked, "page_key").filter((F.col("edge") > F.col("__top")) & (F.col("edge") < F.col("__bottom"))).select("page_key", "target", "edge").distinct()
    edge = edges.join(inside, ["page_key", "target", "edge"], "left_anti").groupBy("page_key", "target").agg(F.min(F.struct(F.abs(F.col("edge") - F.col("target")).alias("d"), "edge"))["edge"].alias("__edge"))
    return asked.join(best, ["page_key", "target"], "left").join(edge, ["page_key", "target"], "left").select("page_key", "target", F.coalesce("__free", "__edge", "__any", F.least("target", "__length")).alias("cut"))


def place_in_order(slots: pd.DataFrame, free: pd.DataFrame, step: int) -> list[int] | None:
    """Tops of slots (in their given order, ideal) in their free intervals, `step` apart, each the nearest to its ideal
    that leaves room for those behind; None where not all fit.

    All intervals are one table (turn, start, end). A bound for each turn is swept up from the last one: the latest top
    that its intervals allow below it. Intervals are clipped to these bounds, then to what the tops before leave."""
    turns = slots.reset_index(drop=True).reset_index(names="turn")[["turn", "slot_id"]]
    table = free.merge(turns, on="slot_id").sort_values(["turn", "start"])
    turn, low, high = (table[c].to_numpy("int64") for c in ("turn", "start", "end"))
    edges = np.searchsorted(turn, np.arange(len(slots) + 1))
    bound = np.iinfo("int64").max
    for a, b in zip(edges[-2::-1], edges[:0:-1], strict=True):
        high[a:b] = np.where(low[a:b] <= bound, np.minimum(high[a:b], bound), low[a:b] - 1)
        if not (low[a:b] <= high[a:b]).any():
            return None
        bound = int(high[a:b][low[a:b] <= high[a:b]].max()) - step
    tops: list[int] = []
    for ideal, a, b in zip(slots.ideal, edges[:-1], edges[1:], strict=True):
        start = np.maximum(low[a:b], tops[-1] + step) if tops else low[a:b]
        near = np.clip(round(ideal), start, high[a:b])[start <= high[a:b]]
        if not len(near):
            return None
        tops.append(int(near[np.lexsort((near, np.abs(near - ideal)))[0]]))
    return tops


def balanced_slots(slots: DataFrame, boxes: DataFrame, minimum_gap: int) -> DataFrame:
    """Place every page's slots (slot_id, page_key, ord, x, low, high, mark_width, mark_height, ideal) off its boxes, at
    least `minimum_gap` apart; a page whose slots cannot all be placed has none."""

    def place(key, page: pd.DataFrame, free: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"page_key": page.page_key[:0], "slot_id": page.slot_id[:0], "x": page.x[:0].astype("int64"), "y": pd.Series([], dtype="int64")})
        if not len(page):
            return empty
        page = page.sort_values("ord")
        tops = place_in_order(page, free.rename(columns={"__slot": "slot_id"}), int(page.mark_height.iloc[0]) + minimum_gap)
        return empty if tops is None else pd.DataFrame({"page_key": page.page_key, "slot_id": page.slot_id, "x": page.x, "y": tops})

    free = free_rows(slots, boxes).select(F.col("page_key").alias("__page"), F.col("slot_id").alias("__slot"), "start", "end")
    key, slot = (slots.schema[c].dataType.simpleString() for c in ("page_key", "slot_id"))
    return slots.groupBy("page_key").cogroup(free.groupBy("__page")).applyInPandas(place, f"page_key {key}, slot_id {slot}, x long, y long")


def balanced_lines(words: list[str], widths: list[float], space: float, most: float) -> list[str]:
    """Words broken into the fewest lines that fit, of these the breaks with the least squared slack; a word wider than
    a line stands alone."""
    n = len(words)
    best: list[tuple[int, float, int]] = [(0, 0.0, 0)] + [(n + 1, np.inf, 0)] * n
    for j in range(1, n + 1):
        width = -space
        for i in range(j - 1, -1, -1):
            width += widths[i] + space
            if width > most and i < j - 1:
                break
            lines, cost, _ = best[i]
            best[j] = min(best[j], (lines + 1, cost + max(0.0, most - width) ** 2, i))
    out: list[str] = []
    while n:
        i = best[n][2]
        out.append(" ".join(words[i:n]))
        n = i
    return out[::-1]


def wrap(rows: DataFrame, text: str, most: Column, glyph_width: float = 1.0) -> DataFrame:
    """Rows with lines, the text broken to a width, at `glyph_width` for each character (a measure can be put here)."""

    @F.pandas_udf("array<string>")
    def broken(texts: pd.Series, width: pd.Series) -> pd.Series:
        cut = [(t or "").split() for t in texts]
        return pd.Series([balanced_lines(w, [len(x) * glyph_width for x in w], glyph_width, m) for w, m in zip(cut, width, strict=True)])

    return rows.withColumn("lines", broken(F.col(text), most.cast("double")))
