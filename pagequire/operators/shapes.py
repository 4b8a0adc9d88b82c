"""Shapes and their records: strokes, chords of balloons, saved layouts, marks that stand too close, batches of crops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import half_even

# fixed values: a mask counts from here; a stroke that crosses a page is this long and this thin or this empty
STROKE = {"mask": 8, "longest": 384, "thin": 5.0, "fill": 0.22}


def crossing_strokes(points: DataFrame, stroke: str, x: str, y: str, value: str) -> DataFrame:
    """stroke, width, height, filled and crossing (long, and very thin or nearly empty) of masks given by their points,
    each once; masks without a point that counts have no row."""
    box = points.filter(F.col(value) > STROKE["mask"]).groupBy(stroke).agg((F.max(x) - F.min(x) + 1).alias("width"), (F.max(y) - F.min(y) + 1).alias("height"), F.count("*").alias("filled"))
    longest, shortest = F.greatest("width", "height"), F.least("width", "height")
    thin = longest / shortest >= STROKE["thin"]
    return box.withColumn("crossing", (longest >= STROKE["longest"]) & (thin | (F.col("filled") / (F.col("width") * F.col("height")) < STROKE["fill"])))


def chords(shape: Column, width: Column, height: Column, lines: Column, line_height: Column, padding: Column) -> Column:
    """left and right of each of a text's lines inside a balloon, for an ellipse, a diamond or else a rectangle; empty if
    the lines are too high or one has no room."""
    n = F.greatest(F.lit(1), lines)
    total = F.greatest(F.lit(1.0), line_height * n)
    pad = F.greatest(F.lit(2), F.least(padding, F.greatest(F.lit(2), F.floor(F.least(width, height) / 5))))
    rx, ry = (F.greatest(F.lit(1.0), c / 2 - pad) for c in (width, height))

    def chord(i: Column) -> Column:
        away = F.abs((i + 0.5) * line_height - total / 2) / ry
        round_ = F.when(away < 1, F.sqrt(1 - F.least(F.lit(0.999), away * away))).otherwise(0.0)
        share = F.when(shape == "ellipse", round_).when(shape == "diamond", F.greatest(F.lit(0.0), 1 - away)).otherwise(1.0)
        left = F.greatest(F.lit(0), half_even(width / 2 - F.greatest(F.lit(8.0), rx * share)))
        return F.struct(left.alias("left"), (width - left).cast("long").alias("right"))

    every = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), chord)
    fits = (total <= height) & F.forall(every, lambda c: c["right"] > c["left"] + 4)
    return F.when(fits, every).otherwise(F.slice(every, 1, 0))


def bezier(a: Column, b: Column, c: Column, d: Column, t: Column) -> Column:
    """A coordinate of a cubic curve at t."""
    u = 1 - t
    return u * u * u * a + 3 * u * u * t * b + 3 * u * t * t * c + t * t * t * d


def valid_layout(signature: Column, expected: Column, lines: Column, spans: Column, width: Column, height: Column, font_size: Column, overflow: Column) -> Column:
    """Whether a saved layout still holds: same signature, no overflow, a span inside the width for each line, a size in
    bounds. `spans`: structs of two numbers."""
    inside = F.forall(spans, lambda s: (s["left"] >= 0) & (s["left"] < s["right"]) & (s["right"] <= width))
    whole = (F.size(lines) > 0) & (F.size(lines) == F.size(spans)) & F.forall(lines, lambda x: x.isNotNull())
    good = (signature == expected) & ~F.coalesce(overflow, F.lit(False)) & whole & inside & (width > 0) & (height > 0) & font_size.between(4, 500)
    return F.coalesce(good, F.lit(False))


def carried_layouts(rows: DataFrame, valid: str, was: tuple[str, str], now: tuple[str, str], at: tuple[str, str]) -> DataFrame:
    """Rows with moved, and the place of a valid layout moved as far as its box."""
    moved = F.coalesce(F.col(valid) & ~(F.col(was[0]).eqNullSafe(F.col(now[0])) & F.col(was[1]).eqNullSafe(F.col(now[1]))), F.lit(False))
    rows = rows.withColumn("moved", moved)
    return rows.withColumns({a: F.when(F.col("moved"), F.col(a) + F.col(n) - F.col(w)).otherwise(F.col(a)) for a, n, w in zip(at, now, was, strict=True)})


def clear_of(marks: DataFrame, fixed: DataFrame, gap: int, cell: int = 4096) -> DataFrame:
    """Marks (chapter_id, mark, y, height) at least `gap` away from everything fixed (chapter_id, low, high) in their
    chapter. Both meet by cells of y."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))).alias("cell")
    mine = marks.select("chapter_id", "mark", F.col("y").alias("__y"), (F.col("y") + F.col("height")).alias("__end"), cells(F.col("y") - gap, F.col("y") + F.col("height") + gap))
    other = fixed.filter("low < high").select("chapter_id", "low", "high", cells(F.col("low"), F.col("high"))).distinct()
    near = mine.join(other, ["chapter_id", "cell"]).filter((F.col("__end") + gap > F.col("low")) & (F.col("__y") < F.col("high") + gap)).select("chapter_id", "mark").distinct()
    return marks.join(near, ["chapter_id", "mark"], "left_anti")


def renumbered(regions: DataFrame, ordered: DataFrame, page: str, region: str, place: str, number: str) -> DataFrame:
    """Regions with number: the one that their id has in the reading order (of several, the last), else their place in
    the list, from 1. Numbers in `ordered` and places begin at 1."""
    known = ordered.groupBy(page, region).agg(F.max(number).alias("__number"))
    at = F.row_number().over(W.partitionBy(page).orderBy(place))
    rows = regions.withColumn("__at", at).join(known, [page, region], "left")
    return rows.withColumn("number", F.coalesce("__number", "__at").cast("long")).drop("__at", "__number")


def relative_path(path: Column, root: Column) -> Column:
    """The path below the root; null if it is not inside, or there is no root."""
    return F.when(path == root, F.lit(".")).when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path)))


def endpoint(url: Column, ending: str, base: str, full: str) -> Column:
    """The url of a service with its full path: https, a host with the given ending, no user, query, fragment, braces or
    other port, and no path, the base or the full one; else null."""
    text = F.regexp_replace(F.trim(url), "/+$", "")
    part = lambda name: F.try_parse_url(text, F.lit(name))
    path = F.regexp_replace(F.coalesce(part("PATH"), F.lit("")), "/+$", "")
    authority = part("AUTHORITY")
    good = (part("PROTOCOL") == "https") & F.lower(part("HOST")).endswith(ending) & ~authority.contains("@") & ~authority.rlike(r":(?!443$)") & ~text.rlike(r"[?#{}]")
    return F.when(good & path.isin("", base, full), F.concat(F.lit("https://"), authority, F.lit(full)))


def joined_lines(boxes: DataFrame, page: str, overlap: float = 0.25, gap: float = 5) -> DataFrame:
    """page, x, y, width, height and confidence after joining boxes that stand like lines of one text: they share enough of
    the narrower one's width and lie close enough. By y and x, the first box that has such a partner below it in this
    order is joined with the first of these, until none is left. One page at a time."""

    def near(some: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Which boxes (by their corners) stand like lines with one."""
        shared = np.minimum(some[:, 2], one[2]) - np.maximum(some[:, 0], one[0])
        least = np.maximum(1, np.minimum(some[:, 2] - some[:, 0], one[2] - one[0]))
        return (np.maximum(shared, 0) >= overlap * least) & (np.maximum(some[:, 1], one[1]) - np.minimum(some[:, 3], one[3]) <= gap)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        a = rows[["x", "y", "width", "height", "confidence"]].to_numpy(float)
        a[:, 2:4] += a[:, :2]  # corners
        a = a[np.lexsort([a[:, 0], a[:, 1]])]
        i = 0  # no box before has a partner
        while i < len(a):
            end = np.searchsorted(a[:, 1], a[i, 3] + gap, "right")  # boxes below that are out of reach
            hit = np.flatnonzero(near(a[i + 1 : end], a[i]))
            if not len(hit):
                i += 1
                continue
            j = i + 1 + int(hit[0])
            while True:
                whole = np.r_[np.minimum(a[i, :2], a[j, :2]), np.maximum(a[i, 2:], a[j, 2:])]
                a = np.delete(a, [i, j], 0)
                j = int(((a[:, 1] < whole[1]) | (a[:, 1] == whole[1]) & (a[:, 0] <= whole[0])).sum())
                a = np.insert(a, j, whole, 0)
                hit = np.flatnonzero(near(a[:j], whole))  # a box before that had no partner may have one now
                if not len(hit):
                    break
                i = int(hit[0])
            i = j
        a[:, 2:4] -= a[:, :2]
        return pd.DataFrame(a, columns=["x", "y", "width", "height", "confidence"]).assign(**{page: rows[page].iloc[0]})[[page, "x", "y", "width", "height", "confidence"]]

    kind = boxes.schema[page].dataType.simpleString()
    return boxes.groupBy(page).applyInPandas(join, f"`{page}` {kind}, x double, y double, width double, height double, confidence double")


def crop_batches(crops: DataFrame, page: str, order: str, most: int, pixels: int, tile: int, step: int = 160) -> DataFrame:
    """Crops (whole columns width and height) of a page with batch: numbered from 0 by their first crop. Those over `tile`
    go alone; others of like size, in steps, go together in order, up to `most` and as long as all at the largest width
    and height have no more than `pixels`. One page at a time."""

    def batches(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        now, first = {}, []  # of each size: first crop, number, width and height of the batch
        for i, (w, h) in enumerate(zip(rows["width"], rows["height"], strict=True)):
            size = (-(-w // step), -(-h // step)) if max(w, h) <= tile else i
            start, n, bw, bh = now.get(size, (i, 0, 0, 0))
            bw, bh = max(bw, w), max(bh, h)
            if n and (n == most or bw * bh * (n + 1) > pixels):
                start, n, bw, bh = i, 0, w, h
            now[size] = (start, n + 1, bw, bh)
            first.append(start)
        return rows.assign(batch=np.unique(np.array(first), return_inverse=True)[1].astype("int32"))

    return crops.groupBy(page).applyInPandas(batches, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in crops.schema) + ", batch int")
