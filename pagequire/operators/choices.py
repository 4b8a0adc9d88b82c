"""Choices among rows and repairs of settings: which detections stay, order and lists of layers, defaults and limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import area, box, intersection
from ..functions.values import has_text
from .boxes import meetings

# fixed values: the share of a page that a box may cover without further evidence
LARGE = 0.15
# fixed values: of a block's lines, the least confidence and largest page share of the block; of a line, the largest share
# of the block, the least share inside it, the farthest middle; of all lines, their least number, area, width and height,
# and the largest gap in line heights
BLOCK = {"confidence": 0.65, "page": 0.45, "line": 0.3, "inside": 0.9, "middle": 0.15, "lines": 3, "area": 0.12, "width": 0.25, "height": 0.2, "gap": 1.5}
# fixed values: layers of a page and their defaults
LAYERS = ["automatic", "paint", "restore"]
#: Saved names at most.
SAVED = 20


def sound_predictions(rows: DataFrame, confidence: Column, fields: list[str]) -> DataFrame:
    """Raw predictions of enough confidence whose fields are all finite and whose sizes are positive."""
    finite = F.lit(True)
    for c in fields:
        finite &= F.coalesce(~F.isnan(c) & (F.abs(F.col(c).cast("double")) != float("inf")), F.lit(False))
    return rows.filter(finite & (F.col("confidence") >= confidence) & (F.col("width") > 0) & (F.col("height") > 0))


def block_support(boxes: DataFrame) -> DataFrame:
    """page_key and idx of large boxes that three or more of the page's boxes bear out as lines of one block: inside it,
    in its middle, without wide gaps. Boxes have page_width and page_height; blocks and lines meet by cells of the page."""
    block = boxes.filter((F.col("confidence") >= BLOCK["confidence"]) & (F.col("width") * F.col("height") <= BLOCK["page"] * F.col("page_width") * F.col("page_height")) & (F.col("width") * F.col("height") > LARGE * F.col("page_width") * F.col("page_height")))
    b, one = box("a_"), box("b_")
    middle = F.abs(one("x") + one("width") / 2 - b("x") - b("width") / 2) <= BLOCK["middle"] * b("width")
    met = meetings(block, boxes).filter((b("idx") != one("idx")) & (area(one) <= BLOCK["line"] * area(b)) & (intersection(b, one) >= BLOCK["inside"] * area(one)) & middle)
    turn = W.partitionBy("page_key", "a_idx").orderBy("b_y", "b_idx")
    gap = F.col("b_y") - F.lag("b_y").over(turn) - F.lag("b_height").over(turn)
    wide = F.coalesce(gap > BLOCK["gap"] * F.greatest("b_height", F.lag("b_height").over(turn)), F.lit(False))
    facts = met.withColumn("wide", wide).groupBy("page_key", "a_idx", "a_width", "a_height").agg(F.count("*").alias("n"), F.sum(area(one)).alias("area"), F.max("b_width").alias("width"), F.max_by(F.col("b_y") + F.col("b_height"), F.struct("b_y", "b_idx")).alias("low"), F.min("b_y").alias("top"), F.max("wide").alias("wide"))
    whole = F.col("a_width") * F.col("a_height")
    good = (F.col("n") >= BLOCK["lines"]) & (F.col("area") >= BLOCK["area"] * whole) & (F.col("width") >= BLOCK["width"] * F.col("a_width")) & (F.col("low") - F.col("top") >= BLOCK["height"] * F.col("a_height")) & ~F.col("wide")
    return facts.filter(good).select("page_key", F.col("a_idx").alias("idx"))


def without_large(boxes: DataFrame) -> DataFrame:
    """Boxes of positive size that cover a small share of their page, or are borne out by their lines."""
    small = F.col("width") * F.col("height") <= LARGE * F.greatest(F.lit(1), F.col("page_width") * F.col("page_height"))
    whole = boxes.filter("width > 0 and height > 0")
    return whole.filter(small).unionByName(whole.filter(~small).join(block_support(whole), ["page_key", "idx"], "left_semi").select(*boxes.columns))


def union_groups(rows: DataFrame, key: str, order: str, most: int = 2048) -> DataFrame:
    """Boxes of a cluster with group, from 0: in order, a new one wherever the box around the group would be wider or
    higher than `most`. A cluster is what overlaps on one page."""

    def grouped(cluster: pd.DataFrame) -> pd.DataFrame:
        cluster = cluster.sort_values(order, kind="stable")
        corners = cluster[["x", "y"]].to_numpy(float), cluster[["x", "y"]].to_numpy(float) + cluster[["width", "height"]].to_numpy(float)
        out, start, group = np.zeros(len(cluster), int), 0, 0
        for i in range(len(cluster)):
            size = corners[1][start : i + 1].max(0) - corners[0][start : i + 1].min(0)
            if i > start and (size > most).any():
                start, group = i, group + 1
            out[i] = group
        return cluster.assign(group=out)

    return rows.groupBy(key).applyInPandas(grouped, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", group int")


def greedy_lines(rows: DataFrame, text: str, most: Column, glyph_width: float = 1.0) -> DataFrame:
    """Rows with lines: each paragraph's words (or, of one word, its characters) put on a line as long as they fit."""

    def broken(paragraph: str, width: float) -> Iterator[str]:
        units, gap = paragraph.split(), " "
        if len(units) < 2:
            units, gap = list(paragraph), ""
        line = ""
        for unit in units:
            longer = line + gap + unit if line else unit
            if line and len(longer) * glyph_width > width:
                yield line
                longer = unit
            line = longer
        yield line

    @F.pandas_udf("array<string>")
    def wrapped(texts: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([[x for p in (t or "").splitlines() or [""] for x in broken(p, w)] for t, w in zip(texts, width, strict=True)])

    return rows.withColumn("lines", wrapped(F.col(text), most.cast("double")))


def search_rect(page_width: Column, page_height: Column) -> dict[str, Column]:
    """left, top, width and height of the room around a box in which its balloon is looked for, on the page."""
    across = F.greatest(F.lit(96), 2 * F.col("width"), 2 * F.col("height"))
    down = F.greatest(F.lit(96), 3 * F.col("height"), F.col("width"))
    left, top = F.greatest(F.lit(0), F.col("x") - across), F.greatest(F.lit(0), F.col("y") - down)
    right, bottom = F.least(page_width, F.col("x") + F.col("width") + across), F.least(page_height, F.col("y") + F.col("height") + down)
    return {"left": left, "top": top, "room_width": F.greatest(F.lit(1), right - left), "room_height": F.greatest(F.lit(1), bottom - top)}


def edge_sides(page_width: Column, page_height: Column, room: dict[str, Column]) -> dict[str, Column]:
    """Which sides of a box's room are edges of the page."""
    left, top = room["left"], room["top"]
    return {"at_left": left <= 0, "at_top": top <= 0, "at_right": left + room["room_width"] >= page_width, "at_bottom": top + room["room_height"] >= page_height}


def padding(requested: Column, stroke: Column) -> Column:
    """The space kept to a balloon's outline: the requested one, or what its size and stroke ask for, up to a quarter."""
    short = F.greatest(F.lit(1), F.least("width", "height"))
    least = F.greatest(F.lit(2), F.bround(short * 0.055).cast("int"), stroke * 2 + 4)
    return F.least(F.greatest(requested, least), F.greatest(F.lit(2), F.floor(short / 4).cast("int")))


def remembered(saved: Column, name: Column) -> Column:
    """A list of saved names with one put to the front, each once, at most SAVED."""
    return F.when(has_text(name), F.slice(F.array_distinct(F.concat(F.array(F.trim(name)), saved)), 1, SAVED)).otherwise(saved)


def layer_states(states: Column) -> Column:
    """visible, opacity (0 to 100) and locked of all layers, in order; `states`: a map by layer; others are left out."""
    one = lambda name: states[name]
    limits = lambda x: F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(x, F.lit(100))))
    return F.array(*[F.struct(F.lit(n).alias("layer"), F.coalesce(one(n)["visible"], F.lit(True)).alias("visible"), limits(one(n)["opacity"]).alias("opacity"), F.coalesce(one(n)["locked"], F.lit(False)).alias("locked")) for n in LAYERS])


def recent_rows(rows: DataFrame, key: str, order: str, most: int = 12) -> DataFrame:
    """The last `most` rows of each key with position, from 1 over all of them."""
    turn = W.partitionBy(key)
    last = rows.withColumn("__back", F.row_number().over(turn.orderBy(F.desc(order)))).filter(F.col("__back") <= most)
    return last.join(rows.groupBy(key).agg(F.count("*").alias("__n")), key).withColumn("position", F.col("__n") - F.col("__back") + 1).drop("__back", "__n")


def moved(rows: DataFrame, key: str, place: str, source: Column, target: Column) -> DataFrame:
    """Rows of each list (places from 0) with the one at `source` moved to `target`; nothing moves where one is outside."""
    n = rows.groupBy(key).agg(F.count("*").alias("__n"))
    inside = (source >= 0) & (target >= 0) & (source < F.col("__n")) & (target < F.col("__n"))
    at = F.col(place)
    new = F.when(at == source, target).when((at > source) & (at <= target), at - 1).when((at < source) & (at >= target), at + 1).otherwise(at)
    return rows.join(n, key).withColumn(place, F.when(inside, new).otherwise(at)).drop("__n")


def deleted(rows: DataFrame, key: str, place: str, chosen: Column) -> DataFrame:
    """Rows of each list without the chosen ones that are not locked, places closed up."""
    left = rows.filter(~F.coalesce(chosen & ~F.coalesce("locked", F.lit(False)), F.lit(False)))
    return left.withColumn(place, F.row_number().over(W.partitionBy(key).orderBy(place)) - 1)


def duplicated(rows: DataFrame, key: str, place: str, chosen: Column) -> DataFrame:
    """Rows of each list with a copy behind each chosen one: named so, 12 pixels on, unlocked and visible."""
    twin = rows.filter(chosen).withColumns({"name": F.concat(F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Capa "), (F.col(place) + 1).cast("string"))), F.lit(" copia")), "x": F.col("x") + 12, "y": F.col("y") + 12, "locked": F.lit(False), "visible": F.lit(True), "__twin": F.lit(1)})
    both = rows.withColumn("__twin", F.lit(0)).unionByName(twin)
    return both.withColumn(place, F.row_number().over(W.partitionBy(key).orderBy(place, "__twin")) - 1).drop("__twin")


def tile_order(tiles: DataFrame, view: str, visible: Column, centre_x: Column, centre_y: Column, pixels: int) -> DataFrame:
    """Tiles of each view by turn: the visible ones first, then the nearer to the centre by rows and columns together, as
    long as their pixels stay within a budget; the first always."""
    away = F.abs(F.col("x") + F.col("width") / 2 - centre_x) + F.abs(F.col("y") + F.col("height") / 2 - centre_y)
    turn = W.partitionBy(view).orderBy(F.when(visible, 0).otherwise(1), "__away", "idx")
    rows = tiles.withColumn("__away", away).withColumns({"turn": F.row_number().over(turn), "__sum": F.sum(F.col("width") * F.col("height")).over(turn.rowsBetween(W.unboundedPreceding, 0))})
    return rows.filter((F.col("__sum") <= pixels) | (F.col("turn") == 1)).drop("__away", "__sum")


def purged(files: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Files that are not older than so many days."""
    return files.filter(F.col("modified") >= now - F.expr(f"INTERVAL {days} DAYS"))


def _missing(base: Column, own: Column) -> Column:
    return F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k))


def over_defaults(stored: Column, defaults: dict[str, dict[str, str]]) -> Column:
    """Settings as a map of maps, of the known sections alone: stored values over the defaults'."""
    sections = []
    for name, values in defaults.items():
        base = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
        own = F.coalesce(stored[name], F.create_map().cast("map<string,string>"))
        sections += [F.lit(name), F.map_concat(_missing(base, own), own)]
    return F.create_map(*sections)


def fingerprint(*parts: Column) -> Column:
    """A signature of values in order: SHA-1, each value behind its length, null apart from empty."""
    return F.sha1(F.concat(*[F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]))
