"""Marks along a chapter: evenly pitched places in the chapter's own coordinates, moved a little to keep clear of boxes, and
brought back to the pages they fall on.

Pages have chapter_id, ord, page_key, width, height, and mark_width and mark_height, null where no mark may stand.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..functions.values import floor_div
from .boxes import free_rows
from .lettering import spread
from .shapes import clear_of
from .strips import offsets


@dataclass(frozen=True)
class Layout:
    """How marks are dealt along a chapter. `distribution`: column (one side), alternating (left and right in turn) or
    adaptive (the side, else others, for each mark)."""

    side: str = "right"
    distribution: str = "column"
    gap: int = 400
    count: int | None = None
    """How many marks; None: by the chapter's length, at most `limit`."""
    limit: int = 12
    interval: int = 0
    margin_x: int = 0
    margin_y: int = 0
    offset_x: int = 0
    offset_y: int = 0

    def sides(self) -> list[str]:
        other = ("left", "right") if self.side == "left" else ("right", "left")
        return {"alternating": list(other), "adaptive": list(dict.fromkeys([self.side, "left", "right", "center"]))}.get(self.distribution, [self.side])


FITS = "mark_width is not null and mark_height is not null and mark_height <= height and mark_width <= width"


def chapter_pitch(pages: DataFrame, layout: Layout) -> DataFrame:
    """For each chapter with marked pages: total, step (mark and gap), margin, count, pitch, first and drift."""
    if_marked = lambda c: F.max(F.when(F.expr(FITS), F.col(c)))
    rows = pages.groupBy("chapter_id").agg(F.sum("height").alias("total"), if_marked("mark_height").alias("most"), if_marked("width").alias("wide"))
    rows = rows.filter("most is not null").withColumn("step", F.col("most") + layout.gap)
    rows = rows.withColumn("margin", F.least(F.lit(layout.margin_y), F.greatest(F.lit(0), F.expr("(total - most) div 2"))))
    rows = rows.withColumn("usable", F.greatest(F.lit(0), F.col("total") - 2 * F.col("margin") - F.col("most")))
    if layout.count is None:
        # fixed values: the least distance of marks by default, and in widths and mark heights
        every = F.greatest(F.lit(float(layout.interval)), "step") if layout.interval else F.greatest(F.lit(1600.0), F.col("wide") * 2.5, F.col("most") * 8.0, F.col("step").cast("double"))
        wanted = F.greatest(F.lit(1), F.least(F.lit(layout.limit), F.bround(F.col("total") / every).cast("long")))
    else:
        wanted = F.lit(layout.count)
    rows = rows.withColumn("count", F.least(wanted, 1 + F.expr("usable div step"))).filter("count > 0")
    pitch = F.when(F.col("count") > 1, F.greatest(F.col("step").cast("double"), F.least(F.col("total") / F.col("count"), F.col("usable") / (F.col("count") - 1)))).otherwise(F.col("total").cast("double"))
    rows = rows.withColumn("pitch", pitch)
    return rows.withColumns({"first": (F.col("total") - F.col("most") - (F.col("count") - 1) * F.col("pitch")) / 2, "drift": F.col("pitch") * 0.25})


def side_x(side: Column, layout: Layout) -> Column:
    room = F.col("width") - F.col("mark_width")
    x = F.when(side == "left", F.lit(layout.margin_x)).when(side == "right", room - layout.margin_x).otherwise(F.expr("(width - mark_width) div 2"))
    return F.greatest(F.lit(0), F.least(x + layout.offset_x, room)).cast("long")


def open_ranges(marked: DataFrame, pitch: DataFrame, boxes: DataFrame, layout: Layout) -> DataFrame:
    """Where tops of marks may stand, in chapter coordinates: chapter_id, side, page_key, x, low, high. Marks keep whole on
    their pages; the margin counts at the chapter's ends alone."""
    rows = marked.join(pitch.select("chapter_id", "total", "margin"), "chapter_id").withColumn("side", F.explode(F.array(*[F.lit(s) for s in layout.sides()])))
    low, high = F.greatest(F.lit(0), F.col("margin") - F.col("y")), F.least(F.col("height") - F.col("mark_height"), F.col("total") - F.col("margin") - F.col("mark_height") - F.col("y"))
    rows = rows.select("chapter_id", "page_key", "side", F.concat_ws("|", "page_key", "side").alias("slot_id"), side_x(F.col("side"), layout).alias("x"), low.alias("low"), high.alias("high"), "mark_width", "mark_height", F.col("y").alias("above")).filter("low <= high")
    free = free_rows(rows, boxes, keep=("chapter_id", "side", "x", "above"))
    return free.select("chapter_id", "side", "page_key", "x", "above", (F.col("start") + F.col("above")).alias("low"), (F.col("end") + F.col("above")).alias("high"))


def pitched(pitch: DataFrame, span: int = 512) -> DataFrame:
    """The rows of chapters, once for each mark i: a chapter is one row and its marks may be millions, so runs of `span` marks
    are dealt over the tasks of a shuffle first."""
    last = F.col("count") - 1
    runs = spread(pitch.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(span).cast("long"))).alias("__run")))
    return runs.select("*", F.explode(F.sequence(F.col("__run"), F.least(F.col("__run") + (span - 1), last))).alias("i")).drop("__run")


def choices(pitch: DataFrame, ranges: DataFrame, layout: Layout, cell: int) -> DataFrame:
    """For each mark (chapter_id, i, ideal, low, high of its band) and each side it may take, in order: the last open place
    before its ideal one, and the open ranges from there on. Of these only the first is kept where the mark before cannot
    reach beyond the ideal place; else the band there is shorter than a step, so there are few."""
    sides = layout.sides()
    marks = pitched(pitch).withColumn("ideal", F.col("first") + F.col("i") * F.col("pitch") + F.greatest(-F.col("drift"), F.least(F.lit(float(layout.offset_y)), F.col("drift"))))
    around = lambda c: F.bround(c).cast("long")
    marks = marks.select("chapter_id", "i", "ideal", around(F.col("ideal")).alias("near"), around(F.col("ideal") - F.col("drift")).alias("from"), around(F.col("ideal") + F.col("drift")).alias("to"), "step", (3 * F.col("pitch") < 4 * F.col("step") + 8).alias("tight"))
    every = F.array(*[F.struct(F.lit(k).alias("turn"), F.lit(s).alias("side")) for k, s in enumerate(sides)])
    mine = every if layout.distribution == "adaptive" else F.array(F.element_at(every, (F.col("i") % len(sides) + 1).cast("int")))
    asked = marks.select("*", F.explode(mine).alias("m")).select("*", "m.turn", "m.side").drop("m")
    cells = lambda low, high: F.explode(F.sequence(floor_div(low, F.lit(cell)), floor_div(high, F.lit(cell))))
    wanted = asked.withColumn("__cell", cells(F.col("from"), F.col("to")))
    there = ranges.withColumn("__cell", cells(F.col("low"), F.col("high")))
    # Spark takes the marks to be as few as the chapters that they come from and would broadcast them all
    met = wanted.hint("merge").join(there, ["chapter_id", "side", "__cell"]).filter("low <= `to` and high >= `from`")
    met = met.filter(F.col("__cell") == floor_div(F.greatest("low", "from"), F.lit(cell))).withColumns({"low": F.greatest("low", "from"), "high": F.least("high", "to")})
    place = F.struct("low", "high", "x", "page_key", "above")
    before, after = F.when(F.col("high") < F.col("near"), F.struct("high", place.alias("r"))), F.when(F.col("high") >= F.col("near"), place)
    found = met.groupBy("chapter_id", "i", "ideal", "near", "from", "step", "turn").agg(F.max(before)["r"].alias("before"), F.min(after).alias("next"), F.collect_list(F.when(F.col("tight"), after)).alias("all"))
    rest = F.when(F.size("all") > 0, F.array_sort("all")).when(F.col("next").isNotNull(), F.array("next")).otherwise(F.array().cast(found.schema["all"].dataType))
    found = found.select("chapter_id", "i", "ideal", "near", "from", "step", F.struct("turn", "before", rest.alias("after")).alias("choice"))
    return found.groupBy("chapter_id", "i", "ideal", "near", "from", "step").agg(F.array_sort(F.collect_list("choice")).alias("choices"))


def take(row, floor: int) -> tuple[int, dict] | None:
    """The open place nearest to the ideal one, not above the floor: (y, range); by the first side that has any."""
    for choice in row.choices:
        some = []
        if choice["before"] is not None and choice["before"]["high"] >= floor:
            some.append((choice["before"]["high"], choice["before"]))
        after = next((r for r in choice["after"] if r["high"] >= floor), None)
        if after is not None:
            some.append((max(after["low"], floor, min(row.near, after["high"])), after))
        if some:
            return min(some, key=lambda s: (abs(s[0] - row.ideal), s[0]))
    return None


def along(marks: DataFrame, span: int) -> DataFrame:
    """Places for marks in order, each at least a step below the one before: chapter_id, i, y, x, page_key, above.

    A chapter's marks are handled by ranges of `span`, each from the floor that the range before leaves. Floors begin at 0
    and are handed on until none changes: a range matters to the next one only where its last mark reaches into its first
    one's band, so a few rounds do."""
    marks = settled(marks.withColumn("__range", floor_div(F.col("i"), F.lit(span))))
    kinds = {c: marks.schema[c].dataType.simpleString() for c in ("chapter_id",)} | {"page_key": marks.schema["choices"].dataType.elementType["before"].dataType["page_key"].dataType.simpleString()}

    def run(key: tuple, rows: pd.DataFrame, floors: pd.DataFrame) -> pd.DataFrame:
        floor, out = int(floors.floor.iloc[0]) if len(floors) else 0, []
        for row in rows.sort_values("i").itertuples() if len(rows) else ():
            if found := take(row, floor):
                y, place = found
                out.append((key[0], key[1], row.i, y, place["x"], place["page_key"], place["above"]))
                floor = y + row.step
        out.append((key[0], key[1], -1, floor, None, None, None))
        return pd.DataFrame(out, columns=["chapter_id", "__range", "i", "y", "x", "page_key", "above"]).astype({"x": "Int64", "above": "Int64"})

    schema = f"chapter_id {kinds['chapter_id']}, __range long, i long, y long, x long, page_key {kinds['page_key']}, above long"
    turn = W.partitionBy("chapter_id").orderBy("__range")
    begins = marks.groupBy("chapter_id", "__range").agg(F.min_by("from", "i").alias("__from"))
    floors = settled(begins.select("chapter_id", "__range", F.lit(0).cast("long").alias("floor")))
    several = not begins.filter("__range > 0").isEmpty()
    while True:
        placed = marks.groupBy("chapter_id", "__range").cogroup(floors.groupBy("chapter_id", "__range")).applyInPandas(run, schema)
        if not several:
            return placed.filter("i >= 0").drop("__range")
        placed = settled(placed)
        left = placed.filter("i < 0").withColumn("__left", F.coalesce(F.lag("y").over(turn), F.lit(0))).select("chapter_id", "__range", "__left")
        then = begins.join(left, ["chapter_id", "__range"]).select("chapter_id", "__range", F.when(F.col("__left") > F.col("__from"), F.col("__left")).otherwise(0).cast("long").alias("floor"))
        then = settled(then)
        if then.exceptAll(floors).isEmpty():
            return placed.filter("i >= 0").drop("__range")
        floors = then


def chapter_slots(pages: DataFrame, boxes: DataFrame, layout: Layout = Layout(), manual: DataFrame | None = None, cell: int = 4096, span: int = 512) -> DataFrame:
    """Places of marks (chapter_id, page_key, x, y on the page, and i, which of the chapter's marks it is).

    Marks are pitched over the whole chapter, as many as have room; each may drift by a quarter of the pitch to keep clear of
    boxes, at least the gap below the one before, also over page edges. One that finds no place is left out and its place
    given to no other. Pages without a mark or too small for it take up room only; those without size, chapter or order
    not even that.

    `manual`: page_key, x, y of marks that stand by hand: their pages have no others, and others keep the gap to them; a
    page whose marks by hand leave the page or meet each other has its own ones instead. Chapters without a marked page have
    no places. Repeated page keys are not meant. A chapter is nowhere gathered: pages, boxes and marks meet by page or by
    cells of y, and marks are placed by ranges."""
    valid = pages.filter("width > 0 and height > 0 and chapter_id is not null and ord is not null")
    marked = offsets(valid, span=4096).drop("x").filter(FITS)
    pitch = chapter_pitch(valid, layout)
    found = along(choices(pitch, open_ranges(marked, pitch, boxes, layout), layout, cell), span)
    own = found.select("chapter_id", "page_key", "x", (F.col("y") - F.col("above")).alias("y"), "i", F.col("y").alias("__at"))
    if manual is None:
        return own.drop("__at")
    hand = manual.select("page_key", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).join(marked.select("page_key", "chapter_id", "width", "height", "mark_width", "mark_height", F.col("y").alias("above")), "page_key")
    outside = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") > F.col("width") - F.col("mark_width")) | (F.col("y") > F.col("height") - F.col("mark_height"))
    # each mark by hand with those of its page, few of which anyone sets
    others = F.collect_list(F.struct("x", "y")).over(W.partitionBy("page_key"))
    close = F.size(F.filter(others, lambda o: (F.abs(o["x"] - F.col("x")) < F.col("mark_width")) & (F.abs(o["y"] - F.col("y")) < F.col("mark_height")))) > 1
    marks = hand.withColumn("__one", outside | close).withColumn("__bad", F.max("__one").over(W.partitionBy("page_key")))
    good = marks.filter("not __bad")
    fixed = good.select("chapter_id", (F.col("above") + F.col("y")).alias("low"), (F.col("above") + F.col("y") + F.col("mark_height")).alias("high"))
    free = own.join(good.select("page_key").distinct(), "page_key", "left_anti").join(marked.select("page_key", F.col("mark_height").alias("height")), "page_key")
    clear = clear_of(free.select("chapter_id", F.col("i").alias("mark"), F.col("__at").alias("y"), "height"), fixed, layout.gap, cell)
    kept = own.join(clear.select("chapter_id", F.col("mark").alias("i")), ["chapter_id", "i"], "left_semi").join(good.select("page_key").distinct(), "page_key", "left_anti")
    return kept.select("chapter_id", "page_key", "x", "y", "i").unionByName(good.select("chapter_id", "page_key", "x", "y", F.lit(None).cast("long").alias("i")))
