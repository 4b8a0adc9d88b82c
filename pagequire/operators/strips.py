"""Chapters as one strip: running offsets, which page a coordinate falls on, context along pages.

Pages have chapter_id, ord, page_key, width and height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import floor_div


def offsets(pages: DataFrame, chapter: str = "chapter_id", order: str = "ord", placed: Column | None = None, span: int = 4096) -> DataFrame:
    """Pages with y, the heights before them, and x, centred in the widest page. `placed`: pages that take up room.

    Heights are summed by ranges of `span` places first, so that a task sorts one range of a chapter, not all of it."""
    height = F.col("height") if placed is None else F.when(placed, F.col("height")).otherwise(0)
    rows = pages.withColumns({"__range": floor_div(F.col(order), F.lit(span)), "__height": height})
    whole = rows.groupBy(chapter, "__range").agg(F.sum("__height").alias("__sum"), F.max("width").alias("__wide"))
    above = F.sum("__sum").over(W.partitionBy(chapter).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    whole = whole.select(chapter, "__range", F.coalesce(above, F.lit(0)).alias("__above"), F.max("__wide").over(W.partitionBy(chapter)).alias("__widest"))
    turn = W.partitionBy(chapter, "__range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum("__height").over(turn), F.lit(0))).join(whole, [chapter, "__range"])
    return rows.select(*[F.col(c) for c in pages.columns if c not in ("x", "y")], (F.col("__above") + F.col("__within")).alias("y"), F.floor((F.col("__widest") - F.col("width")) / 2).cast("long").alias("x"))


def sums_before(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, span: int = 4096) -> DataFrame:
    """Rows with `name`, the sum of the values before them, within their keys and in the order, whose first column holds
    whole numbers: by ranges of `span` of these, so that a task sorts one range only. Nulls count 0."""
    rows = rows.withColumns({"__range": floor_div(F.col(order[0]), F.lit(span)), "__value": F.coalesce(value, F.lit(0))})
    whole = rows.groupBy(*keys, "__range").agg(F.sum("__value").alias("__sum"))
    above = F.sum("__sum").over(W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    whole = whole.select(*keys, "__range", F.coalesce(above, F.lit(0)).alias("__above"))
    within = F.coalesce(F.sum("__value").over(W.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__within", within).join(whole, [*keys, "__range"]).withColumn(name, F.col("__above") + F.col("__within")).drop("__range", "__value", "__above", "__within")


def strip_size(pages: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    return pages.groupBy(chapter).agg(F.max("width").alias("width"), F.sum("height").alias("height"), F.count("*").alias("pages"))


def tallest_by_width(pages: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    return pages.groupBy(chapter, "width").agg(F.max("height").alias("tallest"))


def intersecting(placed: DataFrame, ranges: DataFrame, chapter: str = "chapter_id", cell: int = 4096) -> DataFrame:
    """Placed pages with the ranges (range_id, top, bottom) of their chapter that they meet; a range without length
    meets none. Pages and ranges meet by cells of y, and a pair is taken in the first cell that both lie in."""
    cells = lambda start, end: F.explode(F.sequence(floor_div(start, F.lit(cell)), floor_div(F.greatest(start, end), F.lit(cell))))
    over = (F.col("y") < F.col("bottom")) & (F.col("y") + F.col("height") > F.col("top"))
    spread = ranges.filter("bottom > top").withColumn("__cell", cells(F.col("top"), F.col("bottom")))
    pages = placed.withColumn("__cell", cells(F.col("y"), F.col("y") + F.col("height")))
    first = F.col("__cell") == floor_div(F.greatest("y", "top"), F.lit(cell))
    return spread.join(pages, [chapter, "__cell"]).filter(over & first).drop("__cell")


def page_at(placed: DataFrame, points: DataFrame, chapter: str = "chapter_id", order: str = "ord", cell: int = 1 << 16) -> DataFrame:
    """Points (point_id, at) with the page under them; before the first page it is the first, behind the last the last.

    As-of by sorts: the points and the pages' starts are merged cell by cell of the strip, each point takes the last start
    before it in its cell, or else the last one of the cells above."""
    none = F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id")
    starts = placed.filter("height > 0").select(chapter, F.col("y").cast("double").alias("at"), F.lit(0).alias("__kind"), none, F.struct(F.col(order).alias("ord"), "page_key").alias("__page"))
    asked = points.select(chapter, F.col("at").cast("double").alias("at"), F.lit(1).alias("__kind"), "point_id", F.lit(None).cast(starts.schema["__page"].dataType).alias("__page"))
    in_cell = floor_div(F.col("at"), F.lit(float(cell))).alias("__cell")
    both = starts.unionByName(asked).select("*", in_cell)
    last = both.groupBy(chapter, "__cell").agg(F.max(F.when(F.col("__kind") == 0, F.struct("at", "__page"))).alias("__last"), F.min("__page").alias("__least"))
    cells = W.partitionBy(chapter)
    above = F.last("__last", ignorenulls=True).over(cells.orderBy("__cell").rowsBetween(W.unboundedPreceding, -1))
    last = last.select(chapter, "__cell", above["__page"].alias("__above"), F.min("__least").over(cells).alias("__first"))
    turn = W.partitionBy(chapter, "__cell").orderBy("at", "__kind").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__page", ignorenulls=True).over(turn)).filter("__kind = 1").join(last, [chapter, "__cell"])
    return found.withColumn("__found", F.coalesce("__found", "__above", "__first")).filter("__found is not null").select(chapter, "point_id", "at", "__found.*")


def neighbours(pages: DataFrame, active: Column, radius: int, order: str = "ord") -> DataFrame:
    return pages.filter(F.abs(F.col(order) - active) <= radius)


def neighbours_of_all(pages: DataFrame, radius: int, order: str = "ord") -> DataFrame:
    """The neighbours of every page, with its place as `active`. Whole-number places meet by equality."""
    active = pages.select(F.col(order).alias("active")).withColumn(order, F.explode(F.sequence(F.col("active") - radius, F.col("active") + radius)))
    return pages.join(active, order)


def recent_contexts(pairs: DataFrame, group: str, page: str, order: list[str], most: int = 40, chars: int = 5000, span: int = 1024) -> DataFrame:
    """For every page of a group the last `most` source and target pairs of earlier pages, joined, its last characters;
    the empty string where there are none. Pairs with an empty or null side do not count. `page`: whole numbers.

    Pairs are numbered by ranges of pages, and meet the pages that want them by ranges of these numbers, so that no task
    handles a whole group."""
    line = F.when((F.col("source") != "") & (F.col("target") != ""), F.concat("source", F.lit(" → "), "target"))
    rows = pairs.select(group, page, F.struct(*order, line.alias("__t")).alias("__line"), line.isNotNull().alias("__good"))
    pages = rows.groupBy(group, page).agg(F.count_if("__good").alias("__n"))
    pages = sums_before(pages, [group], [page], F.col("__n"), "__from", span)
    turn = F.row_number().over(W.partitionBy(group, page).orderBy(F.desc("__line")))
    last = rows.filter("__good").withColumn("__back", turn).filter(F.col("__back") <= most)  # of a page only these can be wanted
    numbers = last.join(pages, [group, page]).select(group, (F.col("__from") + F.col("__n") - F.col("__back")).alias("__i"), "__line.__t")
    numbers = numbers.withColumn("__cell", floor_div(F.col("__i"), F.lit(span)))
    cells = F.explode(F.sequence(floor_div(F.greatest(F.lit(0), F.col("__from") - most), F.lit(span)), floor_div(F.col("__from"), F.lit(span))))
    # a cell's lines stand beside the pages that ask for them: a line is gathered by the frame of a page, not once a pair
    asked = pages.withColumn("__cell", cells).select(group, "__cell", (F.col("__from") - 1).alias("__i"), F.lit(None).cast("string").alias("__t"), page)
    both = numbers.select(group, "__cell", "__i", "__t", F.lit(None).cast(pages.schema[page].dataType).alias(page)).unionByName(asked)
    frame = W.partitionBy(group, "__cell").orderBy("__i").rangeBetween(1 - most, 0)
    found = both.withColumn("__some", F.collect_list(F.when(F.col("__t").isNotNull(), F.struct("__i", "__t"))).over(frame)).filter(F.col(page).isNotNull())
    lines = F.transform(F.array_sort(F.flatten(F.collect_list("__some"))), lambda s: s["__t"])
    whole = found.groupBy(group, page).agg(F.array_join(lines, "\n").alias("__whole"))
    return whole.select(group, page, F.expr(f"right(__whole, {chars})").alias("context"))


def gaps(boxes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Boxes with the clear space to the one before, and whether it is over 1.5 times the greatest height of the group."""
    before = lambda c: F.lag(c).over(W.partitionBy(group).orderBy(*order))
    gap = F.col("y") - before("y") - before("height")
    return boxes.withColumn("gap", gap).withColumn("wide", F.coalesce(F.col("gap") > 1.5 * F.max("height").over(W.partitionBy(group)), F.lit(False)))


def numbered_text(rows: DataFrame, group: str, number: str, text: str) -> DataFrame:
    """The non-blank texts of each group as numbered lines, in order; blank ones keep their number."""
    lines = F.sort_array(F.collect_list(F.when(F.col(text).rlike(r"\S"), F.struct(F.col(number).alias("n"), F.concat(F.col(number).cast("string"), F.lit(". "), F.col(text)).alias("t")))))
    return rows.groupBy(group).agg(F.array_join(F.transform(lines, lambda s: s["t"]), "\n").alias("page_text"))


def ordered_text(rows: DataFrame, page: str, order: list[str], text: str) -> DataFrame:
    """text of each page: its rows' texts in order, numbered from 1, with blank lines between."""
    numbered = rows.withColumn("__n", F.row_number().over(W.partitionBy(page).orderBy(*order)))
    line = F.concat(F.col("__n").cast("string"), F.lit(". "), F.trim(F.coalesce(text, F.lit(""))))
    return numbered.groupBy(page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", line.alias("l")))), lambda s: s["l"]), "\n\n").alias("text"))
