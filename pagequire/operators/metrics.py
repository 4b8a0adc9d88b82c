"""Aggregates over logs, patches and fitted sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import flag, half_even, upper_median


def recent_operations(events: DataFrame, last: int = 120, name: str = "name", seconds: str = "seconds", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Mean and count of each operation among the last events; `newest` orders them by most recent use."""
    recent = events.orderBy(*[F.desc(c) for c in order]).limit(last)
    newest = F.max(F.struct(*order)) if len(order) > 1 else F.max(order[0])
    return recent.groupBy(name).agg(F.avg(seconds).alias("mean"), F.count("*").alias("samples"), newest.alias("newest"))


def usage(events: DataFrame, prompt: str = "prompt_tokens", completion: str = "completion_tokens") -> DataFrame:
    """Requests, responses that reported both counts, and their tokens with negatives as 0."""
    told = F.col(prompt).isNotNull() & F.col(completion).isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(told, F.greatest(F.col(c), F.lit(0)))), F.lit(0))
    return events.agg(F.count("*").alias("requests"), F.count_if(told).alias("reported"), total(prompt).alias("input_tokens"), total(completion).alias("output_tokens"))


def counts_with_zeros(rows: DataFrame, value: str, wanted: list[str]) -> DataFrame:
    """Rows per wanted value, 0 where there are none."""
    names = rows.sparkSession.createDataFrame([(w,) for w in wanted], f"`{value}` string")
    return names.join(rows.groupBy(value).agg(F.count("*").alias("n")), value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))


def mask_totals(entries: DataFrame, plan: str, pixels: Column, solid: Column) -> DataFrame:
    """masked_pixels and solid_entries of each plan: what its entries cover, and how many are solid; nulls count nothing."""
    return entries.groupBy(plan).agg(F.coalesce(F.sum(F.greatest(pixels, F.lit(0))), F.lit(0)).alias("masked_pixels"), F.count_if(flag(solid)).alias("solid_entries"))


def patch_layer(kind: Column) -> Column:
    """automatic, restore, or else paint."""
    low = F.lower(F.trim(F.coalesce(kind, F.lit("legacy"))))
    return F.when(low.isin("automatic", "restore"), low).otherwise("paint")


def typical_size(sizes: DataFrame, group: str, size: str, least: int = 3) -> DataFrame:
    """The median size of each group rounded to even, null with fewer than `least` positive sizes."""
    some = F.when(F.col(size) > 0, F.col(size))
    return sizes.groupBy(group).agg(F.when(F.count(some) >= least, half_even(F.median(some))).alias("typical"))


def evenly_sampled(rows: DataFrame, group: str, order: list[str], most: int = 40) -> DataFrame:
    """At most `most` rows of each group, spread evenly over its order: the first of each of `most` equal parts."""

    turn = W.partitionBy(group)
    placed = rows.withColumns({"__i": F.row_number().over(turn.orderBy(*order)) - 1, "__n": F.count("*").over(turn)})
    # row i is floor(k * n / most) for some k: the part it falls into begins at it
    k = F.ceil(F.col("__i") * most / F.col("__n"))
    return placed.filter((F.col("__n") <= most) | (F.floor(k * F.col("__n") / most) == F.col("__i"))).drop("__i", "__n")


def latency_choice(rows: DataFrame, key: str, order: list[str], value: str, least: int = 4, last: int = 8) -> DataFrame:
    """latency of each key: the upper median of its last values, null while there are fewer than `least`. Rows are ranked
    before they are gathered, so that no key is gathered whole."""
    back = F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    recent = rows.withColumn("__back", back).filter(F.col("__back") <= last).groupBy(key).agg(F.collect_list(value).alias("__v"))
    return recent.select(key, F.when(F.size("__v") >= least, upper_median(F.col("__v"))).alias("latency"))


def bounding_box(boxes: DataFrame, group: str) -> DataFrame:
    right, bottom = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    return boxes.groupBy(group).agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("width"), (bottom - F.min("y")).alias("height"))


def cache_stats(entries: DataFrame, size: str, hit: str) -> DataFrame:
    return entries.agg(F.count("*").alias("items"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count_if(flag(hit)).alias("hits"), F.count_if(~flag(hit)).alias("misses"))


def capped_sizes(regions: DataFrame, size: Column, dialogue: Column) -> DataFrame:
    """Dialogue boxes capped at a chapter's size. What was asked for first is remembered in font_size_requested and
    capped anew by a later, larger size; a size that was changed since is what was asked for. `changed` tells the rows."""
    current = F.coalesce(F.nullif("font_size", F.lit(0)), size)
    change = dialogue & ~((current <= size) & F.coalesce(F.col("chapter_font_size") == size, F.lit(False)))
    untouched = F.col("font_size").eqNullSafe(F.col("chapter_font_applied"))
    asked = F.coalesce(F.when(untouched, F.col("font_size_requested")), current)
    new = {"font_size_requested": asked, "font_size": F.least(asked, size), "chapter_font_applied": F.least(asked, size), "chapter_font_size": size}
    return regions.withColumns({k: F.when(change, v).otherwise(F.col(k)) for k, v in new.items()} | {"changed": change})


def coverage(expected: DataFrame, boxes: DataFrame, group: str, cell: int = 512) -> DataFrame:
    """How many expected boxes have their centre inside some box of the group, of how many. Centres meet the boxes of
    their grid cell alone."""
    at = lambda c: F.floor(c / cell)
    steps = lambda start, size: F.explode(F.sequence(at(F.col(start)), at(F.col(start) + F.greatest(F.col(size), F.lit(0)))))
    o = boxes.withColumn("__cx", steps("x", "width")).withColumn("__cy", steps("y", "height")).select(group, "__cx", "__cy", *[F.col(c).alias(f"o_{c}") for c in ("x", "y", "width", "height")])
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    inside = (cx >= F.col("o_x")) & (cx <= F.col("o_x") + F.col("o_width")) & (cy >= F.col("o_y")) & (cy <= F.col("o_y") + F.col("o_height"))
    met = expected.withColumns({"__cx": at(cx), "__cy": at(cy)}).join(o, [group, "__cx", "__cy"]).filter(inside).select(group, "idx").distinct().withColumn("__met", F.lit(True))
    return expected.join(met, [group, "idx"], "left").groupBy(group).agg(F.count_if(flag("__met")).alias("covered"), F.count("*").alias("expected"))
