"""What is done and what is pending, per region, page and chapter.

Regions have page_key, ord, id, text, translation, applied_text and flags; pages have chapter_id, ord, name and page_key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import matches
from ..functions.values import first_text, flag, has_text, stripped
from .strips import sums_before


def needs_reading(prefix: str = "") -> Column:
    """Stale, or never checked, completed or filled; a seam's other half and repeated captions only when stale."""
    c = lambda n: F.col(prefix + n)
    stale = flag(c("ocr_stale"))
    return stale | ~(flag(c("seam_child")) | flag(c("repeated_caption")) | flag(c("ocr_checked")) | flag(c("ocr_completed")) | has_text(c("text")))


def needs_translation() -> Column:
    """Has text, and no completed translation that is not blank."""
    return has_text(F.col("text")) & ~(flag("translation_completed") & has_text(F.col("translation")))


def is_dialogue() -> Column:
    """Speech or thought with any text, fitted automatically, and no sound effect."""
    kind = F.coalesce(F.nullif("balloon_kind", F.lit("")), F.lit("dialogue"))
    text = first_text(F.col("applied_text"), F.col("translation"), F.col("text"))
    return has_text(text) & ~flag("sfx_enabled") & F.coalesce("auto_fit", F.lit(True)) & kind.isin("dialogue", "thought")


def is_caption_candidate() -> Column:
    """A blank detected line at least four times as wide as high, of modest confidence."""
    automatic = ~flag("manual") & ~F.coalesce(F.col("id").startswith("manual-"), F.lit(False))
    return ~flag("repeated_caption") & ~has_text(F.col("text")) & automatic & (F.col("height") > 0) & (F.col("width") >= 4 * F.col("height")) & (F.coalesce("confidence", F.lit(1.0)) < 0.5)


def page_status(pages: DataFrame, regions: DataFrame, patches: DataFrame, key: str = "page_key") -> DataFrame:
    """detected, ocr, translated, typeset and cleaned per page. The last regions' test holds for all regions but seam
    children and repeated captions; a page that has only these is done, one without regions is not."""
    counts = ~(flag("seam_child") | flag("repeated_caption"))
    text, translation = stripped(F.coalesce("text", F.lit(""))), stripped(F.coalesce("translation", F.lit("")))
    tests = {
        "ocr": has_text(F.col("text")),
        "translated": flag("translation_completed") | ((translation != "") & (translation != text)),
        "typeset": flag("typeset_completed") | (has_text(F.col("applied_text")) & flag("has_style")),
    }
    per_page = regions.groupBy(key).agg(F.count("*").alias("__n"), *[F.bool_and(F.when(counts, t)).alias(f"__{k}") for k, t in tests.items()])
    cleaned = patches.select(key).distinct().withColumn("__cleaned", F.lit(True))
    joined = pages.join(per_page, key, "left").join(cleaned, key, "left")
    some = F.coalesce(F.col("__n"), F.lit(0)) > 0
    return joined.select(*pages.columns, some.alias("detected"), *[(some & F.coalesce(f"__{k}", F.lit(True))).alias(k) for k in tests], flag("__cleaned").alias("cleaned"))


def pages_without(pages: DataFrame, rows: DataFrame, key: str = "page_key") -> DataFrame:
    """Pages that have none of the rows, such as pages to detect."""
    return pages.join(rows.select(key).distinct(), key, "left_anti")


def pages_with(pages: DataFrame, rows: DataFrame, key: str = "page_key") -> DataFrame:
    return pages.join(rows.select(key).distinct(), key, "left_semi")


def pages_to_clean(pages: DataFrame, regions: DataFrame, patches: DataFrame, key: str = "page_key") -> DataFrame:
    """Pages with regions and without patches."""
    return pages_without(pages_with(pages, regions, key), patches, key)


def filter_pages(status: DataFrame, choice: str, text: str = "") -> DataFrame:
    """Pages of one status whose name holds a text: all, or `<flag>` or `no_<flag>` of page_status."""
    if choice != "all":
        status = status.filter(~F.col(choice[3:]) if choice.startswith("no_") else F.col(choice))
    return status.filter(matches(F.col("name"), F.lit(text))) if text else status


def next_pending(status: DataFrame, pending: Column, chapter: str, order: str, current: Column) -> DataFrame:
    """The next pending page of each chapter behind the current one, else the first: wraps around."""
    after = F.min(F.when(pending & (F.col(order) > current), F.col(order)))
    return status.groupBy(chapter).agg(F.coalesce(after, F.min(F.when(pending, F.col(order)))).alias("next_pending"))


def moved_regions(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The new regions with ocr_stale set where their box differs from the old one of the same key."""
    sides = ("x", "y", "width", "height")
    before = old.select(*key, *[F.col(c).alias(f"__{c}") for c in sides], F.lit(True).alias("__was"))
    moved = F.lit(False)
    for c in sides:
        moved |= ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    stale = flag("ocr_stale") if "ocr_stale" in new.columns else F.lit(False)
    return new.join(before, key, "left").withColumn("ocr_stale", stale | (flag("__was") & moved)).select(*dict.fromkeys([*new.columns, "ocr_stale"]))


def released_seams(regions: DataFrame, key: str = "id") -> DataFrame:
    """Regions whose seam partner is gone or points elsewhere lose their partner and child flag and become stale."""
    other = regions.select(F.col(key).alias("__id"), F.col("seam_partner").alias("__back"))
    joined = regions.join(other, F.col("seam_partner") == F.col("__id"), "left")
    broken = F.col("seam_partner").isNotNull() & ~F.col("__back").eqNullSafe(F.col(key))
    changed = {"seam_partner": F.when(~broken, F.col("seam_partner")), "seam_child": flag("seam_child") & ~broken, "ocr_stale": flag("ocr_stale") | (broken & flag("seam_child"))}
    return joined.withColumns(changed).select(*regions.columns)


def prefer_scripted(rows: DataFrame, text: str, group: str, script: str) -> DataFrame:
    """The rows of a group in a script if it has any, else all its rows."""
    own = F.coalesce(F.col(text).rlike(script), F.lit(False))
    return rows.withColumn("__own", own).withColumn("__any", F.max("__own").over(W.partitionBy(group))).filter("__own or not __any").drop("__own", "__any")


def failures_by_page(regions: DataFrame, key: str = "page_key") -> DataFrame:
    """Failed readings per page, and in total as the row without a page."""
    return regions.filter(flag("_ocr_failed")).rollup(key).agg(F.count("*").alias("failures"))


def visible_with_text(regions: DataFrame) -> DataFrame:
    """Regions that are visible (by default) and show a text."""
    text = first_text(F.col("applied_text"), F.col("translation"), F.col("text"))
    return regions.filter(F.coalesce("visible", F.lit(True)) & has_text(text))


def reversed_pages(pages: DataFrame, chapter: str, order: str) -> DataFrame:
    """Pages with place, from 1 for the last of their chapter: how many pages stand behind, counted by ranges of order."""
    return sums_before(pages.withColumn("__back", -F.col(order)), [chapter], ["__back"], F.lit(1), "place").withColumn("place", F.col("place") + 1).drop("__back")
