"""Texts of a chapter: search and replacement, numbered pages and sections, batches for a translator and their answers,
context along pages, and what readings leave in the fields of regions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import CJK, one_row, reading_text, translation_text
from ..functions.values import first_text, floor_div, has_text, stripped
from .strips import sums_before

# the mark before each text of a batch, by its slot
MARK, MARK_FORM = "<<<BOX_%04d>>>", r"<<<BOX_(\d{4})>>>"
# fixed values: keys under which lists of terms nest, and keys that make an object a term
TERM_LISTS, TERM_KEYS = ["terms", "glossary", "entries", "items"], ["source", "original", "term", "name"]
#: Foreign terms that go along as reference, at most.
REFERENCES = 40


def pattern(wanted: str, same_case: bool, whole_word: bool) -> str:
    """A regular expression for literal text."""
    body = re.sub(r"([^\w\s])", r"\\\1", wanted)
    return ("" if same_case else "(?iu)") + (rf"\b{body}\b" if whole_word else body)


def shown_text() -> Column:
    """What a region shows in the script: the translation, else the applied text, else the reading."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("translation", "applied_text", "text")], F.lit(""))


def find_next(regions: DataFrame, page: str, order: str, after: Column, wanted: str, same_case: bool = False, whole_word: bool = False) -> DataFrame:
    """On each page the first region behind place `after` (0-based, circular, itself last) whose shown text or reading
    holds what is searched for; pages without one have no row."""
    turn = W.partitionBy(page)
    rows = regions.withColumns({"__at": F.row_number().over(turn.orderBy(order)) - 1, "__n": F.count("*").over(turn)})
    found = rows.filter(shown_text().rlike(pattern(wanted, same_case, whole_word)) | F.coalesce("text", F.lit("")).rlike(pattern(wanted, same_case, whole_word)))
    far = F.pmod(F.col("__at") - after - 1, F.col("__n"))
    return found.groupBy(page).agg(F.min(F.struct(far, "__at"))["__at"].alias("place"))


def replace_all(regions: DataFrame, wanted: str, put: str, same_case: bool = False, whole_word: bool = False) -> DataFrame:
    """Regions with replaced, how often the shown text held what is searched for; where it did, the new text is the
    translation and the applied text. `put` is literal."""
    form, text = pattern(wanted, same_case, whole_word), shown_text()
    new = F.regexp_replace(text, form, put.replace("\\", "\\\\").replace("$", "\\$"))
    rows = regions.withColumns({"replaced": F.regexp_count(text, F.lit(form)), "__new": new})
    return rows.withColumns({c: F.when(F.col("replaced") > 0, F.col("__new")).otherwise(F.col(c)) for c in ("translation", "applied_text")}).drop("__new")


def layer_matches(number: Column, label: Column, wanted: Column) -> Column:
    """Whether a layer's number, label or texts hold what is searched for; everything does where that is blank."""
    text = F.lower(F.concat_ws(" ", number.cast("string"), *[F.coalesce(c, F.lit("")) for c in (label, F.col("text"), F.col("translation"), F.col("applied_text"))]))
    return F.when(~has_text(wanted), True).otherwise(text.contains(F.lower(stripped(wanted))))


def numbered_lines(rows: DataFrame, page: str, number: str, text: str) -> DataFrame:
    """content of each page: its texts as one row each with their numbers, without blank ones; pages of blank texts have
    none."""
    rows = rows.withColumn("__row", one_row(F.col(text))).filter("__row <> ''")
    line = F.concat(F.greatest(F.lit(1), F.col(number)).cast("string"), F.lit(". "), F.col("__row"))
    return rows.groupBy(page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(number).alias("n"), line.alias("line")))), lambda s: s["line"]), "\n").alias("content"))


def chapter_text(pages: DataFrame, chapter: str, order: str, name: str, content: str) -> DataFrame:
    """The pages that have content as sections under their names, in order."""
    body = stripped(F.col(content))
    rows = pages.filter(has_text(F.col(content))).withColumn("__part", F.concat(F.lit("=== "), F.col(name), F.lit(" ===\n"), body))
    return rows.groupBy(chapter).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__part").alias("p")))), lambda s: s["p"]), "\n\n").alias("chapter_text"), F.count("*").alias("sections"))


def dialogue_counts(regions: DataFrame, page: str) -> DataFrame:
    return regions.groupBy(page).agg(F.count("*").alias("total"), F.count_if(has_text(F.col("translation"))).alias("translated"))


def marked_batches(rows: DataFrame, batch: list[str], order: str, text: str) -> DataFrame:
    """One text for each batch, its parts in order behind marks with their slots from 1."""
    slots = rows.withColumn("__slot", F.row_number().over(W.partitionBy(*batch).orderBy(order)))
    part = F.concat(F.format_string(MARK, "__slot"), F.lit("\n"), F.coalesce(text, F.lit("")))
    return slots.groupBy(*batch).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__slot", part.alias("p")))), lambda s: s["p"]), "\n\n").alias("marked"), F.count("*").alias("expected"))


def unmarked(answer: Column, expected: Column) -> Column:
    """The texts of an answer by slot; null unless it has each slot from 1 to `expected` once."""
    slots = F.transform(F.regexp_extract_all(answer, F.lit(MARK_FORM), F.lit(1)), lambda x: x.cast("int"))
    texts = F.transform(F.slice(F.split(answer, MARK_FORM), F.lit(2), F.greatest(F.lit(0), F.size(slots))), stripped)
    ordered = F.transform(F.array_sort(F.arrays_zip(slots.alias("slot"), texts.alias("text"))), lambda s: s["text"])
    return F.when(F.array_sort(slots) == F.sequence(F.lit(1), F.greatest(F.lit(1), expected)), ordered)


def json_texts(answer: Column, expected: Column) -> Column:
    """The translations of an answer in JSON, a list or an object with one, with or without a code fence; null unless
    there are as many as expected."""
    bare = stripped(answer)
    inside = F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n", ""), r"(?s)```[^`]*$", "")
    bare = stripped(F.when(bare.startswith("```"), inside).otherwise(bare))
    found = F.coalesce(F.when(bare.startswith("["), F.from_json(bare, "array<string>")), F.when(bare.startswith("{"), F.from_json(bare, "translations array<string>")["translations"]))
    return F.when(F.size(found) == expected, F.transform(found, stripped))


@F.pandas_udf(StringType())
def innermost(texts: pd.Series) -> pd.Series:
    """JSON without the objects around its list of terms, however deep they nest; other text as it is."""

    def inner(text: str | None) -> str | None:
        try:
            found = json.loads(text)
            at = found
            while isinstance(at, dict):
                under = next((at[k] for k in TERM_LISTS if isinstance(at.get(k), (dict, list))), None)
                if under is None:
                    break
                at = under
            return text if at is found else json.dumps(at, ensure_ascii=False)
        except (TypeError, ValueError, RecursionError):  # null, not JSON, or nested beyond what parsers read
            return text

    return texts.map(inner)


def json_terms(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Terms out of JSON: a list of objects, lists under a known key (one inside another too), one object that is a term,
    or an object of sources with their targets. Returns key, place, source and target; text that is no JSON has none."""
    rows = rows.select(*key, stripped(innermost(F.col(value))).alias("__j"))
    one = F.coalesce(*[F.get_json_object("__j", f"$.{k}") for k in TERM_KEYS])
    parts = F.when(F.col("__j").startswith("["), F.from_json("__j", "array<string>")).when(one.isNotNull(), F.array("__j"))
    listed = rows.filter(parts.isNotNull()).select(*key, F.posexplode(parts).alias("place", "t"))
    field = lambda names: F.coalesce(*[F.get_json_object("t", f"$.{n}") for n in names])
    listed = listed.select(*key, "place", field(TERM_KEYS).alias("source"), field(["target", "translation"]).alias("target"))
    pairs = rows.filter(F.col("__j").startswith("{") & one.isNull()).select(*key, F.posexplode(F.map_entries(F.from_json("__j", "map<string,string>"))).alias("place", "e"))
    pairs = pairs.select(*key, "place", F.col("e.key").alias("source"), F.coalesce(F.get_json_object("e.value", "$.target"), "e.value").alias("target"))
    return listed.unionByName(pairs).filter(has_text(F.col("source")))


def memory_pairs(context: Column, most: int = 12) -> Column:
    """The first pairs (source, target) of a context, a line each with an arrow between them; lines without one, or with a
    blank side, do not count. Null has none."""
    parts = F.transform(F.split(F.coalesce(context, F.lit("")), "\r\n|\r|\n"), lambda line: F.split(line, "→", 2))
    pairs = F.transform(F.filter(parts, lambda p: F.size(p) == 2), lambda p: F.struct(stripped(p[0]).alias("source"), stripped(p[1]).alias("target")))
    return F.slice(F.filter(pairs, lambda p: (p["source"] != "") & (p["target"] != "")), 1, most)


def first_terms(found: DataFrame, key: str, order: str, most: int = 100) -> DataFrame:
    """The first terms of each batch: ranked before the shuffle's end, so that a batch keeps `most` rows a task."""
    return found.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order))).filter(F.col("__n") <= most).drop("__n")


def prompt_terms(found: DataFrame, key: str, order: str) -> DataFrame:
    """One text for each batch: its terms as `source = target (note)`, in order."""
    note = F.when(has_text(F.col("note")), F.concat(F.lit(" ("), stripped(F.col("note")), F.lit(")"))).otherwise("")
    line = F.concat("source", F.lit(" = "), "target", note)
    return found.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda s: s["l"]), "\n").alias("terms"))


def reference_terms(terms: DataFrame, texts: DataFrame, key: str, text: str, found: DataFrame, order: str, span: int = 4096) -> DataFrame:
    """For each batch with a Chinese, Japanese or Korean text the first REFERENCES terms in another script that none of
    its texts holds; such names could never match. `found`: (key, order) of those that match. `order`: whole numbers,
    by ranges of which terms are counted, so that no task sorts all of them. Only the first terms can be meant, REFERENCES
    more than match at most, so no batch meets all terms."""
    batches = texts.groupBy(key).agg(F.max(F.coalesce(F.col(text), F.lit("")).rlike(CJK)).alias("__cjk")).filter("__cjk").select(key)
    hits = found.select(key, order).distinct().groupBy(key).agg(F.count("*").alias("__hits"))
    foreign = terms.filter(~F.col("source").rlike(CJK) & has_text(F.col("source")))
    place = sums_before(foreign.withColumn("__all", F.lit(0)), ["__all"], [order], F.lit(1), "__place", span).withColumn("__place", F.col("__place") + 1).drop("__all")
    wanted = batches.join(hits, key, "left").select(key, F.explode(F.sequence(F.lit(1), (F.coalesce("__hits", F.lit(0)) + REFERENCES).cast("int"))).alias("__place"))
    rest = wanted.join(place, "__place").join(found.select(key, order).distinct(), [key, order], "left_anti")
    return rest.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy("__place"))).filter(F.col("__n") <= REFERENCES).drop("__n", "__place")


def _earlier(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """Rows with __end, the sum of their texts' lengths so far, and __before: the last `most` characters of the earlier
    texts (__own, at most that long), a line each, empty ones left out. Only rows within reach are gathered for a row."""
    size = F.when(F.col("__own") == "", 0).otherwise(F.length("__own") + 1)
    rows = rows.withColumn("__end", F.sum(size).over(W.partitionBy(*keys).orderBy(order)))
    near = F.collect_list(F.struct(F.col(order).alias("o"), F.col("__own").alias("t"))).over(W.partitionBy(*keys).orderBy("__end").rangeBetween(-2 * most - 2, 0))
    rows = rows.withColumn("__near", F.sort_array(near))
    past = F.filter("__near", lambda s: (s["o"] < F.col(order)) & (s["t"] != ""))
    return rows.withColumn("__before", F.array_join(F.transform(past, lambda s: s["t"]), "\n")).withColumn("__before", F.expr(f"right(__before, {most})")).drop("__near")


def rolling_context(pairs: DataFrame, chapter: str, order: str, most: int = 5000, span: int = 1024) -> DataFrame:
    """For each page of a chapter the last `most` characters of all pairs (source, target) of earlier pages, in order.

    `order`: whole numbers. Pairs with a null side are left out; their page has its row. A page's own text is cut to `most`
    characters. Pages are handled by ranges of `span` places: within a range a page sees the earlier ones, and the tail of
    the ranges before is carried in, so that no task handles a whole chapter."""
    line = F.concat("source", F.lit(" → "), "target")
    pages = pairs.groupBy(chapter, order).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("l")))), lambda s: s["l"]), "\n").alias("__own"))
    pages = pages.withColumns({"__own": F.expr(f"right(__own, {most})"), "__range": floor_div(F.col(order), F.lit(span))})
    inside = _earlier(pages, [chapter, "__range"], order, most)
    whole = F.max("__end").over(W.partitionBy(chapter, "__range"))
    last = inside.withColumn("__left", whole - F.col("__end")).filter((F.col("__left") <= most) & (F.col("__own") != ""))
    tails = last.groupBy(chapter, "__range").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__own").alias("t")))), lambda s: s["t"]), "\n").alias("__own"))
    tails = tails.withColumn("__own", F.expr(f"right(__own, {most})"))
    # a range without text still needs what is carried over it
    every = inside.select(chapter, "__range").distinct().join(tails, [chapter, "__range"], "left").withColumn("__own", F.coalesce("__own", F.lit("")))
    carried = _earlier(every, [chapter], "__range", most).select(chapter, "__range", F.col("__before").alias("__carried"))
    both = F.concat_ws("\n", F.nullif("__carried", F.lit("")), F.nullif("__before", F.lit("")))
    return inside.join(carried, [chapter, "__range"]).withColumn("__text", both).select(chapter, order, F.expr(f"right(__text, {most})").alias("context"))


def promoted(regions: DataFrame) -> DataFrame:
    """After a reading: its text made clean, and shown where a region has no translation or applied text yet."""
    text = reading_text(F.col("text"))
    rows = regions.withColumns({"text": text}).withColumns({"ocr_completed": has_text(F.col("text")), "translation": F.when(has_text(F.col("translation")), F.col("translation")).otherwise(F.col("text"))})
    return rows.withColumn("applied_text", F.when(has_text(F.col("applied_text")), F.col("applied_text")).otherwise(first_text(F.col("translation"), F.col("text"))))


def repaired(regions: DataFrame) -> DataFrame:
    """Stored texts without transport labels, changed where one differs, and flags that follow the texts."""
    new = {"text": reading_text(F.col("text")), "translation": translation_text(F.col("translation")), "applied_text": translation_text(F.col("applied_text"))}
    changed = F.lit(False)
    for c, x in new.items():
        changed |= F.coalesce(F.col(c), F.lit("")) != x
    rows = regions.withColumn("changed", changed).withColumns(new)
    return rows.withColumns({"translation_completed": F.when(F.col("translation") == "", False).otherwise(F.col("translation_completed")), "ocr_completed": has_text(F.col("text"))})


def read_together(boxes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes without the halves of seam pairs (page_key, u_idx, next_key, l_idx), and a job for each pair."""
    halves = pairs.select("page_key", F.col("u_idx").alias("idx")).unionByName(pairs.select(F.col("next_key").alias("page_key"), F.col("l_idx").alias("idx")))
    return boxes.join(halves, ["page_key", "idx"], "left_anti"), pairs.select("page_key", "u_idx", "next_key", "l_idx")
