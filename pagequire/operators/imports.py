"""Context of a work brought in as text or JSON: its sections, its fields, and the block that it becomes in a prompt."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import has_text, stripped

# fixed values: words that open a section, and the longest heading
SECTIONS = {
    "context": ["contexto", "historia", "resumen", "sinopsis", "context", "story", "summary"],
    "style": ["estilo", "reglas", "tono", "convenciones", "style", "rules"],
    "glossary": ["glosario", "terminos", "nombres", "glossary", "terms"],
}
LONGEST = 30
# fixed values: keys of the fields in JSON
KEYS = {
    "title": ["obra", "titulo", "title"],
    "context": ["contexto", "context", "historia", "resumen"],
    "style": ["estilo", "style", "reglas", "rules"],
}
# fixed values: what begins the parts of the block
LABELS = {"title": "Obra: ", "context": "Contexto de la historia:\n", "style": "Reglas de estilo que se deben respetar:\n"}


def alike(a: Column, word: str) -> Column:
    """Equal but for case and accents."""
    return F.collate(a, "UNICODE_CI_AI") == F.lit(word)


def among(a: Column, words: list[str]) -> Column:
    return functools.reduce(Column.__or__, [alike(a, w) for w in words])


def sectioned_lines(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """Lines with heading (whether the line opens a section), section (the one it opens or stands in; null before the
    first) and rest (what a heading says behind its colon).

    A heading is a section's word, or up to three words that begin with one, before a colon or the end; lines with bars
    or tabs are none. With text behind the colon it counts if it is marked (#, **, __), or if no section is open yet.
    `order` has no ties within a document."""
    raw = stripped(F.col(line))
    body = stripped(F.regexp_replace(raw, "^#+", ""))
    at = F.regexp_instr(body, F.lit("[:：]"))
    word = stripped(F.regexp_replace(F.when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(body), r"^[ *_#]+|[ *_#]+$", ""))
    rest = F.when(at > 0, F.regexp_replace(F.expr("substring(__body, __at + 1)"), r"^[\s*_]+|[\s*_]+$", "")).otherwise(F.lit(""))
    words = F.split("__word", r"\s+")
    named = F.coalesce(*[F.when(among(F.col("__word"), w) | among(words[0], w) & (F.size(words) <= 3), F.lit(s)) for s, w in SECTIONS.items()])
    able = ~raw.rlike(r"[|\t]") & (F.col("__word") != "") & (F.length("__word") <= LONGEST)
    rows = lines.withColumns({"__body": body, "__at": at, "__word": word}).withColumns({"__named": F.when(able, named), "__rest": rest})
    turn = W.partitionBy(doc).orderBy(order)
    opened = F.coalesce(F.max(F.col("__named").isNotNull()).over(turn.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    sure = raw.rlike(r"^(#|\*\*|__)") | (F.col("__rest") == "")
    heading = F.col("__named").isNotNull() & F.coalesce(sure | ~opened, F.lit(False))
    rows = rows.withColumn("heading", heading)
    section = F.last(F.when(F.col("heading"), F.col("__named")), True).over(turn)
    return rows.withColumns({"section": section, "rest": F.when(F.col("heading"), F.col("__rest"))}).drop("__body", "__at", "__word", "__named", "__rest")


def section_texts(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """Each document's sections as texts: what their headings say and the lines in them, in order."""
    rows = sectioned_lines(lines, doc, order, line).filter("section is not null").filter("not heading or rest <> ''")
    said = F.when(F.col("heading"), F.col("rest")).otherwise(F.coalesce(F.col(line), F.lit("")))
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), said.alias("s"))))
    return rows.groupBy(doc, "section").agg(stripped(F.array_join(F.transform(parts, lambda p: p["s"]), "\n")).alias("content"))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """What `then` makes of a value that is reckoned once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def json_context(text: Column) -> Column:
    """title, context and style of a JSON object, by keys in any case and with or without accents: the first key that has
    a value; lists become rows with dashes. Null where the text is no object."""
    names = [name for some in KEYS.values() for name in some]
    # each entry is told apart once: which of the names its key reads as, 0 for none, and whether its value is as good as none
    number = lambda key: functools.reduce(lambda rest, i: F.when(alike(key, names[i]), i + 1).otherwise(rest), reversed(range(len(names))), F.lit(0))
    read = lambda entries: F.transform(entries, lambda e: F.struct(number(e["key"]).alias("n"), F.when(~e["value"].isin("", "[]", "{}", "0", "false", "null"), e["value"]).alias("value")))

    def field(known: Column, some: list[str]) -> Column:
        """The first name whose last key has a value."""
        last = lambda name: F.try_element_at(F.filter(known, lambda e: e["n"] == names.index(name) + 1), F.lit(-1))["value"]
        value = F.coalesce(*[last(name) for name in some])
        rows = lambda v: F.array_join(F.transform(F.from_json(v, "array<string>"), lambda x: F.concat(F.lit("- "), F.coalesce(x, F.lit("None")))), "\n")
        return once(value, lambda v: F.coalesce(F.when(v.startswith("["), rows(v)), stripped(v), F.lit("")))

    fields = lambda known: F.when(known.isNotNull(), F.struct(*[field(known, some).alias(name) for name, some in KEYS.items()]))
    entries = F.when(stripped(text).startswith("{"), F.map_entries(F.from_json(text, "map<string,string>")))
    return once(read(entries), fields)


def merged_prompt(prompt: Column, fields: dict[str, Column], start: str, end: str) -> Column:
    """The prompt with a block of the fields that are not blank at its end, in place of earlier blocks."""
    base = stripped(F.regexp_replace(F.coalesce(prompt, F.lit("")), "(?s)" + re.escape(start) + ".*?" + re.escape(end), ""))
    parts = [F.when(has_text(fields[name]), F.concat(F.lit(label), fields[name])) for name, label in LABELS.items()]
    some = F.coalesce(*parts).isNotNull()
    block = F.concat_ws("\n", F.lit(start), *parts, F.lit(end))
    return F.when(~some, base).when(base == "", block).otherwise(F.concat_ws("\n\n", base, block))
