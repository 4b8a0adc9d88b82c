"""Queries of text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import terms
from .base import Collector, Tables

query = Collector()
def _raw(t: Tables) -> DataFrame:
    k = F.col("turn") % 4
    raw = F.when(k == 0, F.concat(F.lit("BEGIN\n"), "text", F.lit("  \n\n\n\nEND"))).when(k == 1, F.concat(F.lit("<|im_start|>"), "text", F.lit("<box 3>"))).when(k == 2, F.concat(F.lit("```text\n"), "text", F.lit("\n```"))).otherwise(F.concat(F.lit("  "), "text", F.lit("\r\nSTOP:")))
    return t.conversations.select("conv_id", "turn", raw.alias("raw"))


# a text as its lines, without blanks around them, in paragraphs
TIGHT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[ \\t]+\\n', E'\\n', 'g'), '\\n{{3,}}', E'\\n\\n', 'g'), '^\\s+', ''), '\\s+$', '')"
LINES = "array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda x: trim(x, E' \\t')), lambda x: x <> ''), chr(10))"


@query(f"""WITH s AS (SELECT conv_id, turn, regexp_split_to_array({TIGHT.format("text")}, '\\n[ \\t]*\\n+') AS p FROM conversations), e AS (SELECT conv_id, turn, generate_subscripts(p, 1) AS i, unnest(p) AS p FROM s)
SELECT conv_id, turn, coalesce(string_agg({LINES}, E'\\n\\n' ORDER BY i) FILTER (WHERE {LINES} <> ''), '') AS text FROM e GROUP BY conv_id, turn""")
def f1_reading_text(t: Tables) -> DataFrame:
    """Whatever was put around the texts goes, and their own lines come back."""
    return _raw(t).select("conv_id", "turn", text.reading_text(F.col("raw")).alias("text"))


@query(f"""WITH x AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN '<|im_start|>' || text || '<box 3>' WHEN 2 THEN E'```text\\n' || text || E'\\n```' ELSE text || E'\\nSTOP:' END AS text FROM conversations) SELECT conv_id, turn, {TIGHT.format("text")} AS text FROM x""")
def f2_translation_text(t: Tables) -> DataFrame:
    """Of what was put around the texts only the labels BEGIN and END go."""
    return _raw(t).select("conv_id", "turn", text.translation_text(F.col("raw")).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ja' WHEN doc_id % 5 = 0 THEN 'ko' WHEN doc_id % 7 = 0 THEN 'zh' ELSE 'es' END AS language FROM documents")
def f4_language(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    tail = F.when(k % 3 == 0, "漢字かな").when(k % 5 == 0, "한국 漢").when(k % 7 == 0, "漢字").otherwise("")
    return t.documents.select("doc_id", text.language(F.concat("text", tail)).alias("language"))


@query("SELECT conv_id, turn, word || trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS entry FROM (SELECT conv_id, turn, CASE turn % 5 WHEN 3 THEN '2024 ' WHEN 4 THEN '' ELSE 'x ' END AS word, replace(replace(text, E'\\n', ' '), E'\\t', ' ') AS text FROM conversations)")
def f20_without_number(t: Tables) -> DataFrame:
    """Numbered one-row entries lose one number and keep what follows, another number too."""
    clean = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    k = F.col("turn") % 5
    word = F.when(k == 3, "2024 ").when(k == 4, "").otherwise("x ")
    number = F.when(k == 0, "12. ").when(k == 1, "#7 ").when(k == 2, "[3] ").when(k == 3, "9) ").otherwise("[ 4 ]: ")
    return t.conversations.select("conv_id", "turn", text.without_number(F.concat(number, word, clean)).alias("entry"))


@query("SELECT doc_id, array_to_string(list_filter([array_to_string(list_filter([trim(l, E' \\t\\r') FOR l IN string_split(p, chr(10))], lambda x: x <> ''), ' ') FOR p IN regexp_split_to_array(trim(text, E' \\t\\n\\r'), '\\n\\s*\\n+')], lambda x: x <> ''), ' / ') AS entry FROM documents")
def f21_one_row(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.one_row(F.col("text")).alias("entry"))


RULES = ", ".join(f"({i}, '{kind}', {list(fragments)!r})" for i, (kind, _, fragments) in enumerate(text.FAILURES))
MESSAGE = "CASE event_type WHEN 'error' THEN 'Provider (HTTP ' || (400 + event_id % 105) || '): refused' WHEN 'view' THEN 'CUDA out of memory' WHEN 'click' THEN 'Connection reset by peer' ELSE 'nothing known ' || event_id END"


def _messages(t: Tables) -> DataFrame:
    e = F.col("event_type")
    message = F.when(e == "error", F.concat(F.lit("Provider (HTTP "), (400 + F.col("event_id") % 105).cast("string"), F.lit("): refused"))).when(e == "view", "CUDA out of memory").when(e == "click", "Connection reset by peer").otherwise(F.concat(F.lit("nothing known "), F.col("event_id").cast("string")))
    return t.events.select("event_id", message.alias("message"))


@query(f"WITH m AS (SELECT event_id, lower({MESSAGE}) AS low FROM events), r(ord, kind, fragments) AS (VALUES {RULES}), f AS (SELECT event_id, arg_min(kind, ord) AS kind FROM m JOIN r ON len([x FOR x IN fragments IF contains(low, x)]) > 0 GROUP BY event_id) SELECT event_id, coalesce(kind, 'unknown') AS kind FROM m LEFT JOIN f USING (event_id)")
def f25_failure_kind(t: Tables) -> DataFrame:
    return _messages(t).select("event_id", text.failure_kind(F.col("message")).alias("kind"))


@query(f"SELECT event_id, len([x FOR x IN {text.TRANSIENT!r} IF contains(lower({MESSAGE}), x)]) > 0 AS again FROM events")
def f26_transient(t: Tables) -> DataFrame:
    return _messages(t).select("event_id", text.is_transient(F.col("message")).alias("again"))


@query("WITH e AS (SELECT event_id, value AS s, (event_id % 120)::DOUBLE AS p FROM events), l AS (SELECT *, s * (100 - p) / nullif(p, 0) AS l FROM e) SELECT event_id, CASE WHEN p >= 5 AND p < 100 AND s >= 3 THEN (CASE WHEN l < 60 THEN round_even(l / 5, 0) * 5 ELSE round_even(l / 60, 0) * 60 END)::BIGINT END AS remaining FROM l")
def f27_remaining(t: Tables) -> DataFrame:
    percent = F.nullif((F.col("event_id") % 120).cast("double"), F.lit(0.0))
    return t.events.select("event_id", text.remaining_seconds(F.col("value"), percent).alias("remaining"))


@query("SELECT doc_id, sha256(length(lang) || ':' || lang || length(source) || ':' || source || '-' || length(doc_id::VARCHAR) || ':' || doc_id) AS key FROM documents")
def f28_content_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.content_key(F.col("lang"), F.col("source"), F.lit(None).cast("string"), F.col("doc_id")).alias("key"))


@query("SELECT p_partkey AS id, upper(p_name) AS upper, lower(p_name) AS lower FROM part")
def f39_case(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.part.select(F.col("p_partkey").alias("id"), text.cased(name, F.lit("upper")).alias("upper"), text.cased(name, F.lit("lower")).alias("lower"))


@query("SELECT o_custkey AS folder, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders")
def o1_natural_order(t: Tables) -> DataFrame:
    """Files named by unpadded numbers come in the order of the numbers."""
    from pyspark.sql import Window as W

    name = F.concat(F.lit("Page "), F.col("o_orderkey").cast("string"), F.lit(".PNG"))
    turn = W.partitionBy("o_custkey").orderBy(values.natural_key(name))
    return t.orders.select(F.col("o_custkey").alias("folder"), F.col("o_orderkey").alias("id"), F.row_number().over(turn).alias("place"))


@query("SELECT item_id, generate_subscripts(w, 1) AS place, unnest(w) AS entry FROM (SELECT item_id, [x FOR x IN string_split(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), ' ') IF x <> ''] AS w FROM benchmark)")
def f23_numbered_entries(t: Tables) -> DataFrame:
    """The words of a text, written as numbered rows, come back as entries."""
    words = F.filter(F.split(F.regexp_replace("text", "[^a-zA-Z ]", ""), " "), lambda x: x != "")
    page = F.array_join(F.transform(words, lambda w, i: F.concat((i + 1).cast("string"), F.lit(". "), w)), "\n")
    return terms.numbered_entries(t.benchmark.select("item_id", page.alias("page")), "item_id", "page")


@query("""WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n, replace(coalesce(text, ''), '=', '-') AS text FROM conversations)
SELECT conv_id, 'turn ' || n AS name, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS body FROM r WHERE regexp_matches(text, '\\S')""")
def f24_sections(t: Tables) -> DataFrame:
    """Turns of all conversations under headers, numbered from 1, with signs that could be headers written otherwise, come
    back as sections."""
    whole = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.replace(F.coalesce("text", F.lit("")), F.lit("="), F.lit("-")).alias("text")))).alias("turns"))
    page = F.array_join(F.transform("turns", lambda s, i: F.concat(F.lit("=== turn "), (i + 1).cast("string"), F.lit(" ===\n"), s["text"])), "\n\n")
    return terms.sections(whole.select("conv_id", page.alias("page")), "conv_id", "page").select("conv_id", "name", "body")


@query("WITH w AS (SELECT doc_id, text, 'the' AS a, 'th' AS b FROM documents) SELECT doc_id, replace(replace(text, a, '__TERM_0000__'), b, '__TERM_0001__') AS text FROM w")
def f17_protected(t: Tables) -> DataFrame:
    words = F.array(F.struct(F.lit("th").alias("source")), F.struct(F.lit("the").alias("source")))
    return t.documents.select("doc_id", terms.protect(F.col("text"), words).alias("text"))


@query("SELECT doc_id, contains(lower(text), 'the th') AS hit FROM documents")
def p11_search(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.matches(F.col("text"), F.lit("The TH")).alias("hit"))


QUERIES, ORACLE_SQL = query.queries, query.sql
