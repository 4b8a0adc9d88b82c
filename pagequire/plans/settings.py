"""Queries of imported context, fonts and looks, shapes and saved layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import fonts, imports, limits, shapes
from .base import BOXES, REGIONS, Collector, Tables

query = Collector()
LINES = """lines_ AS (SELECT conv_id, turn, k, l, CASE k WHEN 0 THEN '## Contexto' WHEN 1 THEN 'Estilo: ' || l WHEN 2 THEN l WHEN 3 THEN 'TÉRMINOS:' ELSE 'a | ' || l END AS line
 FROM (SELECT conv_id, turn, (conv_id + turn) % 5 AS k, regexp_replace(text, '\\s+', ' ', 'g') AS l FROM conversations)),
open_ AS (SELECT *, coalesce(max(k IN (0, 1, 3)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS opened FROM lines_),
heads_ AS (SELECT *, k IN (0, 3) OR k = 1 AND NOT opened AS heading, CASE k WHEN 0 THEN 'context' WHEN 1 THEN 'style' ELSE 'glossary' END AS named FROM open_),
sections_ AS (SELECT conv_id, turn, line, heading, last_value(CASE WHEN heading THEN named END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section,
 CASE WHEN heading THEN CASE WHEN k = 1 THEN trim(l, ' *_') ELSE '' END END AS rest FROM heads_)"""


def _lines(t: Tables) -> DataFrame:
    k, one = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)), F.regexp_replace("text", r"\s+", " ")
    line = F.when(k == 0, "## Contexto").when(k == 1, F.concat(F.lit("Estilo: "), one)).when(k == 2, one).when(k == 3, "TÉRMINOS:").otherwise(F.concat(F.lit("a | "), one))
    return t.conversations.select("conv_id", "turn", line.alias("line"))


@query(f"WITH {LINES} SELECT conv_id, turn, heading, section, rest FROM sections_")
def f7_headings(t: Tables) -> DataFrame:
    return imports.sectioned_lines(_lines(t), "conv_id", "turn", "line").select("conv_id", "turn", "heading", "section", "rest")


@query(f"WITH {LINES} SELECT conv_id, section, trim(string_agg(CASE WHEN heading THEN rest ELSE line END, chr(10) ORDER BY turn), E' \\n') AS content FROM sections_ WHERE section IS NOT NULL AND (NOT heading OR rest <> '') GROUP BY conv_id, section")
def s13_sections(t: Tables) -> DataFrame:
    return imports.section_texts(_lines(t), "conv_id", "turn", "line")


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN '' END AS title, CASE p_partkey % 4 WHEN 0 THEN '- ' || p_brand || E'\\n- ' || p_type WHEN 1 THEN '' WHEN 2 THEN p_name END AS context, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_type WHEN 2 THEN '' END AS style FROM part")
def f9_json_context(t: Tables) -> DataFrame:
    """Keys in any case and with accents, lists, empty values, and a text that is no object."""
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.to_json(F.struct(F.col("p_name").alias("Título"), F.array("p_brand", "p_type").alias("CONTEXTO"))))
    text = text.when(k == 1, F.to_json(F.struct(F.lit("").alias("obra"), F.col("p_brand").alias("title"), F.col("p_type").alias("Rules"), F.array().cast("array<string>").alias("context"))))
    text = text.when(k == 2, F.to_json(F.struct(F.col("p_name").alias("historia")))).otherwise(F.to_json(F.array("p_name")))
    return t.part.select(F.col("p_partkey").alias("id"), imports.json_context(text).alias("c")).select("id", "c.title", "c.context", "c.style")


@query("""WITH p AS (SELECT conv_id, turn, trim(CASE WHEN turn % 2 = 0 THEN text ELSE '' END, E' \\t\\r\\n') AS base, CASE WHEN turn % 3 = 0 THEN 'Obra: ' || role END AS title, CASE WHEN turn % 5 = 0 THEN E'Reglas de estilo que se deben respetar:\\n' || text END AS style FROM conversations)
SELECT conv_id, turn, CASE WHEN title IS NULL AND style IS NULL THEN base ELSE CASE WHEN base = '' THEN '' ELSE base || E'\\n\\n' END || concat_ws(chr(10), '[[', title, style, ']]') END AS prompt FROM p""")
def f10_merged_prompt(t: Tables) -> DataFrame:
    prompt = F.concat(F.lit("[[old\nblock]]"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(" "), F.lit("[[ ]]"))
    fields = {"title": F.when(F.col("turn") % 3 == 0, F.col("role")), "context": F.lit("  "), "style": F.when(F.col("turn") % 5 == 0, F.col("text"))}
    return t.conversations.select("conv_id", "turn", imports.merged_prompt(prompt, fields, "[[", "]]").alias("prompt"))


ALIASES = ["  Diálogo", "GRITOS", "Narración", "sfx", "Efectos de Sonido", "other", "Pensamiento ", "cuadro"]


@query(f"""WITH a AS (SELECT p_size AS project, p_partkey, p_name, {ALIASES}[p_partkey % 8 + 1] AS alias FROM part),
k AS (SELECT *, CASE WHEN p_partkey % 8 = 0 THEN 'dialogue' WHEN p_partkey % 8 = 1 THEN 'shout' WHEN p_partkey % 8 IN (2, 7) THEN 'caption' WHEN p_partkey % 8 IN (3, 4) THEN 'sfx' WHEN p_partkey % 8 = 6 THEN 'thought' END AS kind FROM a)
SELECT project, kind, arg_min(alias, p_partkey) AS alias, arg_min(p_name, p_partkey) AS family FROM k WHERE kind IS NOT NULL GROUP BY project, kind""")
def j26_fonts_of_kinds(t: Tables) -> DataFrame:
    alias = F.element_at(F.array(*[F.lit(a) for a in ALIASES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return fonts.fonts_of_kinds(t.part.withColumn("alias", alias), "p_size", "p_partkey", "alias", "p_name")


@query("SELECT DISTINCT trim(p_name) || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' ' || p_size END AS family FROM part WHERE p_size % 5 <> 0")
def o14_families(t: Tables) -> DataFrame:
    name = F.concat(F.when(F.col("p_size") % 5 == 0, "@").otherwise("  "), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "\t").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"))))
    return fonts.families(t.part.select(name.alias("name")), "name")


@query(f"""WITH {REGIONS}, r AS (SELECT *, nullif(balloon_kind, 'dialogue') IS NULL AND NOT (has_style AND trim(coalesce(translation, '')) <> '') AS put FROM regions_)
SELECT page_key, ord, CASE WHEN put THEN 'Role' ELSE nullif(balloon_kind, 'dialogue') END AS font_role, CASE WHEN put THEN 'Serif' WHEN has_style THEN translation END AS family, CASE WHEN put THEN 'red' WHEN has_style THEN 'black' END AS colour FROM r""")
def p26_role_defaults(t: Tables) -> DataFrame:
    style = F.when(F.col("has_style"), F.create_map(F.lit("font_family"), "translation", F.lit("colour"), F.lit("black")))
    rows = t.line_regions().select("page_key", "ord", F.col("balloon_kind").alias("font_role"), style.alias("style"))
    done = fonts.role_defaults(rows, F.lit("Role"), F.lit("Serif"), F.create_map(F.lit("colour"), F.lit("red")))
    return done.select("page_key", "ord", "font_role", F.col("style")["font_family"].alias("family"), F.col("style")["colour"].alias("colour"))


@query(f"WITH {REGIONS} SELECT page_key, ord, CASE WHEN NOT auto_fit THEN 'false' WHEN NOT sfx_enabled THEN 'true' END AS auto_fit, CASE WHEN NOT sfx_enabled THEN 'true' END AS balloon_fit FROM regions_")
def p27_adaptive_flags(t: Tables) -> DataFrame:
    style = F.map_filter(F.create_map(F.lit("sfx_enabled"), F.col("sfx_enabled").cast("string"), F.lit("auto_fit"), F.col("auto_fit").cast("string")), lambda _, v: v.isNotNull())
    done = fonts.adaptive_flags(t.line_regions().select("page_key", "ord", style.alias("style")))
    return done.select("page_key", "ord", *[F.col("style")[c].alias(c) for c in ("auto_fit", "balloon_fit")])


@query(f"WITH {REGIONS} SELECT page_key, ord, CASE balloon_kind WHEN 'shout' THEN 'upper' ELSE 'lower' END AS letters, CASE balloon_kind WHEN 'shout' THEN '3' END AS outline, CASE balloon_kind WHEN 'thought' THEN '1' END AS slant FROM regions_")
def p28_looks_of_kinds(t: Tables) -> DataFrame:
    looks = t.spark.createDataFrame([("shout", {"letters": "upper", "outline": "3"}), ("thought", {"slant": "1"})], "kind string, look map<string,string>")
    rows = t.line_regions().select("page_key", "ord", F.col("balloon_kind").alias("kind"), F.create_map(F.lit("letters"), F.lit("lower")).alias("style"))
    return fonts.looks_of_kinds(rows, looks).select("page_key", "ord", *[F.col("style")[c].alias(c) for c in ("letters", "outline", "slant")])


@query("""WITH p AS (SELECT l_suppkey AS stroke, l_partkey * 7 % 600 AS x, l_linenumber * (l_suppkey % 9 + 1) AS y FROM lineitem WHERE l_quantity > 8),
b AS (SELECT stroke, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS filled FROM p GROUP BY stroke)
SELECT *, greatest(width, height) >= 384 AND (greatest(width, height) / least(width, height) >= 5 OR filled / (width * height) < 0.22) AS crossing FROM b""")
def p17_crossing_strokes(t: Tables) -> DataFrame:
    points = t.lineitem.select(F.col("l_suppkey").alias("stroke"), (F.col("l_partkey") * 7 % 600).alias("x"), (F.col("l_linenumber") * (F.col("l_suppkey") % 9 + 1)).alias("y"), F.col("l_quantity").alias("value"))
    return shapes.crossing_strokes(points, "stroke", "x", "y", "value")


@query("""WITH b AS (SELECT p_partkey AS id, p_partkey % 3 AS shape, p_size * 8 AS w, p_size * 6 AS h, p_partkey % 5 + 1 AS n, greatest(2, least(8, greatest(2, least(p_size * 8, p_size * 6) // 5))) AS pad FROM part),
c AS (SELECT *, g.i::INT AS line, abs((g.i + 0.5::DOUBLE) * 12 - n * 6) / greatest(1, h / 2.0::DOUBLE - pad) AS away FROM b, generate_series(0, n - 1) g(i)),
d AS (SELECT *, greatest(0, round_even(w / 2.0::DOUBLE - greatest(8, greatest(1, w / 2.0::DOUBLE - pad) * CASE shape WHEN 0 THEN CASE WHEN away < 1 THEN sqrt(1 - least(0.999::DOUBLE, away * away)) ELSE 0 END WHEN 1 THEN greatest(0, 1 - away) ELSE 1 END), 0))::BIGINT AS lft FROM c),
e AS (SELECT *, bool_and(w - lft > lft + 4) OVER (PARTITION BY id) AS fits FROM d) SELECT id, line, lft AS left_edge, w - lft AS right_edge FROM e WHERE fits AND n * 12 <= h""")
def f42_chords(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    shape = F.when(k % 3 == 0, "ellipse").when(k % 3 == 1, "diamond").otherwise("rectangle")
    found = shapes.chords(shape, F.col("p_size") * 8, F.col("p_size") * 6, k % 5 + 1, F.lit(12.0), F.lit(8))
    return t.part.select(k.alias("id"), F.posexplode(found).alias("line", "c")).select("id", "line", F.col("c.left").alias("left_edge"), F.col("c.right").alias("right_edge"))


@query("SELECT p_partkey AS id, round(pow(1 - u, 3) * p_size + 3 * pow(1 - u, 2) * u * 10 + 3 * (1 - u) * u * u * p_retailprice + pow(u, 3) * 40, 4) AS at FROM (SELECT *, p_partkey % 11 / 10.0::DOUBLE AS u FROM part)")
def f42_bezier(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.round(shapes.bezier(F.col("p_size"), F.lit(10.0), F.col("p_retailprice"), F.lit(40.0), F.col("p_partkey") % 11 / 10), 4).alias("at"))


# a turn's layout holds: its text is the one it was made for, every sentence has a span inside the width, and its size is in bounds
LAID = """l_ AS (SELECT conv_id, turn, text, [length(x) FOR x IN string_split(text, '. ')] AS n FROM conversations), v_ AS (SELECT *, turn % 5 <> 0 AND turn % 7 <> 3 AND turn % 6 <> 5 AND list_min(n) >= 1 AND list_max(n) <= 118 AND length(text) % 600 BETWEEN 4 AND 500 AS valid FROM l_)"""


def _layouts(t: Tables) -> DataFrame:
    """The sentences of turns as the lines of their saved layouts; every fifth was made for another text, some are cut, and
    some lack a line's span."""
    k, lines = F.col("turn"), F.split("text", r"\. ")
    spans = F.transform(lines, lambda x: F.struct(F.lit(2).alias("left"), (F.length(x) + 2).alias("right")))
    spans = F.when(k % 6 == 5, F.slice(spans, F.lit(1), F.size(spans) - 1)).otherwise(spans)
    made_for = F.sha1(F.when(k % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    good = shapes.valid_layout(made_for, F.sha1("text"), lines, spans, F.lit(120), F.lit(40), F.length("text") % 600, k % 7 == 3)
    return t.conversations.select("conv_id", "turn", good.alias("valid"), (k * 2).alias("old_x"), F.lit(5).alias("old_y"), (k * 3).alias("x"), (5 + k % 2).alias("y"), F.length("text").alias("at_x"), k.alias("at_y"))


@query(f"WITH {LAID} SELECT conv_id, turn, valid FROM v_")
def f30_valid_layouts(t: Tables) -> DataFrame:
    return _layouts(t).select("conv_id", "turn", "valid")


@query(f"WITH {LAID} SELECT conv_id, turn, valid AND turn > 0 AS moved, length(text) + CASE WHEN valid THEN turn ELSE 0 END AS at_x, turn + CASE WHEN valid THEN turn % 2 ELSE 0 END AS at_y FROM v_")
def f31_carried_layouts(t: Tables) -> DataFrame:
    return shapes.carried_layouts(_layouts(t), "valid", ("old_x", "old_y"), ("x", "y"), ("at_x", "at_y")).select("conv_id", "turn", "moved", "at_x", "at_y")


@query("""WITH f AS (SELECT o_custkey, trunc(o_totalprice / 2)::BIGINT AS low, trunc(o_totalprice / 2)::BIGINT + 20000 AS high FROM orders WHERE o_orderstatus = 'F'),
m AS (SELECT o_custkey, o_orderkey, trunc(o_totalprice)::BIGINT AS y FROM orders) SELECT o_custkey AS chapter_id, o_orderkey AS mark, y FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.o_custkey = m.o_custkey AND y + 100 + 500 > low AND y < high + 500)""")
def j25_clear_marks(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("chapter_id"), F.col("o_orderkey").alias("mark"), F.col("o_totalprice").cast("long").alias("y"), F.lit(100).alias("height"), (F.col("o_totalprice") / 2).cast("long").alias("low"), "o_orderstatus")
    fixed = rows.filter("o_orderstatus = 'F'").select("chapter_id", "low", (F.col("low") + 20000).alias("high"))
    return shapes.clear_of(rows, fixed, 500).select("chapter_id", "mark", "y")


@query(f"""WITH {BOXES}, o AS (SELECT page_key, idx, row_number() OVER (PARTITION BY page_key ORDER BY y, x, idx) AS number FROM boxes_ WHERE idx % 3 <> 0)
SELECT b.page_key, b.idx, coalesce(o.number, row_number() OVER (PARTITION BY b.page_key ORDER BY b.idx)) AS number FROM boxes_ b LEFT JOIN o ON o.page_key = b.page_key AND o.idx = b.idx""")
def w5_renumbered(t: Tables) -> DataFrame:
    """Boxes whose ids are known to the order, and others."""
    from pyspark.sql import Window as W

    number = F.row_number().over(W.partitionBy("page_key").orderBy("y", "x", "idx"))
    ordered = t.boxes().filter("idx % 3 <> 0").select("page_key", "idx", number.alias("number"))
    return shapes.renumbered(t.boxes(), ordered, "page_key", "idx", "idx", "number").select("page_key", "idx", "number")


@query("SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN CASE WHEN regexp_matches(url, '^https?://[^/]*$') THEN '.' ELSE regexp_replace(url, '^https?://[^/]*/', '') END END AS path FROM pages")
def f38_relative_path(t: Tables) -> DataFrame:
    root = F.when(F.col("page_id") % 4 == 0, "https://m").otherwise(F.regexp_extract("url", "^https?://[^/]*", 0))
    return t.pages.select("page_id", shapes.relative_path(F.col("url"), root).alias("path"))


@query("""WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE regexp_replace(url, '/[0-9]+.*$', '/') END AS url FROM pages)
SELECT page_id, CASE WHEN regexp_matches(url, '^https://[a-z0-9.-]*\\.example\\.com(/fr)?/*$') THEN regexp_replace(regexp_replace(url, '/+$', ''), '/fr$', '') || '/fr/chat' END AS endpoint FROM u""")
def f35_endpoint(t: Tables) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.regexp_replace("url", r"/\d+.*$", "/"))
    return t.pages.select("page_id", shapes.endpoint(url, ".example.com", "/fr", "/fr/chat").alias("endpoint"))


@query()
def g3_joined_lines(t: Tables) -> DataFrame:
    return shapes.joined_lines(t.boxes(), "page_key")


@query()
def g8_crop_batches(t: Tables) -> DataFrame:
    return shapes.crop_batches(t.boxes(), "page_key", "idx", 4, 30_000, 150, 40).select("page_key", "idx", "batch")


STYLES = """styles_ AS (SELECT p_partkey AS id, p_partkey % 5 AS m5, p_size * 20 - 100 AS size, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 1000 END AS weight, p_partkey % 3 = 1 AS bold,
 ['upper', 'TITLE', 'lower', NULL][p_partkey % 4 + 1] AS cased, ['SCREEN', 'overlay', 'none'][p_partkey % 3 + 1] AS blend, p_partkey - 500 AS angle,
 [' #ab12cd ', 'red', '#F0a', '#12345'][p_partkey % 4 + 1] AS colour, p_size * 5 - 120 AS node, p_partkey * 3 AS quad FROM part)"""


def _turns(*values: str | None) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % len(values) + 1).cast("int"))


@query(f"""WITH {STYLES} SELECT id, least(300, greatest(6, size))::VARCHAR AS font_size,
 CASE WHEN weight IS NULL THEN CASE WHEN bold THEN '700' ELSE '400' END ELSE list_sort(list_transform(range(100, 1000, 100), lambda x: [abs(x - weight), x]))[1][2]::VARCHAR END AS font_weight,
 CASE WHEN cased IN ('upper', 'lower') THEN cased ELSE 'original' END AS text_case, CASE blend WHEN 'none' THEN 'normal' ELSE lower(blend) END AS blend_mode,
 (((angle % 360) + 360) % 360)::VARCHAR AS gradient_angle, CASE colour WHEN ' #ab12cd ' THEN '#AB12CD' WHEN '#F0a' THEN '#F0A' ELSE '#FFFFFF' END AS stroke_color,
 (CASE WHEN m5 = 0 THEN least(5000, quad) ELSE round_even(least(100, greatest(-100, node)) * 0.25, 0)::BIGINT END)::VARCHAR AS sfx_quad_tl_x, 'kept' AS note, true AS gone FROM styles_""")
def p21_styles(t: Tables) -> DataFrame:
    """Numbers beyond their limits, unknown words, odd colours, old bold flags and corners, and a key of no rule."""
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    values = {
        "font_size": text(F.col("p_size") * 20 - 100), "font_weight": F.when(k % 3 == 0, text(k % 1000)), "bold": F.when(k % 3 == 1, "true"), "text_case": _turns("upper", "TITLE", "lower", None),
        "blend_mode": _turns("SCREEN", "overlay", "none"), "gradient_angle": text(k - 500), "stroke_color": _turns(" #ab12cd ", "red", "#F0a", "#12345"),
        "sfx_node_tl_x": text(F.col("p_size") * 5 - 120), "sfx_quad_tl_x": F.when(k % 5 == 0, text(k * 3)), "note": F.lit("kept"),
    }
    style = F.map_filter(F.create_map(*[x for name, v in values.items() for x in (F.lit(name), v)]), lambda _, v: v.isNotNull())
    rows = t.part.select(k.alias("id"), limits.style_in_limits(style).alias("s"))
    shown = ["font_size", "font_weight", "text_case", "blend_mode", "gradient_angle", "stroke_color", "sfx_quad_tl_x", "note"]
    return rows.select("id", *[F.col("s")[c].alias(c) for c in shown], (~F.map_contains_key("s", "bold")).alias("gone"))


@query("""WITH l AS (SELECT o_orderkey AS id, o_custkey - 50 AS scale, o_orderkey % 30000 - 15000 AS shift, ['center', 'left', 'top-right'][o_orderkey % 3 + 1] AS anchor, split_part(o_orderpriority, '-', 2) AS one, o_orderstatus AS two FROM orders)
SELECT id, least(100, greatest(1, scale))::VARCHAR AS scale_percent, greatest(0, least(10000, shift))::VARCHAR AS margin_x, shift::VARCHAR AS offset_x, CASE anchor WHEN 'left' THEN 'bottom-right' ELSE anchor END AS anchor,
 '48' AS minimum_gap, CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END AS keep_inside, CASE WHEN one = '' THEN two ELSE one || ',' || two END AS pages, shift || ',7' AS places FROM l""")
def p22_logos(t: Tables) -> DataFrame:
    k, shift = F.col("o_orderkey"), (F.col("o_orderkey") % 30000 - 15000).cast("string")
    anchor = F.element_at(F.array(F.lit("center"), F.lit("left"), F.lit("top-right")), (k % 3 + 1).cast("int"))
    values = {"scale_percent": (F.col("o_custkey") - 50).cast("string"), "margin_x": shift, "offset_x": shift, "anchor": anchor, "minimum_gap": F.lit("wide"), "keep_inside": (k % 2 == 0).cast("string")}
    settings = F.create_map(*[x for name, v in values.items() for x in (F.lit(name), v)])
    one = F.coalesce(F.get(F.split("o_orderpriority", "-"), F.lit(1)), F.lit(""))
    pages = limits.named_pages(F.array(one, F.col("o_orderstatus"), F.lit(""), one, F.col("o_orderstatus")))
    points = limits.places(F.array(F.array(shift, F.lit("7"), F.lit("9")), F.array(shift)))
    rows = t.orders.select(k.alias("id"), limits.logo_in_limits(settings).alias("s"), F.array_join(pages, ",").alias("pages"), F.array_join(F.flatten(points), ",").alias("places"))
    return rows.select("id", *[F.col("s")[c].alias(c) for c in ("scale_percent", "margin_x", "offset_x", "anchor", "minimum_gap", "keep_inside")], "pages", "places")


QUERIES, ORACLE_SQL = query.queries, query.sql
