"""Queries of texts of chapters, choices among boxes, lists and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK
from ..operators import choices, lookup, script
from .base import BOXES, REGIONS, Collector, Tables

query = Collector()
ROW = "array_to_string(list_filter([array_to_string(list_filter([trim(l, E' \\t\\r') FOR l IN string_split(p, chr(10))], lambda x: x <> ''), ' ') FOR p IN regexp_split_to_array(trim(coalesce(text, ''), E' \\t\\n\\r'), '\\n\\s*\\n+')], lambda x: x <> ''), ' / ')"
NUMBERED = f"numbered_ AS (SELECT conv_id, string_agg(greatest(1, turn) || '. ' || {ROW}, chr(10) ORDER BY turn, {ROW}) AS content FROM conversations WHERE {ROW} <> '' GROUP BY conv_id)"
SHOWN = "coalesce(nullif(translation, ''), nullif(applied_text, ''), nullif(text, ''), '')"


@query(f"WITH {NUMBERED} SELECT conv_id, content FROM numbered_")
def f22_numbered_lines(t: Tables) -> DataFrame:
    return script.numbered_lines(t.conversations, "conv_id", "turn", "text")


@query(f"WITH {NUMBERED} SELECT conv_id // 10 AS chapter_id, string_agg('=== conversation ' || conv_id || E' ===\\n' || content, E'\\n\\n' ORDER BY conv_id) AS chapter_text, count(*) AS sections FROM numbered_ GROUP BY conv_id // 10")
def a16_chapter_text(t: Tables) -> DataFrame:
    pages = script.numbered_lines(t.conversations, "conv_id", "turn", "text")
    pages = pages.select(F.floor(F.col("conv_id") / 10).alias("chapter_id"), "conv_id", F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("name"), "content")
    return script.chapter_text(pages, "chapter_id", "conv_id", "name", "content")


@query(f"WITH {REGIONS} SELECT page_key, count(*) AS total, count_if(trim(coalesce(translation, '')) <> '') AS translated FROM regions_ GROUP BY page_key")
def a17_dialogue_counts(t: Tables) -> DataFrame:
    return script.dialogue_counts(t.line_regions(), "page_key")


@query(f"WITH {REGIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY ord, coalesce(text, ''), coalesce(translation, ''), coalesce(applied_text, '')) - 1 AS pl, count(*) OVER (PARTITION BY page_key) AS n FROM regions_) SELECT page_key, arg_min(pl, (pl - 2 - 1 + 1000 * n) % n) AS place FROM r WHERE contains({SHOWN}, 'tr 1') OR contains(coalesce(text, ''), 'tr 1') GROUP BY page_key")
def p12_find_next(t: Tables) -> DataFrame:
    order = F.struct("ord", *[F.coalesce(c, F.lit("")) for c in ("text", "translation", "applied_text")])  # line numbers repeat
    return script.find_next(t.line_regions().withColumn("place", order), "page_key", "place", F.lit(2), "TR 1").select("page_key", F.col("place").cast("long").alias("place"))


@query(f"WITH {REGIONS}, r AS (SELECT page_key, ord, {SHOWN} AS s, translation, applied_text FROM regions_), c AS (SELECT *, len(regexp_extract_all(s, '\\btr\\b')) AS replaced, regexp_replace(s, '\\btr\\b', '$1\\\\x', 'g') AS new FROM r) SELECT page_key, ord, replaced::INT AS replaced, CASE WHEN replaced > 0 THEN replace(s, 'tr ', '$1\\x ') ELSE translation END AS translation, CASE WHEN replaced > 0 THEN replace(s, 'tr ', '$1\\x ') ELSE applied_text END AS applied_text FROM c")
def p13_replace_all(t: Tables) -> DataFrame:
    done = script.replace_all(t.line_regions(), "tr", "$1\\x", whole_word=True)
    return done.select("page_key", "ord", "replaced", "translation", "applied_text")


@query(f"WITH {REGIONS} SELECT page_key, ord FROM regions_ WHERE contains(lower(concat_ws(' ', ord, id, coalesce(text, ''), coalesce(translation, ''), coalesce(applied_text, ''))), 'text 2')")
def p10_layer_search(t: Tables) -> DataFrame:
    return t.line_regions().filter(script.layer_matches(F.col("ord"), F.col("id"), F.lit(" TEXT 2"))).select("page_key", "ord")


@query(f"WITH {REGIONS} SELECT page_key, ord FROM regions_ WHERE NOT coalesce(repeated_caption, false) AND trim(coalesce(nullif(applied_text, ''), nullif(translation, ''), nullif(text, ''), '')) <> ''")
def p15_visible_with_text(t: Tables) -> DataFrame:
    from ..operators.status import visible_with_text

    return visible_with_text(t.line_regions().withColumn("visible", ~F.coalesce("repeated_caption", F.lit(False)))).select("page_key", "ord")


@query("""WITH b AS (SELECT conv_id, turn // 4 AS batch, string_agg('<<<BOX_' || lpad(slot::VARCHAR, 4, '0') || E'>>>\\n' || coalesce(text, ''), E'\\n\\n' ORDER BY slot) AS marked, count(*) AS expected
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn, text) AS slot FROM conversations) GROUP BY ALL) SELECT * FROM b""")
def f18_marked_batches(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", F.floor(F.col("turn") / 4).alias("batch"), F.struct("turn", "text").alias("ord"), "text")
    return script.marked_batches(rows, ["conv_id", "batch"], "ord", "text")


@query("SELECT conv_id, turn // 4 AS batch, list(regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', '') ORDER BY turn, text) AS texts FROM conversations GROUP BY ALL")
def f18_unmarked_batches(t: Tables) -> DataFrame:
    """What is marked comes back by slots; an answer with a slot less does not."""
    marked = f18_marked_batches(t)
    short = marked.select("conv_id", "batch", script.unmarked(F.col("marked"), F.col("expected").cast("int") + 1).alias("none"))
    both = marked.join(short, ["conv_id", "batch"]).filter("none is null")
    return both.select("conv_id", "batch", script.unmarked(F.col("marked"), F.col("expected").cast("int")).alias("texts"))


@query("SELECT conv_id, list(trim(coalesce(text, ''), E' \\t\\n\\r') ORDER BY turn, text) AS texts FROM conversations GROUP BY conv_id")
def f19_json_answers(t: Tables) -> DataFrame:
    """Texts as JSON, plain, in an object or fenced, come back as they were."""
    rows = t.conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("x")))), lambda s: s["x"]).alias("x"))
    plain, inside = F.to_json("x"), F.to_json(F.struct(F.col("x").alias("translations")))
    k = F.col("conv_id") % 3
    answer = F.when(k == 0, plain).when(k == 1, inside).otherwise(F.concat(F.lit("```json\n"), inside, F.lit("\n```")))
    return rows.select("conv_id", script.json_texts(answer, F.size("x")).alias("texts"))


@query("SELECT p_partkey AS id, g.place::INT AS place, CASE WHEN g.place = 0 THEN p_brand ELSE p_type END AS source, p_name || ' ' || g.place AS target FROM part, (VALUES (0), (1)) g(place)")
def f12_json_terms(t: Tables) -> DataFrame:
    one = lambda k, name: F.struct(F.col(k).alias(name), F.concat("p_name", F.lit(" 0" if k == "p_brand" else " 1")).alias("target"))
    lists = F.to_json(F.struct(F.struct(F.array(one("p_brand", "source"), one("p_type", "source")).alias("items")).alias("glossary")))
    other = F.to_json(F.array(one("p_brand", "term"), one("p_type", "term")))
    pairs = F.to_json(F.map_from_arrays(F.array("p_brand", "p_type"), F.array(F.concat("p_name", F.lit(" 0")), F.concat("p_name", F.lit(" 1")))))
    k = F.col("p_partkey") % 3
    rows = t.part.select(F.col("p_partkey").alias("id"), F.when(k == 0, lists).when(k == 1, other).otherwise(pairs).alias("json"))
    return script.json_terms(rows, ["id"], "json")


@query("SELECT p_brand AS batch, string_agg(p_name || ' = ' || p_type || CASE WHEN trim(p_brand) <> '' AND p_size > 25 THEN ' (' || trim(p_brand) || ')' ELSE '' END, chr(10) ORDER BY p_partkey) AS terms FROM part GROUP BY p_brand")
def f16_prompt_terms(t: Tables) -> DataFrame:
    found = t.part.select(F.col("p_brand").alias("batch"), "p_partkey", F.col("p_name").alias("source"), F.col("p_type").alias("target"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("note"))
    return script.prompt_terms(found, "batch", "p_partkey")


@query("""WITH l AS (SELECT nextkey, ord, source, target FROM (SELECT conv_id AS nextkey, turn AS ord, text AS source, role AS target FROM conversations)),
p AS (SELECT nextkey // 10 AS chapter_id, nextkey AS conv_id, string_agg(source || ' → ' || target, chr(10) ORDER BY ord, source || ' → ' || target) AS own FROM l GROUP BY nextkey)
SELECT a.chapter_id, a.conv_id, coalesce(right(string_agg(b.own, chr(10) ORDER BY b.conv_id), 300), '') AS context FROM p a LEFT JOIN p b ON b.chapter_id = a.chapter_id AND b.conv_id < a.conv_id GROUP BY a.chapter_id, a.conv_id""")
def w8_rolling_context(t: Tables) -> DataFrame:
    pairs = t.conversations.select(F.floor(F.col("conv_id") / 10).alias("chapter_id"), "conv_id", F.col("turn").alias("ord"), F.col("text").alias("source"), F.col("role").alias("target"))
    return script.rolling_context(pairs, "chapter_id", "conv_id", 300)


@query(f"WITH {REGIONS} SELECT page_key, ord, trim(coalesce(text, '')) AS text, trim(coalesce(text, '')) <> '' AS ocr_completed, CASE WHEN trim(coalesce(translation, '')) <> '' THEN translation ELSE trim(coalesce(text, '')) END AS translation, CASE WHEN trim(coalesce(applied_text, '')) <> '' THEN applied_text WHEN trim(coalesce(translation, '')) <> '' THEN translation ELSE trim(coalesce(text, '')) END AS applied_text FROM regions_")
def p25_promoted(t: Tables) -> DataFrame:
    return script.promoted(t.line_regions()).select("page_key", "ord", "text", "ocr_completed", "translation", "applied_text")


@query(f"WITH {REGIONS}, r AS (SELECT page_key, ord, q % 2 = 0 AS odd, CASE WHEN l_q % 3 = 0 THEN E'BEGIN\\n' || text ELSE text END AS text, translation, applied_text, translation_completed FROM (SELECT *, CASE WHEN applied_text IS NULL THEN 1 ELSE 2 END AS q, ord AS l_q FROM regions_)) SELECT page_key, ord, trim(replace(coalesce(text, ''), E'BEGIN\\n', '')) AS text, coalesce(text, '') <> trim(replace(coalesce(text, ''), E'BEGIN\\n', '')) AS changed, CASE WHEN coalesce(translation, '') = '' THEN false ELSE translation_completed END AS translation_completed FROM r")
def f3_repaired(t: Tables) -> DataFrame:
    rows = t.line_regions().withColumn("text", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("BEGIN\n"), "text")).otherwise(F.col("text")))
    return script.repaired(rows).select("page_key", "ord", "text", "changed", "translation_completed")


@query(f"SELECT doc_id, regexp_matches(text, '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}\\x{{ac00}}-\\x{{d7af}}]') AS cjk FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN coalesce(text, '') || '漢' ELSE coalesce(text, '') END AS text FROM documents)")
def f5_cjk(t: Tables) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(text, F.lit("漢"))).otherwise(text).rlike(CJK).alias("cjk"))


@query()
def j8_left_after_pairs(t: Tables) -> DataFrame:
    from ..operators import boxes

    pages = t.boxes().select("page_key").distinct().select(F.floor(F.col("page_key") / 10).alias("chapter_id"), F.col("page_key").alias("ord"), "page_key", F.lit(800).alias("width"), F.lit(2000).alias("height"))
    left, _ = script.read_together(t.boxes(), boxes.seam_pairs(pages, t.boxes(), margin=60))
    return left.select("page_key", "idx")


@query(f"WITH {BOXES} SELECT page_key, idx FROM boxes_ WHERE confidence >= 0.3 AND width > 40 AND idx % 9 <> 0")
def p19_sound_predictions(t: Tables) -> DataFrame:
    odd = t.boxes().withColumns({"width": F.when(F.col("width") > 40, F.col("width")).otherwise(0), "x": F.when(F.col("idx") % 9 == 0, float("nan")).otherwise(F.col("x").cast("double"))})
    return choices.sound_predictions(odd, F.lit(0.3), ["x", "y", "width", "height", "confidence"]).select("page_key", "idx")


@query(f"""WITH {BOXES}, s AS (SELECT page_key, idx, x, y, CASE WHEN idx % 10 = 0 THEN width * 6 ELSE width END AS width, CASE WHEN idx % 10 = 0 THEN height * 12 ELSE height END AS height, CASE WHEN idx % 10 = 0 THEN 0.8 ELSE confidence END AS confidence FROM boxes_),
b AS (SELECT * FROM s WHERE confidence >= 0.65 AND width * height <= 0.45 * 960000 AND width * height > 0.15 * 960000),
m AS (SELECT b.page_key, b.idx, b.width AS bw, b.height AS bh, l.y, l.width, l.height, l.idx AS l_idx FROM b JOIN s l ON l.page_key = b.page_key AND l.idx <> b.idx AND l.width * l.height <= 0.3 * b.width * b.height
AND greatest(0, least(b.x + b.width, l.x + l.width) - greatest(b.x, l.x)) * greatest(0, least(b.y + b.height, l.y + l.height) - greatest(b.y, l.y)) >= 0.9 * l.width * l.height AND abs(l.x + l.width / 2 - b.x - b.width / 2) <= 0.15 * b.width),
g AS (SELECT *, coalesce(y - lag(y) OVER w - lag(height) OVER w > 1.5 * greatest(height, lag(height) OVER w), false) AS wide FROM m WINDOW w AS (PARTITION BY page_key, idx ORDER BY y, l_idx)),
f AS (SELECT page_key, idx FROM g GROUP BY page_key, idx, bw, bh HAVING count(*) >= 3 AND sum(width * height) >= 0.12 * bw * bh AND max(width) >= 0.25 * bw AND arg_max(y + height, (y, l_idx)) - min(y) >= 0.2 * bh AND NOT bool_or(wide))
SELECT page_key, idx FROM s WHERE width * height <= 0.15 * 960000 OR (page_key, idx) IN (SELECT (page_key, idx) FROM f)""")
def p18_without_large(t: Tables) -> DataFrame:
    """With every tenth box blown up to a block."""
    tenth = F.col("idx") % 10 == 0
    some = t.boxes().withColumns({"width": F.when(tenth, F.col("width") * 6).otherwise(F.col("width")), "height": F.when(tenth, F.col("height") * 12).otherwise(F.col("height")), "confidence": F.when(tenth, 0.8).otherwise(F.col("confidence")), "page_width": F.lit(800), "page_height": F.lit(1200)})
    return choices.without_large(some).select("page_key", "idx")


@query(f"""WITH RECURSIVE {BOXES}, s AS (SELECT page_key, idx, x * 3 AS x0, y * 3 AS y0, x * 3 + width AS x1, y * 3 + height AS y1, row_number() OVER (PARTITION BY page_key ORDER BY idx) AS i FROM boxes_),
g AS (SELECT page_key, idx, i, x0, y0, x1, y1, 0 AS n FROM s WHERE i = 1 UNION ALL
SELECT s.page_key, s.idx, s.i, CASE WHEN w THEN s.x0 ELSE least(g.x0, s.x0) END, CASE WHEN w THEN s.y0 ELSE least(g.y0, s.y0) END, CASE WHEN w THEN s.x1 ELSE greatest(g.x1, s.x1) END, CASE WHEN w THEN s.y1 ELSE greatest(g.y1, s.y1) END, g.n + w::INT
FROM g JOIN s ON s.page_key = g.page_key AND s.i = g.i + 1, LATERAL (SELECT greatest(g.x1, s.x1) - least(g.x0, s.x0) > 2048 OR greatest(g.y1, s.y1) - least(g.y0, s.y0) > 2048 AS w))
SELECT page_key, idx, n AS "group" FROM g""")
def g7_union_groups(t: Tables) -> DataFrame:
    far = t.boxes().select("page_key", "idx", (F.col("x") * 3).alias("x"), (F.col("y") * 3).alias("y"), "width", "height")
    return choices.union_groups(far, "page_key", "idx").select("page_key", "idx", "group")


@query(f"""WITH {BOXES}, s AS (SELECT *, greatest(96, 2 * width, 2 * height) AS a, greatest(96, 3 * height, width) AS d FROM boxes_), r AS (SELECT *, greatest(0, x - a) AS l, greatest(0, y - d) AS o FROM s)
SELECT page_key, idx, l AS "left", o AS top, greatest(1, least(800, x + width + a) - l) AS room_width, greatest(1, least(2000, y + height + d) - o) AS room_height,
least(greatest(3, greatest(2, round_even(greatest(1, least(width, height)) * 0.055, 0)::INT, 8)), greatest(2, greatest(1, least(width, height)) // 4)) AS padding FROM r""")
def f43_search_rects(t: Tables) -> DataFrame:
    room = choices.search_rect(F.lit(800), F.lit(2000))
    return t.boxes().select("page_key", "idx", *[c.alias(n) for n, c in room.items()], choices.padding(F.lit(3), F.lit(2)).alias("padding"))


@query(f"""WITH {BOXES}, s AS (SELECT *, greatest(96, 2 * width, 2 * height) AS a, greatest(96, 3 * height, width) AS d FROM boxes_)
SELECT page_key, idx, x - a <= 0 AS at_left, y - d <= 0 AS at_top, x + width + a >= 800 AS at_right, y + height + d >= 2000 AS at_bottom FROM s""")
def f43_edge_sides(t: Tables) -> DataFrame:
    sides = choices.edge_sides(F.lit(800), F.lit(2000), choices.search_rect(F.lit(800), F.lit(2000)))
    return t.boxes().select("page_key", "idx", *[c.alias(n) for n, c in sides.items()])


@query("""WITH l AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS source, role AS target, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations WHERE turn % 3 <> 0 AND trim(text) <> '')
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) - 1 AS place, source, target FROM l QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n) <= 2""")
def o9_memory(t: Tables) -> DataFrame:
    """The first two pairs of each conversation's turns; every third turn has no arrow."""
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    tie = F.when(F.col("turn") % 3 == 0, F.lit(" - ")).otherwise(F.lit(" → "))
    context = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text", F.concat(clean, tie, "role").alias("line")))), lambda s: s["line"]), "\n")
    pairs = t.conversations.groupBy("conv_id").agg(context.alias("c")).select("conv_id", F.posexplode(script.memory_pairs(F.col("c"), 2)).alias("place", "p"))
    return pairs.select("conv_id", "place", "p.source", "p.target")


@query("SELECT p_brand AS batch, p_partkey AS ord, p_name AS source FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 5")
def o9_first_terms(t: Tables) -> DataFrame:
    found = t.part.select(F.col("p_brand").alias("batch"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("source"))
    return script.first_terms(found, "batch", "ord", 5)


@query("SELECT user_id, list_slice(list_distinct_ordered, 1, 20) AS saved FROM (SELECT user_id, [event_type] || [x FOR x IN ['view', 'click', 'a', 'b'] IF x <> event_type] AS list_distinct_ordered FROM (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id))")
def o10_remembered(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("name"))
    saved = F.array(*[F.lit(x) for x in ("view", "click", "a", "b")])
    return last.select("user_id", choices.remembered(saved, F.concat(F.lit(" "), "name")).alias("saved"))


@query("""SELECT o_orderkey AS id, l.layer, CASE WHEN l.layer = 'paint' THEN o_orderstatus = 'F' ELSE true END AS visible, CASE WHEN l.layer = 'paint' THEN greatest(0, least(100, o_orderkey % 300 - 100)) ELSE 100 END::BIGINT AS opacity, false AS locked FROM orders, (VALUES ('automatic'), ('paint'), ('restore')) l(layer)""")
def p23_layer_states(t: Tables) -> DataFrame:
    state = F.struct((F.col("o_orderstatus") == "F").alias("visible"), (F.col("o_orderkey") % 300 - 100).alias("opacity"), F.lit(None).cast("boolean").alias("locked"))
    states = F.create_map(F.lit("paint"), state, F.lit("unknown"), state)
    return t.orders.select(F.col("o_orderkey").alias("id"), F.inline(choices.layer_states(states)))


@query("SELECT user_id, event_id, position FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) WHERE back <= 12")
def w9_recent_rows(t: Tables) -> DataFrame:
    return choices.recent_rows(t.events.select("user_id", "event_id"), "user_id", "event_id").select("user_id", "event_id", "position")


@query("WITH p AS (SELECT l_orderkey AS page_key, l_linenumber AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS pl, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT page_key, id, CASE WHEN n < 4 THEN pl WHEN pl = 3 THEN 1 WHEN pl IN (1, 2) THEN pl + 1 ELSE pl END AS place FROM p")
def o15_moved(t: Tables) -> DataFrame:
    return choices.moved(_places(t), "page_key", "place", F.lit(3), F.lit(1)).select("page_key", "id", F.col("place").cast("long").alias("place"))


def _places(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    turn = W.partitionBy("l_orderkey").orderBy("l_linenumber")
    return t.lineitem.select(F.col("l_orderkey").alias("page_key"), F.col("l_linenumber").alias("id"), (F.row_number().over(turn) - 1).alias("place"), (F.col("l_returnflag") == "R").alias("locked"), F.lit(True).alias("visible"), F.when(F.col("l_linenumber") % 2 == 0, "layer").alias("name"), F.lit(5).alias("x"), F.lit(6).alias("y"))


@query("SELECT l_orderkey AS page_key, l_linenumber AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS place FROM lineitem WHERE NOT (l_linenumber IN (2, 4) AND l_returnflag <> 'R')")
def o15_deleted(t: Tables) -> DataFrame:
    return choices.deleted(_places(t), "page_key", "place", F.col("id").isin(2, 4)).select("page_key", "id", F.col("place").cast("long").alias("place"))


@query("""WITH p AS (SELECT l_orderkey AS page_key, l_linenumber AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS pl, CASE WHEN l_linenumber % 2 = 0 THEN 'layer' END AS name FROM lineitem),
b AS (SELECT page_key, id, pl, 0 AS twin, name, 5 AS x FROM p UNION ALL SELECT page_key, id, pl, 1, coalesce(name, 'Capa ' || (pl + 1)) || ' copia', 17 FROM p WHERE id % 3 = 0) SELECT page_key, id, name, x, row_number() OVER (PARTITION BY page_key ORDER BY pl, twin) - 1 AS place FROM b""")
def o15_duplicated(t: Tables) -> DataFrame:
    return choices.duplicated(_places(t), "page_key", "place", F.col("id") % 3 == 0).select("page_key", "id", "name", "x", F.col("place").cast("long").alias("place"))


@query(f"WITH {BOXES}, t AS (SELECT *, abs(x + width / 2 - 400) + abs(y + height / 2 - 1000) AS away FROM boxes_), r AS (SELECT *, row_number() OVER w AS turn, sum(width * height) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM t WINDOW w AS (PARTITION BY page_key ORDER BY CASE WHEN y < 900 THEN 0 ELSE 1 END, away, idx)) SELECT page_key, idx, turn::INT AS turn FROM r WHERE total <= 60000 OR turn = 1")
def o12_tile_order(t: Tables) -> DataFrame:
    return choices.tile_order(t.boxes(), "page_key", F.col("y") < 900, F.lit(400), F.lit(1000), 60000).select("page_key", "idx", "turn")


@query(f"WITH {BOXES} SELECT page_key, string_agg(n || '. box ' || idx, E'\\n\\n' ORDER BY n) AS text FROM (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY y, x, idx) AS n FROM boxes_) GROUP BY page_key")
def o16_ordered_text(t: Tables) -> DataFrame:
    from ..operators.strips import ordered_text

    return ordered_text(t.boxes().withColumn("text", F.concat(F.lit("box "), F.col("idx").cast("string"))), "page_key", ["y", "x", "idx"], "text")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS")
def s25_purged(t: Tables) -> DataFrame:
    newest = t.events.agg(F.max("ts").alias("newest"))  # one row
    return choices.purged(t.events.withColumnRenamed("ts", "modified").crossJoin(F.broadcast(newest)), F.col("newest")).select("event_id")


@query("SELECT doc_id, coalesce(lang, 'es') AS lang, 'fast' AS mode, source FROM documents")
def s9_settings(t: Tables) -> DataFrame:
    """Stored settings over defaults; an unknown section and nulls go."""
    own = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")), lambda k, v: v.isNotNull())
    stored = F.create_map(F.lit("ocr"), own, F.lit("unknown"), own)
    merged = choices.over_defaults(stored, {"ocr": {"lang": "es", "mode": "fast"}, "view": {"zoom": "1"}})
    return t.documents.select("doc_id", merged["ocr"].alias("m")).select("doc_id", F.col("m.lang").alias("lang"), F.col("m.mode").alias("mode"), F.col("m.source").alias("source"))


@query("SELECT doc_id, sha1(coalesce(length(lang) || ':' || lang, '-') || coalesce(length(source) || ':' || source, '-') || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-')) AS signature FROM documents")
def f29_fingerprint(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", choices.fingerprint(F.col("lang"), F.col("source"), F.col("n_chars")).alias("signature"))


@query("""WITH RECURSIVE w AS (SELECT item_id, [x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> ''] AS w FROM benchmark WHERE len([x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> '']) > 1),
g AS (SELECT item_id, w, 1 AS i, w[1] AS line, 0 AS n FROM w UNION ALL SELECT item_id, w, i + 1, CASE WHEN length(line) + 1 + length(w[i + 1]) > 40 THEN w[i + 1] ELSE line || ' ' || w[i + 1] END, n + (length(line) + 1 + length(w[i + 1]) > 40)::INT FROM g WHERE i < len(w))
SELECT item_id, list(line ORDER BY n) AS lines FROM (SELECT item_id, n, arg_max(line, i) AS line FROM g GROUP BY item_id, n) GROUP BY item_id""")
def g15_greedy_lines(t: Tables) -> DataFrame:
    return choices.greedy_lines(t.benchmark.withColumn("text", F.regexp_replace("text", r"\s+", " ")), "text", F.lit(40)).select("item_id", "lines")


@query()
def j12_reference_terms(t: Tables) -> DataFrame:
    """Part names as terms; every third conversation has a Chinese text."""
    texts = t.conversations.select(F.col("conv_id").alias("batch"), F.when(F.col("conv_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("漢"))).otherwise(F.col("text")).alias("text"))
    terms = t.part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("source"))
    found = lookup.relevant_terms(terms.withColumnRenamed("ord", "id"), texts, "batch", "text").select("batch", F.col("id").alias("ord"))
    return script.reference_terms(terms, texts, "batch", "text", found, "ord").select("batch", "ord")


QUERIES, ORACLE_SQL = query.queries, query.sql
