"""Queries of boxes, strips and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.geometry import box, contained, iou, mark_count
from ..operators import boxes, lettering, metrics, planning, slots, strips
from ..sources.files import slice_plan
from .base import BOXES, REGIONS, STRIPS, Collector, Tables

query = Collector()
MEET = "greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))"


@query()
def g1_suppressed(t: Tables) -> DataFrame:
    return boxes.suppress(t.boxes()).select("page_key", "idx")


@query(f"WITH {BOXES} SELECT page_key, idx FROM boxes_ a WHERE idx % 4 <> 0 OR NOT EXISTS (SELECT 1 FROM boxes_ b WHERE b.page_key = a.page_key AND b.idx % 4 <> 0 AND {MEET} >= 0.75 * a.width * a.height AND b.width * b.height <= 4 * a.width * a.height)")
def j22_without_fragments(t: Tables) -> DataFrame:
    return boxes.without_fragments(t.boxes(), F.col("idx") % 4 == 0).select("page_key", "idx")


@query(f"WITH {BOXES} SELECT page_key, idx FROM boxes_ a WHERE idx % 3 = 0 AND NOT EXISTS (SELECT 1 FROM boxes_ b WHERE b.page_key = a.page_key AND b.idx % 3 <> 0 AND {MEET} >= 0.7 * a.width * a.height)")
def j21_uncovered(t: Tables) -> DataFrame:
    return boxes.uncovered(t.boxes().filter("idx % 3 = 0"), t.boxes().filter("idx % 3 <> 0")).select("page_key", "idx")


PAIRS = f"pairs_ AS (SELECT a.page_key, a.idx AS a, b.idx AS b FROM boxes_ a JOIN boxes_ b ON a.page_key = b.page_key AND a.idx < b.idx AND {MEET} > 0)"


@query(f"WITH {BOXES}, {PAIRS} SELECT * FROM pairs_")
def j18_overlapping_pairs(t: Tables) -> DataFrame:
    return boxes.overlapping_pairs(t.boxes())


@query(f"""WITH RECURSIVE {BOXES}, {PAIRS}, e AS (SELECT a, b FROM pairs_ UNION SELECT b, a FROM pairs_), c AS (SELECT page_key, idx AS start, idx FROM boxes_ UNION SELECT c.page_key, c.start, e.b FROM c JOIN e ON c.idx = e.a)
SELECT page_key, start AS idx, min(idx) AS cluster FROM c GROUP BY page_key, start""")
def g4_clusters(t: Tables) -> DataFrame:
    return boxes.clusters(t.boxes())


@query(f"WITH {BOXES} SELECT a.page_key, a.idx AS a, b.idx AS b, ({MEET})::DOUBLE / greatest(1, a.width * a.height + b.width * b.height - {MEET}) AS iou, ({MEET})::DOUBLE / greatest(1, a.width * a.height) AS inside FROM boxes_ a JOIN boxes_ b ON a.page_key = b.page_key AND a.idx < b.idx AND {MEET} > 0")
def f41_box_arithmetic(t: Tables) -> DataFrame:
    one = lambda side: t.boxes().select("page_key", F.col("idx").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("x", "y", "width", "height")])
    pairs = boxes.overlapping_pairs(t.boxes()).join(one("a"), ["page_key", "a"]).join(one("b"), ["page_key", "b"])
    return pairs.select("page_key", "a", "b", iou(box("a_"), box("b_")).alias("iou"), contained(box("a_"), box("b_")).alias("inside"))


@query(f"""WITH {BOXES}, p AS (SELECT page_key, page_key // 10 AS chapter_id, page_key AS ord, 800 AS pw, 2000 AS ph FROM (SELECT DISTINCT page_key FROM boxes_)), n AS (SELECT *, lead(page_key) OVER (PARTITION BY chapter_id ORDER BY ord) AS next_key FROM p)
SELECT n.page_key, n.next_key, u.idx AS u_idx, l.idx AS l_idx, (least(u.x + u.width, l.x + l.width) - greatest(u.x, l.x))::DOUBLE / least(u.width, l.width) AS share
FROM n JOIN boxes_ u ON u.page_key = n.page_key AND u.y + u.height >= 1940 JOIN boxes_ l ON l.page_key = n.next_key AND l.y <= 60 WHERE share >= 0.5""")
def j6_seam_candidates(t: Tables) -> DataFrame:
    pages = t.boxes().select("page_key").distinct().select(F.floor(F.col("page_key") / 10).alias("chapter_id"), F.col("page_key").alias("ord"), "page_key", F.lit(800).alias("width"), F.lit(2000).alias("height"))
    return boxes.seam_candidates(pages, t.boxes(), margin=60).select("page_key", "next_key", "u_idx", "l_idx", "share")


@query()
def j7_seam_pairs(t: Tables) -> DataFrame:
    pages = t.boxes().select("page_key").distinct().select(F.floor(F.col("page_key") / 10).alias("chapter_id"), F.col("page_key").alias("ord"), "page_key", F.lit(800).alias("width"), F.lit(2000).alias("height"))
    return boxes.seam_pairs(pages, t.boxes(), margin=60).select("page_key", "next_key", "u_idx", "l_idx", "anchor_is_upper")


@query(f"""WITH {BOXES}, h AS (SELECT page_key, min(y) AS top, greatest(12, list_sort(list(greatest(1, height)))[count(*)::INT // 2 + 1] // 2) AS step FROM boxes_ GROUP BY page_key)
SELECT page_key, idx, row_number() OVER (PARTITION BY page_key ORDER BY (y - top) // step, x, y, idx)::INT AS number FROM boxes_ JOIN h USING (page_key)""")
def o2_left_to_right(t: Tables) -> DataFrame:
    return boxes.left_to_right(t.boxes()).select("page_key", "idx", "number")


@query()
def o3_right_to_left(t: Tables) -> DataFrame:
    return boxes.right_to_left(t.boxes()).select("page_key", "idx", "number")


@query()
def a7_repeated_captions(t: Tables) -> DataFrame:
    """Boxes five times as wide, so that most are captions."""
    wide = t.boxes().withColumn("width", F.col("width") * 5).filter("confidence < 0.5 and width >= 4 * height")
    return boxes.repeated_captions(wide.withColumn("chapter_id", F.floor(F.col("page_key") / 10))).select("chapter_id", "page_key", "idx", "repeated_caption")


@query(f"""WITH {BOXES}, s AS (SELECT page_key, page_key AS slot_id, (page_key * 97 % 700)::INT AS x, 0 AS low, 1940 AS high, 40 AS mw, 60 AS mh, 16 AS pad FROM (SELECT DISTINCT page_key FROM boxes_)),
b AS (SELECT slot_id, low, high, greatest(low, b.y - mh - pad + 1) AS s, least(high, b.y + b.height + pad - 1) AS e FROM s JOIN boxes_ b USING (page_key) WHERE s.x + mw + pad > b.x AND s.x < b.x + b.width + pad),
u AS (SELECT * FROM b WHERE s <= high AND e >= low AND s <= e UNION ALL SELECT slot_id, low, high, high + 1, high + 1 FROM s), g AS (SELECT *, max(e) OVER (PARTITION BY slot_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM u)
SELECT slot_id, coalesce(past + 1, low) AS start, s - 1 AS "end" FROM g WHERE coalesce(past + 1, low) <= s - 1""")
def j24_free_rows(t: Tables) -> DataFrame:
    return boxes.free_rows(_slots(t), t.boxes()).select("slot_id", "start", "end")


def _slots(t: Tables) -> DataFrame:
    k = F.col("page_key")
    return t.boxes().select("page_key").distinct().select(k, k.alias("slot_id"), F.lit(0).alias("ord"), (k * 97 % 700).cast("int").alias("x"), F.lit(0).alias("low"), F.lit(1940).alias("high"), F.lit(40).alias("mark_width"), F.lit(60).alias("mark_height"), F.lit(970.0).alias("ideal"))


@query()
def g11_balanced_slots(t: Tables) -> DataFrame:
    return planning.balanced_slots(_slots(t), t.boxes(), 100)


PLACED = f"{STRIPS}, placed_ AS (SELECT *, coalesce(sum(height) OVER (PARTITION BY chapter_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS y, (max(width) OVER (PARTITION BY chapter_id) - width) // 2 AS x FROM strips_)"


@query(f"WITH {PLACED} SELECT chapter_id, page_key, x, y FROM placed_")
def w1_offsets(t: Tables) -> DataFrame:
    return strips.offsets(t.strip_pages()).select("chapter_id", "page_key", "x", "y")


@query(f"WITH {STRIPS} SELECT chapter_id, page_key, coalesce(sum(CASE WHEN page_key % 3 <> 0 THEN height ELSE 0 END) OVER (PARTITION BY chapter_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS y FROM strips_")
def w2_offsets_of_some(t: Tables) -> DataFrame:
    return strips.offsets(t.strip_pages(), placed=F.col("page_key") % 3 != 0).select("chapter_id", "page_key", "y")


@query(f"WITH {STRIPS} SELECT chapter_id, max(width) AS width, sum(height)::BIGINT AS height, count(*) AS pages FROM strips_ GROUP BY chapter_id")
def a11_strip_size(t: Tables) -> DataFrame:
    return strips.strip_size(t.strip_pages())


@query(f"WITH {STRIPS} SELECT chapter_id, width, max(height) AS tallest FROM strips_ GROUP BY chapter_id, width")
def a12_tallest_by_width(t: Tables) -> DataFrame:
    return strips.tallest_by_width(t.strip_pages())


@query(f"WITH {PLACED}, z AS (SELECT chapter_id, greatest(1, sum(height)) AS size FROM strips_ GROUP BY chapter_id), r AS (SELECT doc_id AS range_id, source AS chapter_id, doc_id * 7919 % size AS top FROM documents JOIN z ON z.chapter_id = source) SELECT range_id, page_key FROM r JOIN placed_ p USING (chapter_id) WHERE p.y < top + 800 AND p.y + p.height > top")
def j16_intersecting(t: Tables) -> DataFrame:
    """Every document as a range, spread over the whole of its strip."""
    k, placed = F.col("doc_id"), strips.offsets(t.strip_pages())
    whole = strips.strip_size(t.strip_pages()).select("chapter_id", F.col("height").alias("__size"))
    ranges = t.documents.select(k.alias("range_id"), F.col("source").alias("chapter_id"), "doc_id").join(whole, "chapter_id").withColumn("top", k * 7919 % F.greatest("__size", F.lit(1)))
    return strips.intersecting(placed, ranges.select("range_id", "chapter_id", "top", (F.col("top") + 800).alias("bottom"))).select("range_id", "page_key")


@query(f"""WITH {PLACED}, q AS (SELECT doc_id AS point_id, source AS chapter_id, (doc_id * 17 % 300000 - 500)::DOUBLE AS place FROM documents), h AS (SELECT * FROM placed_ WHERE height > 0)
SELECT point_id, coalesce(arg_max(page_key, y) FILTER (WHERE y <= place), arg_min(page_key, y)) AS page_key FROM q JOIN h USING (chapter_id) GROUP BY point_id""")
def j17_page_at(t: Tables) -> DataFrame:
    points = t.documents.select(F.col("doc_id").alias("point_id"), F.col("source").alias("chapter_id"), (F.col("doc_id") * 17 % 300000 - 500).alias("at"))
    return strips.page_at(strips.offsets(t.strip_pages()), points).select("point_id", "page_key")


@query("SELECT a.doc_id AS active_id, b.doc_id FROM documents a JOIN documents b ON b.doc_id BETWEEN a.doc_id - 7 AND a.doc_id + 7")
def w10_neighbours(t: Tables) -> DataFrame:
    return strips.neighbours_of_all(t.documents.select("doc_id"), 7, "doc_id").select(F.col("active").alias("active_id"), "doc_id")


@query("""WITH p AS (SELECT DISTINCT conv_id, turn FROM conversations), l AS (SELECT conv_id, turn, text || ' → ' || role AS line FROM conversations WHERE text <> '' AND role <> ''),
r AS (SELECT p.conv_id, p.turn, line, l.turn AS back, row_number() OVER (PARTITION BY p.conv_id, p.turn ORDER BY l.turn DESC, line DESC) AS n FROM p LEFT JOIN l ON l.conv_id = p.conv_id AND l.turn < p.turn)
SELECT conv_id, turn, coalesce(right(string_agg(line, chr(10) ORDER BY back, line), 900), '') AS context FROM r WHERE n <= 4 GROUP BY conv_id, turn""")
def w7_recent_context(t: Tables) -> DataFrame:
    """Turns as pages: what the four turns before each one hold, at most 900 characters."""
    pairs = t.conversations.select("conv_id", "turn", F.col("text").alias("source"), F.col("role").alias("target"))
    return strips.recent_contexts(pairs, "conv_id", "turn", ["turn"], 4, 900)


@query(f"""WITH {BOXES}, g AS (SELECT page_key, idx, y - lag(y) OVER w - lag(height) OVER w AS gap, max(height) OVER (PARTITION BY page_key) AS h FROM boxes_ WINDOW w AS (PARTITION BY page_key ORDER BY y, idx)) SELECT page_key, idx, gap, coalesce(gap > 1.5 * h, false) AS wide FROM g""")
def w6_gaps(t: Tables) -> DataFrame:
    return strips.gaps(t.boxes(), "page_key", ["y", "idx"]).select("page_key", "idx", "gap", "wide")


@query(f"WITH {REGIONS} SELECT page_key, coalesce(string_agg(ord || '. ' || text, chr(10) ORDER BY ord, text) FILTER (WHERE trim(text) <> ''), '') AS page_text FROM regions_ GROUP BY page_key")
def a15_numbered_text(t: Tables) -> DataFrame:
    return strips.numbered_text(t.line_regions(), "page_key", "ord", "text")


@query(f"WITH {BOXES} SELECT page_key, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM boxes_ GROUP BY page_key")
def a10_bounding_box(t: Tables) -> DataFrame:
    return metrics.bounding_box(t.boxes(), "page_key")


@query(f"""WITH {BOXES} SELECT page_key, count_if(EXISTS (SELECT 1 FROM boxes_ b WHERE b.page_key = a.page_key AND b.idx % 5 <> 0 AND a.x + a.width / 2 BETWEEN b.x AND b.x + b.width AND a.y + a.height / 2 BETWEEN b.y AND b.y + b.height)) AS covered, count(*) AS expected FROM boxes_ a WHERE idx % 5 = 0 GROUP BY page_key""")
def a25_coverage(t: Tables) -> DataFrame:
    return metrics.coverage(t.boxes().filter("idx % 5 = 0"), t.boxes().filter("idx % 5 <> 0"), "page_key")


@query("SELECT doc_id, unnest(list_distinct(list_append(range(0, greatest(0, n_chars - 2000) + 1, 1700), greatest(0, n_chars - 2000)))) AS start FROM documents")
def g5_tile_starts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(planning.tile_starts(F.col("n_chars"), 2000, 300)).alias("start"))


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) + 24 AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
b AS (SELECT conv_id, turn, i, s AS total, 1 AS n, 0 AS batch FROM r WHERE i = 1 UNION ALL
SELECT r.conv_id, r.turn, r.i, CASE WHEN b.n >= 3 OR b.total + r.s > 900 THEN r.s ELSE b.total + r.s END, CASE WHEN b.n >= 3 OR b.total + r.s > 900 THEN 1 ELSE b.n + 1 END, b.batch + (b.n >= 3 OR b.total + r.s > 900)::INT FROM b JOIN r ON r.conv_id = b.conv_id AND r.i = b.i + 1)
SELECT conv_id, turn, batch FROM b""")
def g6_batches(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", "text")
    return planning.batches(rows, "conv_id", ["turn"], F.length("text") + 24, 3, 900).select("conv_id", "turn", "batch")


@query()
def g10_best_cuts(t: Tables) -> DataFrame:
    """Prices of a customer's orders as row scores, one text row for each page."""
    from pyspark.sql import Window as W

    rows = t.orders.select(F.col("o_custkey").alias("page_key"), (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("row"), (F.col("o_totalprice") / 1000).alias("score"))
    pages = rows.select("page_key").distinct()
    return planning.best_cuts(rows, pages.withColumn("target", F.lit(5)), pages.select("page_key", (F.col("page_key") % 6).alias("top"), (F.col("page_key") % 6 + 1).alias("bottom")), 3, 1)


@query()
def g12_wrapped_lines(t: Tables) -> DataFrame:
    return planning.wrap(t.benchmark.select("item_id", "text"), "text", F.lit(40.0))


VOWELS, CLUSTERS, NO_WORD = repr(text.VOWELS), ", ".join(map(repr, text.CLUSTERS)), "'" + text.NO_WORD.replace("'", "''") + "'"


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS word FROM documents),
c AS (SELECT word, trim(word, {NO_WORD}) AS bare, length(word) - length(ltrim(word, {NO_WORD})) AS lead FROM w), l AS (SELECT *, unnest(range(2, greatest(3, length(bare) - 2))) AS i FROM c)
SELECT word, coalesce(list((lead + i)::INT ORDER BY i) FILTER (WHERE i < length(bare) - 2 AND length(bare) >= 7 AND contains({VOWELS}, bare[i]) AND NOT contains({VOWELS}, bare[i + 1]) AND lower(bare[i + 1:i + 2]) NOT IN ({CLUSTERS})), []) AS points FROM l GROUP BY word""")
def f37_hyphen_points(t: Tables) -> DataFrame:
    """Of every word of the documents."""
    words = t.documents.select(F.explode(F.split("text", r"\s+")).alias("word")).distinct()
    return words.select("word", text.hyphen_points(F.col("word")).alias("points"))


@query()
def g12_lettered_rows(t: Tables) -> DataFrame:
    """Every text of the benchmark in rows of two widths in turn, as many as its length wants, and every conversation's
    turn in one more row of one width."""
    rows = lambda n, a, b: F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i % 2 == 1, a).otherwise(b))
    size = lambda c: F.ceil(F.length(c) / 48).cast("int")
    items = t.benchmark.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.lit(0).alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    turns = t.conversations.select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    both = items.withColumn("widths", rows(F.greatest(F.lit(1), size("text")), F.lit(30.0), F.lit(24.0))).unionByName(turns.withColumn("widths", rows(size("text") + 1, F.lit(28.0), F.lit(28.0))))
    return lettering.spread(both).select("kind", "id", "turn", lettering.wrapped(F.col("text"), F.col("widths")).alias("lines"))


@query()
def g13_balanced_rows(t: Tables) -> DataFrame:
    """Part names in three rows of unequal widths, by plain rules."""
    widths = F.array(F.lit(8.0), F.lit(10.0), F.lit(8.0))
    return lettering.spread(t.part.select("p_partkey", "p_name")).select(F.col("p_partkey").alias("id"), lettering.wrapped(F.col("p_name"), widths, lettering.Style(plain=True)).alias("lines"))


@query()
def g13_effect_lines(t: Tables) -> DataFrame:
    """Part names, every third without its spaces, as sounds in boxes by their sizes."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.col("p_name"))
    return lettering.spread(t.part.select("p_partkey", "p_name", "p_size")).select(k.alias("id"), lettering.effects(name, F.col("p_size") * 4 + 20, 220 - F.col("p_size") * 4, F.lit(14)).alias("lines"))


@query()
def g14_fitted_text(t: Tables) -> DataFrame:
    """Every turn of the conversations in a box by its number, at the largest size of 6 to 40 that fits."""
    k = F.col("conv_id")
    boxes = t.conversations.select("conv_id", "turn", "text", (k % 7 * 40 + 120).alias("width"), (F.col("turn") % 5 * 40 + 60).alias("height"), F.lit(40).alias("size"))
    return lettering.fit_text(boxes, "text", "width", "height", "size").select("conv_id", "turn", "lines", "font_size", "overflow")


@query()
def g2_tile_suppressed(t: Tables) -> DataFrame:
    """Parts as boxes of tiles of one page for a thousand, tiles a hundred rows apart, by their overlap alone."""
    k = F.col("idx")
    tiles = t.boxes().withColumns({"page_key": F.floor(k / 1000), "top": F.floor(k / 100) % 10 * 100, "left": F.lit(None).cast("int"), "y": F.col("y") % 300})
    return boxes.suppress_crowds(boxes.on_page(tiles, "left", "top"), 0.35, None).select("page_key", "idx", "x", "y")


@query(f"""WITH {STRIPS}, h AS (SELECT chapter_id, sum(height)::BIGINT AS h FROM strips_ GROUP BY chapter_id HAVING sum(height) > 0), n AS (SELECT *, greatest(1, h // 2000 + (h % 2000 >= 500)::INT) AS n FROM h),
r AS (SELECT *, unnest(range(1, n + 1)) AS number FROM n) SELECT chapter_id, number, (number - 1) * 2000 AS top, CASE WHEN number = n THEN h ELSE number * 2000 END AS bottom FROM r""")
def s18_slices(t: Tables) -> DataFrame:
    return slice_plan(strips.strip_size(t.strip_pages()), 2000)


@query()
def g9_chapter_slots(t: Tables) -> DataFrame:
    """Marks of 120 by 60 along the strips, by one for each 1,600 rows, off two boxes on each page."""
    k, h = F.col("page_key"), F.greatest(F.lit(1), F.col("height"))
    pages = t.strip_pages().withColumns({"mark_width": F.lit(120), "mark_height": F.when(k % 9 != 0, 60)})
    regions = t.strip_pages().select("page_key", F.explode(F.array(F.lit(0), F.lit(1))).alias("idx"), (k * 37 % 500).alias("x"), "height")
    regions = regions.select("page_key", "idx", "x", ((k * 53 + F.col("idx") * 400) % h).alias("y"), F.lit(200).alias("width"), F.lit(150).alias("height"))
    return slots.chapter_slots(pages, regions, slots.Layout(distribution="adaptive", gap=300, limit=1_000_000, interval=1600, margin_x=20, margin_y=40))


@query("SELECT doc_id, greatest(1, least(12, round_even(n_chars / greatest(1600.0, (doc_id % 5 * 50 + 600) * 2.5, 480.0)::DOUBLE, 0)::INT)) AS marks FROM documents")
def f44_mark_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", mark_count(F.col("n_chars"), F.col("doc_id") % 5 * 50 + 600, F.lit(60), F.lit(0)).alias("marks"))


QUERIES, ORACLE_SQL = query.queries, query.sql
