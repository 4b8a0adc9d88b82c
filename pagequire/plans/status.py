"""Queries of what is done and pending, and of logs and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import half_even
from ..operators import history, metrics, status
from .base import PAGES, REGIONS, Collector, Tables

query = Collector()
COUNTS = "NOT (seam_child OR repeated_caption)"
STATUS = f"""{PAGES}, {REGIONS}, s AS (SELECT p.*, count(r.page_key) > 0 AS detected,
 count(r.page_key) > 0 AND coalesce(bool_and(trim(text) <> '') FILTER (WHERE {COUNTS}), true) AS ocr,
 count(r.page_key) > 0 AND coalesce(bool_and(translation_completed OR (coalesce(trim(translation), '') <> '' AND trim(translation) <> trim(text))) FILTER (WHERE {COUNTS}), true) AS translated,
 count(r.page_key) > 0 AND coalesce(bool_and(typeset_completed OR (applied_text IS NOT NULL AND has_style)) FILTER (WHERE {COUNTS}), true) AS typeset,
 page_key IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS cleaned FROM pages_ p LEFT JOIN regions_ r USING (page_key) GROUP BY ALL)"""


@query(f"WITH {STATUS} SELECT * FROM s")
def a1_page_status(t: Tables) -> DataFrame:
    return status.page_status(t.order_pages(), t.line_regions(), t.order_patches())


@query(f"WITH {STATUS} SELECT chapter_id, count(*) AS pages, count_if(typeset) AS typeset, count_if(detected) AS detected FROM s GROUP BY chapter_id")
def a8_chapter_counts(t: Tables) -> DataFrame:
    return a1_page_status(t).groupBy("chapter_id").agg(F.count("*").alias("pages"), F.count_if("typeset").alias("typeset"), F.count_if("detected").alias("detected"))


@query(f"WITH {STATUS} SELECT chapter_id, coalesce(min(ord) FILTER (WHERE NOT translated AND ord > 3000), min(ord) FILTER (WHERE NOT translated)) AS next_pending FROM s GROUP BY chapter_id")
def p9_next_pending(t: Tables) -> DataFrame:
    return status.next_pending(a1_page_status(t), ~F.col("translated"), "chapter_id", "ord", F.lit(3000))


@query(f"WITH {STATUS} SELECT * FROM s WHERE NOT typeset AND contains(lower(name), '77.png')")
def p8_filter_pages(t: Tables) -> DataFrame:
    return status.filter_pages(a1_page_status(t), "no_typeset", "77.PNG")


@query(f"WITH {STATUS} SELECT avg(((detected::INT + ocr::INT + translated::INT + typeset::INT + cleaned::INT) / 5)::DOUBLE) AS progress, count_if(detected AND ocr AND translated AND typeset AND cleaned) AS done FROM s")
def a18_progress(t: Tables) -> DataFrame:
    flags = [F.col(c).cast("int") for c in ("detected", "ocr", "translated", "typeset", "cleaned")]
    total = sum(flags[1:], flags[0])
    return a1_page_status(t).agg(F.avg(total / 5).alias("progress"), F.count_if(total == 5).alias("done"))


@query(f"WITH {REGIONS} SELECT page_key, id, ord FROM regions_ WHERE ocr_stale OR NOT (seam_child OR repeated_caption OR ocr_checked OR trim(text) <> '')")
def p1_needs_reading(t: Tables) -> DataFrame:
    return t.line_regions().filter(status.needs_reading()).select("page_key", "id", "ord")


@query(f"WITH {PAGES} SELECT * FROM pages_ WHERE page_key NOT IN (SELECT l_orderkey FROM lineitem)")
def p2_pages_to_detect(t: Tables) -> DataFrame:
    return status.pages_without(t.order_pages(), t.line_regions())


@query(f"WITH {PAGES}, {REGIONS} SELECT * FROM pages_ WHERE page_key IN (SELECT page_key FROM regions_ WHERE trim(text) <> '' AND NOT (translation_completed AND translation IS NOT NULL))")
def p3_pages_to_translate(t: Tables) -> DataFrame:
    return status.pages_with(t.order_pages(), t.line_regions().filter(status.needs_translation()))


@query(f"WITH {PAGES} SELECT * FROM pages_ WHERE page_key IN (SELECT l_orderkey FROM lineitem) AND page_key NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def p4_pages_to_clean(t: Tables) -> DataFrame:
    return status.pages_to_clean(t.order_pages(), t.line_regions(), t.order_patches())


@query(f"WITH {REGIONS} SELECT page_key, id FROM regions_ WHERE (applied_text IS NOT NULL OR translation IS NOT NULL OR trim(text) <> '') AND NOT sfx_enabled AND auto_fit AND balloon_kind <> 'shout'")
def p5_dialogue(t: Tables) -> DataFrame:
    return t.line_regions().filter(status.is_dialogue()).select("page_key", "id")


@query(f"WITH {REGIONS} SELECT page_key, id FROM regions_ WHERE NOT repeated_caption AND trim(text) = '' AND height > 0 AND width >= 4 * height AND confidence < 0.5")
def p6_caption_candidates(t: Tables) -> DataFrame:
    return t.line_regions().filter(status.is_caption_candidate()).select("page_key", "id")


@query(f"WITH {REGIONS} SELECT page_key, id, coalesce(applied_text, translation, text) AS shown FROM regions_")
def p7_shown_text(t: Tables) -> DataFrame:
    from ..functions.values import first_text

    return t.line_regions().select("page_key", "id", first_text(F.col("applied_text"), F.col("translation"), F.col("text")).alias("shown"))


@query("SELECT c_custkey AS page_key, c_name AS text FROM customer WHERE contains(c_name, '9') OR c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE contains(c_name, '9'))")
def p14_prefer_scripted(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("page_key"), "c_nationkey", F.col("c_name").alias("text"))
    return status.prefer_scripted(rows, "text", "c_nationkey", "9").select("page_key", "text")


@query("""SELECT o_orderkey AS id, o_custkey AS x, o_orderkey % 90 AS y, 10 AS width, (10 + (o_orderkey % 4 = 0)::INT)::INT AS height, o_orderkey % 4 = 0 OR o_orderkey % 30 = 0 AS ocr_stale FROM orders""")
def p20_moved_regions(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    new = t.orders.select(k.alias("id"), F.col("o_custkey").alias("x"), (k % 90).alias("y"), F.lit(10).alias("width"), (F.lit(10) + (k % 4 == 0).cast("int")).alias("height"), (k % 30 == 0).alias("ocr_stale"))
    return status.moved_regions(new.withColumn("height", F.lit(10)), new, ["id"])


@query("""WITH r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 1 WHEN s_suppkey % 6 = 1 THEN s_suppkey - 1 END AS partner, s_suppkey % 6 = 3 AS child FROM supplier),
j AS (SELECT r.*, r.partner IS NOT NULL AND o.partner IS DISTINCT FROM r.id AS broken FROM r LEFT JOIN r o ON o.id = r.partner)
SELECT id, CASE WHEN NOT broken THEN partner END AS seam_partner, child AND NOT broken AS seam_child, broken AND child AS ocr_stale FROM j""")
def p24_released_seams(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    rows = t.supplier.select(k.alias("id"), F.when(k % 3 == 0, k + 1).when(k % 6 == 1, k - 1).alias("seam_partner"), (k % 6 == 3).alias("seam_child"), F.lit(False).alias("ocr_stale"))
    return status.released_seams(rows)


@query(f"WITH {REGIONS} SELECT page_key, count(*) AS failures FROM regions_ WHERE ocr_failed GROUP BY ROLLUP (page_key)")
def a19_failures(t: Tables) -> DataFrame:
    return status.failures_by_page(t.line_regions())


@query("""WITH e AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 120)
SELECT event_type AS name, avg(value) AS mean, count(*) AS samples, max(event_id) AS newest_id FROM (SELECT event_type, value, arg_max(event_id, (ts, event_id)) OVER (PARTITION BY event_type) AS event_id FROM e) GROUP BY event_type""")
def a4_recent_operations(t: Tables) -> DataFrame:
    rows = metrics.recent_operations(t.events, 120, "event_type", "value", ("ts", "event_id"))
    return rows.select(F.col("event_type").alias("name"), "mean", "samples", F.col("newest.event_id").alias("newest_id"))




@query("SELECT count(*) AS requests, count(*) FILTER (WHERE p IS NOT NULL AND c IS NOT NULL) AS reported, sum(greatest(p, 0)) FILTER (WHERE p IS NOT NULL AND c IS NOT NULL)::BIGINT AS input_tokens, sum(greatest(c, 0)) FILTER (WHERE p IS NOT NULL AND c IS NOT NULL)::BIGINT AS output_tokens FROM (SELECT try_cast(json_extract_string(props, '$.k') AS INT) AS p, CASE WHEN event_type <> 'view' THEN trunc(value)::INT - 50 END AS c FROM events)")
def a5_usage(t: Tables) -> DataFrame:
    rows = t.events.select(F.get_json_object("props", "$.k").try_cast("int").alias("prompt_tokens"), F.when(F.col("event_type") != "view", F.col("value").cast("int") - 50).alias("completion_tokens"))
    return metrics.usage(rows)


@query("WITH w(layer) AS (VALUES ('automatic'), ('paint'), ('restore')), p AS (SELECT CASE WHEN event_type = 'click' THEN 'automatic' ELSE 'paint' END AS layer FROM events) SELECT layer, count(p.layer) AS n FROM w LEFT JOIN p USING (layer) GROUP BY layer")
def a6_layer_counts(t: Tables) -> DataFrame:
    layers = t.events.select(metrics.patch_layer(F.when(F.col("event_type") == "click", " Automatic ").otherwise(F.col("event_type"))).alias("layer"))
    return metrics.counts_with_zeros(layers, "layer", ["automatic", "paint", "restore"])


@query("SELECT l_suppkey AS chapter_id, CASE WHEN count(*) >= 3 THEN round_even(median(l_quantity), 0)::BIGINT END AS typical FROM lineitem GROUP BY l_suppkey")
def a2_typical_size(t: Tables) -> DataFrame:
    return metrics.typical_size(t.lineitem.select(F.col("l_suppkey").alias("chapter_id"), "l_quantity"), "chapter_id", "l_quantity")


@query("""WITH r AS (SELECT l_suppkey AS chapter_id, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT chapter_id, l_orderkey, l_linenumber FROM r WHERE n <= 40 OR i IN (SELECT k * n // 40 FROM range(40) k(k))""")
def a3_evenly_sampled(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("chapter_id"), "l_orderkey", "l_linenumber")
    return metrics.evenly_sampled(rows, "chapter_id", ["l_orderkey", "l_linenumber"])


@query("WITH l AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id), x AS (SELECT user_id, len(v) AS n, list_sort(v[greatest(1, len(v) - 7):]) AS w FROM l) SELECT user_id, CASE WHEN n >= 4 THEN w[len(w) // 2 + 1] END AS latency FROM x")
def a13_latency(t: Tables) -> DataFrame:
    return metrics.latency_choice(t.events, "user_id", ["ts", "event_id"], "value")


@query("SELECT count(*) AS items, sum(n_chars)::BIGINT AS bytes, count_if(l.doc_id IS NOT NULL) AS hits, count_if(l.doc_id IS NULL) AS misses FROM documents d LEFT JOIN labels l USING (doc_id)")
def a20_cache_stats(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels.select("doc_id", F.lit(True).alias("hit")), "doc_id", "left")
    return metrics.cache_stats(rows, "n_chars", "hit")


@query("""WITH r AS (SELECT p_partkey AS id, p_size AS size, p_size % 3 = 0 AS seen, p_size % 5 <> 0 AS dialogue FROM part),
c AS (SELECT *, dialogue AND NOT (size <= 25 AND seen) AS change, CASE WHEN seen AND size % 2 = 0 THEN size + 10 ELSE size END AS asked FROM r)
SELECT id, CASE WHEN change THEN asked WHEN seen THEN size + 10 END AS font_size_requested, CASE WHEN change THEN least(asked, 25) ELSE size END AS font_size, change AS changed FROM c""")
def g16_capped_sizes(t: Tables) -> DataFrame:
    s = F.col("p_size")
    seen = s % 3 == 0
    rows = t.part.select(F.col("p_partkey").alias("id"), s.alias("font_size"), F.when(seen, s + 10).alias("font_size_requested"), F.when(seen, F.when(s % 2 == 0, s).otherwise(s + 1)).alias("chapter_font_applied"), F.when(seen, F.lit(25)).alias("chapter_font_size"))
    return metrics.capped_sizes(rows, F.lit(25), F.col("font_size") % 5 != 0).select("id", "font_size_requested", "font_size", "changed")


@query("SELECT median(value) AS seconds, round_even(median(value), 0)::BIGINT AS whole FROM events")
def a24_median_seconds(t: Tables) -> DataFrame:
    return t.events.agg(F.median("value").alias("seconds"), half_even(F.median("value")).alias("whole"))


@query("""WITH o AS (SELECT p_partkey AS path, p_size AS s FROM part WHERE p_partkey % 7 <> 0), n AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS s FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (path) WHERE o.s IS DISTINCT FROM n.s""")
def t2_changed_files(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    old, new = t.part.filter(k % 7 != 0).select(k.alias("path"), F.col("p_size").alias("sig")), t.part.filter(k % 5 != 0).select(k.alias("path"), F.when(k % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("sig"))
    return history.changes(old, new, "path", "sig")


@query("SELECT d.doc_id, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id AND d.doc_id % 2 = l.quality")
def t6_fresh_results(t: Tables) -> DataFrame:
    results = t.documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("version"), "lang")
    return history.fresh_results(results, t.labels.select("doc_id", F.col("quality").alias("version")), "doc_id", "version").select("doc_id", "lang")


@query("""WITH e AS (SELECT user_id, event_id, value < 60 AS bad FROM events), s AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e),
k AS (SELECT *, sum(bad::INT) OVER (PARTITION BY user_id, g ORDER BY event_id) AS n FROM s)
SELECT user_id, event_id, coalesce(max((n >= 4)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS broken FROM k""")
def t9_circuit(t: Tables) -> DataFrame:
    return history.circuit(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", F.col("value") < 60).select("user_id", "event_id", "broken")


@query("SELECT l_orderkey AS plan, sum(l_quantity)::BIGINT AS masked_pixels, count_if(l_returnflag = 'R')::BIGINT AS solid_entries FROM lineitem GROUP BY l_orderkey")
def a14_mask_totals(t: Tables) -> DataFrame:
    """Lines as the entries of their orders' plans."""
    rows = t.lineitem.withColumn("plan", F.col("l_orderkey"))
    return metrics.mask_totals(rows, "plan", F.col("l_quantity").cast("long"), F.col("l_returnflag") == "R")


@query("SELECT o_custkey AS chapter_id, o_orderkey AS page_key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS place FROM orders")
def o13_reversed(t: Tables) -> DataFrame:
    """The pages of a chapter from the last to the first."""
    return status.reversed_pages(t.order_pages(), "chapter_id", "ord").select("chapter_id", "page_key", "place")


QUERIES, ORACLE_SQL = query.queries, query.sql
