"""Queries of the corpus operators over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import kept
from .url_filter import PATTERN_RULES, SITE_RULES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The model file of the standard encoder.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every document, and whether the best decodes to its text."""
    from .pieces import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), PIECES, 4)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by source: 150 % of all words shared by the weights 3, 1, 2, at most 2 times a source."""
    from .mixing import MAX_PATTERNS, mix, shares, text_sizes

    # written once: the sizes are read for the totals, the order and the result
    sizes = kept(text_sizes(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text", "size"))
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).limit(MAX_PATTERNS + 1).collect()  # one row per source
    if len(by_source) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sources")
    named = sorted((r.source for r in by_source if r.source is not None), key=lambda s: s.encode()) + [None] * any(r.source is None for r in by_source)
    key = {s: "-" if s is None else f"={s}" for s in named}
    total = {key[r.source]: r.source_size for r in by_source}
    weights = {key[s]: (3, 1, 2)[i % 3] for i, s in enumerate(named)}
    targets = shares(total, weights, 1.5 * sum(total.values()), 2)
    source = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), "source"))
    mixed = mix(sizes.withColumn("source_key", source), "doc_id", "size", F.array("source_key"), {s: round(t) for s, t in targets.items()}, 2, 0)
    facts = spark.createDataFrame([(s, total[s], float(targets[s])) for s in total], "source_key string, source_size long, target double")
    return mixed.join(F.broadcast(facts), "source_key").select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


def op5_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain junk, toxic over the labels, scored on all documents."""
    from .toxicity import score_chain

    chain = {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}
    return score_chain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), chain)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "p_low", "kept")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of floor(256 x) of every fiftieth vector with all others."""
    from .topk_search import top_k

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    # what is not finite becomes null, and vectors with nulls take no part
    whole = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.floor(x * 256))
    rows = rows.select("vec_id", F.transform("v", whole).alias("v"))
    return top_k(rows, "v", "vec_id", F.col("vec_id") % 50 == 0, 5)


def op9_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op10_dedup_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .span_dedup import dedup_spans

    done = dedup_spans(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", "n_sentences", "n_removed", "removed", F.array_sort("first_ids").alias("first_ids"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of the five nearest positives of every hundredth vector."""
    from .hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    whole = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.floor(x * 256))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), F.transform("v", whole).alias("v"))
    return hard_negatives(rows, "v", "vec_id", "label", F.col("vec_id") % 100 == 0, 5, 10, (30, 100), (90, 100))


#: The tokenizer file of packed sequences.
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 ids, with the crc of each piece's ids."""
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), TOKENIZER).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_groups

    return spelling_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pieces, op2_mix_sources, op3_quality_rules, op4_jaccard_join, op5_filter_urls, op6_toxicity, op7_quality_classifier, op8_top_k, op9_scan_licenses, op10_dedup_spans, op11_hard_negatives, op12_pack, op13_spelling)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    # the level at which the shares stop: sources are full in the order of their cap per weight
    "op2_mix_sources": f"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
r AS (SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS below, sum(weight) OVER after AS above FROM w
      WINDOW before AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             after AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM s) - below)::DOUBLE / above AS per FROM r),
f AS (SELECT min(CASE WHEN per * weight <= 2 * source_size THEN 2.0 * source_size / weight END) AS first FROM l),
p AS (SELECT arg_min(per, 2.0 * source_size / weight) AS per FROM l WHERE 2.0 * source_size / weight >= (SELECT first FROM f)),
t AS (SELECT source, source_size, CASE WHEN (SELECT per FROM p) * weight > 2 * source_size OR (SELECT per FROM p) IS NULL THEN 2.0 * source_size ELSE (SELECT per FROM p) * weight END::DOUBLE AS target FROM w),
q AS (SELECT *, round_even(target, 0)::BIGINT AS quota FROM t),
o AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.quota, ('0x' || substr(md5('0|' || coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT AS seed, d.source FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY seed, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT doc_id, size, source_size, target, (size * CASE WHEN source_size = 0 OR quota >= 2 * source_size THEN 2 * (source_size > 0)::INT
       ELSE quota // source_size + (2 * before + size <= 2 * (quota % source_size) AND size > 0)::INT END)::BIGINT AS taken FROM c
""",
    "op5_filter_urls": f"""
WITH u AS (SELECT page_id, lower(coalesce(url, '')) AS low, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT *, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, action) AS (VALUES {", ".join(f"('{r}', '{a}')" for r, a in SITE_RULES)}),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM p, r
      WHERE suffix('.' || host, '.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id),
m(pattern, expression, action) AS (VALUES {", ".join(f"('{n}', '{e}', '{a}')" for n, e, _, a in PATTERN_RULES)}),
g AS (SELECT page_id, min(pattern) AS pattern, arg_min(m.action, pattern) AS action FROM p JOIN m ON regexp_matches(low, expression) WHERE page_id NOT IN (SELECT page_id FROM f) GROUP BY page_id)
SELECT page_id, host, path, rule, pattern, coalesce(f.action, g.action, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id) LEFT JOIN g USING (page_id)
""",
    "op8_top_k": """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding]::DOUBLE[] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
}
