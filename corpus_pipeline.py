"""A training corpus from raw documents, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() chains them, each over the written result of the
one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequire.llm.mixing import MAX_PATTERNS, mix, shares, text_sizes
from pagequire.llm.ngram_join import jaccard_classes
from pagequire.llm.pieces import encode_texts
from pagequire.llm.quality_classifier import score_quality
from pagequire.llm.queries import PIECES, table
from pagequire.llm.span_dedup import dedup_spans
from pagequire.llm.text import free, kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the co-trained classifier keeps."""
    return score_quality(docs, table(spark, sf_dir, "labels")).filter("kept").select(*docs.columns)


def row_key(docs: DataFrame) -> Column:
    """What tells rows apart: ids may be null or repeated with other texts. Rows that are equal share it."""
    return F.xxhash64(*[F.struct(F.col(c), F.col(c).isNull()) for c in docs.columns])


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of the Jaccard join: the one with the smallest id (null last), of several the one with the
    smallest hash. Rows that share an id but no class all stay, and so do rows without an id."""
    key, size, of = free(docs, "key", "n_shingles", "component_id")
    rows = docs.withColumn(key, row_key(docs))
    classes = jaccard_classes(rows, key).distinct().select(key, F.col("component_id").alias(of))
    first = rows.select(F.struct(F.col("doc_id").isNull(), "doc_id", key).alias(size), key).join(classes, key).groupBy(of).agg(F.min(size)[key].alias(key))
    return rows.join(kept(first.select(key)), key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def without_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without sentences of repeated runs; those of which nothing is left go, n_chars follows the text."""
    cut = dedup_spans(docs)
    cut = cut.filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: each once, and half as many words again by repetition; no document is
    read more than twice. A document belongs to its source and to its language: a source's quota is its own size, the
    other half is shared out to the languages by the square roots of their sizes, so that small languages gain. The flow
    says which words count for which. Equal rows are mixed alike."""
    key, size = free(docs, "key", "size")
    rows = docs.withColumn(key, row_key(docs))
    sizes = kept(text_sizes(rows, [key, "source", "lang"], "text", size))
    named = lambda c, mark: F.when(F.col(c).isNull(), f"{mark}-").otherwise(F.concat(F.lit(f"{mark}="), c))
    members = sizes.select(key, size, named("lang", "l").alias("lang"), named("source", "s").alias("source"))
    total = {name: {r[0]: r.n for r in members.groupBy(name).agg(F.sum(size).alias("n")).limit(MAX_PATTERNS + 1).collect()} for name in ("source", "lang")}
    more = shares(total["lang"], {x: float(n) ** 0.5 for x, n in total["lang"].items()}, 0.5 * sum(total["lang"].values()), 1)
    quotas = total["source"] | {x: round(n) for x, n in more.items()}
    taken = mix(members, key, size, F.array("lang", "source"), quotas, 2, 0)
    taken = taken.filter("copies > 1").groupBy(key).agg(F.max("copies").alias("copies"))  # equal rows go alike
    copies = rows.select(F.struct(*docs.columns).alias("row"), key).join(taken, key, "left").select("row", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))))
    return copies.select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, scores and changes of the four best segmentations."""
    return encode_texts(docs, PIECES, 4)


STAGES = [("quality classifier", good_documents), ("n-gram Jaccard join", one_of_each_class), ("substring dedup", without_repeated_spans), ("source mixing", mixed), ("SentencePiece", encoded)]
#: Classifiers and searches in Python are no SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
