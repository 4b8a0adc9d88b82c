"""How a module of queries collects them, and the tables' projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of one folder, and domain tables made of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def order_pages(self) -> DataFrame:
        """Orders as pages of the chapters that customers are."""
        return self.orders.select(F.col("o_custkey").alias("chapter_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("page_key"), F.concat(F.lit("page "), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("name"), F.lit(800).alias("width"), (F.col("o_totalprice") / 100).cast("long").alias("height"))

    def line_regions(self) -> DataFrame:
        """Order lines as regions: flags and texts by flag columns and remainders."""
        n, q = F.col("l_linenumber"), F.col("l_quantity").cast("long")
        return self.lineitem.select(
            F.col("l_orderkey").alias("page_key"), n.alias("ord"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
            F.when(F.col("l_returnflag") != "N", F.concat(F.lit("text "), q.cast("string"))).otherwise(F.lit("  ")).alias("text"),
            F.when(q % 3 != 0, F.concat(F.lit("tr "), q.cast("string"))).alias("translation"), F.when(q % 2 == 0, F.lit("applied")).alias("applied_text"),
            (F.col("l_linestatus") == "F").alias("translation_completed"), (F.col("l_linestatus") == "F").alias("ocr_checked"), F.lit(None).cast("boolean").alias("ocr_completed"), (q % 7 == 0).alias("ocr_stale"),
            (q % 11 == 0).alias("seam_child"), F.when(q % 13 == 0, F.lit(True)).alias("repeated_caption"), (q % 5 == 0).alias("typeset_completed"), (q % 4 == 0).alias("has_style"), (q % 17 == 0).alias("_ocr_failed"),
            F.when(q % 6 == 0, "shout").when(q % 6 == 1, "thought").alias("balloon_kind"), (q % 10 == 0).alias("sfx_enabled"), F.when(q % 9 == 0, F.lit(False)).alias("auto_fit"), F.lit(False).alias("manual"),
            (q * 4).cast("int").alias("width"), (F.col("l_tax") * 1000).cast("int").alias("height"), (F.col("l_discount") * 8).alias("confidence"),
        )

    def order_patches(self) -> DataFrame:
        return self.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("page_key"))

    def boxes(self) -> DataFrame:
        """Parts as boxes of pages, 100 to a page."""
        k = F.col("p_partkey")
        return self.part.select(F.floor(k / 100).alias("page_key"), k.alias("idx"), ((k * 7919) % 800).cast("int").alias("x"), ((k * 37) % 2000).cast("int").alias("y"), (F.col("p_size") * 3 + 20).cast("int").alias("width"), (F.col("p_size") + 5).cast("int").alias("height"), ((k * 31) % 97 / 97).alias("confidence"))

    def strip_pages(self) -> DataFrame:
        """Documents as pages of the chapters that sources are."""
        return self.documents.select(F.col("source").alias("chapter_id"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("page_key"), (F.col("doc_id") % 5 * 50 + 600).alias("width"), F.col("n_chars").alias("height"))


# the same projections for the oracle, to begin a WITH list
PAGES = "pages_ AS (SELECT o_custkey AS chapter_id, o_orderkey AS ord, o_orderkey AS page_key, 'page ' || o_orderkey || '.png' AS name, 800 AS width, trunc(o_totalprice / 100)::BIGINT AS height FROM orders)"
REGIONS = """regions_ AS (SELECT l_orderkey AS page_key, l_linenumber AS ord, l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_returnflag <> 'N' THEN 'text ' || q ELSE '  ' END AS text,
 CASE WHEN q % 3 <> 0 THEN 'tr ' || q END AS translation, CASE WHEN q % 2 = 0 THEN 'applied' END AS applied_text, l_linestatus = 'F' AS translation_completed, l_linestatus = 'F' AS ocr_checked,
 q % 7 = 0 AS ocr_stale, q % 11 = 0 AS seam_child, q % 13 = 0 AS repeated_caption, q % 5 = 0 AS typeset_completed, q % 4 = 0 AS has_style, q % 17 = 0 AS ocr_failed,
 CASE q % 6 WHEN 0 THEN 'shout' WHEN 1 THEN 'thought' ELSE 'dialogue' END AS balloon_kind, q % 10 = 0 AS sfx_enabled, q % 9 <> 0 AS auto_fit,
 (q * 4)::INT AS width, trunc(l_tax * 1000)::INT AS height, l_discount * 8 AS confidence FROM (SELECT *, l_quantity::BIGINT AS q FROM lineitem))"""
BOXES = "boxes_ AS (SELECT p_partkey // 100 AS page_key, p_partkey AS idx, (p_partkey * 7919 % 800)::INT AS x, (p_partkey * 37 % 2000)::INT AS y, p_size * 3 + 20 AS width, p_size + 5 AS height, (p_partkey * 31) % 97 / 97.0::DOUBLE AS confidence FROM part)"
STRIPS = "strips_ AS (SELECT source AS chapter_id, doc_id AS ord, doc_id AS page_key, doc_id % 5 * 50 + 600 AS width, n_chars AS height FROM documents)"


class Collector:
    """Queries by name, and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
