"""Queries of documents, profiles and warps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents
from .base import Collector, Tables

query = Collector()


@query("""SELECT o_orderkey AS id, sha256('{"a":{"flag":' || CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END || ',"key":' || o_custkey || ',"pixels":true},"list":[{"p":1,"q":"' || o_orderpriority || '"}],"status":"' || o_orderstatus || '"}') AS fingerprint FROM orders""")
def f32_document_fingerprints(t: Tables) -> DataFrame:
    """Orders as documents whose keys stand in one of two orders, with pixels of their own."""
    k = F.col("o_orderkey")
    flag, pixels = F.when(k % 3 == 0, "true").otherwise("false"), F.concat(F.lit('"'), F.sha1(k.cast("string")), F.lit('"'))
    one = F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('","a":{"pixels":'), pixels, F.lit(',"key":'), F.col("o_custkey").cast("string"), F.lit(',"flag":'), flag, F.lit('},"list":[{"q":"'), "o_orderpriority", F.lit('","p":1}]}'))
    other = F.concat(F.lit('{ "list": [ {"p": 1, "q": "'), "o_orderpriority", F.lit('"} ], "a": {"flag": '), flag, F.lit(', "key": '), F.col("o_custkey").cast("string"), F.lit(', "pixels": '), pixels, F.lit('}, "status": "'), "o_orderstatus", F.lit('"}'))
    return t.orders.select(k.alias("id"), documents.document_fingerprint(F.when(k % 2 == 0, one).otherwise(other)).alias("fingerprint"))


@query("SELECT l_orderkey AS id, string_agg(l_linenumber || ':' || CASE WHEN l_returnflag = 'N' THEN true ELSE l_returnflag = 'A' END || ':' || coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity::INT END, 100), '|' ORDER BY l_linenumber::VARCHAR) AS signature FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def f33_state_signatures(t: Tables) -> DataFrame:
    """Lines as the layers of their orders; what is not returned says nothing on being visible."""
    seen = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A")
    opacity = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("int"))
    states = F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string"), F.struct(seen.alias("visible"), opacity.alias("opacity")))))
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_quantity").alias("l_quantity"))
    return lines.groupBy(F.col("l_orderkey").alias("id")).agg(documents.state_signature(states).alias("signature"))


QUAD = "p_partkey AS id, (p_partkey % 7)::DOUBLE AS x0, (p_partkey % 5)::DOUBLE AS y0, 100.0::DOUBLE + p_partkey % 11 AS x1, (p_partkey % 3)::DOUBLE AS y1, 90.0::DOUBLE + p_partkey % 13 AS x2, 80.0::DOUBLE + p_partkey % 17 AS y2, (p_partkey % 9)::DOUBLE AS x3, 70.0::DOUBLE + p_partkey % 19 AS y3"


@query(f"""WITH q AS (SELECT {QUAD} FROM part), d AS (SELECT *, (x1 - x2) * (y3 - y2) - (y1 - y2) * (x3 - x2) AS det, x0 - x1 + x2 - x3 AS sx, y0 - y1 + y2 - y3 AS sy FROM q),
w AS (SELECT *, (sx * (y3 - y2) - sy * (x3 - x2)) / det AS g, ((x1 - x2) * sy - (y1 - y2) * sx) / det AS h FROM d), p AS (SELECT unnest([0.0, 0.25, 0.5, 1.0]::DOUBLE[]) AS u, unnest([0.0, 1.0, 0.5, 0.75]::DOUBLE[]) AS v)
SELECT id, u, v, round(((x1 - x0 + g * x1) * u + (x3 - x0 + h * x3) * v + x0) / (g * u + h * v + 1), 6) AS x, round(((y1 - y0 + g * y1) * u + (y3 - y0 + h * y3) * v + y0) / (g * u + h * v + 1), 6) AS y FROM w, p""")
def f42_warps(t: Tables) -> DataFrame:
    """Four points of every part's quadrangle."""
    k = F.col("p_partkey")
    corners = {"tl": (k % 7, k % 5), "tr": (100 + k % 11, k % 3), "br": (90 + k % 13, 80 + k % 17), "bl": (k % 9, 70 + k % 19)}
    points = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in ((0.0, 0.0), (0.25, 1.0), (0.5, 0.5), (1.0, 0.75))])
    rows = t.part.select("p_partkey", F.explode(points).alias("p")).select("p_partkey", "p.u", "p.v")
    x, y = documents.projective(corners, F.col("u"), F.col("v"))
    return rows.select(k.alias("id"), "u", "v", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("SELECT c_mktsegment AS type, c_name AS project, CASE WHEN c_custkey % 4 = 0 THEN '{}' ELSE '{\"a\":' || c_nationkey || '}' END AS fonts, CASE c_custkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'default' ELSE 'own ' || c_custkey END AS prompt, '[]' AS glossary FROM customer")
def s10_profiles(t: Tables) -> DataFrame:
    """Customers as profiles of their segments, each with an older file; some say nothing, some have the old prompt."""
    k = F.col("c_custkey")
    fonts = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit('"fonts": {"a": '), F.col("c_nationkey").cast("string"), F.lit("},")))
    prompt = F.when(k % 3 == 0, F.lit('{"prompt": "old "}')).when(k % 3 == 1, F.lit("{}")).otherwise(F.concat(F.lit('{"prompt": "own '), k.cast("string"), F.lit('", "glossary": 3}')))
    path = F.concat(F.lit("/profiles/"), "c_mktsegment", F.lit("/"), "c_name", F.lit("/profile.json"))
    rows = t.customer.select(path.alias("path"), F.concat(F.lit("{"), fonts, F.lit('"translation": '), prompt, F.lit("}")).alias("text"), F.lit(2).alias("modified"))
    older = rows.select("path", F.lit('{"fonts": {"z": 1}}').alias("text"), F.lit(1).alias("modified"))
    return documents.profiles(rows.unionByName(older), "default", {"old": "new"})


QUERIES, ORACLE_SQL = query.queries, query.sql
