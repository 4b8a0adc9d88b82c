import pytest
from pyspark.sql import functions as F

from pagequire.functions import text, values
from pagequire.operators import lookup, terms


@pytest.fixture(scope="module")
def apply(spark):
    def run(f, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
        return [r.o for r in rows.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]

    return run


def test_readings(apply):
    assert apply(text.reading_text, "漢字\nかな です", "한국\n말", "one\ntwo\n\n\nthree  ", "```\nx y\n```", "BEGIN\nthe beginning\nEND:", None, "<|a|>b<box 1>", "漢 字 a b", "x\r\ny") == ["漢字かなです", "한국 말", "one\ntwo\n\nthree", "x y", "the beginning", "", "b", "漢字 a b", "x\ny"]
    assert apply(text.translation_text, "BEGIN\nHi begin.\nEND", "a  \n\n\n\nb") == ["Hi .", "a\n\nb"]


def test_languages(apply):
    assert apply(text.language, "かな 漢", "한", "漢字", "hola", "") == ["ja", "ko", "zh", "es", "es"]


def test_rows_and_numbers(apply):
    assert apply(text.one_row, " a\n b\n\n\n c ", "", None) == ["a b / c", "", ""]
    assert apply(text.without_number, "12. hi", "#3 yo", "[4] x", "2024", "no 1. x", " 7) y") == ["hi", "yo", "x", "2024", "no 1. x", "y"]
    assert apply(text.without_fences, "```json\n{}\n```") == ["{}"]


def test_folding(apply):
    assert apply(text.casefold, "Straße", "ΣΑΣ", None) == ["strasse", "σασ", None]
    assert apply(text.plain, "Título ÁÉ") == ["titulo ae"]


def test_failures(apply):
    assert apply(text.failure_kind, "HTTP 401", "free quota, HTTP 429", "Too many requests", "CUDA out of memory", "?", None) == ["credentials", "billing", "rate_limit", "memory", "unknown", "unknown"]
    assert apply(lambda c: text.failure_title(c, F.lit("reading")), "Qwen (HTTP 9): odd. \nmore", "", "x" * 200) == ["odd", "reading", "x" * 140]
    assert apply(text.is_transient, "HTTP 503", "HTTP 400", None) == [True, False, False]


def test_values(apply, spark):
    names = ["page10.png", "page2.png", "Page1.png"]
    assert [names[i] for i in sorted(range(3), key=lambda i: apply(values.natural_key, *names)[i])] == ["Page1.png", "page2.png", "page10.png"]
    assert apply(values.has_text, "　", " a", None, "") == [False, True, False, False]
    assert apply(values.stripped, "　a ") == ["a"]
    row = spark.range(1).select(values.half_even(F.lit(2.5)).alias("a"), values.half_even(F.lit(3.5)).alias("b"), values.upper_median(F.array(F.lit(4), F.lit(1), F.lit(3), F.lit(2))).alias("c"), values.version_key(F.lit("v1.10.x")).alias("d"), values.floor_div(F.lit(-7), F.lit(2)).alias("e")).first()
    assert tuple(row) == (2, 4, 3, [1, 10, 0], -4)


def test_term_lines(spark):
    lines = ["- Li Wei => Li Wei", "1. Sect: Secta", "| Sword | Espada | objeto | rare |", "a, b, lugar, note", "x; y", "two  parts", "alone", "# no", "|---|---|", "", '"a, b", c', "T\tU"]
    got = [(r.source, r.target, r.category, r.note) for r in terms.parse_terms(spark.createDataFrame(list(enumerate(lines)), "i int, line string").coalesce(1), "line").orderBy("i").collect()]
    assert got == [("Li Wei", "Li Wei", "término", ""), ("Sect", "Secta", "término", ""), ("Sword", "Espada", "objeto", "rare"), ("a", "b", "lugar", "note"), ("x", "y", "término", ""), ("two", "parts", "término", ""), ("alone", "alone", "término", ""), ("a, b", "c", "término", ""), ("T", "U", "término", "")]


def test_merge_prefers_the_first_list(spark):
    schema = "ord int, source string, target string, category string, note string"
    stored = spark.createDataFrame([(0, "Wei", "old", "c", "kept"), (1, "Li", "li", "c", "")], schema)
    imported = spark.createDataFrame([(0, "WEI", "new", "c", ""), (1, " ", "x", "c", "")], schema)
    got = {(r.source, r.target, r.note) for r in lookup.merge_terms(imported, stored, F.lower("source"), "ord").collect()}
    assert got == {("WEI", "new", "kept"), ("Li", "li", "")}


def test_relevant_terms(spark):
    found = lookup.relevant_terms(spark.createDataFrame([(1, "Straße"), (2, "zz"), (3, " ")], "id int, source string"), spark.createDataFrame([("b", "in der STRASSE"), ("b", None)], "batch string, text string"), "batch", "text")
    assert [(r.batch, r.id) for r in found.collect()] == [("b", 1)]


def test_relevant_terms_as_sql_lowers(spark, tmp_path):
    import duckdb

    from pagequire.plans import lookups

    spark.createDataFrame([(1, "Erßie entech x"), (2, "ΟΔΟΣ des"), (3, "İst da")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "an erssie entech"), (2, "AN ERßIE ENTECH"), (3, "οδος des"), (4, "οδοσ des"), (5, "ist da"), (6, None)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.item_id) for r in lookups.QUERIES["j12_relevant_terms"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted((d, i) for d, i, _ in con.execute(lookups.ORACLE_SQL["j12_relevant_terms"]).fetchall()) == [(2, 1), (4, 2), (5, 3)]


def test_pasted_text(spark):
    texts = ["1. one\nmore\n2) two\n\n#3 three", "first\n\nsecond\nline", "a\nb", "intro\n1. x", "[1]\nown line\n[2] y"]
    rows = terms.numbered_entries(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").orderBy("id", "place").collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append(r.entry)
    assert got == {0: ["one\nmore", "two", "three"], 1: ["first", "second\nline"], 2: ["a", "b"], 3: ["intro", "x"], 4: ["own line", "y"]}
    parts = terms.sections(spark.createDataFrame([(1, "lost\n=== p 1 ===\n1. a\n\n== p 2 ==\n\n==x==\nz")], "id int, t string"), "id", "t").orderBy("ord").collect()
    assert [(r.name, r.body) for r in parts] == [("p 1", "1. a"), ("x", "z")]


def test_protection(apply):
    words = F.array(F.struct(F.lit("Li").alias("source")), F.struct(F.lit("Li Wei").alias("source")))
    assert apply(lambda c: terms.protect(c, words), "Li Wei saw Li") == ["__TERM_0000__ saw __TERM_0001__"]


def test_relevant_terms_by_shards_and_in_long_texts(spark):
    import random
    import time

    r = random.Random(1)
    names = ["".join(r.choices("abcß", k=r.randint(1, 4))) for _ in range(60)]
    found = spark.createDataFrame([*enumerate(names), (100, None), (101, "")], "id int, source string")
    texts = [(i % 5, "".join(r.choices("abcSß ", k=40))) for i in range(12)] + [(7, ""), (8, None)]
    frame = spark.createDataFrame(texts, "batch int, text string")
    want = sorted((b, i) for b, i in {(b, i) for b, t in texts for i, n in enumerate(names) if n.casefold() in (t or "").casefold()})
    for shard in (7, 1000):
        assert sorted((x.batch, x.id) for x in lookup.relevant_terms(found, frame, "batch", "text", shard).collect()) == want
    assert lookup.relevant_terms(found.limit(0), frame, "batch", "text").count() == 0 == lookup.relevant_terms(found, frame.limit(0), "batch", "text").count()
    long = spark.createDataFrame([(1, "the name of the rose " * 10_000)], "batch int, text string")
    began = time.time()
    assert lookup.relevant_terms(spark.createDataFrame([(1, "the"), (2, "Rose THE"), (3, "roses")], "id int, source string"), long, "batch", "text").count() == 2
    assert time.time() - began < 5


def test_natural_order_of_long_numbers(apply):
    names = ["p" + "9" * 30, "p1" + "0" * 30, "p2", "p010", "p9", "p", "p0", None]
    keys = apply(values.natural_key, *names)
    assert keys[-1] is None and [names[i] for i in sorted(range(7), key=lambda i: keys[i])] == ["p", "p0", "p2", "p9", "p010", "p" + "9" * 30, "p1" + "0" * 30]


def test_json_terms_at_any_depth(spark):
    import json

    from pagequire.operators import script

    deep = [{"source": "a", "target": "b"}]
    for k in ("items", "terms", "glossary", "entries", "items", "terms"):
        deep = {"other": 1, k: deep}
    rows = [(1, json.dumps(deep)), (2, "[" * 3000), (3, None), (4, "no json"), (5, json.dumps({"x": "y", "z": {"target": "w"}})), (6, "{}"), (7, json.dumps({"source": "one", "target": "two"}))]
    got = sorted((r.id, r.source, r.target) for r in script.json_terms(spark.createDataFrame(rows, "id int, j string"), ["id"], "j").collect())
    assert got == [(1, "a", "b"), (5, "x", "y"), (5, "z", "w"), (7, "one", "two")]


def test_tags_fences_and_titles(apply):
    assert apply(text.without_tags, "a<|x|>b", "<box 1>x</ BOX>", "1 < 2 > 0 <b>", "<s_box", "< /start>y<beginning>", None, "<|a") == ["ab", "x", "1 < 2 > 0 <b>", "<s_box", "y", None, "<|a"]
    assert apply(text.without_fences, "```json\n{}\n  ```  \nx ``` y\n``` two words", None, "```") == ["{}\nx ``` y\n``` two words", "", ""]
    assert apply(text.reading_text, "```\n", "```x", "a ``` b", "```py\na\n```\n``` tail") == ["", "", "a ``` b", "a\n```"]
    title = lambda c: text.failure_title(c, F.lit("op"))
    assert apply(title, "DashScope: no.", "QWEN (HTTP 12) : what: this", "Qwen (odd): x", "Other: x", "qwen", ":", "") == ["no", "what: this", "Qwen (odd): x", "Other: x", "qwen", ":", "op"]


def test_terms_as_text(spark):
    rows = spark.createDataFrame([(1, "a", "b", "x", " n "), (2, "c", "d", "lugar", None)], "ord int, source string, target string, category string, note string")
    assert [r.t for r in rows.coalesce(1).orderBy("ord").select(terms.terms_as_text().alias("t")).collect()] == ["a\tb\tx\t n", "c\td\tlugar"]


def test_memory_of_odd_contexts(apply):
    from pagequire.operators import script

    out = apply(script.memory_pairs, "a → b\r\n → c\nd →\nno arrow\n e→f → g \n", None, "", "\n".join(f"s{i} → t" for i in range(20)))
    assert [[tuple(p) for p in x] for x in out[:3]] == [[("a", "b"), ("e", "f → g")], [], []] and len(out[3]) == 12
