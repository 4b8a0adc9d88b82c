import os

import pytest

from pagequire.llm.queries import ORACLE_SQL, PIECES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF) or not os.path.exists(PIECES), reason="no test tables")


def test_stages_one_by_one(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    assert 100 < sizes[0] < 200 and sizes[1] <= sizes[0] and sizes[2] <= sizes[1] <= sizes[3] <= 2 * sizes[2] and sizes[4] == sizes[3]
    assert sorted(r.doc_id for r in p.run(spark, SF).collect()) == sorted(r.doc_id for r in docs.collect())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*order).collect()))) == sorted(map(str, want.select(*order).fetchall()))


def odd_documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in all columns, repeated rows and ids, no words, ties, long texts, empty tables: against plain rules."""
    import corpus_pipeline as p

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    long = " ".join(f"c{i}" for i in range(20000))
    rows = [(1, a, "en", "s0", 9), (1, a, "en", "s0", 9), (2, a, "en", "s1", 9), (1, b, "de", "s0", 9), (None, b, None, None, None), (None, "x y", "en", "s1", 3), (7, None, None, "s1", None), (8, "", "de", "s0", 0), (9, long, "de", "s1", 5)]
    docs = odd_documents(spark, rows)
    plain = lambda frame: sorted(map(str, map(tuple, frame.collect())))
    # of the class of a the row with id 1, of b's too: a null id comes last
    assert plain(p.one_of_each_class(spark, docs, "")) == sorted(map(str, [rows[0], rows[3], rows[5], rows[6], rows[7], rows[8]]))
    cut = {str(tuple(r)) for r in p.without_repeated_spans(spark, docs, "").collect()}
    assert {str(rows[i]) for i in (4, 5, 8)} <= cut and not any(x.startswith("(2") for x in cut)
    many = [(i, " ".join(f"w{i}x{k}" for k in range(5 + i % 7)), ("en", "de", "fr", None)[i * i % 11 % 4], f"s{i % 3}" if i % 13 else None, 1) for i in range(400)] + rows
    taken = {}
    for r in p.mixed(spark, odd_documents(spark, many), "").collect():
        taken[tuple(r)] = taken.get(tuple(r), 0) + 1
    size = lambda r: len((r[1] or "").split())
    repeated = many.count(rows[0])
    assert set(taken) == set(many) and all(n <= 2 * (repeated if r == rows[0] else 1) for r, n in taken.items())
    more, total = {}, {}
    for r in many:
        total[r[2]] = total.get(r[2], 0) + size(r)
        more[r[2]] = more.get(r[2], 0) + size(r) * (taken[r] - many.count(r)) // many.count(r)
    # no document is halved: each pattern may miss its flow by half a document
    assert abs(sum(more.values()) - sum(total.values()) / 2) < 0.5 * 20000 + 400
    none = docs.limit(0)
    for f in (p.one_of_each_class, p.without_repeated_spans, p.mixed, p.encoded):
        assert f(spark, none, "").count() == 0
    assert p.encoded(spark, docs, "").count() == len(rows)
    docs.limit(0).selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.good_documents(spark, docs, str(tmp_path)).count() == len(rows)
