import itertools

from pyspark.sql import functions as F

from pagequire.llm import queries
from pagequire.llm.mixing import mix, route, shares


def test_shares_stop_at_their_bound_and_pass_on():
    assert shares({"a": 10, "b": 100, "c": 100}, {"a": 3, "b": 1, "c": 2}, 90, 2) == {"a": 20.0, "b": 70 / 3, "c": 140 / 3}
    assert shares({"a": 0, "b": 4}, {"a": 1, "b": 1}, 6, 2) == {"a": 0.0, "b": 6.0}
    assert shares({}, {}, 0, 2) == {}


def cost(flow, capacity):
    """Each token costs the number of times that its pattern has been read before."""
    total = 0
    for p, by in flow.items():
        used, level = sum(by.values()), 0
        while used > 0:
            total += level * min(used, capacity[p])
            used -= capacity[p]
            level += 1
    return total


def test_route_is_a_least_cost_flow():
    capacity, quota, repeats = {("a",): 2, ("a", "b"): 2, ("b",): 1}, {"a": 3, "b": 3}, 2
    flow = route(capacity, quota, repeats)
    best = None
    for x in itertools.product(range(5), repeat=4):
        by = {("a",): {"a": x[0]}, ("a", "b"): {"a": x[1], "b": x[2]}, ("b",): {"b": x[3]}}
        if all(sum(f.values()) <= repeats * capacity[p] for p, f in by.items()) and x[0] + x[1] <= 3 and x[2] + x[3] <= 3:
            key = (-(sum(x)), cost(by, capacity))
            best = min(best or key, key)
    assert (-sum(sum(f.values()) for f in flow.values()), cost(flow, capacity)) == best


def test_overlapping_sources(spark):
    rows = spark.createDataFrame([(i, 1, (["a"], ["a", "b"], ["b"], [])[i % 4]) for i in range(400)], "doc_id long, size long, sources array<string>")
    out = mix(rows, "doc_id", "size", F.col("sources"), {"a": 150, "b": 150}, 2, 1)
    by = {tuple(r.sources): r.n for r in out.groupBy("sources").agg(F.sum("taken").alias("n")).collect()}
    assert by[()] == 0 and sum(by.values()) == 300 and by[("a",)] == by[("a", "b")] == by[("b",)] == 100


def test_query_on_odd_rows(spark, table, folder):
    docs = table([(1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, "d e", None), (4, "d e", None), (5, "w " * 3000, "z"), (6, "q r s t", "x")])
    at = folder(documents=docs)
    out = queries.op2_mix_sources(spark, at).collect()
    assert len(out) == 7 and {r.size for r in out if r.doc_id in (2, 3)} == {0}
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    assert sorted(map(tuple, out)) == sorted(map(tuple, queries.op2_mix_sources(spark, at).collect()))
    assert queries.op2_mix_sources(spark, folder(documents=docs.limit(0))).count() == 0


def test_many_documents_come_near_their_target(spark, table, folder):
    docs = table([(i, "w " * (1 + i % 7), f"s{i % 5 if i % 2 else 0}") for i in range(3000)])
    out = queries.op2_mix_sources(spark, folder(documents=docs)).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 8 for r in out)
