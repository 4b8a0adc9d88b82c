import numpy as np
import pytest

from pagequire.llm import queries, topk_search
from pagequire.llm.topk_search import threshold_search, top_k


def brute(ids, rows, asked, queries_, k):
    out = {}
    for q, v in zip(asked, queries_, strict=True):
        score = rows @ v
        order = sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if i != q)
        out[int(q)] = [(i, -s) for s, i in order[:k]]
    return out


@pytest.mark.parametrize("kind", ["random", "ties", "same", "few"])
def test_threshold_search_equals_brute_force(kind):
    r = np.random.default_rng(4)
    n = {"few": 3}.get(kind, 400)
    rows = r.integers(-120, 120, (n, 16)) if kind != "same" else np.ones((n, 16), int)
    if kind == "ties":
        rows = r.integers(-1, 2, (n, 16))
    ids = r.permutation(5 * n)[:n]
    asked = np.concatenate([ids[: n // 4 + 1], [10**6]])
    vectors = np.concatenate([rows[: n // 4 + 1], rows[:1]])
    q, found, score = threshold_search(ids, rows.astype(np.int32), asked, vectors.astype(np.int32), 5)
    got = {}
    for a, i, s in zip(q, found, score, strict=True):
        got.setdefault(int(asked[a]), []).append((int(i), int(s)))
    want = brute(ids, rows, asked, vectors, 5)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_search_stops_early():
    rows = np.zeros((4000, 8), np.int32)
    rows[:10] = 100
    calls = []
    original = np.partition
    topk_search.np.partition = lambda *a, **k: (calls.append(a[0].shape), original(*a, **k))[1]
    try:
        threshold_search(np.arange(4000), rows, np.array([-1]), np.ones((1, 8), np.int32), 5)
    finally:
        topk_search.np.partition = original
    assert sum(s[1] for s in calls) < 2000


@pytest.mark.parametrize("block, group", [(50, 7), (8192, 16384)])
def test_blocks(spark, block, group):
    r = np.random.default_rng(1)
    data = [(int(i), [int(x) for x in r.integers(-50, 50, 6)]) for i in range(200)]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(data, "vec_id long, v array<int>")
    out = top_k(frame, "v", "vec_id", F.col("vec_id") % 10 == 0, 4, block, group).collect()
    got = {}
    for x in sorted(out, key=lambda x: x["rank"]):
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    m = np.array([v for _, v in data])
    assert got == brute(np.arange(200), m, np.arange(0, 200, 10), m[::10], 4)


def test_query_leaves_out_broken_vectors(spark, folder):
    rows = [(0, [0.5, 0.25], 1), (50, [0.5, None], 1), (100, None, 1), (1, [0.1, float("nan")], 1), (2, [0.5, 0.5], 1), (3, [-0.5, float("inf")], 1), (4, [0.5, 0.5], 1), (150, [], 1), (200, [0.1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = [tuple(x) for x in queries.op8_top_k(spark, folder(embeddings=frame)).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 2, 128 * 128 + 64 * 128), (0, 2, 4, 128 * 128 + 64 * 128)]
    assert queries.op8_top_k(spark, folder(embeddings=frame.limit(0))).count() == 0


@pytest.mark.parametrize("size", [10**5, 10**7, 2 * 10**9])
def test_large_components_are_exact(spark, size):
    from pyspark.sql import functions as F

    r = np.random.default_rng(9)
    m = r.integers(-3, 4, (120, 4)).astype(object)
    m[:, 0] = m[:, 0] // 3 * size
    m[7], m[8] = m[9], m[9]
    frame = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(m)], "vec_id long, v array<long>")
    got = {}
    for x in sorted(top_k(frame, "v", "vec_id", F.col("vec_id") % 7 == 0, 5, 40, 8).collect(), key=lambda x: x["rank"]):
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    want = {}
    for q in range(0, 120, 7):
        want[q] = [(i, -s) for s, i in sorted((-sum(a * b for a, b in zip(m[q], m[i], strict=True)), i) for i in range(120) if i != q)[:5]]
    assert got == want


def test_scores_beyond_64_bits_are_an_error():
    with pytest.raises(ValueError):
        threshold_search(np.arange(2), np.full((2, 2), 1 << 40), np.array([0]), np.full((1, 2), 1 << 40), 1)


def test_large_component_of_the_query(spark, folder):
    frame = spark.createDataFrame([(0, [1e7, 0.5]), (1, [1e7, 0.25]), (2, [-1.0, 1.0])], "vec_id long, embedding array<double>")
    out = [tuple(x) for x in queries.op8_top_k(spark, folder(embeddings=frame)).orderBy("rank").collect()]
    assert out == [(0, 1, 1, 2560000000**2 + 128 * 64), (0, 2, 2, -2560000000 * 256 + 128 * 256)]


def test_integers_stop_early():
    """Rows whose values fall off: the lists are read a few ranks deep, and few rows are scored."""
    rows = np.zeros((4000, 8), np.int64)
    rows[:10] = 1 << 28
    scored = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            scored.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    topk_search.integer_search(np.arange(4000), rows.view(Counted), np.array([-1]), np.full((1, 8), 1 << 28), 5)
    assert 0 < sum(scored) < 400


def test_rows_that_repeat_an_id_are_dealt_over_blocks(spark):
    from pyspark.sql import functions as F

    rows = [(0, [2, 1])] * 30 + [(i, [i, 1]) for i in range(1, 8)] + [(3, [9, 9])] * 2
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    for block in (5, 8192):
        got = [tuple(r) for r in top_k(frame, "v", "vec_id", F.col("vec_id") % 3 == 0, 4, block, 1).orderBy("query_id", "rank").collect()]
        want = []
        for q in (0, 3, 6):
            vec = min((np.array(v, np.int64).tobytes(), v) for i, v in rows if i == q)[1]
            best = sorted((-(v[0] * vec[0] + v[1] * vec[1]), i) for i, v in rows if i != q)[:4]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
        assert got == want
