from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequire.llm import queries
from pagequire.llm.hard_negatives import first_between, hard_negatives, within


def brute(rows, asked, positives, negatives, low=Fraction(30, 100), high=Fraction(90, 100)):
    """rows: (id, label, vector); of anchors that repeat an id the first in the order of label counts."""
    out = set()
    for a in asked:
        _, label, vec = min(r for r in rows if r[0] == a)
        score = lambda r: sum(x * y for x, y in zip(vec, r[2], strict=True))  # noqa: E731, B023
        ranked = sorted(((-score(r), r[0], r[1]) for r in rows))
        best = [(-s, i) for s, i, k in ranked if k == label and i != a][:positives]
        for p, i in best:
            hard = [(-s, j) for s, j, k in ranked if k != label and low * p <= -s <= high * p][:negatives]
            out |= {(a, i, n + 1, j, p, s) for n, (s, j) in enumerate(hard)}
    return out


def got(frame):
    rows = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def run(spark, rows, every, *sizes):
    frame = spark.createDataFrame(rows, "vec_id long, label int, v array<long>").repartition(3)
    return got(hard_negatives(frame, "v", "vec_id", "label", F.col("vec_id") % every == 0, 3, 4, (30, 100), (90, 100), *sizes))


@pytest.mark.parametrize("sizes", [(), (17, 5)])
@pytest.mark.parametrize("kind", ["random", "ties", "one label", "hot label", "zero"])
def test_equals_brute_force(spark, kind, sizes):
    r = np.random.default_rng(3)
    values = {"ties": (-1, 2), "zero": (0, 1)}.get(kind, (-9, 10))
    labels = {"one label": [1], "hot label": [0] * 20 + [1, 2]}.get(kind, [0, 1, 2, 3])
    rows = [(int(i), int(r.choice(labels)), r.integers(*values, 5).tolist()) for i in r.permutation(90)]
    assert run(spark, rows, 9, *sizes) == brute(rows, range(0, 90, 9), 3, 4)


def test_repeated_ids_and_rows(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), int(r.integers(3)), r.integers(0, 6, 4).tolist()) for i in range(40)]
    rows += rows[:12] * 3 + [(10, 2, [5, 5, 5, 5]), (5, 1, [1, 2, 3, 4])]
    some = spark.createDataFrame(rows, "vec_id long, label int, v array<long>")
    found = [tuple(x) for x in hard_negatives(some, "v", "vec_id", "label", F.col("vec_id") % 10 == 0, 3, 4, (30, 100), (90, 100), 7, 2).select("anchor_id", "rank", "negative_score", "positive_score").collect()]
    want = []
    for a in (0, 10, 20, 30):
        label, vec = min((k, np.array(v, np.int64).tobytes()) for i, k, v in rows if i == a)
        scored = sorted(((-int(np.frombuffer(vec, np.int64) @ np.array(v)), i, k) for i, k, v in rows))
        for p in [-s for s, i, k in scored if k == label and i != a][:3]:
            hard = [-s for s, i, k in scored if k != label and 30 * p <= -100 * s <= 90 * p][:4]
            want += [(a, n + 1, s, p) for n, s in enumerate(hard)]
    # equal positives, whose rows are the same, stand as often as they are repeated
    assert sorted(found) == sorted(want)


def test_large_values_are_exact_or_refused(spark):
    big = 1 << 30
    rows = [(0, 1, [big, 1]), (1, 1, [big, 0]), (2, 0, [big // 2, 3]), (3, 0, [big // 2, 2]), (4, 0, [big, 5])]
    assert run(spark, rows, 100) == brute(rows, [0], 3, 4)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, 1, [1 << 40, 1 << 40]), (1, 1, [1 << 40, 1 << 40])], 100)


def test_query_leaves_out_broken_rows_and_moves_labels(spark, folder):
    rows = [
        (0, [0.5, 0.25], 9, "x"), (100, None, 1, "x"), (200, [0.5, None], 1, "x"), (300, [0.5, 0.5], None, "x"), (None, [0.5, 0.5], 1, "x"), (1, [float("nan"), 0.5], 1, "x"), (2, [float("inf"), 0.5], 0, "x"),
        (7, [0.5, 0.5], 9, "x"), (8, [0.25, 0.25], 1, "x"), (9, [0.25, 0.0], 1, "x"), (10, [], 1, "x"), (11, [0.5], 1, "x"), (400, [0.5, 0.5], 3, "x"),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")
    # ids 0 and 7 are divisible by 7: label 0; 400 has no other row of its label
    found = got(queries.op11_hard_negatives(spark, folder(embeddings=frame)))
    positive = 128 * 128 + 64 * 128
    assert found == {(0, 7, 1, 8, positive, 128 * 64 + 64 * 64), (0, 7, 2, 9, positive, 128 * 64)}
    assert queries.op11_hard_negatives(spark, folder(embeddings=frame.limit(0))).count() == 0


@pytest.mark.parametrize("score, limits", [(7, (3, 6)), (10, (3, 9)), (-10, (-3, -9)), (0, (0, 0)), (1, (1, 0)), (3 * 10**18, (9 * 10**17, 27 * 10**17))])
def test_limits(score, limits):
    assert within(score, (30, 100), (90, 100)) == limits


def test_first_between_reads_only_other_labels_in_the_limits():
    ranked = np.array([9, 7, 7, 5, 5, 2, 0])
    assert first_between(ranked, np.array([0, 2, 3, 5]), (2, 7), 2).tolist() == [2, 3]
    assert first_between(ranked, np.array([0, 2, 3, 5]), (2, 6), 9).tolist() == [3, 5]
    assert first_between(ranked, np.array([0]), (10, 12), 3).tolist() == []
