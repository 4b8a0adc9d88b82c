import itertools
import random

import numpy as np
import pandas as pd
import pytest

from pagequire.operators import boxes, planning
from pagequire.operators.reading import right_to_left_order

SCHEMA = "page_key string, idx int, x int, y int, width int, height int, confidence double"


def frame(spark, rows):
    return spark.createDataFrame([("p", i, *r) if len(r) == 5 else ("p", i, *r, 0.5) for i, r in enumerate(rows)], SCHEMA)


def order(frame_):
    return [r.idx for r in frame_.orderBy("number").collect()]


def test_right_block_is_read_first(spark):
    block = [(x, y, 60, 40) for x in (0, 90) for y in (0, 90, 180)]
    two = block + [(x + 600, y + 45, w, h) for x, y, w, h in block]
    got = order(boxes.right_to_left(frame(spark, two)))
    assert {*got[:6]} == set(range(6, 12)) and {*got[6:]} == set(range(6))
    lower = [(x, y + 800, w, h) for x, y, w, h in two]
    both = order(boxes.right_to_left(frame(spark, two + lower)))
    assert both[:12] == got and both[12:] == [i + 12 for i in got]


def test_order_does_not_depend_on_input():
    r = np.random.default_rng(4)
    for _ in range(30):
        x, y, w, h = r.integers(0, 900, 40), r.integers(0, 1500, 40), r.integers(20, 200, 40), r.integers(20, 90, 40)
        items = np.column_stack([x, y, x + w, y + h, np.arange(40)])
        want = right_to_left_order(items)
        assert sorted(want) == list(range(40))
        assert (right_to_left_order(r.permutation(items)) == want).all()


def test_orders_by_hand():
    """Rows from the right; two blocks; a lone box beside rows; bands; rows that cross a gap."""
    def read(*rows):
        return right_to_left_order(np.array([(x, y, x + w, y + h, i) for i, (x, y, w, h) in enumerate(rows)])).tolist()

    assert read((0, 0, 50, 40), (200, 5, 50, 40), (400, 0, 50, 40)) == [2, 1, 0]
    assert read((0, 0, 50, 40), (300, 40, 50, 40)) == [0, 1]  # under 12 pixels or 0.65 of the height: one row; here two
    assert read((0, 0, 50, 40), (300, 20, 50, 40)) == [1, 0]
    assert read((0, 0, 100, 60), (300, 100, 100, 60), (0, 110, 100, 60)) == [1, 0, 2]  # 40 pixels below: one band, two blocks
    assert read((0, 0, 100, 60), (300, 110, 100, 60), (0, 120, 100, 60)) == [0, 1, 2]
    assert read((0, 0, 100, 50), (0, 60, 100, 50), (500, 30, 100, 50), (500, 90, 100, 50)) == [2, 3, 0, 1]
    assert read((0, 0, 100, 50), (500, 0, 100, 50), (0, 60, 100, 50), (500, 60, 100, 50)) == [1, 0, 3, 2]  # rows are read across
    assert read((0, 0, 40, 30), (0, 200, 40, 30), (300, 201, 40, 30)) == [0, 2, 1]
    assert read((5, 5, 1, 1)) == [0]


def plain_places(ideals, spans, step):
    """All choices of tops, the first by each slot's distance in turn."""
    best = None
    for tops in itertools.product(*[[y for s, e in sp for y in range(s, e + 1)] for sp in spans]):
        if all(b - a >= step for a, b in zip(tops, tops[1:], strict=False)):
            cost = [(abs(y - i), y) for y, i in zip(tops, ideals, strict=True)]
            best = min(best, (cost, tops)) if best else (cost, tops)
    return list(best[1]) if best else None


def test_places_equal_all_choices():
    r = random.Random(8)
    for _ in range(60):
        n = r.randrange(1, 4)
        spans = [sorted((s, s + r.randrange(6)) for s in r.sample(range(0, 40, 9), r.randrange(1, 3))) for _ in range(n)]
        ideals = [float(r.randrange(40)) for _ in range(n)]
        free = pd.DataFrame([(k, s, e) for k, sp in enumerate(spans) for s, e in sp], columns=["slot_id", "start", "end"])
        assert planning.place_in_order(pd.DataFrame({"slot_id": range(n), "ideal": ideals}), free, 7) == plain_places(ideals, spans, 7)


def plain_suppression(rows):
    """rows: (x, y, w, h, confidence)."""
    left = sorted(range(len(rows)), key=lambda i: (-rows[i][4], i))
    kept = []
    for i in left:
        x, y, w, h, _ = rows[i]
        for k in kept:
            a, b, c, d, _ = rows[k]
            both = max(0, min(x + w, a + c) - max(x, a)) * max(0, min(y + h, b + d) - max(y, b))
            if both > 0.35 * max(1, w * h + c * d - both) or both > 0.75 * max(1, w * h):
                break
        else:
            kept.append(i)
    return sorted(kept, key=lambda i: (rows[i][1], rows[i][0]))


def test_suppression_equals_a_plain_loop(spark):
    r = random.Random(71)
    rows = [(r.randrange(600), r.randrange(600), r.randrange(1, 120), r.randrange(1, 120), r.choice([0.3, 0.5, 0.9])) for _ in range(400)] + [(10, 10, 100, 100, 0.8), (20, 20, 30, 30, 0.7)]
    got = boxes.suppress(frame(spark, rows)).toPandas()
    assert set(got.idx) == set(plain_suppression(rows))
    assert boxes.suppress(frame(spark, [])).count() == 0


def test_seams(spark):
    pages = spark.createDataFrame([("c", 0, "a", 800, 1000), ("c", 1, "b", 800, 1000), ("c", 2, "d", 700, 900)], "chapter_id string, ord int, page_key string, width int, height int")
    rows = [("a", 0, 100, 950, 200, 50, 0.5), ("a", 1, 500, 400, 100, 50, 0.5), ("b", 0, 110, 0, 190, 40, 0.5), ("b", 1, 600, 3, 100, 40, 0.5), ("b", 2, 100, 960, 200, 40, 0.5), ("d", 0, 100, 0, 200, 90, 0.5)]
    got = boxes.seam_pairs(pages, spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.page_key, r.u_idx, r.l_idx, r.anchor_is_upper) for r in got] == [("a", 0, 0, True)]


def test_clusters_and_captions(spark):
    rows = [(0, 0, 10, 10), (8, 8, 10, 10), (16, 16, 10, 10), (100, 0, 5, 5), (0, 3000, 900, 9)]
    assert {r.idx: r.cluster for r in boxes.clusters(frame(spark, rows)).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    captions = spark.createDataFrame([("c", i, w, h) for i, (w, h) in enumerate([(200, 20), (204, 21), (198, 20), (400, 20), (402, 20)])], "chapter_id string, idx int, width int, height int")
    assert {r.idx for r in boxes.repeated_captions(captions).collect() if r.repeated_caption} == {0, 1, 2}


def test_slots_keep_their_gap(spark):
    slots = spark.createDataFrame([(i, "p", i, 10, 0, 900, 50, 100, 250.0 * i) for i in range(4)], "slot_id int, page_key string, ord int, x int, low int, high int, mark_width int, mark_height int, ideal double")
    placed = planning.balanced_slots(slots, frame(spark, [(0, 240, 200, 60)]), 30).orderBy("slot_id").toPandas()
    tops = list(placed.y)
    assert len(tops) == 4 and all(b - a >= 130 for a, b in zip(tops, tops[1:], strict=False)) and all(y + 100 + 16 <= 240 or y >= 300 + 16 for y in tops)
    assert planning.balanced_slots(slots, frame(spark, [(0, 0, 200, 1000)]), 30).count() == 0


@pytest.mark.parametrize("height", [500, 2000, 2001, 3700, 60000])
def test_tiles_cover(spark, height):
    from pyspark.sql import functions as F

    starts = spark.range(1).select(planning.tile_starts(F.lit(height), 2000, 300).alias("s")).first().s
    assert starts[0] == 0 and starts[-1] == max(0, height - 2000) and all(0 < b - a <= 1700 for a, b in zip(starts, starts[1:], strict=False))
    with pytest.raises(ValueError):
        planning.tile_starts(F.lit(1), 10, 10)


def test_cuts(spark):
    scores = spark.createDataFrame([("p", i, 1.0) for i in range(200)] + [("q", i, 1.0) for i in range(200)], "page_key string, row int, score double")
    targets = spark.createDataFrame([("p", 100), ("q", 100)], "page_key string, target int")
    avoid = spark.createDataFrame([("q", 95, 110)], "page_key string, top int, bottom int")
    cuts = {r.page_key: r.cut for r in planning.best_cuts(scores, targets, avoid, 40).collect()}
    assert cuts == {"p": 100, "q": 82}
    tall = spark.createDataFrame([("q", 55, 150), ("p", 90, 95)], "page_key string, top int, bottom int")
    assert {r.page_key: r.cut for r in planning.best_cuts(scores, targets, tall, 30).collect()} == {"q": 43, "p": 108}


def test_lines():
    assert planning.balanced_lines(["aaa", "bb", "cc", "ddddd"], [3, 2, 2, 5], 1, 6) == ["aaa bb", "cc", "ddddd"] or planning.balanced_lines(["aaa", "bb", "cc", "ddddd"], [3, 2, 2, 5], 1, 6) == ["aaa", "bb cc", "ddddd"]
    assert planning.balanced_lines([], [], 1, 5) == [] and planning.balanced_lines(["long"], [9], 1, 5) == ["long"]
    page = pd.DataFrame({"slot_id": [1], "ideal": [5.0]})
    assert planning.place_in_order(page, pd.DataFrame({"slot_id": [], "start": [], "end": []}), 3) is None


def test_joined_lines_in_crowds_equal_a_plain_loop(spark):
    import random

    from pagequire.operators.shapes import joined_lines

    r = random.Random(3)
    rows = [(p, float(r.randrange(60)), float(r.randrange(40 * n)), float(r.choice([0, 3, 9, 30])), float(r.choice([0, 2, 5])), r.random()) for p, n in enumerate([1, 2, 5]) for _ in range(12 * n)]
    got = sorted(tuple(x) for x in joined_lines(spark.createDataFrame(rows, "page int, x double, y double, width double, height double, confidence double"), "page").collect())
    want = []
    for p in range(3):
        a = [[x, y, x + w, y + h, c] for q, x, y, w, h, c in rows if q == p]
        while True:
            a.sort(key=lambda b: (b[1], b[0]))
            pair = next(((i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if max(0, min(a[i][2], a[j][2]) - max(a[i][0], a[j][0])) >= 0.25 * max(1, min(a[i][2] - a[i][0], a[j][2] - a[j][0])) and max(a[i][1], a[j][1]) - min(a[i][3], a[j][3]) <= 5), None)
            if not pair:
                break
            one, other = a.pop(pair[1]), a.pop(pair[0])
            a.append([min(one[0], other[0]), min(one[1], other[1]), max(one[2], other[2]), max(one[3], other[3]), max(one[4], other[4])])
        want += [(p, x0, y0, x1 - x0, y1 - y0, c) for x0, y0, x1, y1, c in a]
    assert got == sorted(want)


def test_captions_of_one_chapter_are_counted_by_size(spark):
    from pagequire.operators.boxes import repeated_captions

    sizes = [(100, 10)] * 2 + [(104, 11)] + [(120, 10)] * 2 + [(None, 10)] + [(104, 40)] * 3 + [(105, 10)]
    rows = [(1, i, w, h) for i, (w, h) in enumerate(sizes)]
    out = {x.idx: x.repeated_caption for x in repeated_captions(spark.createDataFrame(rows, "chapter_id int, idx int, width int, height int")).collect()}
    assert out == {i: i in (0, 1, 2, 6, 7, 8, 9) for i in range(10)}


def test_crowds_are_suppressed_like_single_pages(spark):
    import random

    from pagequire.operators.boxes import on_page, suppress, suppress_crowds

    r = random.Random(7)
    rows = [(p, i, r.randrange(120), r.randrange(120), r.choice([0, 10, 30]), r.choice([5, 25]), r.choice([0.1, 0.5, 0.5, r.random()])) for p, n in ((1, 150), (2, 5), (3, 1)) for i in range(n)]
    chain = [(4, i, i * 4, 0, 10, 10, 1 - i / 100) for i in range(30)]
    frame = spark.createDataFrame(rows + chain, "page_key int, idx int, x int, y int, width int, height int, confidence double")
    for inside in (0.75, 2.0):
        want = sorted((x.page_key, x.idx) for x in suppress(frame, 0.35, inside).collect())
        assert sorted((x.page_key, x.idx) for x in suppress_crowds(frame, 0.35, inside if inside < 1 else None, 32).collect()) == want
    assert suppress_crowds(frame.limit(0)).count() == 0
    moved = on_page(spark.createDataFrame([(1, 2, 10, None)], "x int, y int, left int, top int"), "left", "top").first()
    assert (moved.x, moved.y) == (11, 2)
