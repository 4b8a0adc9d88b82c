import random

import pytest

from pyspark.sql import functions as F

from pagequire.operators.slots import Layout, chapter_slots, choices, pitched

PAGES = "chapter_id string, ord long, page_key string, width long, height long, mark_width long, mark_height long"
BOXES = "page_key string, idx long, x long, y long, width long, height long"


def plain(pages, boxes, layout, manual=()):
    """The chapter's marks by a plain loop over single rows of pixels."""
    out, by_page = set(), {}
    for p, _, *b in boxes:
        by_page.setdefault(p, []).append(b)
    hand = {}
    for p, x, y in manual:
        hand.setdefault(p, []).append((x, y))
    for chapter in {p[0] for p in pages}:
        rows, total = [], 0
        for _, _, key, w, h, mw, mh in sorted((p for p in pages if p[0] == chapter), key=lambda p: p[1]):
            if w > 0 and h > 0:
                if mw is not None and mw <= w and mh <= h:
                    rows.append((key, total, w, h, mw, mh))
                total += h
        if not rows:
            continue
        most, gap = max(r[5] for r in rows), layout.gap
        step, margin = most + gap, min(layout.margin_y, max(0, (total - most) // 2))
        every = (max(layout.interval, step) if layout.interval else max(1600, max(r[2] for r in rows) * 2.5, most * 8, step))
        wanted = layout.count if layout.count is not None else max(1, min(layout.limit, round(total / every)))
        usable = max(0, total - 2 * margin - most)
        count = min(wanted, 1 + usable // step)
        pitch = max(step, min(total / count, usable / (count - 1))) if count > 1 else total
        first, drift, floor, marks = (total - most - (count - 1) * pitch) / 2, pitch * 0.25, 0, []
        for i in range(count):
            ideal = first + i * pitch + max(-drift, min(layout.offset_y, drift))
            for side in layout.sides() if layout.distribution == "adaptive" else [layout.sides()[i % len(layout.sides())]]:
                some = []
                for key, above, w, h, mw, mh in rows:
                    x = layout.margin_x if side == "left" else w - mw - layout.margin_x if side == "right" else (w - mw) // 2
                    x, pad = max(0, min(x + layout.offset_x, w - mw)), max(16, min(mw, mh) // 4)
                    free = []
                    for y in range(max(above, floor, round(ideal - drift)), min(above + h - mh, total - margin - mh, round(ideal + drift)) + 1):
                        if y >= margin and not any(bw > 0 and bh > 0 and x + mw + pad > bx and x < bx + bw + pad and by - mh - pad < y - above < by + bh + pad for bx, by, bw, bh in by_page.get(key, [])):
                            free.append(y)
                    for y in free:  # of a run of free rows the one nearest to the rounded place
                        if y == round(ideal) or (y + 1 not in free and y < round(ideal)) or (y - 1 not in free and y > round(ideal)):
                            some.append((abs(y - ideal), y, x, key, above, mh))
                if some:
                    break
            if some:
                _, y, x, key, above, mh = min(some)
                floor = y + step
                marks.append((key, x, y - above, y, mh))
        fixed, mine = [], set()
        for key, above, w, h, mw, mh in rows:
            some = hand.get(key, [])
            bad = any(not (0 <= x <= w - mw and 0 <= y <= h - mh) for x, y in some) or any(abs(a[0] - b[0]) < mw and abs(a[1] - b[1]) < mh for i, a in enumerate(some) for b in some[:i])
            if some and not bad:
                mine.add(key)
                out |= {(chapter, key, x, y) for x, y in some}
                fixed += [(above + y, above + y + mh) for x, y in some]
        out |= {(chapter, key, x, y) for key, x, y, at, mh in marks if key not in mine and all(at + mh + gap <= a or at >= b + gap for a, b in fixed)}
    return out


def run(spark, pages, boxes, layout, manual=None, **more):
    hand = None if manual is None else spark.createDataFrame(manual, "page_key string, x long, y long")
    rows = chapter_slots(spark.createDataFrame(pages, PAGES), spark.createDataFrame(boxes, BOXES), layout, hand, **more).collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {(r.chapter_id, r.page_key, r.x, r.y) for r in rows}


@pytest.mark.parametrize("seed, distribution", [(1, "column"), (2, "alternating"), (5, "adaptive")])
def test_places_equal_a_plain_loop(spark, seed, distribution):
    r = random.Random(seed)
    pages = [(c, i, f"{c}{i}", r.choice([300, 400, 0]) if c == "b" else 300, r.choice([90, 200, 700, 1500]), *(r.choice([(60, 40), (60, 40), (None, None), (350, 40)]) if c == "b" else (60, 40))) for c in "ab" for i in range(9)]
    boxes = [(f"{r.choice('ab')}{r.randrange(9)}", k, r.randrange(300), r.randrange(1200), r.choice([0, 30, 120, 300]), r.choice([20, 200])) for k in range(40)]
    layout = Layout(distribution=distribution, gap=r.choice([50, 150]), count=r.choice([None, 30, 12]), interval=r.choice([0, 250]), limit=40, margin_x=r.choice([0, 20]), margin_y=r.choice([0, 35]), offset_y=r.choice([0, 45, -400]), side=r.choice(["left", "right"]))
    manual = [(f"a{r.randrange(9)}", r.randrange(-5, 240), r.randrange(60)) for _ in range(3)]
    assert run(spark, pages, boxes, layout, cell=256, span=4) == plain(pages, boxes, layout)
    assert run(spark, pages, boxes, layout, manual) == plain(pages, boxes, layout, manual)


def test_three_files_are_placed_like_one(spark):
    layout, boxes = Layout(count=6, gap=400), [("p1", 0, 600, 300, 200, 500)]
    three = run(spark, [("c", i, f"p{i}", 800, 1000, 80, 50) for i in range(3)], boxes, layout)
    one = run(spark, [("c", 0, "p", 800, 3000, 80, 50)], [("p", 0, 600, 1300, 200, 500)], layout)
    assert {(x, int(k[1]) * 1000 + y) for _, k, x, y in three} == {(x, y) for _, _, x, y in one} and len(one) >= 5
    tops = sorted(int(k[1]) * 1000 + y for _, k, _, y in three)
    assert all(b - a - 50 >= 400 for a, b in zip(tops, tops[1:], strict=False))


def test_crowded_marks_carry_their_floor_over_ranges(spark):
    """Marks as close as they may be: each range depends on the one before."""
    pages = [("c", i, f"p{i}", 200, 500, 40, 40) for i in range(12)]
    boxes = [(f"p{i}", 0, 150, 200 + 7 * i, 50, 60) for i in range(12)]
    layout = Layout(count=100, gap=60)
    got = run(spark, pages, boxes, layout, span=2)
    assert got == plain(pages, boxes, layout) and len(got) > 20


def test_nothing_to_place(spark):
    empty = spark.createDataFrame([], BOXES)
    assert run(spark, [("c", 0, "p", 10, 10, 40, 40), ("d", 0, "q", 100, 100, None, None)], [], Layout()) == set()
    assert chapter_slots(spark.createDataFrame([], PAGES), empty).count() == 0


def long_chapter(spark, count):
    return spark.createDataFrame([("c", count, 100, 100.0, 0.0, 25.0)], "chapter_id string, count long, step long, pitch double, first double, drift double")


def test_marks_of_one_chapter_meet_open_places_by_a_shuffle(spark):
    """A few chapters have millions of marks: these are neither broadcast nor made in one task."""
    ranges = spark.range(50).selectExpr("'c' AS chapter_id", "'right' AS side", "id AS page_key", "0L AS x", "id * 400 AS above", "id * 400 + 20 AS low", "id * 400 + 399 AS high")
    found = choices(long_chapter(spark, 200), ranges, Layout(), 256)
    assert len(found.collect()) == 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_marks_of_one_chapter_are_made_in_several_tasks(spark):
    marks = pitched(long_chapter(spark, 4000), span=64)
    tasks = marks.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sorted(r.i for r in marks.select("i").collect()) == list(range(4000))
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 2500
    assert [r.i for r in pitched(long_chapter(spark, 1), span=64).collect()] == [0]


def test_pages_without_a_place_in_the_chapter_take_no_room(spark):
    """A page without a chapter or order counts neither for the pitch nor for places."""
    pages, layout = [("c", i, f"p{i}", 300, 900, 60, 40) for i in range(4)], Layout(gap=50, interval=250)
    odd = [("c", None, "n", 300, 5000, 60, 400), (None, 7, "m", 300, 900, 60, 40), ("d", 0, "q", 300, 900, None, None)]
    assert run(spark, pages + odd, [], layout) == plain(pages, [], layout)
