import os

import pytest

from pagequire.operators import strips
from pagequire.plans import layout
from pagequire.plans.base import Tables

SF = "/root/testdata/sf0.001"


def test_ranges_meet_pages_by_cells(spark):
    placed = [(c, k, k * 37 - 200, k % 9 * 40) for c in ("a", "b") for k in range(300)]
    ranges = [(c, n, n * 53 - 300, n * 53 - 300 + n % 7 * 150) for c in ("a", "b", "c") for n in range(200)]
    joined = strips.intersecting(spark.createDataFrame(placed, "chapter_id string, page_key long, y long, height long"), spark.createDataFrame(ranges, "chapter_id string, range_id long, top long, bottom long"), cell=100)
    got = [(r.chapter_id, r.range_id, r.page_key) for r in joined.collect()]
    want = [(c, n, k) for c, n, top, bottom in ranges for d, k, y, h in placed if c == d and y < bottom and y + h > top and bottom > top]
    assert sorted(got) == sorted(want) and len(want) > 1000
    assert "__cell" in joined._jdf.queryExecution().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole_tables_take_part(spark):
    t = Tables(spark, SF)
    placed, docs = strips.offsets(t.strip_pages()).collect(), t.documents.collect()
    size = {}
    for p in placed:
        size[p.chapter_id] = max(size.get(p.chapter_id, 0), p.y + p.height)
    want = [(d.doc_id, p.page_key) for d in docs for top in [d.doc_id * 7919 % max(1, size[d.source])] for p in placed if p.chapter_id == d.source and p.y < top + 800 and p.y + p.height > top]
    assert sorted(tuple(r) for r in layout.QUERIES["j16_intersecting"](spark, SF).collect()) == sorted(want)
    free, every, slots = layout.QUERIES["j24_free_rows"](spark, SF).collect(), t.boxes().collect(), {s.slot_id: s for s in layout._slots(t).collect()}
    got = {(r.slot_id, y) for r in free for y in range(r.start, r.end + 1)}
    want = set()
    for s in slots.values():
        near = [b for b in every if b.page_key == s.page_key and s.x + 56 > b.x and s.x < b.x + b.width + 16]
        want |= {(s.slot_id, y) for y in range(1941) if not any(b.y - 76 < y < b.y + b.height + 16 for b in near)}
    assert got == want
