import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(rows):
    def one(x):
        return "null" if x is None else f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


def own():
    from pagequire.plans import registry

    return registry


@pytest.mark.parametrize("name", sorted(own().ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got, want = own().QUERIES[name](spark, SF), con.sql(own().ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert shown(got.select(*order).collect()) == shown(want.select(*[f'"{c}"' for c in order]).fetchall())


def rows_of(spark, name, columns):
    return sorted(tuple(r[c] for c in columns) for r in own().QUERIES[name](spark, SF).collect())


def boxes_of(spark):
    from pagequire.plans.base import Tables

    pages = {}
    for r in Tables(spark, SF).boxes().collect():
        pages.setdefault(r.page_key, []).append(r)
    return pages


def met(a, b):
    return max(0, min(a.x + a.width, b.x + b.width) - max(a.x, b.x)) * max(0, min(a.y + a.height, b.y + b.height) - max(a.y, b.y))


def test_g1_equals_a_plain_loop(spark):
    want = []
    for page, found in boxes_of(spark).items():
        left = []
        for b in sorted(found, key=lambda r: (-r.confidence, r.idx)):
            if not any(met(a, b) > 0.35 * max(1, a.width * a.height + b.width * b.height - met(a, b)) or met(a, b) > 0.75 * max(1, b.width * b.height) for a in left):
                left.append(b)
        want += [(page, b.idx) for b in left]
    assert rows_of(spark, "g1_suppressed", ["page_key", "idx"]) == sorted(want)


def test_a7_equals_a_plain_loop(spark):
    chapters = {}
    for page, found in boxes_of(spark).items():
        chapters.setdefault(page // 10, []).extend((5 * b.width, b.height, b.idx, page) for b in found if b.confidence < 0.5 and 5 * b.width >= 4 * b.height)
    want, marked = [], 0
    for chapter, found in chapters.items():
        found.sort()
        while found:
            w, h = found[0][:2]
            group = [f for f in found if abs(f[0] - w) <= 0.05 * w and abs(f[1] - h) <= max(2, 0.1 * h)]
            want += [(chapter, f[3], f[2], len(group) >= 3) for f in group]
            marked += len(group) >= 3
            found = [f for f in found if f not in group]
    assert rows_of(spark, "a7_repeated_captions", ["chapter_id", "page_key", "idx", "repeated_caption"]) == sorted(want) and marked


def test_j7_and_j8_equal_a_plain_loop(spark):
    """Of the candidate pairs of two pages the best goes first, and each box goes once."""
    from pagequire.plans import layout
    from pagequire.plans.base import Tables

    left, want = {}, set()
    for r in layout.j6_seam_candidates(Tables(spark, SF)).collect():
        left.setdefault((r.page_key, r.next_key), []).append(r)
    got = {(r.page_key, r.u_idx, r.l_idx) for r in own().QUERIES["j7_seam_pairs"](spark, SF).collect()}
    for pairs in left.values():
        uppers, lowers = {r.u_idx for r in pairs}, {r.l_idx for r in pairs}
        here = {(r.page_key, r.u_idx, r.l_idx) for r in pairs} & got
        assert len({u for _, u, _ in here}) == len({d for _, _, d in here}) == len(here) <= min(len(uppers), len(lowers))
        assert all(any(u == r.u_idx or d == r.l_idx for _, u, d in here) for r in pairs)  # no pair is left whose halves are both free
        want |= here
    assert got == want
    halves = {u for _, u, _ in got} | {d for _, _, d in got}
    every = {(p, b.idx) for p, found in boxes_of(spark).items() for b in found}
    assert set(rows_of(spark, "j8_left_after_pairs", ["page_key", "idx"])) == {x for x in every if x[1] not in halves}


def test_o3_numbers_every_box_once(spark):
    got = {}
    for r in own().QUERIES["o3_right_to_left"](spark, SF).collect():
        got.setdefault(r.page_key, []).append((r.number, r.idx))
    for page, found in boxes_of(spark).items():
        assert sorted(n for n, _ in got[page]) == list(range(1, len(found) + 1)) and {i for _, i in got[page]} == {b.idx for b in found}


def test_g10_equals_a_plain_search(spark):
    rows = {}
    for r in sorted(spark.read.parquet(f"{SF}/orders.parquet").collect(), key=lambda r: r.o_orderkey):
        rows.setdefault(r.o_custkey, []).append(float(r.o_totalprice) / 1000)
    got = {r.page_key: r.cut for r in own().QUERIES["g10_best_cuts"](spark, SF).collect()}
    assert set(got) == set(rows)
    for page, scores in rows.items():
        low, high, top, bottom = 4 - 2, min(len(scores) - 1, 8), page % 6 - 1, page % 6 + 2
        free = [(scores[r] + 2.0 * abs(r - 5) / 3, r) for r in range(low, high + 1) if not top <= r <= bottom] if high > low else []
        if free:
            assert got[page] == min(free)[1]


def test_g12_equals_all_breaks(spark):
    import itertools

    texts = {r.item_id: (r.text or "").split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for r in own().QUERIES["g12_wrapped_lines"](spark, SF).collect():
        words = texts[r.item_id]
        assert " ".join(r.lines).split() == words
        if len(words) <= 14:
            best = None
            for cuts in itertools.product((0, 1), repeat=max(0, len(words) - 1)):
                lines = [[w] for w in words[:1]]
                for w, cut in zip(words[1:], cuts, strict=True):
                    lines.append([w]) if cut else lines[-1].append(w)
                sizes = [len(" ".join(x)) for x in lines]
                if all(n <= 40 or len(x) == 1 for n, x in zip(sizes, lines, strict=True)):
                    cost = (len(lines), sum(max(0, 40 - n) ** 2 for n in sizes))
                    best = min(best, cost) if best else cost
            assert not words or (len(r.lines), sum(max(0, 40 - len(x)) ** 2 for x in r.lines)) == best


def test_g11_places_keep_clear(spark):
    from pagequire.plans.base import Tables
    from pagequire.plans.layout import _slots

    slots, pages = {s.slot_id: s for s in _slots(Tables(spark, SF)).collect()}, boxes_of(spark)
    got = {r.slot_id: r.y for r in own().QUERIES["g11_balanced_slots"](spark, SF).collect()}
    for k, s in slots.items():
        near = [b for b in pages[s.page_key] if s.x + 56 > b.x and s.x < b.x + b.width + 16]
        free = [y for y in range(1941) if not any(b.y - 76 < y < b.y + b.height + 16 for b in near)]
        assert (got[k] == min(free, key=lambda y: (abs(y - 970), y))) if free else k not in got


def test_j12_reference_terms_equal_a_plain_loop(spark):
    terms = [(r.p_partkey, r.p_name) for r in spark.read.parquet(f"{SF}/part.parquet").orderBy("p_partkey").collect()]
    texts = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        texts.setdefault(r.conv_id, []).append(r.text or "")
    want = []
    for k, some in texts.items():
        if k % 3 == 0:
            whole = "\n".join(some).casefold()
            want += [(k, n) for n, name in terms if name.casefold() not in whole][:40]
    assert rows_of(spark, "j12_reference_terms", ["batch", "ord"]) == sorted(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())
