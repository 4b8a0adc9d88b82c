import random

import pytest

from pagequire.operators import script, strips


@pytest.fixture(scope="module")
def pairs():
    r = random.Random(6)
    rows = [(0, p, i, r.choice(["", "s" * r.randint(1, 9), "á", None]), r.choice(["t", "tt" * r.randint(1, 5), "", None])) for p in r.sample(range(60), 40) for i in range(r.randint(1, 3))]
    rows += [(c, p, 0, f"{c}{p}", "x") for c in (1, 2) for p in range(3)]
    return rows + [(3, p, 0, None, None) for p in (0, 1)]


@pytest.mark.parametrize("span", [4, 1024])
@pytest.mark.parametrize("most", [1, 5])
def test_recent_contexts_equal_a_plain_loop(spark, pairs, span, most):
    frame = spark.createDataFrame(pairs, "g int, p int, ord int, source string, target string")
    got = {(r.g, r.p): r.context for r in strips.recent_contexts(frame, "g", "p", ["ord"], most, 30, span).collect()}
    want = {}
    for g, p in {(g, p) for g, p, *_ in pairs}:
        lines = [f"{s} → {t}" for h, q, _, s, t in sorted(pairs, key=lambda x: x[:3]) if h == g and q < p and s and t]
        want[g, p] = "\n".join(lines[-most:])[-30:]
    assert got == want


@pytest.mark.parametrize("span", [4, 1024])
def test_rolling_context_equals_a_plain_loop(spark, pairs, span):
    frame = spark.createDataFrame(pairs, "c int, p int, ord int, source string, target string")
    for most in (7, 40):
        got = {(r.c, r.p): r.context for r in script.rolling_context(frame, "c", "p", most, span).collect()}
        want = {}
        for c, p in {(c, p) for c, p, *_ in pairs}:
            own = {}
            for d, q, _, s, t in sorted(pairs, key=lambda x: x[:3]):
                if d == c and q < p and s is not None and t is not None:
                    own.setdefault(q, []).append(f"{s} → {t}")
            want[c, p] = "\n".join("\n".join(x)[-most:] for _, x in sorted(own.items()))[-most:]
        assert got == want


def test_hot_chapter_is_split(spark):
    """A chapter of all rows: no window holds more than a range of it."""
    rows = spark.range(3000).selectExpr("1 as c", "id as p", "0 as ord", "'s' as source", "'t' as target")
    whole = "\n".join(["s → t"] * 4)
    out = {r.p: r.context for r in script.rolling_context(rows, "c", "p", 14, 64).collect()}
    assert out == {p: "\n".join(["s → t"] * min(p, 4))[-14:] for p in range(3000)} and out[9] == whole[-14:]
    assert strips.recent_contexts(rows, "c", "p", ["ord"], 2, 99, 64).filter("context = 's → t\ns → t'").count() == 2998


def test_reference_terms_by_ranges(spark):
    terms = spark.createDataFrame([(i, f"n{i}" if i % 7 else "漢") for i in range(300)], "ord int, source string")
    texts = spark.createDataFrame([(1, "漢 n1 n2 n3"), (2, "plain"), (3, None)], "batch int, text string")
    found = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "batch int, ord int")
    for span in (16, 4096):
        got = sorted((r.batch, r.ord) for r in script.reference_terms(terms, texts, "batch", "text", found, "ord", span).collect())
        assert got == [(1, i) for i in [i for i in range(4, 300) if i % 7][:40]]
