import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from pagequire.llm import queries, spelling
from pagequire.llm.spelling import Automaton, near_words, pieces, roots, spelling_groups


def near(a, b):
    """Whether exactly one code point is put in, left out or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs, least_length=5, least_count=3):
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{d}:{run}".encode()) if d is not None else 1
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, some in around.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return out


def got(frame):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", range(4))
def test_automaton_numbers_words_and_finds_near_ones(seed):
    r = random.Random(seed)
    words = sorted({"".join(r.choices("abé", k=r.randint(5, 8))) for _ in range(300)})
    automaton = Automaton(words)
    for i, w in enumerate(words):
        state, number = automaton.walk(w)
        assert automaton.final[state] and number == i
    # minimal: no two states have the same words behind them
    tails = {}
    def behind(state):
        if state not in tails:
            tails[state] = frozenset(([""] if automaton.final[state] else []) + [c + x for c, (t, _) in automaton.edges[state].items() for x in behind(t)])
        return tails[state]
    behind(0)
    assert len(set(tails.values())) == len(tails) == len(automaton.edges)
    for w in words[:60]:
        half, rest = w[: len(w) // 2], w[len(w) // 2 :]
        assert {words[i] for i in automaton.near(half, rest)} == {v for v in words if v.startswith(half) and near(w, v)}


def test_automaton_of_no_and_of_odd_words():
    assert Automaton([]).near("a", "b") == set()
    assert Automaton([""]).walk("") == (0, 0)


@pytest.mark.parametrize("shard", [1 << 13, 7])
def test_groups_equal_brute_force(spark, table, shard):
    r = random.Random(8)
    words = ["".join(r.choices("abcdé", k=r.randint(4, 8))) for _ in range(120)]
    words += [w[:i] + x + w[j:] for w in words[:60] for i, j, x in [(3, 3, "e"), (2, 3, ""), (0, 1, "É"), (4, 5, "a")]] + ["prefix" + x for x in ("a", "b", "ab", "bb", "abc", "aab", "aa", "bbb", "")]
    weights = [1 / (i % 40 + 1) for i in range(len(words))]
    docs = [(i, " ".join(r.choices(words, weights, k=80)) + r.choice(["", ".", "×÷ 12x", "ÀB"])) for i in range(60)]
    docs += [(100, None), (101, ""), (None, " ".join(words[:30])), (102, "…" + words[0].upper() + "ß" * 3)] + [(103, "copied copied Copied COPIEDs copyed copyed copyed")] * 4
    assert got(spelling_groups(table(docs), shard=shard)) == brute(docs)


def test_query_and_long_texts(spark, table, folder, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "WORDS", 5)
    docs = [(1, "spelling spelllng spelling spelling, " * 400), (2, "speling " * 200 + "x" * 3000), (3, "naïveté" * 3 + " " + "naïveté " * 9 + "naïvetê " * 3)]
    assert got(queries.op13_spelling(spark, folder(documents=table(docs)))) == brute(docs)
    assert queries.op13_spelling(spark, folder(documents=table([(1, "a b c")]))).count() == 0
    assert queries.op13_spelling(spark, folder(documents=table([]))).count() == 0


def test_pieces_cut_no_run(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 3)
    for text in ("".join(x) for x in itertools.product("aé ×日", repeat=6)):
        raw = text.encode()
        assert b"".join(pieces(raw)) == raw
        assert [w for p in pieces(raw) for w in spelling.RUN.findall(p)] == spelling.RUN.findall(raw)


def test_long_chains_of_forms(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(33)]
    frame = spark.createDataFrame([*chain, ("v", "w05")], "word string, form string")
    assert {tuple(r) for r in roots(frame).collect()} == {(a, "w33") for a, _ in chain} | {("v", "w33")}


def test_a_half_that_most_words_share_is_split(spark):
    words = [(f"commonprefix{a}{b}{c}", ord(a) + ord(b)) for a in "abcd" for b in "abcd" for c in "abc"]
    frame = spark.createDataFrame(words, "word string, n long")
    for shard in (5, 10**4):
        out = {r.word: (r.n_near, r.best_n, r.best) for r in near_words(frame, shard).collect()}
        n = dict(words)
        want = {w: [v for v in n if near(w, v)] for w in n}
        assert out == {w: (len(v), n[b], b) for w, v in want.items() for b in [min(v, key=lambda x: (-n[x], x))]}
