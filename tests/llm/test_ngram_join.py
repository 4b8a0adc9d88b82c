import random

import pytest

from pagequire.llm import ngram_join
from pagequire.llm.components import components
from pagequire.llm.ngram_join import jaccard_classes


def brute_force(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def copies(seed):
    """Copies around the bound of a base and of a copy of it, common passages, prefixes, repeated words and odd texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]

    def noise(words, n):
        words = words[:]
        for _ in range(n):
            i, c = r.randrange(len(words)), r.random()
            if c < 0.7:
                words[i] = r.choice(vocabulary)
            elif c < 0.85:
                words.insert(i, r.choice(vocabulary))
            else:
                del words[i]
        return words

    fresh = lambda n: [r.choice(vocabulary) for _ in range(n)]
    base = fresh(100)
    sub = noise(base, 4)
    texts = [" ".join(noise(base, r.randrange(6))) for _ in range(60)] + [" ".join(noise(sub, r.randrange(5))) for _ in range(25)]
    texts += [" ".join(fresh(25) + base[20:60] + fresh(r.randrange(30))) for _ in range(20)] + [" ".join(base[r.randrange(8) : r.randrange(80, 100)]) for _ in range(25)]
    texts += [" ".join(r.choice(["the the the the the", "a a a a a a a", "A b a b a", ""]) for _ in range(r.randrange(1, 5))) for _ in range(20)]
    texts += [None, "", "  ", "x", "X", "x y", "\n"]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("small", [3, 16])
def test_classes_equal_brute_force(spark, table, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rows = copies(small)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(table(rows)).collect()}
    assert got == brute_force(rows)


def test_repeated_ids_long_texts_and_empty_tables(spark, table):
    long = " ".join(f"v{i}" for i in range(50000))
    out = jaccard_classes(table([(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words stand in this one"), (2, "a b c d e f g"), (5, long), (4, long + " end"), (9, None), (None, long + " final end"), (None, "on its own")])).collect()
    assert len(out) == 9 and {(r.doc_id, r.component_id) for r in out} == {(1, 1), (2, 1), (4, 4), (5, 4), (9, 9), (None, 4), (None, None)}
    assert jaccard_classes(table([(1, "x")]).limit(0)).count() == 0
    assert {(r.doc_id, r.component_id) for r in jaccard_classes(table([(3, "")])).collect()} == {(3, 3)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 80), (None, 3), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 80, 90: 80, 80: 80, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_copies(n, seed=5):
    r = random.Random(seed)
    base = [f"w{r.randrange(3000)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = base[:]
        for _ in range(r.randrange(1, 4)):
            words[r.randrange(120)] = f"z{r.randrange(100000)}"
        rows.append((i, " ".join(words)))
    return rows


def test_one_large_group_of_near_copies(spark, table, monkeypatch):
    """The classes are right, and the pairs that are compared grow with the rows, not with their pairs."""
    compared = []
    compare = ngram_join.Join.compare
    monkeypatch.setattr(ngram_join.Join, "compare", lambda self, pairs, led: compared.append(pairs.distinct().count()) or compare(self, pairs, led))
    rows = near_copies(1000)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(table(rows)).collect()}
    assert got == brute_force(rows)
    assert jaccard_classes(table(near_copies(3000))).count() == 3000
    assert compared[0] < 5 * 1000 and compared[1] < 4 * compared[0]
