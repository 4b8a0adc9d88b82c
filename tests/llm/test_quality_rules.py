import random
from collections import Counter

import numpy as np

from pagequire.llm import quality_rules
from pagequire.llm.quality_rules import measure, quality_rules as rules


def plain(text, n):
    words = (text or "").encode().split()
    grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    inside = {j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
    chars = [len(w.decode()) for w in words]
    top = max((c * sum(len(w.decode()) for w in g) for g, c in grams.items() if c > 1), default=0)
    return len(inside), sum(chars[j] for j in inside), top


def test_measures_equal_brute_force(monkeypatch):
    r = random.Random(3)
    texts = ["", "  ", "a", "a a a a a a", "é é é x é é é x", "a b c\na b c\n\nd", "x" * 50]
    texts += [" ".join(r.choice("ab c# de é f".split()) + r.choice(["", "\n", "\t"]) for _ in range(r.randrange(120))) for _ in range(60)]
    for chunk in (1 << 20, 40):
        monkeypatch.setattr(quality_rules, "CHUNK_WORDS", chunk)
        m = measure([None, *[t.encode() for t in texts]], (2, 3, 4, 5, 7, 10))
        for i, t in enumerate([None, *texts]):
            for n in (2, 3, 4, 5, 7, 10):
                assert (m[f"covered_words_{n}"][i], m[f"covered_chars_{n}"][i], m[f"top_chars_{n}"][i]) == plain(t, n)
            words = (t or "").encode().split()
            lines = [x for x in (t or "").split("\n") if x.encode().split()]
            assert m["n_words"][i] == len(words) and m["word_chars"][i] == sum(len(w.decode()) for w in words)
            assert m["n_dup_lines"][i] == len(lines) - len(set(lines)) and m["n_symbols"][i] == sum((t or "").count(c) for c in "#*$%&|<>")


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(quality_rules, "mix64", lambda x: np.zeros(len(x), np.uint64))
    text = "a b c d e f a b c x y z"
    m = measure([text.encode(), b"p q r s"], (3,))
    assert (m["covered_words_3"][0], m["covered_chars_3"][0], m["top_chars_3"][0]) == plain(text, 3) and m["covered_words_3"][1] == 0


def test_verdicts(spark, table):
    r = random.Random(1)
    fresh = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    line = fresh(12)
    docs = table([(1, fresh(200)), (2, None), (3, ""), (4, fresh(49)), (5, "same words again " * 40), (6, "\n".join([fresh(100), *[line] * 8])), (7, " ".join(w + "###" for w in fresh(100).split())), (8, fresh(60000)), (9, "x"), (9, "x")])
    out = {row.doc_id: row for row in rules(docs).collect()}
    assert {k for k, v in out.items() if v.kept} == {1, 8}
    assert {k for k, v in out.items() if v.base_failed} == {2, 3, 4, 5, 9} and out[8].n_words == 60000
    assert out[6].n_dup_lines == 7 and not out[6].base_failed and rules(docs).count() == 10
    assert rules(docs.limit(0)).count() == 0
