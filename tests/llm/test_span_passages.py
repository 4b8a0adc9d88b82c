import random

import numpy as np
import pyarrow as pa

from pagequire.llm.span_dedup import LEAST, REACH, SPAN, dedup_spans, pieces, runs
from pagequire.llm.text import word_hashes


def test_passages_of_short_lines_go(spark, table):
    """15 lines of 4 words, and 60 of one word: no 3 lines have 15 words."""
    for lines, each in ((15, 4), (60, 1)):
        passage = "".join(" ".join(f"w{i}x{k}" for k in range(each)) + "\n" for i in range(lines))
        rows = [(1, f"head one\n{passage}tail one\n"), (2, f"other head\n{passage}other tail\n")]
        out = {r.doc_id: r for r in dedup_spans(table(rows)).collect()}
        assert out[1].text == rows[0][1] and out[2].text == "other head\nother tail\n" and out[2].removed == list(range(1, lines + 1))


def hashes(*words):
    return word_hashes(pa.array([" ".join(words)]), (-1,), lines=True)[0]


def test_runs_cover_all_repeated_runs():
    r = random.Random(3)
    for _ in range(200):
        words = hashes(*marked(r, fresh(r, r.randrange(40, 200))))
        at, got = pieces(words), runs(words)[1]
        lo, hi = got // SPAN, got // SPAN + got % SPAN
        assert at[0] == 0 and at[-1] == len(words) and (np.diff(at) > 0).all() and (np.diff(at) <= REACH).all()
        for _ in range(5):
            a = r.randrange(len(at) - 1)
            b = r.randrange(a, len(at) - 1) + 1
            if at[b] - at[a] >= LEAST:
                assert {s for x, y in zip(lo, hi, strict=True) if a <= x and y <= b for s in range(x, y)} == set(range(a, b))


def fresh(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def marked(r, words):
    """Words with marks behind some of them, so that sentences have any length."""
    return [w + r.choice([".", "!\n", ",", "", "", ""]) for w in words]


def test_passages_planted_inside_sentences_and_lines_go(spark, table):
    """25* + 30 + 20* words, 55 words without marks on a line of their own and inside a long line, and any others of 51
    to 75: all but REACH - 1 words at the head and as many at the tail go at least, and no word outside."""
    r = random.Random(11)
    edges = fresh(r, 75)
    edges[24] += "."
    edges[54] += "."
    bare = fresh(r, 55)
    planted = [(edges, " "), (bare, "\n"), *((marked(r, fresh(r, r.randrange(51, 76))), " ") for _ in range(40))]
    rows = []
    for i, (passage, gap) in enumerate(planted):
        rows.append((2 * i, " ".join(fresh(r, 9)) + gap + " ".join(passage) + gap + " ".join(fresh(r, 9))))
        rows.append((2 * i + 1, " ".join(fresh(r, 40)) + " " + " ".join(passage) + " " + " ".join(fresh(r, 30))))
    out = {x.doc_id: x for x in dedup_spans(table(rows)).collect()}
    for i, (passage, _) in enumerate(planted):
        assert out[2 * i].text == rows[2 * i][1] and out[2 * i].n_removed == 0
        before, after = rows[2 * i + 1][1].split(), out[2 * i + 1].text.split()
        assert len(passage) - 2 * (REACH - 1) <= len(before) - len(after) <= len(passage) and out[2 * i + 1].first_ids == [2 * i]
        assert after[:40] == before[:40] and after[-30:] == before[-30:]


def test_every_stretch_of_51_words_has_a_run_anywhere():
    r = random.Random(2)
    for n in (51, 52, 80):
        for _ in range(30):
            shared = fresh(r, n) if r.random() < 0.5 else marked(r, fresh(r, n))
            h = [set(runs(hashes(*fresh(r, a), *shared, *fresh(r, b)))[0].tolist()) for a, b in ((0, 0), (7, 90), (300, 1), (50, 50))]
            assert h[0] & h[1] & h[2] & h[3]


def test_what_stays_keeps_its_line_ends(spark, table):
    r = random.Random(4)
    shared = " ".join(fresh(r, 60))
    rows = [(1, shared), (2, f"keep this {shared}\nnext line"), (3, "same " * 400), (4, None)]
    out = {x.doc_id: x for x in dedup_spans(table(rows)).collect()}
    assert out[2].text.startswith("keep this ") and out[2].text.endswith("\nnext line") and 0 < out[2].n_removed < out[2].n_sentences
    assert set(out[3].text.split()) == {"same"} and out[4].text is None


def test_rows_that_share_an_id_may_differ_in_length(spark, table):
    r = random.Random(6)
    shared = " ".join(fresh(r, 90))
    rows = [(1, shared), (2, " ".join(fresh(r, 70)) + " " + shared), (2, "short text")]
    out = {(x.doc_id, len(x.text)): x for x in dedup_spans(table(rows)).collect()}
    assert (2, len("short text")) in out and len(out) == 3
