import random

import re

import numpy as np
import pyarrow as pa

from pagequire.llm.span_dedup import LEAST, REACH, dedup_spans, pieces
from pagequire.llm.text import word_hashes


def cut_plainly(text):
    """(start, end) in the text of each piece, and its words: one word after another."""
    words = [m.span() for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", text.encode())]
    raw = text.encode()
    h = word_hashes(pa.array([text]))[0].tolist()
    ends = [raw[b - 1 : b] in (b".", b"!", b"?") or (i + 1 < len(words) and b"\n" in raw[b : words[i + 1][0]]) for i, (_, b) in enumerate(words)]
    key = [(not e, x >> 1) for e, x in zip(ends, h, strict=True)]
    cuts = {i + 1 for i, e in enumerate(ends) if e}
    for i in range(len(words) - REACH + 1):
        least = min(key[i : i + REACH])
        cuts |= {j + 1 for j in range(i, i + REACH) if key[j] == least}
    at = sorted(cuts | {0, len(words)}) if words else []
    out = []
    for a, b in zip(at, at[1:], strict=False):
        out.append((0 if a == 0 else words[a][0], words[b][0] if b < len(words) else len(raw), tuple(raw[x:y].lower() for x, y in words[a:b])))
    return out


def brute_force(rows):
    """id to the pieces that go, by all runs of all texts."""
    places = {}
    cut = {d: cut_plainly(t) if t else [] for d, t in rows}
    for d, _ in rows:
        for i in range(len(cut[d])):
            for k in range(i + 1, len(cut[d]) + 1):
                run = sum((x[2] for x in cut[d][i:k]), ())
                if len(run) >= LEAST:
                    places.setdefault(run, set()).add((d, i, k))
    gone = {d: set() for d, _ in rows}
    for where in places.values():
        first = min(where)[:2]
        for d, i, k in where:
            if (d, i) != first:
                gone[d] |= set(range(i, k))
    return {d: sorted(g) for d, g in gone.items()}, cut


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(4))
    sentence = lambda: " ".join(word() for _ in range(r.randrange(1, 14))) + r.choice([". ", "! ", "?\n", "\n", ".\n\n"])
    passages = ["".join(sentence() for _ in range(r.randrange(5, 12))) for _ in range(6)] + [" ".join(word() for _ in range(55)) + ". "]
    rows = []
    for i in range(60):
        parts = [sentence() for _ in range(r.randrange(12))]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(len(parts) + 1), r.choice(passages).upper() if r.random() < 0.2 else r.choice(passages))
        rows.append((i, "".join(parts)))
    return [*rows, (60, None), (61, ""), (62, " \n "), (63, max(rows, key=lambda r: len(r[1]))[1]), (64, max(rows, key=lambda r: len(r[1]))[1]), (65, ". . . ! x")]


def test_removal_equals_brute_force(spark, table):
    rows = corpus(7)
    gone, cut = brute_force(rows)
    assert sum(map(len, gone.values())) > 50
    out = {r.doc_id: r for r in dedup_spans(table(rows)).collect()}
    texts = dict(rows)
    for d, r in out.items():
        assert (r.removed, r.n_removed, r.n_sentences) == (gone[d], len(gone[d]), len(cut[d]))
        if not gone[d]:
            assert r.text == texts[d] and r.first_ids is None
        elif len(gone[d]) == len(cut[d]):
            assert r.text == ""
        else:
            assert r.text.encode().split() == b"".join(texts[d].encode()[a:b] for i, (a, b, _) in enumerate(cut[d]) if i not in gone[d]).split()
    assert out[64].text == "" and 63 not in out[64].first_ids and out[64].first_ids
    assert out[1].node == 7 and out[1].copies == "c"


def test_pieces_equal_plain_ones():
    for t in ["x. y!\n\nz", "\n\n a b. c", "a", " ".join(f"w{i}" for i in range(500)), "one two.three four", "a b\r\nc", "same " * 40]:
        at = pieces(word_hashes(pa.array([t]), (-1,), lines=True)[0])
        assert np.diff(at).tolist() == [len(x[2]) for x in cut_plainly(t)]


def test_long_texts_without_marks_share_cuts(spark, table):
    r = random.Random(5)
    fresh = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    shared = fresh(300)
    rows = [(1, f"{fresh(200)} {shared} {fresh(150)}"), (2, f"{fresh(170)} {shared} {fresh(30000)}")]
    out = {x.doc_id: x for x in dedup_spans(table(rows)).collect()}
    assert out[1].n_removed == 0 and out[2].n_removed > 3 and 200 <= len(rows[1][1].split()) - len(out[2].text.split()) <= 300


def test_repeated_rows_and_empty_tables(spark, table):
    text = "one two three four five six. seven eight nine ten eleven. twelve thirteen fourteen fifteen sixteen. " * 3
    out = [(r.doc_id, r.text) for r in dedup_spans(table([(1, text), (1, text), (2, text), (None, text)])).collect()]
    assert sorted(out, key=str) == sorted([(1, text), (1, text), (2, ""), (None, text)], key=str)
    assert dedup_spans(table([(1, "x")]).limit(0)).count() == 0


def test_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a b", 1, 2, 3, 4), (2, None, 5, 6, 7, 8)], "doc_id long, text string, _id int, __PLACES int, N_removed int, ids int")
    out = dedup_spans(rows)
    assert out.columns == ["doc_id", "text", "_id", "__PLACES", "ids", "n_sentences", "n_removed", "removed", "first_ids"]
    assert {(r.doc_id, r._id, r.n_removed) for r in out.collect()} == {(1, 1, 0), (2, 5, 0)}
