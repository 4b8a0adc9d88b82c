import os

import numpy as np
import pytest

from pagequire.llm import pieces
from pagequire.llm.pieces import MARK, Encoder, Model, backward_search, decode_ids, encode_texts, load_model
from pagequire.llm.queries import PIECES

pytestmark = pytest.mark.skipif(not os.path.exists(PIECES), reason="no tokenizer files")
TEXTS = ["hello wo", "a\nb", "aaaaaa", "th ☃ é", "  x  y", " ", "ciónar", "\n\t", "the the th", "𓀀a", "", "aa"]


def every_segmentation(model: Model, text: str) -> list[tuple[float, list[int]]]:
    s, out = MARK + text.replace(" ", MARK), []

    def go(i, score, ids):
        if i == len(s):
            out.append((score, ids))
            return
        single = False
        for j in range(i + 1, min(len(s), i + 16) + 1):
            if p := model.pieces.get(s[i:j]):
                single |= j == i + 1
                go(j, score + p[1], [*ids, p[0]])
        if not single:
            go(i + 1, score + model.unknown, ids + [model.first_byte + b for b in s[i].encode()])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def changed(ids, changes, rank):
    out = list(ids)
    for r, at, removed, put in sorted(changes, key=lambda c: -c[1]):
        if r == rank:
            out[at : at + removed] = put
    return out


@pytest.mark.parametrize("together", [24, 3, 0])
def test_nbest_equals_brute_force(monkeypatch, together):
    monkeypatch.setattr(pieces, "TOGETHER", together)
    model = load_model(PIECES)
    encoder = Encoder(model, 4)
    for t in TEXTS:
        every = every_segmentation(model, t) if t else []
        ids, counts, scores, changes = encoder.encode([t])
        assert scores[0] == [x[0] for x in every[:4]]
        score_of = {tuple(x[1]): x[0] for x in every}
        got = [tuple(changed(ids.tolist(), changes[0], r)) for r in range(len(scores[0]))]
        assert [score_of[g] for g in got] == scores[0] and len(set(got)) == len(got)
    ids, counts, _, _ = encoder.encode(TEXTS)
    assert [x.decode() for x in encoder.decode(ids, counts)] == TEXTS


def test_search_leaves_paths_in_order():
    into = [[], [(0, -1.0, "a"), (0, -2.0, "b")], [(1, -1.0, "c"), (0, -3.5, "d")]]
    assert [(s, [e[2] for e in p]) for s, p in backward_search(into, [0.0, -1.0, -2.0], 9)] == [(-2.0, ["a", "c"]), (-3.0, ["b", "c"]), (-3.5, ["d"])]


def test_marks_in_texts_and_a_full_cache(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 3)
    encoder = Encoder(load_model(PIECES), 2)
    for t in ["a▁b ▁", "▁", "▁▁ x", "x▁", "one two three four five six", "x" * 5000, "y " * 3000]:
        ids, counts, _, _ = encoder.encode([t])
        assert encoder.decode(ids, counts)[0].decode() == t


def test_whole_tables(spark, table):
    docs = table([(1, "hello world"), (2, None), (3, ""), (4, "hello world"), (5, "long text " * 20000), (None, "x")])
    out = {r.doc_id: r for r in encode_texts(docs, PIECES, 3).collect()}
    assert out[2].ids is None and out[2].round_trip is None and out[3].ids == [] and out[3].scores == []
    assert out[1].ids == out[4].ids and out[1].scores == out[4].scores and len(out[1].scores) == 3
    assert all(r.round_trip for r in out.values() if r.ids is not None)
    assert out[5].n_pieces == len(out[5].ids) >= 40000
    back = {r.doc_id: r.text for r in decode_ids(encode_texts(docs, PIECES, 1), PIECES).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    assert encode_texts(docs.limit(0), PIECES).count() == 0


def test_best_score_is_that_of_the_ids(spark):
    model = load_model(PIECES)
    score = np.full(len(model.names), np.nan)
    for i, s in model.pieces.values():
        score[i] = s
    ids, _, scores, _ = Encoder(model, 1).encode(["the quick brown fox"])
    assert score[ids].sum() == scores[0][0]


def test_decoding_of_null_and_unknown_ids_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, [5, None, 10**6, -3, 5], "old"), (2, None, "old"), (3, [], "old"), (4, [None], "old")], "id int, ids array<int>, Text string")
    out = decode_ids(rows, PIECES)
    assert out.columns == ["id", "ids", "text"]
    one = decode_ids(spark.createDataFrame([([5, 5],)], "ids array<int>"), PIECES).first().text
    assert {r.id: r.text for r in out.collect()} == {1: one, 2: None, 3: "", 4: ""}
    assert decode_ids(rows.limit(0), PIECES).count() == 0
    with pytest.raises(ValueError):
        decode_ids(rows, PIECES, text_col="IDS")
