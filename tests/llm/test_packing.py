import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequire.llm import packing, queries
from pagequire.llm.packing import Items, Plan, pack, patterns


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.TOKENIZER)


ODD = ["", " ", "\n\t x", "İstanbul ΟΔΟΣ ΟΔΟΣ' áb é ́x", "don't we'll 12 345 a1b2 <|endoftext|>x y<|startoftext|>", "a b c\x0bd\x0ce\x1cf\x85g　h", "日本語のテキスト と 한국어", "x" * 500, "🙂👩‍👩‍👧 ok", "\x00 a\x00b", "ﬁ ＡＢ ß ẞ K"]


@pytest.mark.parametrize("remembered", [1 << 20, 3])
def test_items_give_the_tokenizers_ids(monkeypatch, remembered):
    monkeypatch.setattr(packing, "ITEMS", remembered)
    monkeypatch.setattr(packing, "SLICE", 7)
    monkeypatch.setattr(packing, "RUN_BYTES", 40)
    r, t = random.Random(2), tokenizer()
    items = Items(queries.TOKENIZER)
    texts = ODD + [" ".join(r.choices("the The of THE's word, words. ééa x1 12 3 naïve ÉÀ ×÷a J\u030c <|endoftext|> <|ENDOFTEXT|> d' 's 'S're ,'s --'t".split(), k=60)) for _ in range(20)]
    texts += ["".join(r.choices("abJ'é \n\t1,Σς\u0301\u030c <|>\x7fsªÀ×", k=80)) for _ in range(300)] + ["".join(r.choices("srevtld'\". AZ9<", k=60)) for _ in range(300)]
    for lo in range(0, len(texts), 50):
        ids, counts = items.encode([x.encode() for x in texts[lo : lo + 50]])
        ends = np.cumsum(counts)
        for text, end, n in zip(texts[lo : lo + 50], ends, counts, strict=True):
            assert ids[end - n : end].tolist() == t.encode(text, add_special_tokens=False).ids, text
    assert [x.tolist() for x in items.encode([])] == [[], []] and [x.tolist() for x in items.encode([b""])] == [[], [0]]


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25), st.sampled_from([40, 64]), st.booleans())
@settings(max_examples=150, deadline=None)
def test_plans_place_every_id_once(histogram, room, cut):
    packs = patterns(histogram, room)
    held = Counter()
    for used, n, holds in packs:
        assert used == sum(a * b for a, b in holds) <= room and n > 0
        for length, times in holds:
            held[length] += n * times
    assert held == Counter(histogram)
    plan = Plan(histogram, room, cut)
    lengths = np.array([x for x, n in histogram.items() for _ in range(n)], np.int64)
    ranks = np.array([i for n in histogram.values() for i in range(n)], np.int64)
    filled = {}
    for length, pieces in zip(lengths.tolist(), plan.lay(lengths, ranks), strict=True) if histogram else ():
        assert [p[0] for p in pieces] == [0, *np.cumsum([p[1] for p in pieces])[:-1].tolist()] and sum(p[1] for p in pieces) == length
        assert cut or len(pieces) == 1
        for _, size, seq, at in pieces:
            filled.setdefault(seq, []).append((at, size))
    assert sorted(filled) == list(range(plan.sequences))
    for some in filled.values():
        some.sort()
        assert [a for a, _ in some] == [0, *np.cumsum([b for _, b in some])[:-1].tolist()]
        used = sum(b for _, b in some)
        assert used <= room and (not cut or used == room or not used & (used - 1))


def test_longest_lengths_open_packs_and_the_shortest_pack_is_filled_first():
    # 6 finds no room; 3 goes to the shortest pack, that of 6, and each 2 then to one of 7
    assert sorted(patterns({7: 2, 6: 1, 3: 1, 2: 2}, 10)) == [(9, 1, [(6, 1), (3, 1)]), (9, 2, [(7, 1), (2, 1)])]


def test_counts_do_not_make_the_plan_larger():
    lengths = random.Random(1).sample(range(1, 2048), 900)
    small, large = (Plan({n: k * (1 + n % 7) for n in lengths}, 2048) for k in (1, 10**7))
    assert len(large.slots) < 3 * len(small.slots) < 30_000


def check(rows, texts, room, end=1):
    """rows of pack() against the tokenizer's ids of each document, repeated documents by their pieces as a multiset."""
    t = tokenizer()
    whole = {d: [t.encode(x or "", add_special_tokens=False).ids + [end] for e, x in texts if e == d] for d, _ in texts}
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert set(by_id) == set(whole)
    for d, wanted in whole.items():
        covered = Counter()
        for r in by_id[d]:
            ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
            assert r.length == len(ids) > 0
            assert any(len(w) == r.doc_tokens and w[r.start : r.start + r.length] == ids for w in wanted)
            covered.update((r.doc_tokens, i) for i in range(r.start, r.start + r.length))
        assert covered == Counter((len(w), i) for w in wanted for i in range(len(w)))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    padding = 0
    for some in sequences.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= room
        padding += 0 if at & (at - 1) == 0 else room - at
    return padding


@pytest.mark.parametrize("cut, broadcast", [(True, 1 << 19), (False, 0)])
def test_pack_holds_every_id_once(spark, table, monkeypatch, cut, broadcast):
    monkeypatch.setattr(packing, "BROADCAST", broadcast)
    r = random.Random(4)
    words = "the of Tier heon naïve x1 longerword, and".split()
    texts = [(i, " ".join(r.choices(words, k=r.choice([1, 3, 9, 20, 60])))) for i in range(120)]
    texts += [(500, None), (501, ""), (None, "a null id"), (502, " ".join(words * 300))] + [(503, "copied text")] * 3 + [(600 + i, "hot copy of it") for i in range(60)] + [(700 + i, x) for i, x in enumerate(ODD)]
    end = 1 if cut else 70_000  # ids beyond 16 bits
    padding = check(pack(table(texts, 5), queries.TOKENIZER, end, 64, cut).collect(), texts, 64, end)
    assert not cut or padding == 0


def test_empty_table(spark, table):
    assert pack(table([]), queries.TOKENIZER).count() == 0


def test_query(spark, table, folder):
    texts = [(i, "some words of it " * (i * 40)) for i in range(25)] + [(30, None)]
    at = folder(documents=table(texts))
    out = queries.op12_pack(spark, at).collect()
    assert {x: sum(r.length for r in out if r.doc_id == x) for x, _ in texts} == {x: next(r.doc_tokens for r in out if r.doc_id == x) for x, _ in texts}
    ids = {x: tokenizer().encode(t or "", add_special_tokens=False).ids + [1] for x, t in texts}
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert sorted(tuple(x) for x in queries.op12_pack(spark, at).collect()) == sorted(tuple(x) for x in out)
