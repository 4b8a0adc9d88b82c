import numpy as np
import pyarrow as pa

from pagequire.llm import text


def test_word_hashes_equal_words_and_cuts(monkeypatch):
    texts = pa.array(["a b  C\ta", "", None, "b", "  ", "c a", " éa É a\n", "x" * 5000 + " a"])
    hashes, counts = text.word_hashes(texts)
    assert counts.tolist() == [4, 0, 0, 1, 0, 2, 3, 2]
    words = [w.lower() for t in texts.to_pylist() for w in (t.encode().split() if t else [])]
    seen = {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    monkeypatch.setattr(text, "CHUNK_BYTES", 7)
    again, same = text.word_hashes(texts)
    assert (again == hashes).all() and (same == counts).all()
    sliced, _ = text.word_hashes(texts.slice(3, 3))
    assert (sliced == hashes[4:7]).all()


def test_affixes_and_case():
    h, _ = text.word_hashes(pa.array(["walking walked Walk"]), (4, -3), lower=False)
    assert h[0, 1] == h[1, 1] != h[2, 1]
    assert h[0, 2] != h[1, 2]
    low, _ = text.word_hashes(pa.array(["walk Walk"]))
    assert low[0] == low[1]


def test_shingle_sets():
    a, b, c, d, e = text.shingle_sets(pa.array(["a b c d e f", "A B C D E F x", "a b", None, "a b c d e a b c d e"]), 5)
    assert len(a) == 2 and len(np.intersect1d(a, b)) == 2 and len(b) == 3
    assert len(c) == 1 and len(d) == 0 and len(e) == 5


def test_cut_keeps_large_rows_alone():
    assert text.cut(np.array([0, 3, 5, 50, 52]), 10) == [(0, 2), (2, 3), (3, 4)]
    assert text.cut(np.array([0]), 10) == []


def test_kept_writes_a_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "shared_folder", lambda _: str(tmp_path))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert text.kept(spark.range(5)).count() == 5
    assert list(tmp_path.glob("pagequire-*/*/*.parquet"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == was


def test_shared_folder_without_a_setting(spark):
    assert text.shared_folder(spark) == text.shared_folder(spark)


def test_long_batches_are_hashed_in_small_parts(monkeypatch):
    """Whatever the batch, a worker keeps few powers, and larger parts give the same hashes."""
    monkeypatch.setattr(text, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    texts = pa.array(["word " * 500_000 + "end", "x" * 5000, None, "a b c"])
    got, counts = text.word_hashes(texts)
    sets = text.shingle_sets(texts, 5)
    assert len(text._powers[0]) <= 1 << 18 and counts.tolist() == [500_001, 1, 0, 3]
    monkeypatch.setattr(text, "CHUNK_BYTES", 1 << 20)
    assert (text.word_hashes(texts)[0] == got).all() and all((a == b).all() for a, b in zip(text.shingle_sets(texts, 5), sets, strict=True))
