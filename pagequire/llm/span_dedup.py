"""Substring dedup by sliding sentence spans.

Texts are cut into pieces of at most REACH words: at the ends of sentences and lines, and inside longer sentences at
words chosen by their hash: of any REACH words in a row without such an end, behind the one with the smallest hash. So
equal stretches are cut alike, whatever stands around them.
Every shortest run of consecutive pieces with LEAST words, from each piece and to each piece, is hashed and joined with
all others. The first place of a repeated run, by id and position, stays; pieces that any other place covers go.

A stretch of n words that two texts share loses its common runs wherever it stands, at least n - 2 * REACH + 1 words
of it, if these are LEAST or more: every passage of over 50 words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SPACES, byte_texts, free, kept, map_rows, mix64, powers, scratch, word_hashes

#: Words of a piece at most, and of a run at least: what any 51 words in a row hold between their first and last cut.
REACH = 8
LEAST = 51 - 2 * REACH + 1
#: Over the pieces of any run; a power of 2.
SPAN = 64
#: Hashes of the marks that end a sentence.
_marks = word_hashes(pa.array([". ! ?"]), (-1,))[0][:, 1]


def pieces(words: np.ndarray) -> np.ndarray:
    """The first word of each piece, and the number of words at last; words: a row (hash, hash of the
    last byte, whether it begins a line) for each."""
    n = len(words)
    ends = np.isin(words[:, 1], _marks) | np.concatenate([words[1:, 2] > 0, [False]])[:n]
    key = words[:, 0] >> np.uint64(1) | np.where(ends, np.uint64(0), np.uint64(1 << 63))
    if n < REACH:
        return np.unique(np.concatenate([[0], np.flatnonzero(ends) + 1, [n]]))
    least, k = key, 1
    while k < REACH:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    edge = np.zeros(REACH - 1, np.uint64)
    least, k = np.concatenate([edge, least, edge]), 1
    while k < REACH:
        least = np.maximum(least[:-k], least[k:])
        k *= 2
    return np.unique(np.concatenate([[0], np.flatnonzero((least == key) | ends) + 1, [n]]))


def runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of a text, and for each its first piece times SPAN plus its number of pieces."""
    at = pieces(words)
    m = len(at) - 1
    if at[-1] < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.searchsorted(at, at[:-1] + LEAST)
    starts = np.searchsorted(at, at[1:] - LEAST, "right") - 1
    first, last = np.flatnonzero(ends <= m), np.flatnonzero(starts >= 0)
    both = np.unique(np.concatenate([first * (m + 1) + ends[first], starts[last] * (m + 1) + last + 1]))
    lo, hi = both // (m + 1), both % (m + 1)
    up, down = powers(1 << max(18, (len(words) - 1).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words[:, 0] * up[: len(words)], dtype=np.uint64)])
    rolled = (sums[at[hi]] - sums[at[lo]]) * down[at[lo]] + (at[hi] - at[lo]).astype(np.uint64)
    return mix64(rolled).astype(np.int64), lo * SPAN + hi - lo


def without(text: bytes, at: np.ndarray, places: list[int]) -> tuple[bytes, list[int]]:
    """The text without the pieces that the places cover, and these pieces. White space goes with the words before it,
    but for a line's end where words of the line stay. Places beyond the text, of other rows of the id, cover nothing."""
    m = len(at) - 1
    lo, size = np.divmod(np.array(places, np.int64), SPAN)
    lo, hi = np.minimum(lo, m), np.minimum(lo + size, m)
    gone = np.cumsum(np.bincount(lo, minlength=m + 1) - np.bincount(hi, minlength=m + 1))[:-1] > 0
    edges = np.diff(np.concatenate([[True], np.isin(np.frombuffer(text, np.uint8), list(SPACES)), [True]]).astype(np.int8))
    begin = np.concatenate([np.flatnonzero(edges == -1)[at[:-1]], [len(text)]]).tolist()
    stop = np.flatnonzero(edges == 1)[at[1:] - 1].tolist()
    begin[0] = 0
    out = b""
    parts = []
    for i, less in enumerate(gone.tolist()):
        if not less:
            parts.append(out := text[begin[i] : begin[i + 1]])
        elif b"\n" in text[stop[i] : begin[i + 1]] and out and not out.endswith(b"\n"):
            parts.append(out := text[stop[i] : begin[i + 1]])
    return b"".join(parts), np.flatnonzero(gone).tolist()


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return all columns of the table with the text after removal, and n_sentences (its pieces: sentences, or parts of
    long ones), n_removed, removed (the numbers from 0 of the pieces that go) and first_ids (the ids that keep them).

    Null texts stay null and word-less ones as they are, with 0 pieces; a text that is covered wholly becomes empty. Of
    equal runs the one with the smallest id, then position, is first; ties of id and position, as between repeated rows,
    are the same place. Rows that share an id are one document: what goes at a position goes in each. Texts differ in
    runs only by words, lower-cased in A-Z. Rows with a null id are left as they are. Columns named n_sentences,
    n_removed, removed or first_ids, in any case, are replaced; other names are free. Tables without rows give none. Runs
    are combined before the shuffle, so that a passage held by a third of all rows is one row per task; places of it are
    joined with that row, where Spark splits a large key.
    """

    def split(texts: pa.Array) -> list[np.ndarray]:
        words, counts = word_hashes(texts, (-1,), lines=True)
        return [words[end - n : end] for end, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True)]

    def hashed(batch: pa.RecordBatch) -> dict:
        found = [runs(words) if len(words) else (np.zeros(0, np.int64),) * 2 for words in split(batch.column(1))]
        ends = pa.array(np.concatenate([[0], np.cumsum([len(h) for h, _ in found])]), pa.int32())
        flat = [np.concatenate([x[k] for x in found]) for k in (0, 1)]
        return {"id": batch.column(0), "h": pa.ListArray.from_arrays(ends, pa.array(flat[0])), "at": pa.ListArray.from_arrays(ends, pa.array(flat[1]))}

    kind = docs.schema[id_col].dataType.simpleString()
    found = map_rows(docs.filter(F.col(id_col).isNotNull()).select(id_col, text_col), hashed, f"id {kind}, h array<long>, at array<long>")
    key, places, ids = free(docs, "id", "places", "ids")
    with scratch(docs.sparkSession) as spare:
        spans = kept(found.select("id", F.explode(F.arrays_zip("h", "at")).alias("s")).select("id", F.col("s.h").alias("h"), F.col("s.at").alias("at")))
        # written, so that what is shuffled to find repeated runs has gone when all runs are shuffled to meet them
        first = kept(spans.groupBy("h").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first"))
        hits = spans.join(first, "h").filter(F.struct("id", "at") != F.col("first")).select("id", "at", F.col("first.id").alias("first_id"))
        # a document has at most two runs for each piece
        gone = spare(hits.groupBy(F.col("id").alias(key)).agg(F.collect_set("at").alias(places), F.collect_set("first_id").alias(ids)))
    names = [c for c in docs.columns if c.lower() not in ("n_sentences", "n_removed", "removed", "first_ids")]
    joined = docs.select(*names).join(gone, F.col(id_col) == F.col(key), "left").drop(key)

    def rewrite(batch: pa.RecordBatch) -> dict:
        cols = dict(zip(batch.schema.names, batch.columns, strict=True))
        texts, sizes, lost = [], [], []
        for text, words, at in zip(byte_texts(cols[text_col]), split(cols[text_col]), cols[places].to_pylist(), strict=True):
            cut = pieces(words)
            text, out = without(text, cut, at) if len(words) and at else (text, [])
            texts.append(text)
            sizes.append(len(cut) - 1)
            lost.append(out)
        new = pa.array(texts, pa.binary()).cast(pa.string())
        return {c: cols[c] for c in names} | {text_col: new, "n_sentences": sizes, "n_removed": [len(x) for x in lost], "removed": lost, "first_ids": cols[ids]}

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + f", n_sentences long, n_removed long, removed array<int>, first_ids array<{kind}>"
    return map_rows(joined, rewrite, schema)
