"""Quality rules by repetition coverage.

Words get integer ids, n-grams get rolling 64-bit hashes over several lengths, and numpy sorts the hashes of a batch of
texts to find what occurs twice within a text. Equal neighbours are compared word by word, so that a hash collision can
never count as a repetition.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import SPACES, byte_texts, cut, map_rows, mix64

# fixed value: characters that count as symbols
SYMBOLS = b"#*$%&|<>"
#: Words whose n-grams are sorted at once.
CHUNK_WORDS = 1 << 20


@dataclass(frozen=True)
class Limits:
    """Largest shares of a text's word characters that a kept text may have, by n-gram length or for lines."""

    most_common: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    duplicated: dict[int, float] = field(default_factory=lambda: {5: 0.15, 7: 0.13, 10: 0.10})
    line_chars: float = 0.20
    #: Symbols per word.
    symbols: float = 0.10
    min_words: int = 50
    #: Largest percentage of words inside repeated 3-word windows.
    window_percent: int = 50


class Words:
    """Words of a batch of texts as integer ids, with character counts; the dictionary lasts for one batch."""

    def __init__(self, texts: list[bytes | None]):
        ids: dict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        split = [t.split() if t else [] for t in texts]
        self.offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(w) for w in split], out=self.offsets[1:])
        self.ids = np.fromiter((ids[w] for words in split for w in words), np.int64, self.offsets[-1])
        self.chars = np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8", "replace")) for w in ids), np.int64, len(ids))[self.ids] if ids else np.zeros(0, np.int64)


def repeats(ids: np.ndarray, doc: np.ndarray, chars: np.ndarray, n: int, rolled: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words stand inside an n-gram found twice or more in their text, and for each text the characters of its
    most frequent repeated n-gram times its count. `rolled` holds the hash of the n words from each position on."""
    covered, top = np.zeros(len(ids), bool), np.zeros(n_docs, np.int64)
    last = len(ids) - n + 1
    if last < 2:
        return covered, top
    starts = np.flatnonzero(doc[:last] == doc[n - 1 :])
    key = rolled[starts] ^ mix64(doc[starts] + 1)
    order = np.argsort(key, kind="stable")
    at, key = starts[order], key[order]
    twin = np.flatnonzero(key[1:] == key[:-1])
    if not len(twin):
        return covered, top
    a, b = at[twin], at[twin + 1]
    same = doc[a] == doc[b]
    for k in range(n):
        same &= ids[a + k] == ids[b + k]
    if not same.all():  # two different n-grams share a hash: count these texts without hashes
        odd = np.unique(np.concatenate([doc[a[~same]], doc[b[~same]]]))
        keep = ~np.isin(doc[a], odd)
        a, b, twin = a[keep], b[keep], twin[keep]
    else:
        odd = ()
    begins = np.zeros(len(ids) + 1, np.int64)
    begins[a] = 1
    begins[b] = 1
    if len(twin):
        first = np.flatnonzero(np.r_[True, np.diff(twin) != 1])
        count = np.diff(np.r_[first, len(twin)]) + 1
        size = np.concatenate([[0], np.cumsum(chars)])
        np.maximum.at(top, doc[a[first]], count * (size[a[first] + n] - size[a[first]]))
    for d in odd:
        lo, hi = np.searchsorted(doc, [d, d + 1])
        grams = [tuple(ids[i : i + n].tolist()) for i in range(lo, hi - n + 1)]
        for gram, count in Counter(grams).items():
            if count > 1:
                where = [lo + i for i, g in enumerate(grams) if g == gram]
                begins[where] = 1
                top[d] = max(top[d], count * chars[where[0] : where[0] + n].sum())
    total = np.cumsum(begins[:-1])
    covered = total - np.concatenate([np.zeros(n, np.int64), total[:-n]]) > 0
    return covered, top


def measure(texts: list[bytes | None], lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Base counts of each text, and for each n-gram length the covered words, covered characters and the weight of the
    most frequent repeated n-gram. Null and empty texts measure 0 everywhere."""
    out = {k: np.zeros(len(texts), np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", "n_lines")}
    for i, t in enumerate(texts):
        if not t:
            continue
        out["word_chars"][i] = (len(t) if t.isascii() else len(t.decode("utf-8", "replace"))) - sum(t.count(c) for c in SPACES)
        out["n_symbols"][i] = sum(t.count(c) for c in SYMBOLS)
        lines = [x for x in t.split(b"\n") if x.strip()]
        out["n_lines"][i] = len(lines)
        if len(lines) > 1 and len(set(lines)) < len(lines):
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
            out["dup_line_chars"][i] = sum((n - 1) * len(b"".join(x.split()).decode("utf-8", "replace")) for x, n in Counter(lines).items() if n > 1)
    for n in lengths:
        out |= {f"covered_words_{n}": np.zeros(len(texts), np.int64), f"covered_chars_{n}": np.zeros(len(texts), np.int64), f"top_chars_{n}": np.zeros(len(texts), np.int64)}
    sizes = np.fromiter((len(t) // 2 if t else 0 for t in texts), np.int64, len(texts))
    for lo, hi in cut(np.concatenate([[0], np.cumsum(sizes)]), 2 * CHUNK_WORDS):
        words = Words(texts[lo:hi])
        counts = np.diff(words.offsets)
        out["n_words"][lo:hi] = counts
        doc = np.repeat(np.arange(hi - lo), counts)
        one = mix64(words.ids + 1)
        rolled, reached = one, 1
        for n in sorted(lengths):
            for k in range(reached, n):  # the hash of k + 1 words from that of k
                rolled = rolled[: max(0, len(one) - k)] * np.uint64(0x9E3779B97F4A7C15) + one[k:]
            reached = n
            covered, top = repeats(words.ids, doc, words.chars, n, rolled, hi - lo)
            out[f"covered_words_{n}"][lo:hi] = np.bincount(doc[covered], minlength=hi - lo)
            out[f"covered_chars_{n}"][lo:hi] = np.bincount(doc[covered], words.chars[covered], hi - lo)
            out[f"top_chars_{n}"][lo:hi] = top
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """Measure every whole text and judge it.

    Returns the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (in 3-word windows), base_failed, the
    share of characters in duplicated lines and n-grams, and kept. Null or empty texts have no words and fail the base
    rules; repeated rows are judged alike, each on its own; other columns of the table are not read. An empty table
    gives an empty result. One pass without a shuffle; a task holds one Arrow batch.
    """
    limits = limits or Limits()
    lengths = tuple(sorted({3, *limits.most_common, *limits.duplicated}))

    def judge(batch: pa.RecordBatch) -> dict:
        m = measure(byte_texts(batch.column(1)), lengths)
        chars = np.maximum(m["word_chars"], 1)
        failed = (m["n_words"] < limits.min_words) | (100 * m["covered_words_3"] > limits.window_percent * m["n_words"])
        ok = m["dup_line_chars"] <= limits.line_chars * chars
        ok &= m["n_symbols"] <= limits.symbols * m["n_words"]
        for n, most in limits.most_common.items():
            ok &= m[f"top_chars_{n}"] <= most * chars
        for n, most in limits.duplicated.items():
            ok &= m[f"covered_chars_{n}"] <= most * chars
        return {
            id_col: batch.column(0), **{k: m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines")}, "n_repeat_words": m["covered_words_3"], "base_failed": failed,
            "dup_line_share": m["dup_line_chars"] / chars, "dup_ngram_share": np.max([m[f"covered_chars_{n}"] / chars for n in limits.duplicated] or [0 * chars], axis=0), "kept": ok & ~failed,
        }

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), judge, f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, dup_line_share double, dup_ngram_share double, kept boolean")
