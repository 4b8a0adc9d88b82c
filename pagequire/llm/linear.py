"""Sparse logistic models over hashed presence features, fitted in numpy on a bounded sample, applied by the tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import kept, word_hashes

#: Hashed features are kept modulo two to this power.
BITS = 18


def hashed_features(texts: pa.Array, affixes: tuple[int, ...], lower: bool, bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text the sorted distinct features of its words and their affixes; and its numbers of words, of distinct
    words, and of words that repeat the one before."""
    hashes, counts = word_hashes(texts, affixes, lower)
    ids = (hashes & np.uint64((1 << bits) - 1)).astype(np.int32)
    ends = np.cumsum(counts)
    found, facts = [], np.zeros((len(counts), 3), np.int64)
    for i, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        found.append(np.unique(ids[end - count : end]))
        one = hashes[end - count : end, 0]
        facts[i] = count, len(np.unique(one)), np.count_nonzero(one[1:] == one[:-1])
    return found, facts


def gathered(rows: DataFrame, order: list[str], size_col: str, most: int) -> pa.Table:
    """The first rows in the given order whose sizes add up to `most` at most, at the driver: fewer rows where they are
    large, but of every size. `rows` must be a bounded sample; it is written once, and one task adds up its sizes."""
    rows = kept(rows)
    sums = rows.select(*order, F.sum(size_col).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)).alias("__sum"))
    return rows.join(sums.filter(F.col("__sum") <= most).select(*order), order, "left_semi").orderBy(*order).toArrow()


@dataclass
class Rows:
    """Feature lists of many rows, one after another."""

    flat: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Rows:
        return cls(np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int32, copy=False), np.cumsum([len(x) for x in lists], dtype=np.int64))

    def __len__(self) -> int:
        return len(self.ends)

    def take(self, which: np.ndarray) -> Rows:
        starts = np.concatenate([[0], self.ends[:-1]])
        return Rows.of([self.flat[starts[i] : self.ends[i]] for i in which])

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The sum of each row's weights, the same wherever the row stands."""
        starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        some, out = self.ends > starts, np.zeros(len(self.ends))
        if some.any():
            out[some] = np.add.reduceat(weights[self.flat].astype(np.float64), starts[some])
        return out


@dataclass
class Logistic:
    """weights over features, weights over dense columns, and a bias; even: features count less the more a row has."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float
    even: bool = False

    def logit(self, rows: Rows, dense: np.ndarray) -> np.ndarray:
        return rows.sums(self.weights) / evened(rows, self.even) + dense @ self.dense + self.bias


def evened(rows: Rows, even: bool) -> np.ndarray | float:
    return np.sqrt(np.maximum(1, np.diff(np.concatenate([[0], rows.ends])))) if even else 1.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(rows: Rows, dense: np.ndarray, y: np.ndarray, dims: int = 1 << BITS, steps: int = 60, ridge: float = 1.0, even: bool = False) -> Logistic:
    """Logistic regression on features scaled by their log count ratio between the classes, by full-batch Adam steps; the
    ridge pulls the scaled weights to their mean contribution. One class alone gives a constant."""
    y = y.astype(float)
    if not len(y) or y.min() == y.max():
        return Logistic(np.zeros(dims), np.zeros(dense.shape[1]), 0.0 if not len(y) else (8.0 if y[0] else -8.0), even)
    n = np.diff(np.concatenate([[0], rows.ends]))
    row = np.repeat(np.arange(len(rows), dtype=np.int32), n)
    less = evened(rows, even)
    # features of one row alone say nothing about another
    keep = np.bincount(rows.flat, minlength=dims)[rows.flat] > 1
    flat, row = rows.flat[keep], row[keep]
    ends = np.cumsum(np.bincount(row, minlength=len(rows)))
    starts = np.concatenate([[0], ends[:-1]])
    up = np.bincount(flat, y[row], dims)
    down = np.bincount(flat, minlength=dims) - up
    alpha = 0.5
    ratio = np.log((up + alpha) / (y.sum() + 2 * alpha)) - np.log((down + alpha) / ((1 - y).sum() + 2 * alpha))
    # a feature of few rows says little: its ratio shrinks with the rows that have it
    ratio *= (up + down) / (up + down + 3.0)
    used = np.flatnonzero(up + down)
    place = np.searchsorted(used, flat)
    del flat, keep
    scale = ratio[used]
    w, d, b = np.full(len(used), 0.05), np.zeros(dense.shape[1]), np.log(y.mean() / (1 - y.mean()))
    m = [np.zeros_like(w), np.zeros_like(d), 0.0]
    v = [np.zeros_like(w), np.zeros_like(d), 0.0]
    for t in range(1, steps + 1):
        total = np.concatenate([[0.0], np.cumsum((w * scale)[place])])
        z = (total[ends] - total[starts]) / less + dense @ d + b
        del total
        g = (sigmoid(z) - y) / len(y)
        grads = [np.bincount(place, (g / less)[row], len(used)) * scale + ridge * w / len(y), dense.T @ g + ridge * d / len(y), g.sum()]
        for i, x in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * x
            v[i] = 0.99 * v[i] + 0.01 * x * x
        move = [0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8) for i in range(3)]
        w, d, b = w - move[0], d - move[1], b - move[2]
    weights = np.zeros(dims)
    weights[used] = w * scale
    return Logistic(weights, d, float(b), even)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on positives are told best by F1, midway between two neighbours; 0.5 without labels."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.r_[p[order][1:] != p[order][:-1], True]
    at = int(np.argmax(np.where(ends, f1, -1)))
    return float((p[order][at] + (p[order][at + 1] if at + 1 < len(p) else 0)) / 2)
