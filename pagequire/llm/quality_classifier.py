"""Quality by co-training of two views.

One model sees the text (hashed words and affixes, how often words repeat, which signs there are), the other only what
is known of the page: its metadata columns. In each round both score all unlabelled documents, and each labels those it
is surest of for the other. Both are then calibrated on labelled texts kept apart, and their evidence is added up to
score all documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import BITS, Logistic, Rows, best_threshold, fit_logistic, gathered, hashed_features, sigmoid
from .text import byte_texts, kept, map_rows, scratch

#: Labelled texts that fitting takes at most, and features of all texts in fitting: of long ones fewer are taken.
MAX_LABELLED, MAX_FEATURES = 4500, 12_000_000
#: Documents of a class that a view teaches the other in the first round, at most; once more in each round after it.
TEACH = 200
ROUNDS, SURE = 2, 0.97
AFFIXES = (3, -2, -3)
_upper = np.zeros(256, bool)
_upper[65:91] = True
_mark = np.zeros(256, bool)
_mark[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def text_view(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Features of the text: words as written, their first and last bytes; how many words come anew or repeat, and the
    shares of capitals and marks."""
    found, facts = hashed_features(texts, AFFIXES, False)
    words = np.maximum(facts[:, 0], 1)
    signs = np.zeros((len(texts), 2))
    for i, t in enumerate(byte_texts(texts)):
        raw = np.frombuffer(t or b" ", np.uint8)
        signs[i] = np.count_nonzero(_upper[raw]) / max(1, len(raw)), np.count_nonzero(_mark[raw]) / max(1, len(raw))
    return found, np.column_stack([5 * facts[:, 1] / words, 5 * facts[:, 2] / words, 5.0 * (facts[:, 2] > 2), np.log1p(facts[:, 0]) / 2, 10 * signs])


def page_view(meta: list[pa.Array]) -> tuple[list[np.ndarray], np.ndarray]:
    """Features of the page: each metadata column's value (numbers by magnitude), and each two of them together."""
    out = []
    for row in zip(*[c.to_pylist() for c in meta], strict=True):
        facts = [f"{k}={x.bit_length() if isinstance(x, int) else x}" for k, x in enumerate(row)]
        facts += [f"{a}&{b}" for i, a in enumerate(facts) for b in facts[:i]]
        out.append(np.unique(np.array([xxhash.xxh3_64_intdigest(f) & ((1 << BITS) - 1) for f in facts], np.int32)))
    return out, np.zeros((len(out), 0))


@dataclass
class View:
    """Some texts as one view sees them."""

    rows: Rows
    dense: np.ndarray

    @classmethod
    def of(cls, seen: tuple[list[np.ndarray], np.ndarray]) -> View:
        return cls(Rows.of(seen[0]), seen[1])

    def take(self, which: np.ndarray) -> View:
        return View(self.rows.take(which), self.dense[which])

    def __add__(self, other: View) -> View:
        a, b = self.rows, other.rows
        return View(Rows(np.concatenate([a.flat, b.flat]), np.concatenate([a.ends, b.ends + len(a.flat)])), np.concatenate([self.dense, other.dense]))


@dataclass
class Views:
    """Both models; slope and offset of their calibration; the prior log-odds; the probability from which on texts go."""

    models: list[Logistic]
    lines: list[tuple[float, float]]
    prior: float
    threshold: float

    def logit(self, seen: list[View]) -> np.ndarray:
        """Calibrated log-odds of low quality: views independent given the class add up their evidence over the prior."""
        return sum(a * m.logit(v.rows, v.dense) + b - self.prior for m, v, (a, b) in zip(self.models, seen, self.lines, strict=True)) + self.prior


Taught = tuple[View, View, np.ndarray]


def co_train(known: list[View], y: np.ndarray, teach: Callable[[list[Logistic], int], list[Taught]], rounds: int = ROUNDS) -> Views:
    """known: the labelled texts in both views; y: 1 for low quality; teach: given both models and the round, for each
    view the unlabelled texts (in both views, with labels) that it is surest of."""
    held = np.arange(len(y)) % 3 == 0
    fit, away = np.flatnonzero(~held), np.flatnonzero(held)

    def fitted(view: int, taught: Taught | None) -> Logistic:
        rows, labels = known[view].take(fit), y[fit]
        if taught and len(taught[2]):
            rows, labels = rows + taught[view], np.concatenate([labels, taught[2]])
        return fit_logistic(rows.rows, rows.dense, labels, steps=60, even=True)

    models = [fitted(0, None), fitted(1, None)]
    for k in range(rounds if len(set(y[fit].tolist())) == 2 else 0):
        lessons = teach(models, k)
        models = [fitted(0, lessons[1]), fitted(1, lessons[0])]  # each learns what the other is sure of
    empty = Rows.of([np.zeros(0, np.int32)] * len(away))
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    lines = []
    for view in (0, 1):
        own = known[view].take(away)
        z = models[view].logit(own.rows, own.dense)
        line = fit_logistic(empty, z[:, None], y[away], steps=200) if len(set(y[away].tolist())) == 2 else None
        lines.append((float(line.dense[0]), line.bias) if line else (0.0, prior))
    views = Views(models, lines, prior, 0.5)
    views.threshold = max(0.5, best_threshold(sigmoid(views.logit([v.take(away) for v in known])), y[away]))  # in doubt a text stays
    return views


@dataclass
class Documents:
    """The documents as both views see them."""

    docs: DataFrame
    labels: DataFrame
    id: str
    text: str
    meta: list[str]
    features: int
    seed: int

    def rows(self, *more: Column) -> DataFrame:
        return self.docs.select(F.col(self.text).alias("__text"), F.col(self.id).alias("__id"), *more, *[F.col(c).alias(f"__m{i}") for i, c in enumerate(self.meta)])

    def seen(self, chosen: DataFrame) -> tuple[list[View], np.ndarray, list[str]]:
        """Both views and the __y of the chosen (__id, __y), a bounded sample, in a seeded order; and their ids."""

        def work(batch: pa.RecordBatch) -> dict:
            (a, dense), (b, _) = text_view(batch.column(0)), page_view(batch.columns[4:])
            return {"turn": batch.column(1), "id": batch.column(2), "y": batch.column(3), "a": [x.tobytes() for x in a], "dense": [x.tobytes() for x in dense], "b": [x.tobytes() for x in b], "size": [len(x) for x in a]}

        some = self.rows().join(F.broadcast(chosen), "__id").withColumns({"__turn": F.xxhash64("__id", F.lit(self.seed)), "__key": F.col("__id").cast("string")})
        rows = map_rows(some.select("__text", "__turn", "__key", "__y", *[f"__m{i}" for i in range(len(self.meta))]), work, "turn long, id string, y int, a binary, dense binary, b binary, size long")
        got = gathered(rows, ["turn", "id", "a"], "size", self.features)
        a, b = ([np.frombuffer(x, np.int32) for x in got[k].to_pylist()] for k in "ab")
        dense = np.array([np.frombuffer(x) for x in got["dense"].to_pylist()]).reshape(len(a), 6)  # the columns of text_view
        return [View.of((a, dense)), View.of((b, np.zeros((len(b), 0))))], got["y"].to_numpy().astype(int), got["id"].to_pylist()

    def surest(self, models: list[Logistic], most: int) -> list[Taught]:
        """For each view the unlabelled documents that it is surest of, `most` of each class, of equal ones one. All
        documents are scored; those that a view is sure of leave the tasks, and the first of them in order are taken."""
        light = [replace(m, weights=m.weights.astype(np.float32)) for m in models]

        def work(batch: pa.RecordBatch) -> dict:
            seen = [text_view(batch.column(0)), page_view(batch.columns[2:])]
            z = [m.logit(Rows.of(f), d) for m, (f, d) in zip(light, seen, strict=True)]
            out = {k: [] for k in ("view", "y", "sure", "same", "__id")}
            for i, key in enumerate(batch.column(1).to_pylist()):
                for view in (0, 1):
                    sure = abs(float(z[view][i]))
                    if sure >= LEAST_SURE:
                        same = xxhash.xxh3_64_intdigest(seen[0][0][i].tobytes()) >> 1
                        for k, x in zip(out, (view, int(z[view][i] > 0), sure, same, key), strict=True):
                            out[k].append(x)
            return out

        kind = self.docs.schema[self.id].dataType.simpleString()
        rows = self.rows().filter("__id is not null")
        sure = map_rows(rows, work, f"view int, y int, sure double, same long, __id {kind}")
        known = self.labels.select(F.col(self.id).alias("__id")).distinct()
        sure = kept(sure.join(known, "__id", "left_anti").groupBy("view", "y", "same").agg(F.max(F.struct("sure", "__id")).alias("best")).select("view", "y", "best.*"))
        first = [sure.filter((F.col("view") == view) & (F.col("y") == y)).orderBy(F.desc("sure"), F.xxhash64("__id"), "__id").limit(most) for view in (0, 1) for y in (0, 1)]
        chosen = kept(functools.reduce(DataFrame.unionByName, first)).select("__id", (F.col("view") * 2 + F.col("y")).alias("__y"))
        views, code, _ = self.seen(chosen)
        out = []
        for view in (0, 1):
            at = np.flatnonzero(code // 2 == view)
            out.append((views[0].take(at), views[1].take(at), code[at] % 2))
        return out


#: The log-odds of SURE.
LEAST_SURE = float(np.log(SURE / (1 - SURE)))


def fit_views(data: Documents, label_col: str, most: int, teach: int, rounds: int) -> Views:
    marks = data.labels.groupBy(F.col(data.id).alias("__id")).agg(F.min(label_col).alias("__y")).dropna()
    sample = marks.select("__id", (1 - F.col("__y")).cast("int").alias("__y")).orderBy(F.xxhash64("__id", F.lit(data.seed)), "__id").limit(most)
    known, y, _ = data.seen(sample)
    return co_train(known, y, lambda models, k: data.surest(models, teach * (k + 1)), rounds)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta: tuple[str, ...] = ("lang", "source", "n_chars"), most: int = MAX_LABELLED, features: int = MAX_FEATURES, teach: int = TEACH, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """Return all columns with p_low, the probability of low quality, and kept, below the threshold of the best F1 on the
    labelled texts kept apart, one half at least.

    Fitting takes `most` labelled texts and `features` in all at most, whatever their lengths; in each of the `rounds` all
    unlabelled documents are scored, and a view teaches the other up to `teach` documents of each class that it is surest
    of, twice as many in the second round, and so on. Labels: 1 good, 0 low; of several for one id the lowest counts, null
    ones and those without a text do not. `features` also bounds the texts that teach in a round. Null and empty texts score
    in the text view what a text without any word does there; null metadata is a value of its own. Rows that are equal score alike. Without labels, or with one class alone, every row gets the prior and is
    kept unless all labels were low. Columns named p_low or kept, in any case, are replaced, other names are free; an
    empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        views = fit_views(Documents(docs, labels, id_col, text_col, list(meta), features, seed), label_col, most, teach, rounds)
    for m in views.models:
        m.weights = m.weights.astype(np.float32)
    names = [c for c in docs.columns if c.lower() not in ("p_low", "kept")]

    def work(batch: pa.RecordBatch) -> dict:
        cols = dict(zip(batch.schema.names, batch.columns, strict=True))
        p = sigmoid(views.logit([View.of(text_view(cols[text_col])), View.of(page_view([cols[c] for c in meta]))]))
        return {c: cols[c] for c in names} | {"p_low": p, "kept": p <= views.threshold}

    return map_rows(docs.select(*names), work, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", p_low double, kept boolean")
