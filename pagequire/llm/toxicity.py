"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over hashed words and word beginnings. A later model also
sees the log-odds of the earlier categories; for fitting these come from models that have not seen the row (out of
fold), so that they are as good as they will be on new texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import Logistic, Rows, best_threshold, fit_logistic, gathered, hashed_features, sigmoid
from .text import map_rows

#: Labelled texts that the models are fitted on at most, and their features in all: of long texts fewer are taken. Scoring
#: covers all rows and all words.
MAX_LABELLED, MAX_FEATURES = 5000, 12_000_000
#: Beginnings of words in bytes: inflected forms share them.
AFFIXES = (4, 6, 8)
FOLDS = 3


@dataclass
class Chain:
    names: list[str]
    models: list[Logistic]
    thresholds: list[float]

    def logits(self, rows: Rows) -> np.ndarray:
        """A column for each category, each fed with those before it."""
        out = np.zeros((len(rows), len(self.models)))
        for k, m in enumerate(self.models):
            out[:, k] = m.logit(rows, out[:, :k])
        return out


def fit_chain(rows: Rows, labels: np.ndarray, names: list[str], folds: int = FOLDS, ridge: float = 3.0) -> Chain:
    """labels: a row per text, a 0/1 column per category."""
    n = len(rows)
    fold = np.arange(n) % folds
    earlier = np.zeros((n, 0))
    models, thresholds = [], []
    for k in range(len(names)):
        held = np.zeros(n)
        for f in range(folds):
            fit, out = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(fit) and len(out):
                held[out] = fit_logistic(rows.take(fit), earlier[fit], labels[fit, k], ridge=ridge, steps=60).logit(rows.take(out), earlier[out])
        models.append(fit_logistic(rows, earlier, labels[:, k], ridge=ridge, steps=60))
        thresholds.append(best_threshold(sigmoid(held), labels[:, k]))
        earlier = np.column_stack([earlier, held])
    return Chain(names, models, thresholds)


def labelled_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, categories: dict[str, Column], most: int, features: int, seed: int) -> tuple[Rows, np.ndarray]:
    """Features and labels of the `most` labelled texts that come first in a seeded order, as long as they have no more
    than so many features in all; several labels of one id count as the largest."""
    marks = labels.groupBy(F.col(id_col).alias("__id")).agg(*[F.max(c.cast("int")).alias(f"__{i}") for i, c in enumerate(categories.values())]).dropna()
    sample = marks.withColumn("__order", F.xxhash64("__id", F.lit(seed))).orderBy("__order", "__id").limit(most)
    n = len(categories)

    def work(batch: pa.RecordBatch) -> dict:
        found, _ = hashed_features(batch.column(0), AFFIXES, True)
        y = zip(*[batch.column(3 + i).to_pylist() for i in range(n)], strict=True)
        return {"turn": batch.column(1), "id": batch.column(2), "f": [f.tobytes() for f in found], "size": [len(f) for f in found], "y": [bytes(v) for v in y]}

    some = docs.select(F.col(text_col).alias("__text"), F.col(id_col).cast("string").alias("__key"), F.col(id_col).alias("__id")).join(F.broadcast(sample), "__id")
    rows = map_rows(some.select("__text", "__order", "__key", *[f"__{i}" for i in range(n)]), work, "turn long, id string, f binary, size long, y binary")
    got = gathered(rows, ["turn", "id", "f"], "size", features)
    return Rows.of([np.frombuffer(f, np.int32) for f in got["f"].to_pylist()]), np.array([list(y) for y in got["y"].to_pylist()], int).reshape(-1, n)


def score_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED, features: int = MAX_FEATURES, seed: int = 0) -> DataFrame:
    """Fit a chain over the categories (0/1 expressions over `labels`, in order) and score every whole text.

    Returns the id, and for each category its probability `p_<name>` and the decision `<name>`, at the threshold of the
    best F1 out of fold. Null and empty texts have no features and get the chain's base rate. Rows of equal text score
    alike; other columns are not read; an empty table gives no rows. Without labels, or with one class alone, a category
    is never (or always) predicted. Fitting takes `most` labelled rows at most, with `features` in all; repeated rows of an
    id count each. Labels whose category is null, or without a text, are not used.
    """
    rows, y = labelled_features(docs, labels, id_col, text_col, categories, most, features, seed)
    chain = fit_chain(rows, y, list(categories))
    for m in chain.models:
        m.weights = m.weights.astype(np.float32)  # 1 MB for each category goes to the tasks

    def work(batch: pa.RecordBatch) -> dict:
        found, _ = hashed_features(batch.column(1), AFFIXES, True)
        p = sigmoid(chain.logits(Rows.of(found)))
        return {id_col: batch.column(0)} | {f"p_{c}": p[:, k] for k, c in enumerate(chain.names)} | {c: p[:, k] >= chain.thresholds[k] for k, c in enumerate(chain.names)}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, " + ", ".join(f"`p_{c}` double" for c in categories) + ", " + ", ".join(f"`{c}` boolean" for c in categories))
