import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagequire.llm.linear import Rows, best_threshold, fit_logistic, sigmoid
from pagequire.llm.quality_classifier import LEAST_SURE, Documents, View, co_train, score_quality, text_view
from pagequire.llm.toxicity import fit_chain, score_chain


def test_logistic_tells_classes_apart():
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 400)
    rows = Rows.of([np.unique(np.r_[r.integers(10, 500, 20), [1] if t else [2]]).astype(np.int32) for t in y])
    for even in (False, True):
        m = fit_logistic(rows, np.zeros((400, 0)), y, 512, even=even)
        assert ((m.logit(rows, np.zeros((400, 0))) > 0) == (y == 1)).mean() > 0.98
    assert fit_logistic(rows, np.zeros((400, 0)), np.ones(400), 512).logit(rows, np.zeros((400, 0))).min() > 0
    assert fit_logistic(Rows.of([]), np.zeros((0, 0)), np.zeros(0), 512).bias == 0


def test_best_threshold():
    p, y = np.array([0.9, 0.8, 0.7, 0.2]), np.array([1, 1, 0, 0])
    assert best_threshold(p, y) == 0.75
    assert best_threshold(np.zeros(0), np.zeros(0)) == 0.5 == best_threshold(p, np.zeros(4))


def test_chain_feeds_earlier_categories():
    r = np.random.default_rng(1)
    first = r.integers(0, 2, 600)
    rows = Rows.of([np.unique(np.r_[r.integers(10, 500, 10), [1] if t else [2]]).astype(np.int32) for t in first])
    chain = fit_chain(rows, np.column_stack([first, first]), ["a", "b"])
    assert len(chain.models[0].dense) == 0 and len(chain.models[1].dense) == 1 and chain.models[1].dense[0] > 0


def corpus(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randrange(20, 120))]
        toxic, low = r.random() < 0.2, r.random() < 0.2
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(["scoundre", "nastywor"]) + r.choice(["l", "ly", "ling", "d"]))
        if low:
            words = [w + "###" for w in words] if r.random() < 0.5 else [w for w in words for _ in range(6)]
        docs.append((i, " ".join(words), f"s{i % 3}"))
        if i % 3:
            labels.append((i, int(not low), int(toxic)))
    return docs, labels, {d for d, q, t in labels if t}, {d for d, q, t in labels if not q}


@pytest.fixture(scope="module")
def marked(spark, table):
    docs, labels, _, _ = corpus(900, 3)
    odd = [(5000, None), (5001, ""), (5002, "scoundrel " * 30000), (5003, docs[0][1]), (5003, docs[0][1])]
    known, hidden = [x for x in labels if x[0] % 2], [x for x in labels if x[0] % 2 == 0]
    extra = [(1, None, None), (77777, 1, 1), (known[0][0], known[0][1], known[0][2])]
    return table(docs + odd), spark.createDataFrame(known + extra, "doc_id long, quality int, toxic int"), hidden


def test_toxicity_on_held_out_labels(marked):
    docs, labels, hidden = marked
    out = {}
    for r in score_chain(docs, labels, {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert len(out[5003]) == 2 and out[5003][0].p_toxic == out[5003][1].p_toxic and out[5002][0].toxic and not out[5000][0].toxic and not out[5001][0].toxic
    truth, said = np.array([t for _, _, t in hidden]), np.array([out[d][0].toxic for d, _, _ in hidden])
    assert said[truth == 1].mean() > 0.95 and said[truth == 0].mean() < 0.03


def test_quality_on_held_out_labels(marked):
    docs, labels, hidden = marked
    done = score_quality(docs, labels)
    assert done.columns == [*docs.columns, "p_low", "kept"]
    out = {r.doc_id: r for r in done.collect()}
    truth, kept = np.array([q for _, q, _ in hidden]), np.array([out[d].kept for d, _, _ in hidden])
    assert kept[truth == 1].mean() > 0.97 and kept[truth == 0].mean() < 0.1
    assert done.count() == docs.count()


def test_without_labels_or_rows(spark, table, marked):
    _, labels, _ = marked
    docs = table([(1, "a b"), (2, None)])
    none = labels.limit(0)
    assert {r.kept for r in score_quality(docs, none).collect()} == {True}
    assert {r.toxic for r in score_chain(docs, none, {"toxic": F.col("toxic")}).collect()} <= {True, False}
    assert score_quality(docs.limit(0), labels).count() == 0
    assert score_chain(docs.limit(0), labels, {"toxic": F.col("toxic")}).count() == 0


def plain_fit(x, dense, y, steps=60, ridge=1.0, even=False):
    """The same model on full matrices: a function from (rows, dense columns) to log-odds."""
    if y.min() == y.max():
        return lambda x, dense: np.full(len(x), 8.0 if y[0] else -8.0)
    less = lambda x: np.sqrt(np.maximum(1, x.sum(1))) if even else np.ones(len(x))
    used = x.sum(0) > 1
    up, down = (x[y == 1] * used).sum(0), (x[y == 0] * used).sum(0)
    ratio = (np.log((up + 0.5) / (y.sum() + 1)) - np.log((down + 0.5) / ((1 - y).sum() + 1))) * (up + down) / (up + down + 3)
    scaled = lambda x: x * (ratio * used) / less(x)[:, None]
    full = lambda x, d: np.column_stack([scaled(x), d, np.ones(len(x))])
    a = full(x, dense)
    n = x.shape[1]
    w = np.concatenate([np.where(used, 0.05, 0.0), np.zeros(dense.shape[1]), [np.log(y.mean() / (1 - y.mean()))]])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = a.T @ ((sigmoid(a @ w) - y) / len(y)) + np.r_[ridge * w[:-1] / len(y), 0]
        g[:n] *= used
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return lambda x, dense: full(x, dense) @ w


def some_rows(n, seed):
    r = np.random.default_rng(seed)
    y = r.integers(0, 2, n)
    lists = [np.unique(np.r_[r.integers(6, 60, 9), [t if r.random() < 0.8 else 1 - t, 2 + t]]).astype(np.int32) for t in y]
    x = np.zeros((n, 64))
    for i, one in enumerate(lists):
        x[i, one] = 1
    return y, Rows.of(lists), x


def test_chain_equals_full_matrices():
    y, rows, x = some_rows(50, 5)
    labels = np.column_stack([y, np.roll(y, 1) | y])
    chain = fit_chain(rows, labels, ["a", "b"])
    earlier, fold = np.zeros((50, 0)), np.arange(50) % 3
    want = []
    for k in (0, 1):
        held = np.zeros(50)
        for f in range(3):
            held[fold == f] = plain_fit(x[fold != f], earlier[fold != f], labels[fold != f, k], ridge=3.0)(x[fold == f], earlier[fold == f])
        want.append(plain_fit(x, earlier, labels[:, k], ridge=3.0))
        earlier = np.column_stack([earlier, held])
    first = want[0](x, np.zeros((50, 0)))
    assert np.allclose(chain.logits(rows), np.column_stack([first, want[1](x, first[:, None])]), atol=1e-6)


def test_co_training_equals_full_matrices():
    y, a, xa = some_rows(60, 6)
    _, b, xb = some_rows(60, 6)
    pool_y, c, xc = some_rows(40, 8)
    none = lambda n: np.zeros((n, 0))
    known, pool = [View(a, none(60)), View(b, none(60))], [View(c, none(40)), View(c, none(40))]

    def teach(models, k):
        out = []
        for m in models:
            z = m.logit(c, none(40))
            at = np.argsort(-np.abs(z), kind="stable")[: 5 * (k + 1)]
            out.append((pool[0].take(at), pool[1].take(at), (z[at] > 0).astype(int)))
        return out

    views = co_train(known, y, teach, 2)
    fit, away = np.flatnonzero(np.arange(60) % 3), np.flatnonzero(np.arange(60) % 3 == 0)
    learn = lambda x, more: plain_fit(np.vstack([x[fit], *[xc[[i]] for i, _ in more]]), none(len(fit) + len(more)), np.r_[y[fit], [t for _, t in more]].astype(int), even=True)
    models = [learn(xa, []), learn(xb, [])]
    for k in range(2):
        said = []
        for m in models:
            z = m(xc, none(40))
            said.append([(i, int(z[i] > 0)) for i in sorted(range(40), key=lambda i: -abs(z[i]))[: 5 * (k + 1)]])
        models = [learn(xa, said[1]), learn(xb, said[0])]
    assert np.allclose(views.models[0].logit(a, none(60)), models[0](xa, none(60)), atol=1e-5)
    assert np.allclose(views.models[1].logit(b, none(60)), models[1](xb, none(60)), atol=1e-5)
    prior = np.log((y.sum() + 0.5) / (60 - y.sum() + 0.5))
    z = prior + sum(s * m(x, none(60)) + o - prior for (s, o), m, x in zip(views.lines, models, (xa, xb), strict=True))
    assert np.allclose(views.logit(known), z, atol=1e-5) and len(away) == 20


def test_surest_documents_of_all(spark, marked):
    """Each view's surest unlabelled documents, of equal texts one, found by scoring every document."""
    docs, labels, _ = marked
    data = Documents(docs, labels, "doc_id", "text", ["lang", "source", "n_chars"], 10**7, 0)
    views, y, _ = data.seen(labels.groupBy("doc_id").agg(F.min("quality").alias("q")).dropna().select(F.col("doc_id").alias("__id"), (1 - F.col("q")).cast("int").alias("__y")))
    models = [fit_logistic(v.rows, v.dense, y, even=True) for v in views]
    got = data.surest(models, 7)
    known, texts = {r.doc_id for r in labels.collect()}, {}
    for r in docs.filter("doc_id is not null").collect():
        if r.doc_id not in known:
            texts[r.text] = r
    sure = []
    for t in texts:
        f, d = text_view(pa.array([t]))
        sure.append(float(models[0].logit(Rows.of(f), d)[0]))
    want = sorted([z for z in sure if z >= LEAST_SURE], reverse=True)[:7], sorted([z for z in sure if -z >= LEAST_SURE])[:7]
    z = models[0].logit(got[0][0].rows, got[0][0].dense)
    assert np.allclose(sorted(z[got[0][2] == 1], reverse=True), want[0], atol=1e-3) and np.allclose(sorted(z[got[0][2] == 0]), want[1], atol=1e-3)
    assert len(want[0]) == 7


def test_columns_of_any_name_and_fewer_features(spark, marked):
    docs, labels, hidden = marked
    out = score_quality(docs.withColumnRenamed("path", "KEPT").withColumnRenamed("node", "__id"), labels, features=60_000)
    assert out.columns == [c for c in docs.withColumnRenamed("node", "__id").columns if c != "path"] + ["p_low", "kept"]
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert np.mean([kept[d] == bool(q) for d, q, _ in hidden]) > 0.9
