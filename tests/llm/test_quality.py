"""Held-out accuracy, gradients, and defined results for odd rows."""

import zlib

import numpy as np

from tests.llm.util import documents, no_rows, odd_documents, table
from tianguis.llm import quality
from tianguis.llm.queries import op3_quality_classifier
from tianguis.llm.ragged import Powers

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score)
    ranks = np.empty(len(y))
    ranks[order] = np.arange(1, len(y) + 1)
    pos = y == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_op3_on_labels_it_did_not_see(spark):
    got = {r.doc_id: r for r in op3_quality_classifier(spark, SF).collect()}
    assert len(got) == 10_000
    labels = {r.doc_id: r.quality for r in table(spark, "labels", SF).collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    fold = [i for i in labels if got[i].held_out]
    y, s = np.array([labels[i] for i in fold]), np.array([got[i].score for i in fold])
    print("held out:", len(fold), "accuracy", ((s >= 0.5) == y).mean(), "auc", auc(s, y))
    assert ((s >= 0.5) == y).mean() > 0.93 and auc(s, y) > 0.93


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    x, bags, y = rng.normal(size=(12, quality.N_FEATURES)), np.array([1, 4, 5, 2]), np.array([1.0, 0, 1, 0])
    model = quality.fit(x, bags, y)
    loss = lambda: np.mean(np.logaddexp(0, model.forward(x, bags)[0]) - y * model.forward(x, bags)[0])
    got = quality._gradients(model, x, bags, y)
    for name, w in model.weights.items():
        at = tuple(0 for _ in w.shape)
        old, eps = w[at].copy(), 1e-6
        w[at] = old + eps
        high = loss()
        w[at] = old - eps
        low = loss()
        w[at] = old
        assert abs((high - low) / (2 * eps) - np.asarray(got[name])[at]) < 1e-6


def test_passages_of_odd_texts():
    x, bags = quality.passages([b"", b"  ", b"one", b"a " * 130], Powers())
    assert bags.tolist() == [1, 1, 1, 3] and x.shape == (6, quality.N_FEATURES) and np.isfinite(x).all()


def test_odd_and_no_rows(spark):
    df = odd_documents(spark)
    labels = spark.createDataFrame([(0, 1, "x"), (3, 0, "x"), (3, 0, "x"), (5, 1, "x"), (None, 1, "x"), (6, None, "x"), (7, 1, "x")], "doc_id long, quality int, text string")
    rows = quality.quality(df, labels).collect()
    assert len(rows) == 10 and len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert {r.score for r in quality.quality(df, no_rows(labels)).collect()} == {0.5}
    assert quality.quality(no_rows(df), labels).count() == 0
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in rows)
    assert quality.accepted(documents(spark, ["a b", None]), no_rows(labels)).count() == 2
