"""Scores against a plain Katz model in dictionaries, and sums of its probabilities."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.util import documents, no_rows, odd_documents, table
from tianguis.llm import katz
from tianguis.llm.queries import op6_lm_scoring

END, BEGIN = "\n end", "\n begin"


def words_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [END]


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


class Plain:
    def __init__(self, rows, share=katz.HISTORY_SHARE):
        train = [words_of(t) for d, t in rows if not is_held_out(d)]
        self.uni = Counter(w for t in train for w in t)
        self.total = sum(self.uni.values())
        self.histories = {w: n for w, n in self.uni.items() if w != END and n >= max(1, self.total * share)} | {BEGIN: len(train)}
        self.bi = Counter((u, v) for t in train for u, v in zip([BEGIN, *t], t) if u in self.histories)
        times = lambda c: [sum(n == r for n in c.values()) for r in range(1, katz.K + 2)]
        self.d1, self.d2 = katz.discounts(times(self.uni)), katz.discounts(times(self.bi))
        self.unknown = 1 - sum(self.p1(v) for v in self.uni)
        self.after = {}
        for u, v in self.bi:
            self.after.setdefault(u, []).append(v)

    @staticmethod
    def cut(n, d):
        return n * (d[n - 1] if n <= katz.K else 1)

    def p1(self, v):
        return self.cut(self.uni[v], self.d1) / (self.total + 1) if self.uni[v] else self.unknown

    def alpha(self, u):
        seen = self.after.get(u, [])
        return (1 - sum(self.p(u, v) for v in seen)) / (1 - sum(self.p1(v) for v in seen))

    def p(self, u, v):
        if u not in self.histories:
            return self.p1(v)
        if self.bi[u, v]:
            return self.cut(self.bi[u, v], self.d2) / (self.histories[u] + 1)
        return self.alpha(u) * self.p1(v)

    def row(self, doc_id, text):
        t = words_of(text)
        base = sum(math.log10((self.uni[w] + 0.1) / (self.total + 0.1 * (len(self.uni) + 1))) for w in t)
        score = sum(math.log10(self.p(u, v)) for u, v in zip([BEGIN, *t], t))
        return (doc_id, is_held_out(doc_id), len(t), sum(self.uni[w] > 0 for w in t), self.total, pytest.approx(base, rel=1e-9, abs=1e-9), pytest.approx(score, rel=1e-9, abs=1e-9))


def key(r):
    return (str(r[0]), r[2], r[3])


def compare(df, rows, **more):
    got = sorted((tuple(r) for r in katz.scores(df, **more).collect()), key=key)
    model = Plain(rows, *more.values())
    assert got == sorted((model.row(d, t) for d, t in rows), key=key)
    return model


@pytest.mark.parametrize("share, sent", [(katz.HISTORY_SHARE, 10**6), (katz.HISTORY_SHARE, 0), (0.001, 10**6), (0.2, 10**6)])
def test_scores_of_some_texts(spark, monkeypatch, share, sent):
    """In several chunks and buckets, common histories over several of them; their sums are sent or met by salt."""
    monkeypatch.setattr(katz, "CHUNK_BYTES", 30_000)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 3_000)
    monkeypatch.setattr(katz, "SPLIT_TOKENS", 100)
    monkeypatch.setattr(katz, "SENT_ROWS", sent)
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").orderBy("doc_id").limit(60).collect()]
    model = compare(spark.createDataFrame(rows, "doc_id long, text string"), rows, history_share=share)
    for u in [BEGIN, *list(model.histories)[:5]]:
        assert sum(model.p(u, v) for v in model.uni) + model.p(u, "never seen") == pytest.approx(1)


def test_op6_is_better_than_its_base_on_texts_it_did_not_see(spark):
    got = op6_lm_scoring(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and len({r.train_tokens for r in got}) == 1
    fold = [r for r in got if r.held_out]
    assert sum(r.score for r in fold) > sum(r.base_score for r in fold) and all(r.score < 0 for r in got)


def test_planes_hold_any_number():
    for values in (np.array([0, 1, 255, 256, 2**62], dtype=np.int64), np.array([0.0, -1.5, 3e300]), np.empty(0, dtype=np.int64)):
        assert np.array_equal(katz.unpacked(katz.packed(values), values.dtype), values)


def test_common_histories_are_dealt_over_several_buckets():
    """No bucket gets more of one history than its part; every pair is dealt once."""
    n = 4000
    words = np.arange(n)
    token = np.column_stack([np.zeros(n, dtype=np.int64), words]).ravel()
    count = np.append(np.full(n, 2), 1)
    count[0] = n
    row = pa.table({"count": [katz.packed(count)], "number": [katz.packed(np.append(words + 1, 0))], "token": [katz.packed(token)], "n": [[2 * n]]})
    p = katz.Pairs(row, katz.Deal(1, 64, 500))
    common = p.run_number == 1
    length = np.diff(np.append(p.first, len(p.dealt)))
    assert len(p.dealt) == len(p.word) == len(set(p.dealt.tolist()))
    assert p.run_split[common].all() and common.sum() >= 5 and length[common].max() < n / 4
    assert not p.run_split[~common].any()


def test_odd_and_no_documents(spark):
    df = odd_documents(spark)
    compare(df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert katz.scores(no_rows(df)).count() == 0
    held = next(i for i in range(100) if is_held_out(i))
    (row,) = katz.scores(documents(spark, ["a b"], [held])).collect()
    assert tuple(row) == (held, True, 3, 0, 0, 0.0, 0.0)
    compare(documents(spark, ["a a a a", "a a a a", ""], [1, 2, 3]), [(1, "a a a a"), (2, "a a a a"), (3, "")])


def test_rare_words_are_histories_however_large_the_corpus(spark):
    """Behind a word of three in more than 262,144 tokens the bigram counts: adding other text does not take it away."""
    rows = [(1, "rare follower"), (2, "rare follower"), (3, "follower rare")] + [(10 + i, "a b c d e f g h " * 2_500) for i in range(20)]
    model = compare(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert model.total > 4 * 65536 and model.p("rare", "follower") > 10 * model.p1("follower")
