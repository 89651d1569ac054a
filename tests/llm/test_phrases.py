"""Collocations against counting every phrase, with batches so small that many rounds are needed."""

import random
import re
from collections import Counter

import pytest

from tests.llm.util import LONG, no_rows, table
from tianguis.llm import phrases
from tianguis.llm.queries import op12_phrase_collocation_mining


def brute(rows, top=2000, least=30):
    counts, total = {}, Counter()
    for lang, text in rows:
        mine = counts.setdefault(lang or "und", Counter())
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 5):
                mine.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and " " in p}
        covered = set()
        for q, a in found.items():
            w = q.split(" ")
            inner = (" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w))
            covered |= {p for p in inner if 100 * a >= 80 * found[p]}
        scored = []
        for p, a in found.items():
            w = p.split(" ")
            cuts = [(f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w))]
            score, _, l, r = min((2000000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
            if p not in covered:
                scored.append((-score, -a, p.encode(), p, a, l, r, score))
        out += [(lang, i, p, a, l, r, total[lang], s) for i, (*_, p, a, l, r, s) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def answers(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def test_query_on_the_table(spark):
    rows = [(r.lang, r.text) for r in table(spark, "documents").collect()]
    assert answers(op12_phrase_collocation_mining(spark, "/root/testdata/sf0.001")) == brute(rows)


@pytest.mark.parametrize("seed,top,batch,block", [(1, 2000, 4000, 200_000), (2, 5, 8, 200_000), (3, 12, 16, 60)])
def test_random_texts_settled_in_rounds(spark, seed, top, batch, block):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(6)] + ["É", "a\x1fb", "New", "York"]
    fixed = ["new york city hall", "w1 w2 w3", "a b c d e", "É é", "tab\tbed"]
    rows = []
    for _ in range(150):
        text = "".join(rng.choice(fixed if rng.random() < 0.4 else words) + rng.choice([" ", " ", " ", "  ", ", ", ".\n", "\x0b"]) for _ in range(60))
        rows.append((rng.choice(["en", "de", None, "und", "x\ny"]), text))
    found = answers(phrases.collocations(frame(spark, rows).repartition(3), top, 4, batch, block))
    assert found == brute(rows, top, 4)


def test_words_beyond_a_full_filter_and_small_buffers(spark, monkeypatch):
    """A filter that lets every word through, spans of some bytes and an index that starts anew change nothing."""
    monkeypatch.setattr(phrases, "MOST_FILTER_BITS", 1)
    monkeypatch.setattr(phrases, "SPAN_BYTES", 50)
    monkeypatch.setattr(phrases, "BUFFER_WORDS", 40)
    rows = [("en", f"the cat sat. the cat ran x{i} the cat sat on") for i in range(40)] + [("en", LONG)]
    assert answers(phrases.collocations(frame(spark, rows), 50, 20, 16, 16)) == brute(rows, 50, 20)


def test_ties_at_the_cut(spark):
    """Forty pairs of one score and count: byte order decides, though a round looks at a part of the phrases only."""
    rows = [("en", ". ".join(f"a{i} b{i}" for i in range(40)))] * 30
    assert answers(phrases.collocations(frame(spark, rows), 7, 30, 16, 20)) == brute(rows, 7, 30)


def test_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**17, 3 * 10**17 + 1), (30, 7)], "a long, t long")
    found = [r[0] for r in df.select(phrases._exact(df.a, df.t)).collect()]
    assert found == [2000000 * 10**17 // (3 * 10**17 + 1), 60000000 // 7]


def test_odd_columns_and_no_rows(spark):
    rows = [("en", "one two " * 40), (None, None), ("en", ""), ("de", "   "), (None, "x y. " * 30)]
    df = frame(spark, rows)
    for name in ("key", "n", "a", "phrase", "size", "rank", "score", "l", "r", "k", "bound"):
        df = df.withColumn(name, df.lang)
    assert answers(phrases.collocations(df)) == brute(rows)
    assert phrases.collocations(no_rows(df)).collect() == []
