"""Containment against brute force over all pairs."""

import random
import re

import pytest

from tests.llm.util import documents, no_rows, odd_documents, table
from tianguis.llm import decontamination
from tianguis.llm.queries import op10_benchmark_decontamination


def shingles(text, k=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub(r"[!-/:-@\[-`{-~]", " ", (text or "").lower())) if w]
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(docs, items, threshold=0.8):
    sets = [(i, shingles(t)) for i, t in items]
    out = []
    for d, t in docs:
        there = shingles(t)
        out += [(d, i, len(s & there), len(s)) for i, s in sets if s and len(s & there) >= threshold * len(s)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op10_equals_brute_force(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    docs = [(r.doc_id, r.text) for r in table(spark, "documents", sf_dir).collect()]
    items = [(r.item_id, r.text) for r in table(spark, "benchmark", sf_dir).collect()]
    want = brute(docs, items)
    assert want and got(op10_benchmark_decontamination(spark, sf_dir)) == want


def planted(seed):
    """Items of 2 to 60 words, whole, edited and cut, inside documents of 0 to 9,000 words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7)))
    items = [(i, " ".join(word() for _ in range(r.choice([2, 4, 5, 6, 9, 17, 25, 60])))) for i in range(60)]
    docs = []
    for d in range(120):
        words = [word() for _ in range(r.choice([0, 3, 40, 300, 9000]))]
        for _ in range(r.randrange(4)):
            part = r.choice(items)[1].split()
            if r.random() < 0.5:
                part[r.randrange(len(part))] = "zz"
            at = r.randrange(len(words) + 1)
            words[at:at] = [w.upper() + r.choice(["", ".", "!!"]) for w in part]
        docs.append((d, " ".join(words)))
    return docs + [(1000, items[0][1]), (1001, items[1][1])], items + [(None, None), (99, ""), items[0]]


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_planted_passages(spark, block_bytes):
    docs, items = planted(5)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(decontamination.contaminated(df, bench, block_bytes=block_bytes)) == brute(docs, items)


def test_odd_and_no_rows(spark):
    df = odd_documents(spark)
    bench = spark.createDataFrame([(1, "A b, c d e f g h i j k l", "x"), (2, None, "x"), (3, "one", "x")], "item_id long, text string, doc_id string")
    want = brute([(r.doc_id, r.text) for r in df.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got(decontamination.contaminated(df, bench)) == want and len(want) == 4
    assert got(decontamination.contaminated(no_rows(df), bench)) == got(decontamination.contaminated(df, no_rows(bench))) == []
    left = decontamination.decontaminated(df, bench)
    assert left.columns == df.columns and sorted((r.doc_id for r in left.collect()), key=str) == sorted([0, 1, 2, 7, 8, None], key=str)


def test_nothing_found_leaves_all(spark):
    df = documents(spark, ["a", None, "b c"])
    assert decontamination.decontaminated(df, spark.createDataFrame([(1, "q w e r t y")], "item_id long, text string")).count() == 3
