"""Groups of equal texts against a dictionary, with copies over many partitions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.util import documents, no_rows, odd_documents, table
from tianguis.llm import exact
from tianguis.llm.queries import op11_exact_dedup


def brute(rows, largest=True):
    """(doc_id, keep_id, size, sha) per row, and the ids kept per text."""
    members = {}
    for i, t in rows:
        members.setdefault(t or "", []).append(i)
    best = {t: (max if largest else min)((i for i in ids if i is not None), default=None) for t, ids in members.items()}
    found = sorted(((i, best[t or ""], len(members[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)
    return found, sorted(((best[t], hashlib.sha256(t.encode()).hexdigest()) for t in members), key=repr)


def answers(df):
    rows = df.collect()
    found = sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr)
    return found, sorted(((r.doc_id, r.text_sha256) for r in rows if r.kept), key=repr)


def test_query_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    assert answers(op11_exact_dedup(spark, "/root/testdata/sf0.001")) == brute(rows)


@pytest.mark.parametrize("keep", exact.KEEP)
@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_copies_over_many_partitions(spark, keep, partitions):
    """A third of all rows are one text, another third hold one head and differ behind it; ids and whole rows repeat."""
    texts = ["same " * 30] * 300 + ["h" * 200 + str(i % 90) for i in range(300)] + [None, "", "x", "x"] * 75
    ids = [None if i % 41 == 0 else (i * 7) % 400 for i in range(len(texts))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = documents(spark, texts, ids).repartition(5)
        assert answers(exact.groups(df, keep)) == brute(list(zip(ids, texts, strict=True)), keep == "largest")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_normalised_texts(spark):
    df = documents(spark, ["A  b", "a b", "c"])
    found = exact.unique_texts(df, normalised=lambda t: F.regexp_replace(F.lower(t), " +", " "))
    assert {tuple(r) for r in found.collect()} == {(0, "a b", 2), (2, "c", 1)}


def test_odd_rows_and_no_rows(spark):
    df = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert answers(exact.groups(df, "largest")) == brute(rows)
    assert exact.groups(no_rows(df)).collect() == []
    with pytest.raises(ValueError):
        exact.groups(df, "any")
