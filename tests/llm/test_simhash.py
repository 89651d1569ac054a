"""Fingerprints, links and components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from tests.llm.util import documents, no_rows, odd_documents, table
from tianguis.llm import simhash
from tianguis.llm.queries import op4_simhash_near_dedup


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, distance=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    raw, n = np.array(fps, dtype=np.uint64), len(rows)
    root = list(range(n))
    changed = True
    near = [np.flatnonzero(np.bitwise_count(raw ^ raw[i]) <= distance) for i in range(n)]
    ids = [float("inf") if d is None else d for d, _ in rows]
    root = list(ids)
    while changed:
        changed = False
        for i in range(n):
            low = min(root[j] for j in near[i])
            for j in near[i]:
                if root[j] > low:
                    root[j], changed = low, True
    return sorted(((d, f"{f:016x}", None if r == float("inf") else r) for (d, _), f, r in zip(rows, fps, root, strict=True)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op4_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents", f"/root/testdata/{sf}").select("doc_id", "text").collect()]
    assert got(op4_simhash_near_dedup(spark, f"/root/testdata/{sf}")) == brute(rows)


def test_odd_and_no_documents(spark):
    df = odd_documents(spark)
    assert got(simhash.near_duplicates(df)) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert simhash.near_duplicates(no_rows(df)).count() == 0


@pytest.mark.parametrize("distance", [1, 3, 4, 6])
def test_links_connect_what_is_near(spark, distance, monkeypatch):
    """Random fingerprints around a few centres, in blocks of few rows."""
    rng = np.random.default_rng(distance)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set()
    for _ in range(600):
        fp = int(rng.choice(centres))
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            fp ^= 1 << int(b)
        fps.add(fp - (1 << 64) if fp >> 63 else fp)
    fps = sorted(fps)
    raw = np.array(fps, dtype=np.int64).view(np.uint64)
    want = {(a, b) for i, a in enumerate(fps) for b in np.array(fps)[np.flatnonzero(np.bitwise_count(raw ^ raw[i]) <= distance)].tolist() if a < b}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    small = simhash.in_blocks
    monkeypatch.setattr(simhash, "in_blocks", lambda d, k, i: small(d, k, i, 16))
    links = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(df, distance).collect()}
    assert links <= want

    def roots(edges):
        root = {f: f for f in fps}
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                low = min(root[a], root[b])
                changed |= root[a] != low or root[b] != low
                root[a] = root[b] = low
        return root

    assert roots(links) == roots(want)


def test_thresholds_follow_the_principle():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for rows in (10, 10**6, 10**9):
        for distance in (0, 1, 4, 7):
            chosen = simhash.allocation(sample, rows, distance)
            assert sorted(b for g, _ in chosen for b in g) == list(range(64))
            assert sum(t + 1 for _, t in chosen) == distance + 1


def test_one_of_each_group_stays(spark):
    a = " ".join(f"w{i}" for i in range(50))
    df = documents(spark, [a, a, "other words are here now and then", None, ""], [5, 3, 7, 8, 9])
    assert sorted(r.doc_id for r in simhash.deduplicated(df).collect()) == [3, 7, 8]


def test_one_row_of_each_group_where_ids_repeat_or_are_missing(spark):
    """Doc 5 stands for two texts, with doc 9 and doc 3 as their copies; copies without an id are a group as well."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (9, a), (5, b), (3, b), (None, c), (None, c), (None, a), (7, c + " x " * 300), (7, c + " x " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicated(df).collect()), key=str)
    assert got == sorted([(5, a), (3, b), (None, c), (7, c + " x " * 300)], key=str)
