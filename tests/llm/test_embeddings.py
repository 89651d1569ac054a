"""Links and components of embeddings against brute force."""

import numpy as np
import pytest

from tests.llm.util import no_rows, table
from tianguis.llm import embeddings
from tianguis.llm.queries import op8_embedding_near_dedup


def brute(rows, cosine=0.98):
    """n_links and component by all pairs."""
    n = len(rows)
    good = [v is not None and lab is not None and i is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    links = [set() for _ in range(n)]
    unit = [np.array(v, dtype=float) / np.linalg.norm(v) if g else None for (_, v, _), g in zip(rows, good, strict=True)]
    groups = {}
    for k, (_, v, lab) in enumerate(rows):
        if good[k]:
            groups.setdefault((lab, len(v)), []).append(k)
    for members in groups.values():
        m = np.stack([unit[k] for k in members])
        for a, b in np.argwhere(m @ m.T >= cosine):
            if a != b:
                links[members[a]].add(members[b])
    low = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for k in range(n):
            for j in links[k]:
                if low[j] < low[k]:
                    low[k], changed = low[j], True
    return {(rows[k][0], len(links[k]), low[k]) for k in range(n)}


def answers(df):
    return {(r.vec_id, r.n_links, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_op8_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, "embeddings", f"/root/testdata/{sf}").collect()]
    got, want = answers(op8_embedding_near_dedup(spark, f"/root/testdata/{sf}")), brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert len(got) == len(rows) and found <= there and found >= 0.98 * there
    assert len(got & want) >= 0.98 * len(rows)


def odd(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 2), (4, [1.0, 0.0, 0.0], None),
        (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [nan, 1.0, 0.0], 1), (9, [inf, 1.0, 0.0], 1), (10, [None, 1.0, 0.0], 1),
        (11, [1.0, 0.01, 0.0], 1), (11, [1.0, 0.01, 0.0], 1), (12, [0.0, 1.0, 0.0], 1), (13, [1.0, 0.0], 1),
    ]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, codes string, links int")


def test_odd_and_no_vectors(spark):
    rows, df = odd(spark)
    assert answers(embeddings.near_duplicates(df)) == brute(rows)
    assert {r.vec_id for r in embeddings.near_duplicates(df).where("kept").collect()} == {0, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13}
    assert embeddings.near_duplicates(no_rows(df)).count() == 0
    assert [tuple(r) for r in embeddings.near_duplicates(df.selectExpr("cast(null as long) vec_id", "embedding", "label").limit(1)).collect()] == [(None, 0, None, None)]


def test_a_dense_group_in_blocks(spark):
    """More near copies than a block holds, with exact copies among them: every link counted once."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.03 * rng.standard_normal(16)).tolist(), 1) for i in range(150)]
    rows += [(1000 + i, rows[i % 7][1], 1) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, want = answers(embeddings.near_duplicates(df, block=16)), brute(rows)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) and all(g[1] <= w[1] for g, w in zip(sorted(got), sorted(want), strict=True))
    assert {r[2] for r in got} == {r[2] for r in want}
