"""Connected components of an edge table by alternating stars, every round from a written table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tianguis.llm.common import Forest
from tianguis.session import durable

_EDGES = "a long, b long"


def _thin(batches):
    """Links of a partition without those that close a circle: at most one less than its nodes."""
    forest = Forest()
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        kept = [(x, y) for x, y in zip(a, b, strict=True) if forest.join(x, y)]
        if len(forest._parent) > 1_000_000:
            forest = Forest()
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of the links (a, b) with the smallest node it can reach.

    Nulls and loops are no links. Alternates the large and the small star: every node hands its neighbours to their
    smallest, until no link moves. The number of rounds grows with the logarithm of the size of a component.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = durable(e.mapInArrow(_thin, _EDGES).distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = durable(small.distinct())
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).groupBy("node").agg(F.min("component").alias("component"))
