"""Near duplicates among embeddings by Euclidean p-stable hashing, with exact cosine checks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tianguis.llm.common import BLOCK_ROWS, Forest, in_blocks, pairs_in_runs, per_block_pair, saved
from tianguis.llm.components import components

#: Width of a cell in units of the distance that belongs to the smallest cosine.
WIDTH = 6.0
#: Chance that two vectors just at the threshold share a bucket of some table.
RECALL = 0.995
SEED = 7


def _same_cell(distance: float, width: float) -> float:
    """Chance that one projection puts two points at ``distance`` into the same cell (normal projections)."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(rows: int, cosine: float) -> tuple[int, int, float]:
    """Projections per table, tables, and cell width: unrelated unit vectors meet about once per row in all."""
    near = math.sqrt(max(2 - 2 * cosine, 1e-6))
    width = WIDTH * near
    p_near, p_far = _same_cell(near, width), _same_cell(math.sqrt(2), width)
    projections = max(4, math.ceil(math.log(max(rows, 2)) / -math.log(p_far)))
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - p_near**projections))
    return projections, tables, width


def _unit(rows: pa.Array) -> np.ndarray:
    """Vectors of one length as unit vectors in double precision."""
    n = len(rows)
    v = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def named(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, class): class is a hash of label and vector, null for rows that cannot be linked.

    Linked are rows with an id, a label, and finite components that are not all zero.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(e, lambda x: x != 0)
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), e.cast("array<double>").alias("embedding")
    )
    return rows.withColumn("class", F.when(usable, F.xxhash64("label", "embedding")))


def _hashed(classes: DataFrame, rows: int, cosine: float) -> DataFrame:
    """(vec_id, codes): one code per hash table, of label, dimension and quantised random projections."""
    projections, tables, width = parameters(rows, cosine)

    def run(batches):
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            codes = np.zeros((batch.num_rows, tables), dtype=np.uint64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                rng = np.random.default_rng(SEED)
                normals = rng.standard_normal((int(dim), tables * projections))
                shifts = rng.uniform(0, width, tables * projections)
                cells = np.floor((_unit(batch.column("embedding").take(pa.array(at))) @ normals + shifts) / width).astype(np.int64)
                weights = rng.integers(1, 2**63, tables * projections, dtype=np.uint64) | np.uint64(1)
                mixed = cells.view(np.uint64) * weights
                codes[at] = mixed.reshape(len(at), tables, projections).sum(axis=2, dtype=np.uint64)
            flat = pa.array(codes.reshape(-1).view(np.int64))
            offsets = pa.array(np.arange(0, batch.num_rows * tables + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(offsets, flat)], names=["vec_id", "codes"])

    return classes.select("vec_id", F.size("embedding").alias("dim"), "embedding").mapInArrow(run, "vec_id long, codes array<long>")


def _compare(cosine: float):
    """Links of each pair of blocks: their weight per vector, and those that connect what was apart.

    A pair that shares buckets of several tables counts in the first of them alone, so every link is counted once.
    """

    def run(table, starts):
        ids, block, at = (table.column(c).to_numpy() for c in ("vec_id", "block", "at"))
        size, dim = table.column("copies").to_numpy(), table.column("dim").to_numpy()
        i, j = table.column("block_i").to_numpy(), table.column("block_j").to_numpy()
        label = table.column("label").to_numpy()
        codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        forest, kept, total = Forest(), ([], []), np.zeros(len(ids), dtype=np.int64)
        vectors = table.column("embedding").combine_chunks()
        units = {int(d): _unit(vectors.take(pa.array(np.flatnonzero(dim == d)))) for d in np.unique(dim)}
        place = np.zeros(len(ids), dtype=np.int64)
        for d in units:
            own = np.flatnonzero(dim == d)
            place[own] = np.arange(len(own))
        for x, y in pairs_in_runs(starts, len(ids)):
            ok = ((i[x] == j[x]) | (block[x] != block[y])) & (dim[x] == dim[y]) & (label[x] == label[y])
            x, y = x[ok], y[ok]
            for begin in range(0, len(x), 65536):
                p, q = x[begin : begin + 65536], y[begin : begin + 65536]
                first = (codes[p] == codes[q]).argmax(axis=1) == at[p]
                p, q = p[first], q[first]
                close = np.zeros(len(p), dtype=bool)
                for d, unit in units.items():
                    own = dim[p] == d
                    close[own] = np.einsum("ij,ij->i", unit[place[p[own]]], unit[place[q[own]]]) >= cosine
                p, q = p[close], q[close]
                np.add.at(total, p, size[q])
                np.add.at(total, q, size[p])
                for u, v in zip(ids[p].tolist(), ids[q].tolist(), strict=True):
                    if forest.join(u, v):
                        kept[0].append(u)
                        kept[1].append(v)
        linked = np.flatnonzero(total)
        n, m = len(kept[0]), len(linked)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kept[0] + ids[linked].tolist(), pa.int64()),
                pa.array(kept[1] + [None] * m, pa.int64()),
                pa.array([0] * n + total[linked].tolist(), pa.int64()),
            ],
            names=["a", "b", "links"],
        )

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = 0.98, block: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings``.

    Rows are linked when labels are equal and their cosine, in double precision, is at least ``cosine``. Vectors that are
    null, empty, zero or hold null or non-finite components, rows without a label and rows without a vec_id link with
    nothing; vectors of different length neither. Equal vectors of a label are one class whose copies are linked with each
    other by count alone. A vec_id that occurs more than once is several rows; their links count each. Other columns play
    no part; an empty table gives no rows. Links are found in hash tables (chance of at least ``RECALL`` at the threshold,
    more above it); none below the threshold is ever counted.
    A row without a vec_id has no component, and null for kept.
    """
    rows = named(embeddings)
    good = rows.where("class is not null").groupBy("class", "label", "embedding")
    classes = saved(good.agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    hashed = _hashed(classes.select(F.col("class").alias("vec_id"), "embedding"), classes.count(), cosine).withColumnRenamed("vec_id", "class")
    hashed = saved(hashed, "codes")
    labelled = hashed.join(classes.select("class", "label"), "class")
    tables = labelled.select("class", F.posexplode("codes").alias("at", "code"), "label").select("class", "at", F.xxhash64("label", "at", "code").alias("_key"))
    met = in_blocks(tables, "_key", "class", block)
    carried = classes.select("class", "copies", "label", F.size("embedding").alias("dim"), "embedding").join(hashed, "class")
    met = met.join(carried, "class").withColumnRenamed("class", "vec_id")
    found = saved(per_block_pair(met, "_key", _compare(cosine), "a long, b long, links long"), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    reached = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "class")
    rooted = classes.select("class", "rep", "copies", "label").join(reached, "class", "left").withColumn("root", F.coalesce("component", "class"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    rooted = rooted.join(least, "root").join(counts, "class", "left")
    answers = rooted.select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    joined = rows.select("vec_id", "class").join(answers, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
