"""Groups of documents with equal texts, found by sorting the contents.

Spark samples splitters and deals the rows out by range, then sorts every partition, on disk where it does not fit. Equal
texts end up next to each other, and neighbours are compared in full. The ranges run over the first bytes of a text, its
hash, the id and a number of the row, so the copies of one text may spread over any number of partitions: what a partition
cannot know is only how the texts at its two ends go on, and those few are added up afterwards. No group is ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tianguis.llm.common import saved

#: Leading bytes of a text that take part in the splitters, so that no sample carries whole texts.
HEAD_BYTES = 64
KEEP = ("smallest", "largest")
_FOUND = "doc_id long, keep_id long, group_size long, text_sha binary, stays boolean, open boolean, part int, text binary"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha", pa.binary()),
        ("stays", pa.bool_()), ("open", pa.bool_()), ("part", pa.int32()), ("text", pa.binary()),
    ]
)


class _Run:
    """Neighbouring rows with one text; ids are kept, the text only once."""

    def __init__(self, key: tuple, body: bytes):
        self.key, self.body, self.ids, self.rows = key, body, [], 0

    def add(self, ids: pa.Array) -> None:
        self.ids.append(ids)
        self.rows += len(ids)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[_Run], bool]]:
    """Finished runs of a sorted partition, and whether they lie at one of its ends.

    Runs are held until the next (head, hash) begins: texts that share both count as one end of the partition.
    """
    first = current = None
    waiting: list[_Run] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        body, head, mix, ids = (batch.column(i) for i in range(4))
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = pc.invert(pc.equal(body[1:], body[:-1])).to_numpy(zero_copy_only=False)
        if current is not None and body[0].as_py() == current.body:
            new[0] = False
        starts = np.flatnonzero(new)
        if current is not None:
            current.add(ids.slice(0, int(starts[0]) if len(starts) else batch.num_rows))
        done: list[_Run] = []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            key = (mix[start].as_py(), head[start].as_py())
            if current is not None:
                waiting.append(current)
                if key != current.key:
                    if current.key == first:
                        yield waiting, True
                    else:
                        done += waiting
                    waiting = []
            else:
                first = key
            current = _Run(key, body[start].as_py())
            current.add(ids.slice(start, end - start))
        if done:
            yield done, False
    if current is not None:
        yield [*waiting, current], True


def _rows(runs: list[_Run], at_end: bool, part: int, largest: bool, texts: bool) -> pa.RecordBatch:
    sizes = np.array([r.rows for r in runs])
    ends = np.cumsum(sizes)
    place = ends - 1 if largest else ends - sizes
    ids = pa.concat_arrays([a for r in runs for a in r.ids])
    n = len(ids)
    stays = np.zeros(n, dtype=bool)
    stays[place] = True
    of = np.repeat(np.arange(len(runs)), sizes)
    shas = pa.array([hashlib.sha256(r.body).digest() for r in runs], pa.binary())
    bodies = pa.nulls(n, pa.binary())
    if texts:
        mine = np.where(stays, of, 0)
        bodies = pa.array([r.body for r in runs], pa.binary()).take(pa.array(mine, mask=~stays))
    columns = [
        ids, ids.take(pa.array(place[of])), pa.array(sizes[of]), shas.take(pa.array(of)),
        pa.array(stays), pa.array(np.full(n, at_end)), pa.array(np.full(n, part, dtype=np.int32)), bodies,
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def groups(
    documents: DataFrame, keep: str = "smallest", normalised: Callable[[Column], Column] | None = None, texts: bool = False
) -> DataFrame:
    """One row per row of ``documents``: doc_id, keep_id, group_size, kept, text_sha256; with ``texts`` also the text of kept rows.

    A group is all rows whose texts are equal after ``normalised`` (by default: as they are); a null text is an empty one.
    The row with the smallest or largest doc_id stays, keep_id is its id. Exactly one row of a group is kept: of rows that
    repeat an id one stays, null ids come last, and a group of null ids alone keeps one of them with a null keep_id.
    An empty table gives no rows; other columns play no part, whatever their names.
    """
    if keep not in KEEP:
        raise ValueError(f"keep is one of {KEEP}")
    largest = keep == "largest"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = (normalised(text) if normalised else text).cast("binary")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body")).select(
        "body", F.substring("body", 1, HEAD_BYTES).alias("head"), F.xxhash64("body").alias("mix"), "doc_id",
        F.monotonically_increasing_id().alias("row"),
    )
    by_id = F.col("doc_id").asc_nulls_first() if largest else F.col("doc_id").asc_nulls_last()
    ranged = rows.repartitionByRange("head", "mix", by_id, "row").sortWithinPartitions("head", "mix", "body", by_id, "row")

    def compare(batches):
        part = TaskContext.get().partitionId()
        for runs, at_end in _runs(batches):
            yield _rows(runs, at_end, part, largest, texts)

    found = saved(ranged.mapInArrow(compare, _FOUND), "exact")
    return _completed(found, largest, texts)


def _completed(found: DataFrame, largest: bool, texts: bool) -> DataFrame:
    """Groups at the ends of partitions added up; there are at most two texts a partition, so that table is small."""
    best, side = (F.max, F.max) if largest else (F.min, F.min)
    at_ends = found.where("open").groupBy(F.col("text_sha").alias("_sha")).agg(
        best("keep_id").alias("_keep"), F.count(F.lit(1)).alias("_size"),
        # The part in which the best id stands; parts of null ids alone lie on the far side.
        side("part").alias("_any"), side(F.when(F.col("keep_id").isNotNull(), F.col("part"))).alias("_part"),
    )
    joined = found.join(F.broadcast(at_ends), F.col("open") & (F.col("text_sha") == F.col("_sha")), "left")
    stays = F.col("stays") & (~F.col("open") | (F.col("part") == F.coalesce("_part", "_any")))
    columns = [
        "doc_id",
        F.when(F.col("open"), F.col("_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(F.col("open"), F.col("_size")).otherwise(F.col("group_size")).alias("group_size"),
        stays.alias("kept"),
        F.lower(F.hex("text_sha")).alias("text_sha256"),
    ]
    if texts:
        columns.append(F.when(stays, F.col("text").cast("string")).alias("text"))
    return joined.select(*columns)


def unique_texts(documents: DataFrame, keep: str = "smallest", normalised: Callable[[Column], Column] | None = None) -> DataFrame:
    """The kept row of every group with its text after ``normalised``: doc_id, text, group_size."""
    return groups(documents, keep, normalised, texts=True).where("kept").select("doc_id", "text", "group_size")
