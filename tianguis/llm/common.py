"""Tables written to the shared folder, tokenising by white space, and rows of a sorted partition taken run by run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tianguis.session import removed, shared_path, shuffles_removed

#: Rows of one block of a large group; a group of more rows is handled in pairs of blocks.
BLOCK_ROWS = 1024
#: Rows up to which a written table of a few numbers a row is sent to every task instead of shuffling texts to it.
SENT_ROWS = 1_000_000


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that nothing before it is computed again; its shuffles are removed."""
    path = shared_path(df.sparkSession, purpose)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Take away tables of :func:`saved` that nothing reads any more."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            removed(table.sparkSession, folder)


def counted(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written and counted: marked for broadcast if it has at most SENT_ROWS rows, plain beyond."""
    table = saved(df, purpose)
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, cut at space and \\x09-\\x0D; none of a null text."""
    return text.lower().split() if text else []


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def text_only(documents: DataFrame, *names: str) -> DataFrame:
    """The given columns of ``documents`` and its text as a string; other columns play no part."""
    return documents.select(*names, F.col("text").cast("string").alias("text"))


def complete_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal non-null ``keys`` in sorted batches, each with the index where every run begins."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        starts = _starts(table, keys)
        if len(starts) > 1:
            cut = int(starts[-1])
            yield table.slice(0, cut).combine_chunks(), starts[:-1]
            rest = table.slice(cut)
        elif table.num_rows:
            rest = table
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), _starts(rest, keys)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    if not table.num_rows:
        return np.empty(0, dtype=np.int64)
    new[0] = True
    for k in keys:
        column = table.column(k).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def pairs_in_runs(starts: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, i + d) within each run, one distance d at a time: never more than ``rows`` pairs in memory."""
    end = np.repeat(np.append(starts[1:], rows), np.diff(np.append(starts, rows)))
    left = np.arange(rows)
    d = 1
    while True:
        left = left[left + d < end[left]]
        if not len(left):
            return
        yield left, left + d
        d += 1


def in_blocks(df: DataFrame, key: str, identity: str, block: int = BLOCK_ROWS) -> DataFrame:
    """Rows of keys that hold two rows or more, each copied to the pairs of blocks it belongs to.

    A key of up to ``block`` rows is one pair (0, 0). A larger key is dealt into blocks by ``identity``; every pair of
    blocks is a group of its own, so no task holds more than about two blocks and no pair of rows is left out.
    Adds block_i, block_j, block.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(identity), F.col("_blocks").cast("long")).cast("int")
    return (
        df.join(sizes, key)
        .withColumn("_blocks", blocks)
        .withColumn("block", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("block_i", F.least("block", "_other"))
        .withColumn("block_j", F.greatest("block", "_other"))
        .drop("_n", "_blocks", "_other")
    )


def per_block_pair(df: DataFrame, key: str, fn, schema: str) -> DataFrame:
    """Apply ``fn(table, starts)`` to the pairs of blocks of :func:`in_blocks`, many small ones at a time."""
    keys = [key, "block_i", "block_j"]

    def run(batches):
        for table, starts in complete_runs(batches, keys):
            yield from fn(table, starts)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


class Forest:
    """Union-find over the few links of one batch; ``links`` are those that joined two trees."""

    def __init__(self):
        self._parent: dict[int, int] = {}

    def _root(self, x: int) -> int:
        parent = self._parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` were in different trees."""
        a, b = self._root(a), self._root(b)
        if a != b:
            self._parent[max(a, b)] = min(a, b)
        return a != b
