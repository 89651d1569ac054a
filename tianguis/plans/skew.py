"""Ordered per-key work that holds when one key owns a large part of all rows.

Plain windows and ``collect_list`` put a whole key into one task. Here the keys above
``hot_rows`` are found first with a pre-aggregated count. Only their rows are range-partitioned by
(key, order) into chunks of bounded size; what one chunk owes to the ones before it travels through a
small table with one row per (key, chunk). Where no key is hot, the plain lazy plan is returned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tianguis.session import durable

HOT_ROWS = 1_000  # a key with more rows than this is cut into chunks
CHUNK_ROWS = 2_000_000  # rows of hot keys aimed at per chunk; work on chunks spills, it is not held in memory
BROADCAST_KEYS = 10_000  # a table of keys is broadcast only when it was counted to be smaller
CHUNK = "_chunk"


@dataclass(frozen=True)
class Limits:
    hot_rows: int = HOT_ROWS
    chunk_rows: int = CHUNK_ROWS
    broadcast_keys: int = BROADCAST_KEYS


DEFAULT = Limits()


@dataclass(frozen=True)
class HotKeys:
    """The keys above the limit, their number and the number of their rows."""

    table: DataFrame
    keys: int
    rows: int

    def side(self, limits: Limits) -> DataFrame:
        return F.broadcast(self.table) if self.keys <= limits.broadcast_keys else self.table


def find_hot(df: DataFrame, keys: Sequence[str], limits: Limits = DEFAULT) -> HotKeys | None:
    """Keys with more than ``hot_rows`` rows, or None. Counts are combined before the shuffle."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > limits.hot_rows)
    totals = sizes.agg(F.count("*").alias("k"), F.sum("_rows").alias("r")).first()
    if totals["k"] == 0:
        return None
    return HotKeys(durable(sizes.select(*keys)), totals["k"], totals["r"])


def row_count(df: DataFrame, keys: Sequence[str], limits: Limits = DEFAULT) -> tuple[int, bool]:
    """(number of rows, whether any key has more than ``hot_rows`` of them)."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    found = sizes.agg(F.sum("_rows").alias("n"), F.max("_rows").alias("most")).first()
    return found["n"] or 0, (found["most"] or 0) > limits.hot_rows


def split_hot(df: DataFrame, keys: Sequence[str], hot: HotKeys, limits: Limits = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(rows of cold keys, rows of hot keys)."""
    side = hot.side(limits).select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    same = _same(df, side, keys, "_hot_")
    return df.join(side, same, "left_anti"), df.join(side, same, "left_semi")


def _same(df: DataFrame, other: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """Equal keys, NULL among them: a NULL key may be as hot as any other."""
    return reduce(Column.__and__, (df[k].eqNullSafe(other[f"{prefix}{k}"]) for k in keys))


def beside(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` joined with ``other`` on ``keys``, NULL matching NULL; the keys are those of ``df``."""
    renamed = other.select(*[F.col(c).alias(f"_of_{c}") if c in keys else F.col(c) for c in other.columns])
    return df.join(renamed, _same(df, renamed, keys, "_of_")).drop(*[f"_of_{k}" for k in keys])


def in_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int, limits: Limits = DEFAULT,
    place: str | None = None, ties: Sequence[Column] = (), keep: Callable[[DataFrame], DataFrame] = durable,
) -> DataFrame:
    """``df`` with a chunk number that rises along (keys, order), fixed by writing it (``keep``).

    ``place`` names a further column, a number that rises along (keys, order, ``ties``). A task sorts several chunks where there
    are more of them than the session has shuffle partitions, so that the blocks of the shuffle do not shrink as the rows grow.
    """
    parts = max(2, -(-rows // limits.chunk_rows))
    tasks = min(parts, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = df.repartitionByRange(tasks, *[F.col(k) for k in keys], *order)
    if place is not None or tasks < parts:
        number = place or "_lugar"
        ranged = ranged.sortWithinPartitions(*[F.col(k) for k in keys], *order, *ties).withColumn(number, F.monotonically_increasing_id())
        if tasks < parts:
            # The number holds the task in its upper bits and the row in the lower 33.
            nth = F.least(F.floor(F.col(number).bitwiseAND(F.lit((1 << 33) - 1)) / limits.chunk_rows), F.lit(parts))
            chunk = (F.spark_partition_id() * (parts + 1) + nth).cast("int")
            return keep(ranged.withColumn(CHUNK, chunk).drop(*([] if place else [number])))
    return keep(ranged.withColumn(CHUNK, F.spark_partition_id()))


def carried(chunks: DataFrame, keys: Sequence[str], **sums: Column) -> DataFrame:
    """Per (keys, chunk): the sums over all earlier chunks of the same key."""
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = chunks.groupBy(*keys, CHUNK).agg(*[agg.alias(name) for name, agg in sums.items()])
    return per_chunk.select(
        *keys, CHUNK, *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in sums]
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, limits: Limits = DEFAULT
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without a whole key in one task."""
    plain = Window.partitionBy(*keys).orderBy(*order)
    hot = find_hot(df, keys, limits)
    if hot is None:
        return df.withColumn(name, F.row_number().over(plain))
    cold_rows, hot_rows = split_hot(df, keys, hot, limits)
    chunks = in_chunks(hot_rows, keys, order, hot.rows, limits)
    offsets = carried(chunks, keys, _before=F.count("*"))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    numbered = (
        beside(chunks.withColumn(name, F.row_number().over(inside)), offsets, [*keys, CHUNK])
        .withColumn(name, (F.col(name) + F.col("_before")).cast("int"))
        .select(*df.columns, name)
    )
    return cold_rows.withColumn(name, F.row_number().over(plain)).unionByName(numbered)


def previous_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, limits: Limits = DEFAULT
) -> DataFrame:
    """``lag(value) over (partition by keys order by order)`` without a whole key in one task."""
    plain = Window.partitionBy(*keys).orderBy(*order)
    hot = find_hot(df, keys, limits)
    if hot is None:
        return df.withColumn(name, F.lag(value).over(plain))
    cold_rows, hot_rows = split_hot(df, keys, hot, limits)
    chunks = in_chunks(hot_rows, keys, [F.col(c) for c in order], hot.rows, limits)
    last = chunks.groupBy(*keys, CHUNK).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    entering = last.select(*keys, CHUNK, F.lag("_last").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("_in"))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    inner = chunks.withColumn("_rn", F.row_number().over(inside)).withColumn(name, F.lag(value).over(inside))
    lagged = (
        beside(inner, entering, [*keys, CHUNK])
        .withColumn(name, F.when(F.col("_rn") == 1, F.col("_in")[value]).otherwise(F.col(name)))
        .select(*df.columns, name)
    )
    return cold_rows.withColumn(name, F.lag(value).over(plain)).unionByName(lagged)
