"""Base tables in buckets of their key, so that a change log reads and writes only the buckets it touches.

A bucket is a partition folder. A log is applied to the touched buckets alone; the result is written to the shared folder
first and then takes their place by dynamic partition overwrite. Every bucket that was written holds one marker row besides,
so a bucket whose rows are all deleted is overwritten as well.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tianguis.operators.changes import Applied
from tianguis.session import shared_path

BUCKET, MARKER = "cubo", "_marca"


def bucket(keys: Sequence[Column], buckets: int) -> Column:
    """The bucket of a key; NULL is a key like any other."""
    return F.pmod(F.xxhash64(*[k.cast("string") for k in keys]), F.lit(buckets)).cast("int")


def _store(rows: DataFrame, path: str, mode: str | None) -> None:
    # The rebalance gathers a bucket in one task and splits one that is larger than a task should write.
    writer = rows.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET)
    (writer.option("partitionOverwriteMode", mode) if mode else writer).parquet(path)


def write(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """``df`` as a table of ``buckets`` buckets by ``keys``. Choose so many that a bucket is what a task should read."""
    _store(df.withColumn(MARKER, F.lit(False)).withColumn(BUCKET, bucket([F.col(k) for k in keys], buckets)), path, None)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    whole = T.StructType([*schema.fields, T.StructField(MARKER, T.BooleanType()), T.StructField(BUCKET, T.IntegerType())])
    return spark.read.schema(whole).parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType, only: Sequence[int] | None = None) -> DataFrame:
    """The table, or the buckets ``only``; the others are not even listed by the scan."""
    rows = _stored(spark, path, schema)
    if only is not None:
        rows = rows.filter(F.col(BUCKET).isin(list(only)))
    return rows.filter(~F.col(MARKER)).select(*schema.names)


def apply_log(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int,
    log: DataFrame, log_keys: Sequence[str], apply: Callable[[DataFrame, DataFrame], Applied],
) -> tuple[DataFrame, list[int]]:
    """Apply ``log`` to the table at ``path``; gives the refused entries and the buckets that were rewritten.

    ``apply`` must judge an entry by rows of its own key alone. ``keys`` and ``buckets`` are those the table was written with,
    ``log_keys`` the columns of the log that name a row. At most ``buckets`` numbers come to the driver.
    """
    here = bucket([F.col(k).cast(schema[t].dataType) for k, t in zip(log_keys, keys, strict=True)], buckets)
    touched = sorted(r[0] for r in log.select(here.alias(BUCKET)).distinct().collect())
    done = apply(read(spark, path, schema, touched), log)
    rejects = shared_path(spark, "rejects")
    done.rejects.write.parquet(rejects)
    if touched:
        after = done.table.select(*schema.names).withColumn(MARKER, F.lit(False)).withColumn(BUCKET, bucket([F.col(k) for k in keys], buckets))
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
        marks = spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int").select(*none, F.lit(True).alias(MARKER), BUCKET)
        staged = shared_path(spark, "buckets")
        after.unionByName(marks).write.parquet(staged)
        _store(spark.read.schema(after.schema).parquet(staged), path, "dynamic")
    return spark.read.schema(done.rejects.schema).parquet(rejects), touched
