"""Rows out of time order: held back until the watermark passes, or written aside with a reason when they come too late.

The watermark of a micro-batch is the newest event time seen before it less the delay. It and the rows held back live in two
folders that micro-batches use by turns, so a repeated one reads what it read before and old ones leave nothing behind.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tianguis.functions import money
from tianguis.streaming.jobs import BATCH, Finished, _finish

#: Texts of our own: why a row is not counted.
TOO_LATE = "Fuera de plazo"
UNDATED = "Sin fecha"
_TOP = "lote int, tope string"


def _turn(path: str, kind: str, number: int) -> str:
    return f"{path}/{kind}/turno={number % 2}"


def _top_before(spark: SparkSession, path: str, number: int) -> str | None:
    """The newest event time before micro-batch ``number``, as text."""
    if number == 0:
        return None
    return spark.read.schema(_TOP).parquet(_turn(path, "tope", number - 1)).first()["tope"]


def _keep_top(rows: DataFrame, time: str, path: str, number: int, before: str | None) -> str | None:
    newest = rows.agg(F.max(time).cast("string")).first()[0]
    top = max((t for t in (newest, before) if t is not None), default=None)
    rows.sparkSession.createDataFrame([(number, top)], _TOP).write.mode("overwrite").parquet(_turn(path, "tope", number))
    return top


def _bound(top: str | None, kind: T.DataType, delay: str) -> Column:
    return F.lit(top).cast(kind) - F.expr(f"interval {delay}")


def released(batch: DataFrame, time: str, path: str, number: int, delay: str) -> DataFrame:
    """Rows of this and earlier micro-batches whose time the watermark has passed; the others wait. Rows without a time do not."""
    spark, kind = batch.sparkSession, batch.schema[time].dataType
    rows = batch
    if number:
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(_turn(path, "espera", number - 1)))
    top = _keep_top(rows, time, path, number, _top_before(spark, path, number))
    waits = F.coalesce(F.col(time) > _bound(top, kind, delay), F.lit(False))
    rows.filter(waits).write.mode("overwrite").parquet(_turn(path, "espera", number))
    return rows.filter(~waits)


def held(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, int] | None:
    """(rows that still wait, newest micro-batch), or None where no micro-batch has run."""
    try:
        last = spark.read.schema(_TOP).parquet(f"{path}/tope").agg(F.max("lote")).first()[0]
    except AnalysisException:
        return None
    return spark.read.schema(schema).parquet(_turn(path, "espera", last)), last


def run_movement_windows(movimientos: DataFrame, path: str, width: str = "1 hour", delay: str = "2 days") -> Finished:
    """Movements per type and window; a row whose window the watermark has closed, or without a time, is written to ``tardias`` with its reason.

    A micro-batch adds its own sums per window, so kept rows and those set aside together are the input; :func:`windows` adds them up.
    """
    late_rows = 0

    def store(batch: DataFrame, number: int) -> None:
        nonlocal late_rows
        batch = batch.persist()
        kind = batch.schema["fecha"].dataType
        bound = _bound(_top_before(batch.sparkSession, path, number), kind, delay)
        # A row without a time has no window, so it is set aside before any is asked for.
        undated = batch.filter("fecha is null").withColumn("motivo", F.lit(UNDATED))
        closes = F.window("fecha", width)["end"].cast(kind)
        marked = batch.filter("fecha is not null").withColumn("_tarde", F.coalesce(closes <= bound, F.lit(False)))
        late = marked.filter("_tarde").drop("_tarde").withColumn("motivo", F.lit(TOO_LATE)).unionByName(undated)
        late.write.mode("overwrite").parquet(f"{path}/tardias/{BATCH}={number}")
        sums = marked.filter(~F.col("_tarde")).groupBy(F.window("fecha", width)["start"].cast("timestamp_ntz").alias("desde"), "tipo")
        sums.agg(F.count("*").alias("cantidad"), F.sum("monto").cast("decimal(38,2)").alias("monto")).write.mode("overwrite").parquet(
            f"{path}/data/{BATCH}={number}"
        )
        late_rows += late.count()
        _keep_top(batch, "fecha", path, number, _top_before(batch.sparkSession, path, number))
        batch.unpersist()

    done = _finish(movimientos.sparkSession, movimientos.writeStream.foreachBatch(store), path)
    return Finished(done.path, done.batches, late_rows)


def windows(spark: SparkSession, path: str) -> DataFrame:
    """Counts and amounts per window and type over all micro-batches."""
    sums = spark.read.parquet(f"{path}/data").groupBy("desde", "tipo")
    return sums.agg(F.sum("cantidad").alias("cantidad"), money.total(F.col("monto")).alias("monto_total"))


def late(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came too late, with the micro-batch that met them and the reason."""
    return spark.read.parquet(f"{path}/tardias")


