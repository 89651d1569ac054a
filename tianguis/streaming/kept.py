"""Live figures kept up to date: a micro-batch adds its own groups to those kept, and no earlier row is read again.

The groups are those of the report (:func:`report.grouped`). A micro-batch writes the groups of its rows alone, combined before
the shuffle. Now and then the groups so far are merged into one table, so a reader takes that table and a bounded
number of later ones, however long the stream runs. Groups are as many as there are roles, states, months, methods,
sellers and products. Rows are taken as new ones; :mod:`retract` serves orders whose state changes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tianguis.plans import report
from tianguis.streaming import jobs
from tianguis.streaming.jobs import BATCH, Finished, _finish

TABLES = ("usuarios", "productos", "ordenes", "pagos", "orden_detalles")
_LAST = f"{BATCH} long"


def _added(groups: DataFrame, schema: T.StructType) -> DataFrame:
    """Groups of several parts as those of all rows, in the types of the groups of one part."""
    measures = [f for f in schema.fields if f.name not in _keys(schema)]
    return groups.groupBy(*_keys(schema)).agg(*[F.sum(f.name).cast(f.dataType).alias(f.name) for f in measures]).select(*schema.names)


def _keys(schema: T.StructType) -> list[str]:
    return [c for c in schema.names if c in ("rol", "estado", "mes", "metodo_pago", "id_vendedor", "id_producto")]


def _before(spark: SparkSession, folder: str, number: int, merged: int, schema: T.StructType) -> DataFrame:
    """The groups of the micro-batches below ``number``, of which those below ``merged`` are one table."""
    paths = [f"{folder}/hasta={merged}"] * (merged > 0) + [f"{folder}/{BATCH}={n}" for n in range(merged, number)]
    return _added(spark.read.schema(schema).parquet(*paths), schema)


def run_figures(rows: DataFrame, table: str, path: str) -> Finished:
    """Consume all new ``rows`` of ``table``; a repeated micro-batch overwrites what it wrote."""
    folder = f"{path}/{table}"

    def store(batch: DataFrame, number: int) -> None:
        spark, groups = batch.sparkSession, report.grouped(table, batch)
        if number and number % jobs.MERGE_EVERY == 0:
            before = _before(spark, folder, number, number - jobs.MERGE_EVERY, groups.schema)
            before.write.mode("overwrite").parquet(f"{folder}/hasta={number}")
        groups.write.mode("overwrite").parquet(f"{folder}/{BATCH}={number}")
        # Readers go by this number, so they never meet what is half written. Two places take turns.
        spark.createDataFrame([(number,)], _LAST).write.mode("overwrite").parquet(f"{folder}/ultimo/turno={number % 2}")

    return _finish(rows.sparkSession, rows.writeStream.foreachBatch(store), folder)


def figures(spark: SparkSession, table: str, path: str, schema: T.StructType) -> DataFrame:
    """The groups of all rows of ``table`` so far; ``schema`` is that of the rows. Empty where no micro-batch has run."""
    folder = f"{path}/{table}"
    groups = report.grouped(table, spark.createDataFrame([], schema))
    try:
        last = spark.read.schema(_LAST).parquet(f"{folder}/ultimo").agg(F.max(BATCH)).first()[0]
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in (err.getCondition() or str(err)):
            raise
        return groups
    return _before(spark, folder, last + 1, last - last % jobs.MERGE_EVERY, groups.schema)


def bases(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> report.Bases:
    """What the report needs of four tables, from the groups kept."""
    return report.Bases(**{t: figures(spark, t, path, schemas[t]) for t in TABLES if t != "orden_detalles"})


def live(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> DataFrame:
    """The live figures as one row, from the groups kept alone; ``schemas``: those of the rows of all :data:`TABLES`."""
    return report.live_of(bases(spark, path, schemas), figures(spark, "orden_detalles", path, schemas["orden_detalles"]))
