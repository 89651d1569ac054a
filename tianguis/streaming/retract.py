"""Monthly sales under changing order states: a change takes back what the order counted for and counts it anew.

A micro-batch reduces its rows per order, compares the result with the state its orders had, and writes the differences
per month; their sum is the report. States are kept as changes, merged into one table now and then, so a micro-batch reads a
bounded number of files however long the stream runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tianguis.functions import money
from tianguis.functions.domain import in_domain
from tianguis.operators.sales import month
from tianguis.streaming import jobs
from tianguis.streaming.jobs import BATCH, Finished, _finish

_VALUES = ("mes", "total", "estado", "ultimo")


def _states(spark: SparkSession, state: str, number: int, merged: int, schema: str) -> DataFrame:
    """The newest state of every order after the micro-batches below ``number``."""
    paths = [f"{state}/hasta={merged}"] * (merged > 0) + [f"{state}/{BATCH}={n}" for n in range(merged, number)]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.groupBy("id").agg(F.max_by(F.struct(*_VALUES), "visto").alias("v")).select("id", "v.*")


def run_sales(entries: DataFrame, path: str, order: Sequence[str]) -> Finished:
    """Consume entries of orders: a row with a total opens the order, one without changes its state.

    ``entries``: id, total, fecha, estado and the ``order`` columns, by which the last valid state wins, in whatever micro-batch
    it comes. A state outside the domain changes nothing. A change that comes before its order waits in the state.
    """
    state, done = f"{path}/state", f"{path}/data"
    kinds = ",".join(f"{c}:{entries.schema[c].dataType.simpleString()}" for c in order)
    schema = f"id {entries.schema['id'].dataType.simpleString()}, mes string, total decimal(12,2), estado string, ultimo struct<{kinds}>, visto int"

    def store(batch: DataFrame, number: int) -> None:
        spark, merged = batch.sparkSession, number - number % jobs.MERGE_EVERY
        if number and number == merged:
            before = _states(spark, state, number, number - jobs.MERGE_EVERY, schema)
            before.withColumn("visto", F.lit(number - 1)).write.mode("overwrite").parquet(f"{state}/hasta={number}")
        valid = F.coalesce(in_domain(F.col("estado"), "ordenes", "estado"), F.lit(False))
        opens, at = F.col("total").isNotNull(), F.struct(*order)
        # Combined per order in every task before the shuffle. The opening state has no moment: any change is newer.
        new = batch.groupBy("id").agg(
            F.max(F.when(opens, month("fecha"))).alias("n_mes"), F.max(F.when(opens, F.col("total"))).cast("decimal(12,2)").alias("n_total"),
            F.max(F.when(opens, F.col("estado"))).alias("n_inicial"), F.max(F.when(~opens & valid, at)).alias("n_ultimo"),
            F.max_by(F.when(~opens & valid, F.col("estado")), F.when(~opens & valid, at)).alias("n_estado"),
        )
        known = _states(spark, state, number, merged, schema).join(new.select("id"), "id", "left_semi")
        newer = F.col("n_ultimo").isNotNull() & (F.col("ultimo").isNull() | (F.col("n_ultimo") > F.col("ultimo")))
        both = new.join(known, "id", "left").select(
            "id", "mes", "total", "estado",
            F.coalesce("mes", "n_mes").alias("m"), F.coalesce("total", "n_total").alias("t"),
            F.when(newer, F.col("n_estado")).otherwise(F.coalesce("estado", "n_inicial")).alias("e"),
            F.when(newer, F.col("n_ultimo")).otherwise(F.col("ultimo")).alias("u"),
        )
        here = f"{state}/{BATCH}={number}"
        own = both.select(
            "id", F.col("m").alias("mes"), F.col("t").alias("total"), F.col("e").alias("estado"), F.col("u").alias("ultimo"),
            F.lit(number).alias("visto"), F.struct(F.col("mes").alias("mes"), F.col("total").alias("total"), F.col("estado").alias("estado")).alias("antes"),
        )
        own.write.mode("overwrite").parquet(here)
        written = spark.read.schema(own.schema).parquet(here)
        sides = written.select(F.col("antes.mes").alias("mes"), F.col("antes.total").alias("total"), F.col("antes.estado").alias("estado"), F.lit(-1).alias("s"))
        sides = sides.unionByName(written.select("mes", "total", "estado", F.lit(1).alias("s"))).filter("total is not null")
        paid = F.when(F.col("estado") == "pagada", F.col("total") * F.col("s")).otherwise(F.lit(0))
        sides.groupBy("mes").agg(F.sum("s").alias("num_ordenes"), F.sum(paid).cast("decimal(38,2)").alias("ingresos")).filter(
            "num_ordenes <> 0 or ingresos <> 0"
        ).write.mode("overwrite").parquet(f"{done}/{BATCH}={number}")

    return _finish(entries.sparkSession, entries.writeStream.foreachBatch(store), path)


def months(spark: SparkSession, done: Finished) -> DataFrame:
    """Orders and paid revenue per month: the sum of all differences."""
    sums = spark.read.parquet(done.path).groupBy("mes").agg(F.sum("num_ordenes").alias("num_ordenes"), money.total(F.col("ingresos")).alias("ingresos"))
    return sums.filter("num_ordenes > 0")
