"""Catalog: public listing, stock, price statistics, inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tianguis.functions import money
from tianguis.functions.text import SELLER_DEFAULT


def active_catalog(productos: DataFrame, usuarios: DataFrame) -> DataFrame:
    """Active and approved products with the seller's name, or a default where there is none."""
    sellers = usuarios.select(F.col("id").alias("id_vendedor"), F.col("nombre").alias("vendedor_nombre"))
    return (
        productos.filter(F.col("activo") & F.col("aprobado"))
        .join(sellers, "id_vendedor", "left")
        .select(
            "id", "id_vendedor", "nombre", "descripcion", money.as_double("precio").alias("precio"), "cantidad",
            F.coalesce(F.nullif("vendedor_nombre", F.lit("")), F.lit(SELLER_DEFAULT)).alias("vendedor"),
        )
    )


def top_stock(productos: DataFrame, k: int = 8) -> DataFrame:
    return (
        productos.filter("activo")
        .orderBy(F.desc("cantidad"), "id")
        .limit(k)
        .select(
            "id", "nombre", money.as_double("precio").alias("precio"), "cantidad",
            (F.col("precio") * F.col("cantidad")).cast("double").alias("valor_inventario"),
        )
    )


def price_stats(productos: DataFrame) -> DataFrame:
    return productos.agg(
        money.mean(F.col("precio")).alias("promedio"),
        F.max("precio").cast("double").alias("maximo"),
        F.min("precio").cast("double").alias("minimo"),
    )


def price_stats_active(productos: DataFrame) -> DataFrame:
    return productos.filter("activo").agg(
        money.mean(F.col("precio")).alias("precio_promedio"),
        F.min("precio").cast("double").alias("precio_minimo"),
        F.max("precio").cast("double").alias("precio_maximo"),
        money.total(F.col("precio") * F.col("cantidad")).alias("valor_total_inventario"),
    )


def price_histogram(productos: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins from the lowest to the highest price, the last one closed; empty bins count 0.

    Bins are cut in whole cents. One single price widens the range by half a unit on both sides.
    """
    price = money.cents("precio")
    lowest, highest = F.min(price), F.max(price)
    slack = F.when(lowest == highest, 50).otherwise(0)
    span = productos.agg(F.struct((lowest - slack).alias("a"), (highest + slack).alias("b")).alias("_span")).scalar()
    low, high = F.col("_span.a"), F.col("_span.b")
    counted = (
        productos.select(price.alias("_price"), span.alias("_span"))
        .select(F.least(money.div((F.col("_price") - low) * bins, high - low), F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    width = (high - low).cast("double") / (100 * bins)
    frame = productos.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), span.alias("_span"))
    return (
        frame.filter(low.isNotNull())
        .select("bin", (low.cast("double") / 100 + F.col("bin") * width).alias("desde"))
        .join(counted, "bin", "left")
        .select("bin", "desde", F.coalesce("n", F.lit(0).cast("bigint")).alias("cantidad"))
        .orderBy("bin")
    )


def inventory_by_seller(productos: DataFrame, k: int = 5) -> DataFrame:
    return (
        productos.groupBy("id_vendedor")
        .agg(
            F.count("*").alias("num_productos"),
            money.mean(F.col("precio")).alias("precio_promedio"),
            money.total(F.col("precio") * F.col("cantidad")).alias("valor_inventario"),
        )
        .orderBy(F.desc("num_productos"), "id_vendedor")
        .limit(k)
        .withColumnRenamed("id_vendedor", "vendedor_id")
    )
