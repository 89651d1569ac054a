"""Sales by product and by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tianguis.functions import money
from tianguis.functions.text import product_name


def month(ts: Column | str) -> Column:
    """Calendar month as yyyy-MM; text that is no timestamp gives NULL."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(column.try_cast("timestamp"), "yyyy-MM")


def sales_by_product(detalles: DataFrame) -> DataFrame:
    return detalles.groupBy("id_producto").agg(
        F.count("*").alias("veces_vendido"),
        F.sum("cantidad").alias("unidades"),
        F.sum(F.col("cantidad") * F.col("precio_unitario")).alias("ingresos"),
    )


def top_products(detalles: DataFrame, productos: DataFrame, k: int = 5) -> DataFrame:
    """The k best sellers by units, then their names; a product the catalog lacks keeps a label."""
    best = sales_by_product(detalles).orderBy(F.desc("unidades"), "id_producto").limit(k)
    names = productos.select(F.col("id").alias("id_producto"), "nombre")
    order = Window.orderBy(F.desc("unidades"), "id_producto")  # over at most k rows
    return (
        best.join(names, "id_producto", "left")
        .select(
            F.row_number().over(order).alias("rank"),
            F.col("id_producto").alias("id"),
            product_name(F.col("nombre"), F.col("id_producto")).alias("nombre"),
            F.col("unidades").alias("unidades_vendidas"),
            F.coalesce(F.col("ingresos"), F.lit(0)).cast("double").alias("ingresos"),
        )
        .orderBy("rank")
    )


def top_products_inner(detalles: DataFrame, productos: DataFrame, k: int = 5) -> DataFrame:
    """Names first, then the cut: a product the catalog lacks cannot take a place."""
    sold = detalles.groupBy("id_producto").agg(F.sum("cantidad").alias("total_vendido"))
    return (
        sold.join(productos.select("id", "nombre"), F.col("id_producto") == F.col("id"), "inner")
        .select("id", "nombre", "total_vendido")
        .orderBy(F.desc("total_vendido"), "id")
        .limit(k)
    )


def top_products_live(detalles: DataFrame, k: int = 5, times_sold: bool = True) -> DataFrame:
    return best_live(sales_by_product(detalles), k, times_sold)


def best_live(sold: DataFrame, k: int = 5, times_sold: bool = True) -> DataFrame:
    """The k best of products whose sales are summed already."""
    best = sold.orderBy(F.desc("unidades"), "id_producto").limit(k)
    columns = ["id_producto", *(["veces_vendido"] if times_sold else []), "unidades"]
    return best.select(*columns, F.col("ingresos").cast("double").alias("ingresos"))


def revenue_by_month(ordenes: DataFrame) -> DataFrame:
    """Paid orders only; a month without one is absent."""
    return (
        ordenes.filter(F.col("estado") == "pagada")
        .groupBy(month("fecha").alias("mes"))
        .agg(money.total(F.col("total")).alias("ingresos"), F.count("*").alias("num_ordenes"))
        .orderBy("mes")
    )


def sales_by_month(ordenes: DataFrame) -> DataFrame:
    """Every order is counted, only paid ones are summed."""
    paid = F.when(F.col("estado") == "pagada", F.col("total")).otherwise(F.lit(0))
    return (
        ordenes.groupBy(month("fecha").alias("mes"))
        .agg(F.count("*").alias("num_ordenes"), money.total(paid).alias("ingresos"))
        .orderBy("mes")
    )


def orders_by_state(ordenes: DataFrame) -> DataFrame:
    return ordenes.groupBy("estado").agg(F.count("*").alias("cantidad"))


def orders_by_state_amount(ordenes: DataFrame) -> DataFrame:
    return ordenes.groupBy("estado").agg(F.count("*").alias("cantidad"), money.total(F.col("total")).alias("monto"))
