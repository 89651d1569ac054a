"""One-row summaries. Every table is scanned once and no frames are crossed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tianguis.functions import money


def _is(column: str, value: str) -> Column:
    return F.col(column) == value


def summary_users(usuarios: DataFrame) -> DataFrame:
    return usuarios.agg(
        F.count("*").alias("total_usuarios"),
        F.count_if(_is("rol", "comprador")).alias("compradores"),
        F.count_if(_is("rol", "vendedor")).alias("vendedores"),
        F.count_if(_is("rol", "admin")).alias("admins"),
        F.count_if(_is("estado", "activo")).alias("usuarios_activos"),
        F.count_if(_is("estado", "pendiente")).alias("usuarios_pendientes"),
    )


def summary_products(productos: DataFrame) -> DataFrame:
    """The total and the average price take every product, active or not."""
    return productos.agg(
        F.count("*").alias("total_productos"),
        F.count_if("activo").alias("productos_activos"),
        money.mean(F.col("precio")).alias("precio_promedio"),
    )


def summary_orders(ordenes: DataFrame) -> DataFrame:
    paid = _is("estado", "pagada")
    return ordenes.agg(
        F.count("*").alias("total_ordenes"),
        F.count_if(paid).alias("ordenes_pagadas"),
        F.count_if(_is("estado", "pendiente")).alias("ordenes_pendientes"),
        money.total(F.when(paid, F.col("total"))).alias("ingresos_totales"),
    )


def summary_payments(pagos: DataFrame) -> DataFrame:
    """Every payment counts, whatever its state."""
    return pagos.agg(F.count("*").alias("total_pagos"), money.total(F.col("monto")).alias("monto_total_pagado"))


def beside(*one_row: DataFrame) -> DataFrame:
    """One-row frames with distinct columns side by side, without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def summary(usuarios: DataFrame, productos: DataFrame, ordenes: DataFrame, pagos: DataFrame) -> DataFrame:
    return beside(summary_users(usuarios), summary_products(productos), summary_orders(ordenes), summary_payments(pagos))


def live_summary(usuarios: DataFrame, productos: DataFrame, ordenes: DataFrame, pagos: DataFrame) -> DataFrame:
    """The live variant: only active products are counted."""
    paid = _is("estado", "pagada")
    return beside(
        usuarios.agg(F.count("*").alias("total_usuarios")),
        productos.agg(F.count_if("activo").alias("total_productos")),
        ordenes.agg(
            F.count("*").alias("total_ordenes"),
            F.count_if(paid).alias("ordenes_pagadas"),
            money.total(F.when(paid, F.col("total"))).alias("ingresos_totales"),
        ),
        summary_payments(pagos),
    )


def admin_counters(usuarios: DataFrame) -> DataFrame:
    """Counters with whole percents of the total and bars relative to the largest role."""
    counts = usuarios.agg(
        F.count("*").alias("total"),
        *[F.count_if(_is("estado", s)).alias(n) for n, s in (
            ("activos", "activo"), ("pendientes", "pendiente"), ("rechazados", "rechazado"))],
        *[F.count_if(_is("rol", r)).alias(n) for n, r in (
            ("compradores", "comprador"), ("vendedores", "vendedor"), ("admins", "admin"))],
    )
    shares = ("activos", "pendientes", "rechazados", "compradores", "vendedores")
    roles = ("compradores", "vendedores", "admins")
    largest = F.greatest(*[F.col(r) for r in roles], F.lit(1))

    def percent(n: str, whole: Column) -> Column:
        return F.coalesce(money.div_half_up(F.col(n) * 100, whole), F.lit(0).cast("bigint"))

    return counts.select(
        "*",
        *[percent(n, F.col("total")).alias(f"pct_{n}") for n in shares],
        *[percent(n, largest).alias(f"barra_{n}") for n in roles],
    )
