"""Checks of relations no schema enforces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tianguis.functions import money
from tianguis.operators.payments import account_statement
from tianguis.plans import skew


def reconcile_orders(ordenes: DataFrame, pagos: DataFrame) -> DataFrame:
    """Orders that are fully paid but still pendiente."""
    statement = account_statement(ordenes, pagos)
    return statement.filter((F.col("estado_pago") == "liquidada") & (F.col("estado_orden") == "pendiente")).select(
        "id_orden", "monto_total_orden", "total_pagado_acumulado"
    )


def ledger_breaks(
    movimientos: DataFrame, order: Sequence[str] = ("fecha", "id"), limits: skew.Limits = skew.DEFAULT
) -> DataFrame:
    """Movements that do not start from the amount the user's previous movement ended at."""
    previous = skew.previous_values(movimientos, ["usuario_id"], list(order), "cupo_despues", "cupo_anterior", limits)
    return previous.filter(F.col("cupo_anterior") != F.col("cupo_antes")).select(
        "usuario_id", *order, "cupo_anterior", "cupo_antes"
    )


def reconcile_totals(ordenes: DataFrame, detalles: DataFrame) -> DataFrame:
    """Orders whose total differs from the sum of their lines."""
    lines = detalles.groupBy(F.col("id_orden").alias("id")).agg(
        F.sum(F.col("cantidad") * F.col("precio_unitario")).alias("suma")
    )
    summed = F.coalesce("suma", F.lit(0).cast("decimal(12,2)"))
    return (
        ordenes.join(lines, "id", "left")
        .filter(F.col("total") != summed)
        .select(
            F.col("id").alias("id_orden"), money.as_double("total").alias("total"),
            summed.cast("double").alias("suma_lineas"), (summed - F.col("total")).cast("double").alias("diferencia"),
        )
    )


def orphans(children: DataFrame, key: str, parents: DataFrame, kind: str, parent_key: str = "id") -> DataFrame:
    """Keys of child rows that have no parent, with the number of such rows.

    Children are counted per key before they meet the parents.
    """
    return (
        children.groupBy(F.col(key).alias("clave"))
        .agg(F.count("*").alias("filas"))
        .join(parents.select(F.col(parent_key).alias("clave")), "clave", "left_anti")
        .select(F.lit(kind).alias("relacion"), "clave", "filas")
    )
