"""Credit lines, instalments and movements: statistics, panels, histories, openings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tianguis.functions import money
from tianguis.functions.text import MOVEMENT_CLASS_DEFAULT, MOVEMENT_CLASSES, label
from tianguis.plans import skew

# Opening limit, its movement text, and the panel texts.
OPENING_LIMIT = 100000
OPENING_TEXT = "Apertura de línea de crédito inicial"
NO_LINE = "Sin datos de credito"
NEARLY_USED = "Casi agotado"
LINE_OK = "Cuenta activa"
PURCHASES_PER_RAISE = 3


def credit_stats(creditos: DataFrame) -> DataFrame:
    used = F.coalesce(F.sum("cupo_total") - F.sum("cupo_disponible"), F.lit(0))
    return creditos.agg(
        money.mean(F.col("cupo_total")).alias("cupo_promedio"),
        money.mean(F.col("cupo_disponible")).alias("disponible_promedio"),
        used.cast("double").alias("cupo_usado_total"),
        F.count("*").alias("total_lineas"),
    )


def credit_stats_by_state(creditos: DataFrame) -> DataFrame:
    """Per state; a line with one side missing does not enter the used sum."""
    return creditos.groupBy("estado").agg(
        F.count("*").alias("total_lineas"),
        money.mean(F.col("cupo_total")).alias("cupo_promedio"),
        money.mean(F.col("cupo_disponible")).alias("disponible_promedio"),
        money.total(F.col("cupo_total") - F.col("cupo_disponible")).alias("cupo_usado_total"),
        F.count("*").alias("cantidad"),
    )


def movements_by_type(movimientos: DataFrame) -> DataFrame:
    return (
        movimientos.groupBy("tipo")
        .agg(F.count("*").alias("cantidad"), money.total(F.col("monto")).alias("monto_total"))
        .orderBy(F.desc("cantidad"), "tipo")
    )


def movement_history(movimientos: DataFrame, newest: int = 20) -> DataFrame:
    """The newest movements of every user, signed and classed.

    The rank filter is applied in every task before the shuffle (WindowGroupLimit), so a user with
    any number of movements sends at most ``newest`` rows per task.
    """
    latest = Window.partitionBy("usuario_id").orderBy(F.desc("fecha"), F.desc("id"))
    amount = F.coalesce(F.col("monto"), F.lit(0).cast("decimal(12,2)"))
    return (
        movimientos.withColumn("posicion", F.row_number().over(latest))
        .filter(F.col("posicion") <= newest)
        .select(
            "usuario_id", "posicion", "id", "tipo", money.as_double("monto").alias("monto"), "fecha",
            F.when(F.col("tipo") == "compra", -amount).otherwise(amount).cast("double").alias("monto_con_signo"),
            label(F.col("tipo"), MOVEMENT_CLASSES, F.lit(MOVEMENT_CLASS_DEFAULT)).alias("clase"),
        )
    )


def credit_panel(usuarios: DataFrame, creditos: DataFrame) -> DataFrame:
    """Buyers with their line: used amount (not below 0), use in percent, label, purchases to the next raise."""
    line = creditos.select(
        F.col("usuario_id").alias("id"), "cupo_total", "cupo_disponible", "compras_completadas",
        F.lit(True).alias("con_linea"),
    )
    used = F.greatest(F.col("cupo_total") - F.col("cupo_disponible"), F.lit(0).cast("decimal(12,2)"))
    rows = (
        usuarios.filter(F.col("rol") == "comprador")
        .select("id", "nombre", "email")
        .join(line, "id", "left")
        .withColumn("usado", used)
        .withColumn("_u", money.cents("usado"))
        .withColumn("_t", money.cents("cupo_total"))
    )
    has = F.col("con_linea").isNotNull()

    def percent(scale: int):
        share = money.div_half_up(F.col("_u") * (100 * scale), F.col("_t"))
        return F.when(F.col("_t") > 0, share).otherwise(F.lit(0).cast("bigint"))

    return rows.select(
        "id", "nombre", "email",
        money.as_double("cupo_total").alias("cupo_total"),
        money.as_double("cupo_disponible").alias("cupo_disponible"),
        F.when(has, F.col("usado")).cast("double").alias("cupo_usado"),
        F.when(has, percent(1)).alias("porcentaje"),
        F.when(has, percent(10).cast("double") / 10).alias("porcentaje_1"),
        F.when(~has, NO_LINE)
        .when((F.col("_t") > 0) & (F.col("_u") * 100 > F.col("_t") * 90), NEARLY_USED)
        .otherwise(LINE_OK)
        .alias("etiqueta"),
        "compras_completadas",
        (F.lit(PURCHASES_PER_RAISE) - F.col("compras_completadas") % PURCHASES_PER_RAISE).alias("compras_para_aumento"),
    )


def pending_instalments(cuotas: DataFrame, limits: skew.Limits = skew.DEFAULT) -> DataFrame:
    """Pending plans of every user with the instalments left, numbered from the newest."""
    pending = cuotas.filter(F.col("estado") == "pendiente").select(
        "usuario_id", "id", "compra_id", money.as_double("monto_total").alias("monto_total"), "cuotas_totales",
        "cuotas_pagadas", (F.col("cuotas_totales") - F.col("cuotas_pagadas")).alias("cuotas_restantes"), "fecha_compra",
    )
    return skew.row_numbers(pending, ["usuario_id"], [F.desc("fecha_compra"), F.col("id")], "posicion", limits)


def pending_count(cuotas: DataFrame) -> DataFrame:
    return (
        cuotas.filter(F.col("estado") == "pendiente")
        .groupBy("usuario_id")
        .agg(F.count("*").alias("cuotas_pendientes"))
    )


def instalment_plan(purchases: DataFrame) -> DataFrame:
    """A plan per purchase: equal instalments to the cent; ``residuo`` is what they miss of the amount.

    The remainder is not spread, so 100.00 in 3 gives 33.33 three times and a remainder of 0.01.
    """
    amount, parts = money.cents("monto_total"), F.col("cuotas_totales").cast("bigint")
    each = money.div_half_up(amount, parts)
    return purchases.select(
        "usuario_id", "compra_id",
        money.as_double("monto_total").alias("monto_total"),
        money.from_cents(each).alias("monto_por_cuota"),
        "cuotas_totales",
        F.lit(0).alias("cuotas_pagadas"),
        F.lit("pendiente").alias("estado"),
        money.from_cents(amount - each * parts).alias("residuo"),
    )


def instalment_schedule(purchases: DataFrame) -> DataFrame:
    """One row per instalment of every plan."""
    return instalment_plan(purchases).select(
        "usuario_id", "compra_id", F.explode(F.sequence(F.lit(1), F.col("cuotas_totales"))).alias("numero"),
        F.col("monto_por_cuota").alias("monto"),
    )


def open_credit_lines(usuarios: DataFrame, creditos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new lines, their movements) of the buyers that have no line yet."""
    limit = F.lit(OPENING_LIMIT).cast("decimal(12,2)")
    lines = (
        usuarios.filter(F.col("rol") == "comprador")
        .select(F.col("id").alias("usuario_id"))
        .join(creditos.select("usuario_id"), "usuario_id", "left_anti")
        .select(
            "usuario_id", limit.alias("cupo_total"), limit.alias("cupo_disponible"),
            F.lit(0).alias("compras_completadas"), F.lit("activo").alias("estado"),
        )
    )
    movements = lines.select(
        "usuario_id", F.lit("aumento_cupo").alias("tipo"), limit.alias("monto"),
        F.lit(0).cast("decimal(12,2)").alias("cupo_antes"), limit.alias("cupo_despues"),
        F.lit(OPENING_TEXT).alias("descripcion"),
    )
    return lines, movements
