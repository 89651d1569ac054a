"""Users: counts by role, state and month, listing and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tianguis.functions.money import div_half_up, from_cents
from tianguis.functions.text import ROLE_LABELS, label
from tianguis.operators.sales import month


def users_by_role(usuarios: DataFrame) -> DataFrame:
    return usuarios.groupBy("rol").agg(F.count("*").alias("cantidad")).orderBy(F.desc("cantidad"), "rol")


def users_by_role_share(usuarios: DataFrame) -> DataFrame:
    """Share of each role in percent with one decimal, and its plural label."""
    counts = users_by_role(usuarios)
    whole = F.sum("cantidad").over(Window.partitionBy())  # one row per role
    tenths = div_half_up(F.col("cantidad") * 1000, whole)
    return counts.select(
        "rol", label(F.col("rol"), ROLE_LABELS).alias("etiqueta"), "cantidad",
        (tenths.cast("double") / 10).alias("porcentaje"),
    )


def users_by_state(usuarios: DataFrame) -> DataFrame:
    return usuarios.groupBy("estado").agg(F.count("*").alias("cantidad"))


def registrations_by_month(usuarios: DataFrame, newest: int = 6) -> DataFrame:
    return (
        usuarios.groupBy(month("fecha_registro").alias("mes"))
        .agg(F.count("*").alias("nuevos"))
        .orderBy(F.desc_nulls_last("mes"))
        .limit(newest)
    )


def access_status(estado: Column) -> Column:
    """What a user in this state may do."""
    return F.when(estado == "pendiente", "pendiente").when(estado == "rechazado", "rechazado").otherwise("permitido")


def users_listing(usuarios: DataFrame) -> DataFrame:
    """All users, newest first, without secrets."""
    return usuarios.select(
        "id", "nombre", "email", "rol", "estado", "fecha_registro",
        access_status(F.col("estado")).alias("access_status"),
    ).orderBy(F.desc_nulls_last("fecha_registro"), "id")


def user_search(usuarios: DataFrame, filtro: str | None = None, texto: str | None = None) -> DataFrame:
    """One role or state filter and a case-blind substring of name or email, both optional."""
    out = usuarios
    if filtro in ("comprador", "vendedor"):
        out = out.filter(F.col("rol") == filtro)
    elif filtro in ("pendiente", "rechazado"):
        out = out.filter(F.col("estado") == filtro)
    if texto:
        wanted = F.lower(F.lit(texto))
        out = out.filter(F.lower("nombre").contains(wanted) | F.lower("email").contains(wanted))
    return out
