"""Checks of enumerated columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tianguis.schema import DOMAINS


def in_domain(c: Column, table: str, column: str) -> Column:
    return F.coalesce(c.isin(*DOMAINS[(table, column)]), F.lit(False))


def validate_enum(df: DataFrame, table: str, column: str) -> DataFrame:
    """Every row with ``valido``: whether its value belongs to the domain."""
    return df.withColumn("valido", in_domain(F.col(column), table, column))


def split_enum(df: DataFrame, table: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows."""
    ok = in_domain(F.col(column), table, column)
    return df.filter(ok), df.filter(~ok)
