"""Key lookups as joins against a table of requested keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def lookup_by_keys(df: DataFrame, requested: DataFrame, on: str, key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``on`` was requested; repeated requests count once."""
    wanted = requested.select(F.col(key or on).alias(on)).distinct()
    return df.join(wanted, on, "left_semi")


def missing_keys(df: DataFrame, requested: DataFrame, on: str, key: str | None = None) -> DataFrame:
    """Requested keys without a row in ``df``."""
    wanted = requested.select(F.col(key or on).alias(on)).distinct()
    return wanted.join(df.select(on), on, "left_anti")
