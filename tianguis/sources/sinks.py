"""Typed bulk export of the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tianguis.schema import MONTH_COLUMN
from tianguis.sources.tables import NULL_TEXT, escaped


def export_table(df: DataFrame, root: str, name: str, fmt: str = "parquet", by_month: bool = False, null: str = NULL_TEXT) -> str:
    """Write one table whole. ``by_month`` lays a fact table out by month for partition pruning.

    In CSV line breaks and backslashes inside texts become backslash escapes, so a row is a line and files can be cut anywhere.
    """
    path = f"{root.rstrip('/')}/{name}.{fmt}"
    writer_input = df
    if fmt == "csv":
        texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
        writer_input = df = df.select(*[escaped(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns])
    partition = []
    if by_month and name in MONTH_COLUMN:
        writer_input = df.withColumn("mes", F.date_format(MONTH_COLUMN[name], "yyyy-MM"))
        # The rebalance splits a month that is larger than a task should write.
        writer_input = writer_input.hint("rebalance", "mes")
        partition = ["mes"]
    writer = writer_input.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(*partition)
    if fmt == "csv":
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        writer = writer.option("header", True).option("quote", '"').option("escape", '"').option("nullValue", null)
    writer.format(fmt).save(path)
    return path


def export_tables(tables: dict[str, DataFrame], root: str, fmt: str = "parquet", by_month: bool = False) -> dict[str, str]:
    return {name: export_table(df, root, name, fmt, by_month) for name, df in tables.items()}
