"""Readers of the canonical tables: Parquet, CSV and JDBC, typed without inference."""

from __future__ import annotations

from collections import Counter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tianguis.schema import TABLES

#: What stands for NULL in a CSV file unless told otherwise; a text that reads so needs another mark.
NULL_TEXT = "NULL"


#: How line breaks inside texts stand in a CSV file: as backslash escapes, so that a file is cut into tasks anywhere; not at
#: all; or bare between quotes, which keeps a file in one task.
LINES = ("escaped", "plain", "multi")


def escaped(text: Column) -> Column:
    """``text`` on one line: backslash, line feed, carriage return and tab as backslash escapes."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for bare, mark in _ESCAPES:
        out = F.replace(out, F.lit(bare), F.lit(mark))
    return out


def unescaped(text: Column) -> Column:
    """What :func:`escaped` was given. Pairs of backslashes are set apart first, so the escapes between them are single ones."""
    def part(piece: Column) -> Column:
        for bare, mark in _ESCAPES:
            piece = F.replace(piece, F.lit(mark), F.lit(bare))
        return piece

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")).otherwise(text)


_ESCAPES = (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The canonical columns of ``df``: extra ones (passwords too) are dropped, absent ones are NULL.

    Text that does not parse becomes NULL. Flags may arrive as 0/1 numbers or as text.
    """
    have = {name.lower(): name for name in df.columns}

    def typed(field: T.StructField):
        source = have.get(field.name.lower())
        if source is None:
            return F.lit(None).cast(field.dataType).alias(field.name)
        column = F.col(source)
        if df.schema[source].dataType == field.dataType:
            return column.alias(field.name)
        if isinstance(df.schema[source].dataType, T.StringType):
            return column.try_cast(field.dataType).alias(field.name)
        return column.cast(field.dataType).alias(field.name)

    return df.select(*[typed(f) for f in schema.fields])


def _untyped(df: DataFrame, schema: T.StructType) -> dict[str, Column]:
    """Per text column of ``df``: whether it holds a value that :func:`conform` cannot type."""
    have = {name.lower(): name for name in df.columns}
    texts = [f for f in schema.fields if f.name.lower() in have and isinstance(df.schema[have[f.name.lower()]].dataType, T.StringType)]
    return {
        f.name: F.col(have[f.name.lower()]).isNotNull() & F.col(have[f.name.lower()]).try_cast(f.dataType).isNull()
        for f in texts
    }


def read_checked(
    spark: SparkSession, root: str, name: str, fmt: str = "csv", file: str | None = None, null: str = NULL_TEXT, lines: str = "escaped"
) -> tuple[DataFrame, DataFrame]:
    """(rows that type whole, refused rows as read with ``columnas`` at fault): together every row of the file."""
    raw = _load(spark, root, name, fmt, file, null, lines)
    faults = [F.when(bad, F.lit(column)) for column, bad in _untyped(raw, TABLES[name]).items()]
    marked = raw.withColumn("columnas", F.array_compact(F.array(*faults)) if faults else F.array().cast("array<string>"))
    return conform(marked.filter(F.size("columnas") == 0), TABLES[name]), marked.filter(F.size("columnas") > 0)


def _load(spark: SparkSession, root: str, name: str, fmt: str, file: str | None, null: str, lines: str) -> DataFrame:
    if lines not in LINES:
        raise ValueError(f"lines is one of {LINES}")
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("nullValue", null).option("escape", '"').option("multiLine", lines == "multi")
    raw = reader.format(fmt).load(f"{root.rstrip('/')}/{file or name + '.' + fmt}")
    if fmt == "csv" and lines == "escaped":
        raw = raw.select(*[unescaped(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return raw


def read_table(
    spark: SparkSession, root: str, name: str, fmt: str = "parquet", optional: bool = True, file: str | None = None,
    null: str = NULL_TEXT, lines: str = "escaped",
) -> DataFrame:
    """One canonical table under ``root``; a missing one is an empty table unless ``optional`` is off.

    A CSV file is read in as many tasks as it has splits; only ``lines="multi"``, for files of others that hold bare line
    breaks in quotes, reads it in one. ``lines="plain"`` takes backslashes as they are.

    CSV columns are matched by header name and cast, so any column order and any user shape reads; ``null`` is the text
    that stands for NULL there. Values that do not type become NULL: :func:`read_checked` sets their rows aside.
    """
    schema = TABLES[name]
    try:
        raw = _load(spark, root, name, fmt, file, null, lines)
    except AnalysisException as err:
        if optional and "PATH_NOT_FOUND" in (err.getCondition() or str(err)):
            return spark.createDataFrame([], schema)
        raise
    return conform(raw, schema)


def read_all(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name, fmt) for name in TABLES}


def jdbc_options(
    url: str,
    table: str,
    properties: dict[str, str],
    column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int | None = None,
    fetch_size: int = 10000,
) -> dict[str, str]:
    """Options of a JDBC read; with ``column`` and ``bounds`` the table is read in parallel ranges."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **properties}
    if column is not None:
        if bounds is None or partitions is None:
            raise ValueError("a partitioned read needs bounds and a number of partitions")
        options |= {
            "partitionColumn": column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def quantile_cuts(keys: DataFrame, column: str, partitions: int, accuracy: int = 10_000) -> list:
    """Cuts at the quantiles of ``column``, twice for a key that holds several: even ranges would leave most rows in one task."""
    at = [i / partitions for i in range(1, partitions)]
    cuts = keys.agg(F.percentile_approx(column, at, accuracy)).first()[0] if at else None
    return sorted(c for c, n in Counter(cuts or ()).items() for _ in range(min(n, 2)))


def jdbc_predicates(column: str, cuts: list) -> list[str]:
    """One condition per task, which together hold every key and NULL exactly once. A cut given twice is a range of its own."""
    def text(v) -> str:
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    if not cuts:
        return ["1 = 1"]
    # (where a range begins, where the one before it ends)
    edges = [(f"{column} > {text(v)}", f"{column} <= {text(v)}") if i and cuts[i - 1] == v else (f"{column} >= {text(v)}", f"{column} < {text(v)}")
             for i, v in enumerate(cuts)]
    between = [f"{begin} AND {end}" for (begin, _), (_, end) in zip(edges, edges[1:], strict=False)]
    return [f"{edges[0][1]} OR {column} IS NULL", *between, edges[-1][0]]


def read_jdbc_at(spark: SparkSession, name: str, url: str, properties: dict[str, str], predicates: list[str], fetch_size: int = 10000) -> DataFrame:
    """One canonical table from a database, a task per predicate of :func:`jdbc_predicates`."""
    return conform(spark.read.jdbc(url, name, predicates=predicates, properties={"fetchsize": str(fetch_size), **properties}), TABLES[name])


def read_jdbc(spark: SparkSession, name: str, url: str, properties: dict[str, str], **ranges) -> DataFrame:
    """One canonical table from a database, conformed like a file table."""
    reader = spark.read.format("jdbc").options(**jdbc_options(url, name, properties, **ranges))
    return conform(reader.load(), TABLES[name])
