"""CSV in several tasks, texts with line breaks, and JDBC predicates on skewed keys."""

import random

import pytest
from pyspark.sql import functions as F

from tianguis.schema import TABLES
from tianguis.sources import sinks, tables

TEXTS = ["a\nb", "c\\n", "\\", "\\\\n", 'q"\r\n,"', "tab\tx", "\\\\\\\nend\\", " plain ", "é x"]


def products(spark, n):
    rows = spark.range(n).select(F.col("id"), F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("id") % len(TEXTS) + 1).cast("int")).alias("descripcion"))
    return tables.conform(rows, TABLES["productos"])


def test_texts_come_back_and_files_are_read_in_several_tasks(spark, tmp_path):
    df = products(spark, 20_000)
    sinks.export_table(df.coalesce(1), str(tmp_path), "productos", "csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        back = tables.read_table(spark, str(tmp_path), "productos", "csv")
        assert back.rdd.getNumPartitions() > 3
        # Blanks at the ends of a text stay as well.
        assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_multi_line_files_of_others(spark, tmp_path):
    (tmp_path / "productos.csv").write_text('id,nombre,descripcion\n1,"two\nlines","a\\nb"\n2,x,y\n')
    rows = tables.read_table(spark, str(tmp_path), "productos", "csv", lines="multi").orderBy("id").collect()
    assert [(r.id, r.nombre, r.descripcion) for r in rows] == [(1, "two\nlines", "a\\nb"), (2, "x", "y")]
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path), "productos", "csv", lines="some")


@pytest.mark.parametrize("keys", [[7] * 300 + list(range(100)), [5], [], [None] * 50, ["o'x", "b", "zz"] * 40 + ["b"] * 200])
def test_predicates_hold_every_key_once(spark, keys):
    rng = random.Random(3)
    keys = [*keys, *([None] * 5 if keys else [])]
    rng.shuffle(keys)
    kind = "string" if any(isinstance(k, str) for k in keys) else "long"
    df = spark.createDataFrame([(k,) for k in keys], f"k {kind}")
    cuts = [] if kind == "string" else tables.quantile_cuts(df, "k", 8)
    cuts = ["b", "o'x"] if kind == "string" else cuts
    found = tables.jdbc_predicates("k", cuts)
    counts = [df.filter(p).count() for p in found]
    assert sum(counts) == len(keys)
    held = df.select(sum((F.coalesce(F.expr(f"({p})"), F.lit(False)).cast("int") for p in found), F.lit(0)).alias("n"))
    assert {r.n for r in held.collect()} <= {1}
    if keys[:1] and kind == "long" and len(keys) > 300:
        assert len(found) > 2 and max(counts) <= 320
