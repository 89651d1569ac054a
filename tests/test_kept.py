"""Live figures from kept groups, and change logs that rewrite touched buckets only."""

import os
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.test_streams import feed, stream
from tianguis.operators import changes
from tianguis.plans import report
from tianguis.sources import buckets
from tianguis.streaming import jobs, kept

T0 = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def session(spark):
    return jobs.stream_session(spark, 2)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_groups_kept_equal_those_of_all_rows(spark, session, tmp_path, monkeypatch):
    """Seven micro-batches in two runs, merged every two: the groups are the batch's, NULL keys and NULL amounts with them."""
    monkeypatch.setattr(jobs, "MERGE_EVERY", 2)
    rows = [
        (i % 7, i, None if i % 9 == 0 else Decimal(i), ["pagada", "pendiente", None][i % 3], None if i % 11 == 0 else T0 + timedelta(days=9 * i))
        for i in range(90)
    ]
    df = spark.createDataFrame(rows, "lote_prueba int, id long, total decimal(12,2), estado string, fecha timestamp")
    plain, path = df.drop("lote_prueba"), str(tmp_path / "out")
    assert kept.figures(spark, "ordenes", path, plain.schema).count() == 0
    for low, high in ((0, 4), (4, 7)):
        feed(df.filter((F.col("lote_prueba") >= low) & (F.col("lote_prueba") < high)), str(tmp_path / "in"), 7)
        kept.run_figures(stream(session, str(tmp_path / "in"), df), "ordenes", path)
        seen = df.filter(F.col("lote_prueba") < high).drop("lote_prueba")
        got = kept.figures(spark, "ordenes", path, plain.schema)
        assert got.dtypes == report.grouped("ordenes", plain).dtypes
        assert rows_of(got) == rows_of(report.grouped("ordenes", seen))
    read = {name for f in got.inputFiles() for name in f.split("/") if name.startswith(("lote=", "hasta="))}
    merged = [n for n in read if n.startswith("hasta=")]
    assert len(merged) == 1 and len(read) <= 1 + jobs.MERGE_EVERY


def files(path):
    return {(root, f): os.stat(f"{root}/{f}").st_mtime_ns for root, _, names in os.walk(path) if buckets.BUCKET in root for f in names}


def catalog(spark, n=200):
    rows = [(i, i % 5, f"p{i}", "d", Decimal(i), i, True, i % 2 == 0) for i in range(n)]
    return spark.createDataFrame(
        rows, "id long, id_vendedor long, nombre string, descripcion string, precio decimal(12,2), cantidad int, activo boolean, aprobado boolean")


def test_a_log_rewrites_the_buckets_it_touches(spark, tmp_path):
    base, path = catalog(spark), str(tmp_path / "t")
    buckets.write(base, path, ["id"], 8)
    assert rows_of(buckets.read(spark, path, base.schema)) == rows_of(base)
    log = spark.createDataFrame(
        [(7, "editar", 2, "vendedor", "new", "x", Decimal(1), 1, 1), (7, "editar", 3, "vendedor", "no", "x", Decimal(1), 1, 2), (7, "aprobar", 0, "admin", None, None, None, None, 3)],
        "id_producto int, tipo string, id_vendedor long, rol string, nombre string, descripcion string, precio decimal(12,2), cantidad int, n int")
    before = files(path)
    rejects, touched = buckets.apply_log(
        spark, path, base.schema, ["id"], 8, log, ["id_producto"], lambda t, c: changes.apply_product_changes(t, c, ["n"]))
    after, want = files(path), changes.apply_product_changes(base, log, ["n"])
    assert len(touched) == 1 and [r.n for r in rejects.collect()] == [2]
    same = {k for k in before if f"{buckets.BUCKET}={touched[0]}" not in k[0]}
    assert same and all(after[k] == before[k] for k in same) and any(k not in before for k in after)
    assert rows_of(buckets.read(spark, path, base.schema)) == rows_of(want.table)


def test_an_emptied_bucket_a_null_key_and_an_empty_log(spark, tmp_path):
    base = spark.createDataFrame([(i, "activo") for i in range(20)] + [(None, "activo")], "id long, estado string")
    path = str(tmp_path / "t")
    buckets.write(base, path, ["id"], 8)
    log = spark.createDataFrame([(i, "eliminar", None, i) for i in range(20)], "usuario_id long, tipo string, estado string, n int")
    apply = lambda t, c: changes.apply_user_changes(t, c, ["n"])
    assert buckets.apply_log(spark, path, base.schema, ["id"], 8, log.limit(0), ["usuario_id"], apply)[1] == []
    assert buckets.read(spark, path, base.schema).count() == 21
    rejects, touched = buckets.apply_log(spark, path, base.schema, ["id"], 8, log, ["usuario_id"], apply)
    assert rejects.count() == 0 and len(touched) > 4
    assert rows_of(buckets.read(spark, path, base.schema)) == [(None, "activo")]


def test_only_touched_buckets_are_scanned(spark, tmp_path):
    base, path = catalog(spark), str(tmp_path / "t")
    buckets.write(base, path, ["id"], 8)
    df = buckets.read(spark, path, base.schema, [3])
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    partitions = next(line for line in text.splitlines() if "PartitionFilters" in line)
    assert f"{buckets.BUCKET}" in partitions and 0 < df.count() < 200


def test_a_micro_batch_has_files_by_the_size_of_its_table(spark, tmp_path, monkeypatch):
    """A table of many splits is dealt into as many files a micro-batch; no task gets a third of it, and nothing is lost."""
    from contract import queries
    from tianguis.sources.views import STAR_SCHEMA, MarketViews

    for name, schema in STAR_SCHEMA.items():
        rows = spark.createDataFrame([], schema)
        if name == "lineitem":
            n = spark.range(4000)
            rows = n.select(*[(F.col("id") if f.name == "l_orderkey" else F.lit(1).cast(f.dataType) if f.name != "l_shipdate" else F.lit("2026-01-01").cast(f.dataType)).alias(f.name) for f in rows.schema])
        rows.coalesce(8).write.parquet(f"{tmp_path}/{name}.parquet")
    asked = []
    real = jobs.read_stream
    monkeypatch.setattr(jobs, "read_stream", lambda s, root, schema, files, per_trigger: asked.append((root, per_trigger)) or real(s, root, schema, files, per_trigger))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        path, schemas = queries._kept(MarketViews(spark, str(tmp_path)))
        by_table = {root.split("/")[-1]: (len(spark.read.parquet(root).inputFiles()), n) for root, n in asked}
        assert report.totals(kept.bases(spark, path, schemas)).first()["total_pagos"] == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    files, each = by_table["orden_detalles"]
    assert each > 1 and files == queries.KEPT_FILES * each
    assert kept.figures(spark, "orden_detalles", path, schemas["orden_detalles"]).agg(F.sum("unidades")).first()[0] == 4000
