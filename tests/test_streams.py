"""Streams over several small files must equal their batch twins."""

import shutil
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tianguis.operators import payments, sales
from tianguis.plans import skew
from tianguis.streaming import jobs


def feed(df, path, files):
    """Write ``df`` as ordered files, one micro-batch each."""
    for n in range(files):
        df.filter(F.col("lote_prueba") == n).drop("lote_prueba").coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(scope="module")
def session(spark):
    return jobs.stream_session(spark, 2)


def stream(session, path, df):
    return jobs.read_stream(session, path, df.drop("lote_prueba").schema, "*.parquet", per_trigger=1)


def test_movement_windows_with_late_rows(spark, session, tmp_path):
    t0 = datetime(2026, 1, 1)
    rows = [(i % 3, ["compra", "pago"][i % 2], Decimal(i), t0 + timedelta(minutes=37 * i)) for i in range(40)]
    rows.append((2, "pago", Decimal(5), t0 - timedelta(days=30)))  # may come after the watermark
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[0]), "lote_prueba int, tipo string, monto decimal(12,2), fecha timestamp")
    feed(df, str(tmp_path / "in"), 3)
    done = jobs.run_update(jobs.movement_windows(stream(session, str(tmp_path / "in"), df), delay="2 days"), str(tmp_path / "out"))
    got = {(r.desde, r.tipo): (r.cantidad, r.monto_total) for r in jobs.latest(spark, done, ["desde", "tipo"]).collect()}
    on_time = df.filter(F.col("fecha") >= F.lit(t0))
    batch = on_time.groupBy(F.window("fecha", "1 hour").start.cast("timestamp_ntz").alias("d"), "tipo").agg(
        F.count("*").alias("n"), F.sum("monto").cast("double").alias("m"))
    assert got == {(r.d, r.tipo): (r.n, r.m) for r in batch.collect()}
    assert done.batches == 3 and done.late_rows == 1


def test_sales_months(spark, session, tmp_path):
    rows = [(i % 2, i, Decimal(i), ["pagada", "pendiente"][i % 2], datetime(2026, 1 + i % 4, 1)) for i in range(30)]
    df = spark.createDataFrame(rows, "lote_prueba int, id int, total decimal(12,2), estado string, fecha timestamp")
    feed(df, str(tmp_path / "in"), 2)
    done = jobs.run_update(jobs.sales_months(stream(session, str(tmp_path / "in"), df)), str(tmp_path / "out"))
    got = {(r.mes, r.num_ordenes, r.ingresos) for r in jobs.latest(spark, done, ["mes"]).collect()}
    assert got == {(r.mes, r.num_ordenes, r.ingresos) for r in sales.sales_by_month(df).collect()}


def test_repeated_payments_are_dropped(spark, session, tmp_path):
    rows = [(i // 10, f"T{i % 12}", datetime(2026, 1, 1) + timedelta(hours=i)) for i in range(30)]
    df = spark.createDataFrame(rows, "lote_prueba int, transaccion_id string, fecha_pago timestamp")
    feed(df, str(tmp_path / "in"), 3)
    done = jobs.run_append(jobs.unique_payments(stream(session, str(tmp_path / "in"), df)), str(tmp_path / "out"))
    got = sorted(r.transaccion_id for r in spark.read.parquet(done.path).collect())
    assert got == sorted(f"T{i}" for i in range(12))


@pytest.mark.parametrize("limits", [skew.DEFAULT, skew.Limits(hot_rows=1, chunk_rows=2)], ids=["one array", "chunks"])
def test_payment_state_equals_batch(spark, session, tmp_path, limits):
    orders = spark.createDataFrame([(i, Decimal("10.00"), "pendiente") for i in range(4)], "id long, total decimal(12,2), estado string")
    rows = [(n // 8, n % 4, f"T{n:02}", Decimal((n * 7) % 6 + 1), datetime(2026, 1, 1) + timedelta(minutes=n)) for n in range(24)]
    df = spark.createDataFrame(rows, "lote_prueba int, id_orden long, transaccion_id string, monto decimal(12,2), fecha_pago timestamp")
    feed(df, str(tmp_path / "in"), 3)
    static = session.createDataFrame([tuple(r) for r in orders.collect()], orders.schema)
    done = jobs.run_payments(stream(session, str(tmp_path / "in"), df), static, str(tmp_path / "out"), limits)
    got = {r.transaccion_id: (r.aceptado, r.total_pagado_acumulado, r.estado_orden) for r in spark.read.parquet(done.path).collect()}
    batch = payments.payment_application(orders, df.drop("lote_prueba"))
    assert got == {r.transaccion_id: (r.aceptado, r.total_pagado_acumulado, r.estado_orden) for r in batch.collect()}
    assert done.batches == 3


def test_payments_out_of_order_are_refused_with_a_reason(spark, session, tmp_path):
    """The later payment is judged first; the earlier one of the same order, in the next file, is refused, not judged anew."""
    t0 = datetime(2026, 1, 1)
    rows = [(0, 1, "B", Decimal("6.00"), t0 + timedelta(hours=1)), (1, 1, "A", Decimal("6.00"), t0),
            (1, 2, "C", Decimal("10.00"), t0), (1, 1, "D", Decimal("4.00"), t0 + timedelta(hours=2))]
    df = spark.createDataFrame(rows, "lote_prueba int, id_orden long, transaccion_id string, monto decimal(12,2), fecha_pago timestamp")
    feed(df, str(tmp_path / "in"), 2)
    static = session.createDataFrame([(i, Decimal("10.00"), "pendiente") for i in (1, 2)], "id long, total decimal(12,2), estado string")
    done = jobs.run_payments(stream(session, str(tmp_path / "in"), df), static, str(tmp_path / "out"))
    got = {r.transaccion_id: (r.aceptado, r.motivo, r.total_pagado_acumulado, r.estado_orden) for r in spark.read.parquet(done.path).collect()}
    assert got == {
        "B": (True, None, 6.0, "pendiente"), "A": (False, jobs.OUT_OF_ORDER, 6.0, "pendiente"),
        "C": (True, None, 10.0, "pagada"), "D": (True, None, 10.0, "pagada"),
    }


def test_counts_cover_more_micro_batches_than_a_query_remembers(spark, session, tmp_path):
    """Every file but the first comes too late; the query itself remembers its newest two micro-batches."""
    t0 = datetime(2026, 1, 1)
    rows = [(n, "pago", Decimal(1), t0 - timedelta(days=30 * (n > 0))) for n in range(6)]
    df = spark.createDataFrame(rows, "lote_prueba int, tipo string, monto decimal(12,2), fecha timestamp")
    feed(df, str(tmp_path / "in"), 6)
    session.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        done = jobs.run_update(jobs.movement_windows(stream(session, str(tmp_path / "in"), df), delay="2 days"), str(tmp_path / "out"))
    finally:
        session.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    # late rows are judged by the watermark before the newest, so those of the second file are still taken
    assert (done.batches, done.late_rows) == (6, 4)


def test_merged_states_give_the_same_verdicts(spark, session, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "MERGE_EVERY", 2)
    orders = spark.createDataFrame([(i, Decimal("20.00"), "pendiente") for i in range(3)], "id long, total decimal(12,2), estado string")
    rows = [(n // 5, n % 3, f"T{n:02}", Decimal((n * 7) % 6 + 1), datetime(2026, 1, 1) + timedelta(minutes=n)) for n in range(30)]
    df = spark.createDataFrame(rows, "lote_prueba int, id_orden long, transaccion_id string, monto decimal(12,2), fecha_pago timestamp")
    feed(df, str(tmp_path / "in"), 6)
    static = session.createDataFrame([tuple(r) for r in orders.collect()], orders.schema)
    done = jobs.run_payments(stream(session, str(tmp_path / "in"), df), static, str(tmp_path / "out"))
    got = {r.transaccion_id: (r.aceptado, r.total_pagado_acumulado, r.estado_orden) for r in spark.read.parquet(done.path).collect()}
    batch = payments.payment_application(orders, df.drop("lote_prueba"))
    assert got == {r.transaccion_id: (r.aceptado, r.total_pagado_acumulado, r.estado_orden) for r in batch.collect()}
    assert done.batches == 6 and {p.name for p in (tmp_path / "out" / "state").iterdir()} >= {"hasta=2", "hasta=4"}


def test_the_first_payments_meet_no_earlier_state(spark, session, tmp_path, monkeypatch):
    """Without an earlier micro-batch nothing is joined with the payments, and the orders come as they are."""
    df = spark.createDataFrame(
        [(n, 1, f"T{n}", Decimal("6.00"), datetime(2026, 1, 1 + n)) for n in range(2)],
        "lote_prueba int, id_orden long, transaccion_id string, monto decimal(12,2), fecha_pago timestamp",
    )
    feed(df, str(tmp_path / "in"), 2)
    static = session.createDataFrame([(1, Decimal("10.00"), "pendiente")], "id long, total decimal(12,2), estado string")
    seen, real = [], jobs.payment_application
    monkeypatch.setattr(jobs, "payment_application", lambda o, p, *a, previous, **k: seen.append((o is static, previous is None)) or real(o, p, *a, previous=previous, **k))
    done = jobs.run_payments(stream(session, str(tmp_path / "in"), df), static, str(tmp_path / "out"))
    assert seen == [(True, True), (True, False)]
    assert [tuple(r) for r in spark.read.parquet(done.path).select("transaccion_id", "aceptado").orderBy("transaccion_id").collect()] == [("T0", True), ("T1", False)]


def test_a_table_in_several_files_is_read_whole(spark, tmp_path):
    """A stream over a folder ``lineitem.parquet`` sees every file of it, as one over a single file of that name does."""
    lines = spark.sql(
        "select id l_orderkey, id l_partkey, id l_suppkey, 1 l_linenumber, 1D l_quantity, 5D l_extendedprice, 0D l_discount, 0D l_tax, "
        "'A' l_returnflag, 'F' l_linestatus, timestamp_ntz'2020-01-01' l_shipdate from range(10)"
    )
    lines.repartition(3).write.parquet(f"{tmp_path}/many/lineitem.parquet")
    lines.coalesce(1).write.parquet(f"{tmp_path}/single")
    (tmp_path / "one").mkdir()
    shutil.copy(*(tmp_path / "single").glob("part-*.parquet"), tmp_path / "one" / "lineitem.parquet")
    for root in ("many", "one"):
        views = jobs.StreamViews(jobs.stream_session(spark, 2), f"{tmp_path}/{root}")
        done = jobs.run_append(views.pagos(), f"{tmp_path}/{root}-out")
        assert sorted(r.id_orden for r in spark.read.parquet(done.path).collect()) == list(range(10))
