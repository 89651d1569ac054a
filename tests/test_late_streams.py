"""Streams fed out of time order: payments held back, late movements set aside, changed orders taken back."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tianguis.operators import orders as ordering, payments, sales
from tianguis.streaming import jobs, late, retract

T0 = datetime(2026, 1, 1)


def feed(df, path, files):
    for n in range(files):
        df.filter(F.col("lote_prueba") == n).drop("lote_prueba").coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(scope="module")
def session(spark):
    return jobs.stream_session(spark, 2)


def stream(session, path, df):
    return jobs.read_stream(session, path, df.drop("lote_prueba").schema, "*.parquet", per_trigger=1)


def test_shuffled_payments_get_the_batch_verdicts(spark, session, tmp_path):
    """Rows lie up to two files from their place in time; the delay covers that, so nothing is out of order."""
    rng = random.Random(5)
    rows = []
    for n in range(60):
        rows.append((min(5, max(0, n // 10 + rng.randint(-1, 1))), n % 5, f"T{n:02}", Decimal(rng.randint(1, 7)), T0 + timedelta(minutes=n)))
    df = spark.createDataFrame(rows, "lote_prueba int, id_orden long, transaccion_id string, monto decimal(12,2), fecha_pago timestamp")
    feed(df, str(tmp_path / "in"), 6)
    made = [(i, Decimal("20.00"), "pendiente") for i in range(5)]
    schema = "id long, total decimal(12,2), estado string"
    out = str(tmp_path / "out")
    done = jobs.run_payments(stream(session, str(tmp_path / "in"), df), session.createDataFrame(made, schema), out, delay="35 minutes")
    rest = jobs.held_verdicts(session, session.createDataFrame(made, schema), out, df.drop("lote_prueba").schema)
    judged = [*spark.read.parquet(done.path).drop("lote").collect(), *rest.collect()]
    got = {r.transaccion_id: (r.aceptado, r.motivo, r.total_pagado_acumulado, r.estado_orden) for r in judged}
    batch = payments.payment_application(spark.createDataFrame(made, schema), df.drop("lote_prueba"))
    assert len(judged) == 60 and got == {
        r.transaccion_id: (r.aceptado, r.motivo, r.total_pagado_acumulado, r.estado_orden) for r in batch.collect()
    }
    assert 0 < rest.count() < 60


def test_beyond_the_delay_a_payment_is_out_of_order(spark, session, tmp_path):
    rows = [(0, 1, "B", Decimal(1), T0 + timedelta(hours=1)), (1, 2, "C", Decimal(1), T0 + timedelta(hours=9)), (2, 1, "A", Decimal(1), T0)]
    df = spark.createDataFrame(rows, "lote_prueba int, id_orden long, transaccion_id string, monto decimal(12,2), fecha_pago timestamp")
    feed(df, str(tmp_path / "in"), 3)
    static = session.createDataFrame([(i, Decimal(5), "pendiente") for i in (1, 2)], "id long, total decimal(12,2), estado string")
    done = jobs.run_payments(stream(session, str(tmp_path / "in"), df), static, str(tmp_path / "out"), delay="2 hours")
    assert {r.transaccion_id: r.motivo for r in spark.read.parquet(done.path).collect()} == {"B": None, "A": jobs.OUT_OF_ORDER}


def test_late_movements_are_written_with_their_reason(spark, session, tmp_path):
    rows = [(n // 10, n, ["compra", "pago"][n % 2], Decimal(n), T0 + timedelta(hours=n)) for n in range(40)]
    rows += [(3, 100, "pago", Decimal(5), T0), (3, 101, "pago", Decimal(5), T0 + timedelta(hours=28)), (2, 102, "pago", Decimal(1), None)]
    df = spark.createDataFrame(rows, "lote_prueba int, id int, tipo string, monto decimal(12,2), fecha timestamp")
    feed(df, str(tmp_path / "in"), 4)
    done = late.run_movement_windows(stream(session, str(tmp_path / "in"), df), str(tmp_path / "out"), delay="5 hours")
    aside = late.late(spark, str(tmp_path / "out")).collect()
    assert {(r.id, r.motivo, r.lote) for r in aside} == {(100, late.TOO_LATE, 3), (102, late.UNDATED, 2)} and done.late_rows == 2
    assert late.windows(spark, str(tmp_path / "out")).agg(F.sum("cantidad")).first()[0] + 2 == len(rows)


def test_changed_orders_are_taken_back(spark, session, tmp_path, monkeypatch):
    """Orders and changes in any order of files: the months equal those after all valid changes."""
    monkeypatch.setattr(jobs, "MERGE_EVERY", 2)
    rng = random.Random(9)
    made = [(i, Decimal(i + 1), T0 + timedelta(days=20 * (i % 6)), rng.choice(["pendiente", "pagada"])) for i in range(25)]
    log = [(rng.randint(0, 27), rng.choice(["pagada", "cancelada", "devuelta", "pendiente"]), n) for n in range(80)]
    rows = [(rng.randint(0, 5), i, t, f, e, None) for i, t, f, e in made] + [(rng.randint(0, 5), i, None, None, e, n) for i, e, n in log]
    df = spark.createDataFrame(rows, "lote_prueba int, id long, total decimal(12,2), fecha timestamp, estado string, n int")
    feed(df, str(tmp_path / "in"), 6)
    done = retract.run_sales(stream(session, str(tmp_path / "in"), df), str(tmp_path / "out"), ("n",))
    base = spark.createDataFrame(made, "id long, total decimal(12,2), fecha timestamp, estado string")
    changes = spark.createDataFrame(log, "id_orden long, estado string, n int")
    after, _ = ordering.order_state_updates(base, changes, ("n",))
    got = {(r.mes, r.num_ordenes, r.ingresos) for r in retract.months(spark, done).collect()}
    assert got == {(r.mes, r.num_ordenes, r.ingresos) for r in sales.sales_by_month(after).collect()}
    assert done.batches == 6
