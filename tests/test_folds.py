"""Ordered folds against row-by-row models, with few rows per key and with keys cut into chunks."""

import random
from decimal import Decimal
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from tests import models
from tianguis.operators import ledger, orders, payments
from tianguis.plans import skew
from tianguis.plans.admission import admit
from tianguis.session import checkpoint_root

SMALL = skew.Limits(hot_rows=40, chunk_rows=60)
NO_BROADCAST = skew.Limits(hot_rows=40, chunk_rows=60, broadcast_keys=0)


def money(cents):
    return None if cents is None else Decimal(cents) / 100


@pytest.mark.parametrize("limits", [skew.DEFAULT, SMALL, NO_BROADCAST], ids=["one array", "chunks", "chunks without broadcast"])
@pytest.mark.parametrize("slack", [0, 1])
def test_admission_equals_model(spark, limits, slack):
    rng = random.Random(7 + slack)
    rows, capacity = [], {0: 1, 1: 0, 2: 17, 3: 1000, 4: 1 << 20, 5: 65536}
    for key in range(7):  # key 6 has no capacity
        top = rng.choice([5, 300, 1 << 17])
        for pos in range(rng.choice([10, 400])):
            rows.append((key, pos, rng.choice([0, -2, rng.randint(1, top), rng.randint(1, max(2, top // 60))])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, pos int, x int")
    cap = spark.createDataFrame(list(capacity.items()), "k int, capacidad bigint")
    got = {(r.k, r.pos): (r.concedido, r.antes, r.despues) for r in admit(df, cap, "k", ["pos"], "x", slack, limits).collect()}
    assert got == models.admit(rows, capacity, slack)


def test_a_third_of_all_rows_in_one_key(spark):
    """One key beside many small ones; its rows are spread over chunks and all come back."""
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 4000).alias("k"), F.col("id").alias("pos"),
        (F.col("id") * 7919 % 1000 + 1).alias("x"),
    )
    cap = rows.select("k").distinct().withColumn("capacidad", F.when(F.col("k") == -1, 123456).otherwise(900).cast("bigint"))
    limits = skew.Limits(hot_rows=500, chunk_rows=1000)
    got = {(r.k, r.pos): (r.concedido, r.antes, r.despues) for r in admit(rows, cap, "k", ["pos"], "x", 0, limits).collect()}
    plain = [(r.k, r.pos, r.x) for r in rows.collect()]
    assert got == models.admit(plain, {r.k: r.capacidad for r in cap.collect()})


def _orders(spark, *rows):
    return spark.createDataFrame([(i, money(t), s) for i, t, s in rows], "id int, total decimal(12,2), estado string")


def _payments(spark, *rows):
    made = [(o, f"T{n}", n, money(c)) for n, (o, c) in enumerate(rows)]
    return spark.createDataFrame(made, "id_orden int, transaccion_id string, fecha_pago int, monto decimal(12,2)")


@pytest.mark.parametrize("limits", [skew.DEFAULT, skew.Limits(hot_rows=2, chunk_rows=2)], ids=["one array", "chunks"])
def test_payment_rules(spark, limits):
    orders_ = _orders(spark, (1, 10000, "pendiente"), (2, 10000, "pendiente"), (3, 10000, "pagada"))
    paid = _payments(
        spark,
        (1, 6000), (1, 5000), (1, 4000), (1, 1),  # too much, then a smaller one that fits and closes
        (2, 10001), (2, 1),  # one cent above the total is tolerated
        (3, 100), (9, 100), (1, -5),
    )
    got = {r.transaccion_id: (r.aceptado, r.motivo, r.estado_orden) for r in payments.payment_application(
        orders_, paid, replay=False, limits=limits).collect()}
    assert got == {
        "T0": (True, None, "pendiente"), "T1": (False, payments.TOO_MUCH, "pendiente"), "T2": (True, None, "pagada"),
        "T3": (False, payments.ORDER_PAID, "pagada"), "T4": (True, None, "pendiente"), "T5": (False, payments.TOO_MUCH, "pendiente"),
        "T6": (False, payments.ORDER_PAID, "pagada"), "T7": (False, payments.ORDER_UNKNOWN, None),
        "T8": (False, payments.ORDER_PAID, "pagada"),
    }


def test_failed_closure_stays_pending(spark):
    orders_ = _orders(spark, (1, 10000, "pendiente"), (2, 500, "pendiente"))
    paid = _payments(spark, (1, 10000), (1, 1), (2, 500))
    closure = spark.createDataFrame([(1, False)], "id_orden int, cierre_ok boolean")
    applied = payments.payment_application(orders_, paid, closure=closure)
    assert [r.aceptado for r in applied.orderBy("transaccion_id").collect()] == [True, True, True]
    first = payments.payment_application(orders_, paid)
    events = payments.closing_events(orders_.withColumn("id_comprador", F.lit(7)), first)
    assert sorted((r.usuario_id, r.monto, r.cuota_id) for r in events.collect()) == [(7, Decimal("5.00"), 2), (7, Decimal("100.00"), 1)]
    states = {r.id_orden: (r.pagada_completa, r.estado) for r in payments.order_closure(orders_, first, closure).collect()}
    assert states == {1: (True, "pendiente"), 2: (True, "pagada")}


def test_stock_refusal_consumes_nothing(spark):
    products = spark.createDataFrame([(1, 10)], "id int, cantidad int")
    asked = spark.createDataFrame([(1, n, q) for n, q in enumerate([6, 5, 4, 1])], "id_producto int, n int, cantidad int")
    done = orders.stock_fold(asked, products, ["n"])
    assert [(r.aceptado, r.stock_despues) for r in done.orderBy("n").collect()] == [(True, 4), (False, 4), (True, 0), (False, 0)]
    assert orders.stock_after(products, done).first().cantidad == 0


def _case(seed):
    rng = random.Random(seed)
    events, lines, plans = [], {}, []
    for u in range(5):
        if u != 4:
            lines[u] = (100000_00, rng.choice([100000_00, 30000_00]), rng.randint(0, 4), "suspendido" if u == 3 else "activo")
        mine = [1000 + u * 10 + p for p in range(3)]
        plans += [(u, p, 123_45, 3, rng.randint(0, 3)) for p in mine]
        for pos in range(rng.choice([15, 130])):
            draw = rng.random()
            if draw < 0.4:
                plan = u * 100000 + pos
                mine.append(plan)
                events.append((u, pos, "usar", rng.choice([rng.randint(1, 40000_00), 0, None]), rng.choice([1, 3, 6]), plan))
            elif draw < 0.9:
                events.append((u, pos, "pagar_cuota", None, None, rng.choice(mine[-6:])))
            elif draw < 0.95:
                events.append((u, pos, "liquidar", None, None, None))
            else:
                events.append((u, pos, "ajustar", rng.choice([100, 50000_00, 200000_00, 600000_00]), None, None))
    rng.shuffle(events)
    return events, lines, plans


@pytest.mark.parametrize("limits", [skew.DEFAULT, skew.Limits(hot_rows=20, chunk_rows=60)], ids=["one array", "chunks"])
@pytest.mark.parametrize("strict", [True, False])
def test_ledger_equals_model(spark, limits, strict):
    events, lines, plans = _case(3)
    made = spark.createDataFrame([(u, i, k, money(x), n, p) for u, i, k, x, n, p in events],
                                 "usuario_id long, i int, tipo string, monto decimal(12,2), cuotas int, cuota_id long")
    opening = spark.createDataFrame([(u, money(t), money(d), c, s) for u, (t, d, c, s) in lines.items()],
                                    "usuario_id long, cupo_total decimal(12,2), cupo_disponible decimal(12,2), compras_completadas int, estado string")
    book = spark.createDataFrame([(u, p, money(v), n, k) for u, p, v, n, k in plans],
                                 "usuario_id long, id long, monto_por_cuota decimal(12,2), cuotas_totales int, cuotas_pagadas int")
    want, final, paid = models.ledger(events, lines, plans, strict)
    out = ledger.credit_ledger(made, opening, book, ["i"], strict=strict, limits=limits)
    rows = out.collect()
    assert {(r.usuario_id, r.i): (r.aceptado, r.cupo_total, r.disponible, r.completadas) for r in rows} == want
    assert all(0 <= r.disponible <= r.cupo_total for r in rows if r.cupo_total is not None)
    after = ledger.ledger_lines(out, opening, ["i"]).collect()
    assert {r.usuario_id: (r.cupo_total, r.cupo_disponible, r.compras_completadas) for r in after} == {
        u: (s["t"] / 100, s["d"] / 100, s["c"]) for u, s in final.items()}
    left = ledger.ledger_plans(out, book, ["i"]).collect()
    assert {(r.usuario_id, r.cuota_id): (r.cuotas_totales, r.cuotas_pagadas) for r in left} == {k: (p[1], p[2]) for k, p in paid.items()}


def test_third_completed_purchase_raises_the_limit(spark):
    events = []
    for n in range(3):
        events += [(1, 2 * n, "usar", money(1000_00), 1, n), (1, 2 * n + 1, "pagar_cuota", None, None, n)]
    events.append((1, 6, "usar", money(149000_00), 3, 9))
    made = spark.createDataFrame(events, "usuario_id long, i int, tipo string, monto decimal(12,2), cuotas int, cuota_id long")
    opening = spark.createDataFrame([(1, money(100000_00), money(90000_00), 0, "activo")],
                                    "usuario_id long, cupo_total decimal(12,2), cupo_disponible decimal(12,2), compras_completadas int, estado string")
    none = spark.createDataFrame([], "usuario_id long, id long, monto_por_cuota decimal(12,2), cuotas_totales int, cuotas_pagadas int")
    out = ledger.credit_ledger(made, opening, none, ["i"])
    rows = {r.i: r for r in out.collect()}
    assert (rows[5].cupo_total, rows[5].despues, rows[5].disponible, rows[5].completadas) == (150000_00, 90000_00, 150000_00, 3)
    assert rows[6].aceptado and rows[6].disponible == 1000_00
    texts = [r.descripcion for r in ledger.ledger_movements(out, ["i"]).orderBy("i").collect()]
    assert texts[:2] == ["Compra en 1 cuotas - Orden #0", "Pago cuota 1 de 1"]


def test_row_numbers_and_previous_values(spark):
    df = spark.range(900).select((F.col("id") % 3 == 0).cast("int").alias("k"), (F.col("id") * 7919 % 900).alias("pos"),
                                 F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    numbered = skew.row_numbers(df, ["k"], [F.desc("pos")], "n", skew.Limits(50, 100))
    want = skew.row_numbers(df, ["k"], [F.desc("pos")], "n", skew.Limits(10**6))
    assert sorted(map(repr, numbered.collect())) == sorted(map(repr, want.collect()))
    lagged = skew.previous_values(df, ["k"], ["pos"], "v", "b", skew.Limits(50, 100))
    want = skew.previous_values(df, ["k"], ["pos"], "v", "b", skew.Limits(10**6))
    assert sorted(map(repr, lagged.collect())) == sorted(map(repr, want.collect()))


def test_a_bound_value_is_not_copied():
    """``transform`` copies what its lambda gives, and so all outcomes of a user at every event."""
    assert "transform" not in str(ledger._let(F.col("x"), lambda x: x + 1))


def test_places_in_chunks_rise_with_the_order(spark):
    """One sort gives every row its place: along the key, the order and then the other columns, chunk after chunk."""
    rows = spark.range(900).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 100).alias("pos"), F.col("id").alias("x"))
    got = skew.in_chunks(rows, ["k"], [F.col("pos")], 900, skew.Limits(10, 100), place="p", ties=[F.col("x")]).collect()
    assert [(r.k, r.pos, r.x) for r in sorted(got, key=lambda r: r.p)] == sorted((r.k, r.pos, r.x) for r in got)
    assert len({r.p for r in got}) == 900 and len({r[skew.CHUNK] for r in got}) > 3
    assert [r[skew.CHUNK] for r in sorted(got, key=lambda r: r.p)] == sorted(r[skew.CHUNK] for r in got)


def test_cold_users_are_dealt_by_user_alone(spark):
    """Their groups meet plans and lines where they are; nothing is dealt by user and part."""
    events = spark.sql("select 1L usuario_id, 'usar' tipo, 5.00BD monto, 1 cuotas, 1L cuota_id, 1 fecha")
    lines = spark.sql("select 1L usuario_id, 9.00BD cupo_total, 9.00BD cupo_disponible, 0 compras_completadas, 'activo' estado")
    plans = spark.sql("select 1L id, 1L usuario_id, 1.00BD monto_por_cuota, 1 cuotas_totales, 0 cuotas_pagadas where false")
    done = ledger.credit_ledger(events, lines, plans, ("fecha",))
    assert "parte" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert [r.aceptado for r in done.collect()] == [True]


def test_slices_of_users_leave_their_outcomes_alone(spark, monkeypatch):
    """Users are folded for a slice at a time; events, groups and rounds of a slice go when its outcomes are stored."""
    monkeypatch.setattr(ledger, "SLICE_ROWS", 100, raising=False)
    events, lines, plans = _case(3)
    made = spark.createDataFrame([(u, i, k, money(x), n, p) for u, i, k, x, n, p in events],
                                 "usuario_id long, i int, tipo string, monto decimal(12,2), cuotas int, cuota_id long")
    opening = spark.createDataFrame([(u, money(t), money(d), c, s) for u, (t, d, c, s) in lines.items()],
                                    "usuario_id long, cupo_total decimal(12,2), cupo_disponible decimal(12,2), compras_completadas int, estado string")
    book = spark.createDataFrame([(u, p, money(v), n, k) for u, p, v, n, k in plans],
                                 "usuario_id long, id long, monto_por_cuota decimal(12,2), cuotas_totales int, cuotas_pagadas int")
    root = Path(urlparse(checkpoint_root(spark)).path)
    before = {p for p in root.rglob("*.parquet") if p.is_file()}
    out = ledger.credit_ledger(made, opening, book, ["i"], limits=skew.Limits(hot_rows=20, chunk_rows=60))
    new = {p.relative_to(root).parts[0] for p in root.rglob("*.parquet") if p.is_file()} - {p.relative_to(root).parts[0] for p in before}
    assert len(new) == -(-len(events) // 100) > 1
    want = models.ledger(events, lines, plans, True)[0]
    assert {(r.usuario_id, r.i): (r.aceptado, r.cupo_total, r.disponible, r.completadas) for r in out.collect()} == want
