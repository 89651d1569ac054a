"""Closing payments that ask the credit line, against one pass over all payments and credit events in order of time."""

import random
from decimal import Decimal

import pytest

from tianguis import session
from tianguis.operators import ledger, payments
from tianguis.plans import skew


def model(orders, paid, lines, others):
    """Verdict per payment and reason per closing; everything happens one after the other."""
    line = {u: [t, d, on] for u, (t, d, on) in lines.items()}
    acc, closed, out, closings = {}, set(), {}, {}
    events = [(when, ref, "pago", o, x) for o, ref, when, x in paid] + [(when, ref, kind, u, x) for u, kind, x, when, ref in others]
    for _, ref, kind, who, x in sorted(events, key=lambda e: e[:2]):
        if kind == "liquidar":
            if who in line:
                line[who][1] = line[who][0]
        elif kind == "ajustar":
            if x >= 5000000:
                line[who] = [x, x, line[who][2] if who in line else True]
        elif who not in orders:
            out[ref] = (False, payments.ORDER_UNKNOWN)
        elif who in closed:
            out[ref] = (False, payments.ORDER_PAID)
        elif x <= 0:
            out[ref] = (False, payments.BAD_AMOUNT)
        elif acc.get(who, 0) + x > orders[who][1] + 1:
            out[ref] = (False, payments.TOO_MUCH)
        else:
            acc[who] = acc.get(who, 0) + x
            out[ref] = (True, None)
            buyer, total = orders[who]
            if acc[who] == total:
                had = line.get(buyer)
                why = ledger.NOT_ACTIVE if not had or not had[2] else ledger.NOT_ENOUGH if total > had[1] else None
                closings[who] = why
                if why is None:
                    had[1] -= total
                    closed.add(who)
    return out, closings, {o: "pagada" if o in closed else "pendiente" for o in orders}


def cents(x):
    return None if x is None else Decimal(x) / 100


@pytest.mark.parametrize("seed,hot", [(1, 1000), (2, 1000), (3, 6)])
def test_closings_ask_the_line(spark, seed, hot):
    rng = random.Random(seed)
    orders = {o: (rng.randint(0, 6), rng.choice([100, 250, 1000])) for o in range(40)}
    paid, n = [], 0
    for _ in range(260):
        o = rng.randint(0, 41)
        paid.append((o, f"T{n:04d}", rng.randint(0, 60), rng.choice([1, 50, 100, 125, 250, 500, 1, 0])))
        n += 1
    lines = {u: (rng.choice([150, 400, 900]),) * 2 + (rng.random() < 0.8,) for u in range(6)}
    others = []
    for i in range(8):
        kind = rng.choice(["liquidar", "ajustar"])
        others.append((rng.randint(0, 6), kind, rng.choice([100, 5000000]) if kind == "ajustar" else None, rng.randint(0, 60), f"E{i:03d}"))
    ordenes = spark.createDataFrame([(o, b, cents(t), "pendiente") for o, (b, t) in orders.items()], "id long, id_comprador long, total decimal(12,2), estado string")
    pagos = spark.createDataFrame([(o, r, w, cents(x)) for o, r, w, x in paid], "id_orden long, transaccion_id string, fecha_pago int, monto decimal(12,2)")
    credit = spark.createDataFrame(
        [(u, cents(t), cents(d), 0, "activo" if on else "suspendido") for u, (t, d, on) in lines.items()],
        "usuario_id long, cupo_total decimal(12,2), cupo_disponible decimal(12,2), compras_completadas int, estado string",
    )
    plans = spark.createDataFrame([], "id long, usuario_id long, monto_por_cuota decimal(12,2), cuotas_totales int, cuotas_pagadas int")
    rest = spark.createDataFrame(
        [(u, k, cents(x), None, None, w, r) for u, k, x, w, r in others],
        "usuario_id long, tipo string, monto decimal(12,2), cuotas int, cuota_id long, fecha_pago int, transaccion_id string",
    )
    states, verdicts = payments.closure_by_credit(
        ordenes, pagos, credit, plans, rest, limits=skew.Limits(hot_rows=hot, chunk_rows=9), ledger_limits=skew.Limits(hot_rows=hot, chunk_rows=20)
    )
    out, closings, final = model(orders, paid, lines, others)
    assert {r.transaccion_id: (r.aceptado, r.motivo) for r in verdicts.collect()} == out
    rows = states.collect()
    assert {r.id_orden: r.estado for r in rows} == final
    assert {r.id_orden: r.motivo_cierre for r in rows if r.transaccion_id} == closings
    assert len(set(closings.values())) > 1


def test_only_payments_from_a_refused_closing_on_are_judged_again(spark, monkeypatch):
    """Two orders of six payments; the fifth closes, the line grants order 2 alone: two payments of order 1 are judged twice."""
    asked, real = [], payments.payment_application

    def counted(ordenes, pagos, *args, **how):
        asked.append(pagos.count())
        return real(ordenes, pagos, *args, **how)

    monkeypatch.setattr(payments, "payment_application", counted)
    ordenes = spark.sql("select * from values (1L, 7L, 50.00BD, 'pendiente'), (2L, 8L, 50.00BD, 'pendiente') t(id, id_comprador, total, estado)")
    rows = [(o, f"t{k}", k, "0.01" if k == 5 else "10.00") for o in (1, 2) for k in range(6)]
    pagos = spark.createDataFrame(rows, "id_orden long, transaccion_id string, fecha_pago int, monto string").selectExpr(
        "id_orden", "transaccion_id", "fecha_pago", "cast(monto as decimal(12,2)) monto"
    )
    lines = spark.sql("select 8L usuario_id, 100.00BD cupo_total, 100.00BD cupo_disponible, 0 compras_completadas, 'activo' estado")
    plans = spark.sql("select 1L id, 1L usuario_id, 1.00BD monto_por_cuota, 1 cuotas_totales, 0 cuotas_pagadas where false")
    states, verdicts = payments.closure_by_credit(ordenes, pagos, lines, plans)
    found = {(r.id_orden, r.transaccion_id): (r.aceptado, r.estado_orden, r.motivo) for r in verdicts.collect()}
    assert asked == [12, 2] and len(found) == 12
    assert found[1, "t4"] == (True, "pendiente", None) and found[1, "t5"] == (True, "pendiente", None)
    assert found[2, "t4"] == (True, "pagada", None) and found[2, "t5"] == (False, "pagada", payments.ORDER_PAID)
    assert {r.id_orden: r.estado for r in states.collect()} == {1: "pendiente", 2: "pagada"}


def test_tables_of_orders_are_not_sent_to_all_tasks(spark, monkeypatch):
    """Stored keys are small in their files only: beyond SENT_ROWS rows they are merged, whatever Catalyst takes them for."""
    monkeypatch.setattr(session, "SENT_ROWS", 1, raising=False)
    met, real = [], payments.payment_application

    def seen(ordenes, pagos, *args, **how):
        if "closure" in how:
            met.extend(df._jdf.queryExecution().executedPlan().toString() for df in (pagos.join(how["closure"], "id_orden"), ordenes))
            return real(ordenes, pagos, *args, **how)
        done = real(ordenes, pagos, *args, **how)
        met.append(done._jdf.queryExecution().executedPlan().toString())
        return done

    monkeypatch.setattr(payments, "payment_application", seen)
    ordenes = spark.sql("select id, id id_comprador, 10.00BD total, 'pendiente' estado from range(3)")
    pagos = spark.sql("select id id_orden, concat('t', id) transaccion_id, 1 fecha_pago, 10.00BD monto from range(3)")
    lines = spark.sql("select 8L usuario_id, 100.00BD cupo_total, 100.00BD cupo_disponible, 0 compras_completadas, 'activo' estado")
    plans = spark.sql("select 1L id, 1L usuario_id, 1.00BD monto_por_cuota, 1 cuotas_totales, 0 cuotas_pagadas where false")
    _, verdicts = payments.closure_by_credit(ordenes, pagos, lines, plans)
    assert {(r.id_orden, r.aceptado, r.estado_orden) for r in verdicts.collect()} == {(k, True, "pendiente") for k in range(3)}
    assert len(met) == 3 and not any("BroadcastHashJoin" in plan for plan in met)
