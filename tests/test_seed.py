"""Golden values on the seed rows."""

import pytest

from tests import seed
from tianguis.operators import catalog, credit, payments, quality, sales, summary, users
from tianguis.plans import report


@pytest.fixture(scope="module")
def t(spark):
    return seed.frames(spark)


def one(df):
    return df.first().asDict()


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_summaries(t):
    got = one(summary.summary(t["usuarios"], t["productos"], t["ordenes"], t["pagos"]))
    assert got == {
        "total_usuarios": 19, "compradores": 16, "vendedores": 1, "admins": 2, "usuarios_activos": 19, "usuarios_pendientes": 0,
        "total_productos": 13, "productos_activos": 13, "precio_promedio": 992.54, "total_ordenes": 7, "ordenes_pagadas": 2,
        "ordenes_pendientes": 5, "ingresos_totales": 1998.0, "total_pagos": 7, "monto_total_pagado": 6642.99,
    }
    live = one(summary.live_summary(t["usuarios"], t["productos"], t["ordenes"], t["pagos"]))
    assert (live["total_productos"], live["ordenes_pagadas"], live["monto_total_pagado"]) == (13, 2, 6642.99)


def test_sales(t):
    top = sales.top_products(t["orden_detalles"], t["productos"])
    assert rows(top, "rank", "id", "unidades_vendidas", "ingresos") == [(1, 1, 5, 4995.0), (2, 2, 1, 348.0), (3, 3, 1, 1299.99)]
    assert rows(sales.revenue_by_month(t["ordenes"]), "mes", "ingresos", "num_ordenes") == [("2026-04", 1998.0, 2)]
    assert rows(sales.sales_by_month(t["ordenes"]), "mes", "num_ordenes", "ingresos") == [("2026-04", 7, 1998.0)]
    by_state = sales.orders_by_state_amount(t["ordenes"])
    assert sorted(rows(by_state, "estado", "cantidad", "monto")) == [("pagada", 2, 1998.0), ("pendiente", 5, 4644.99)]


def test_catalog(t):
    assert one(catalog.price_stats(t["productos"])) == {"promedio": 992.54, "minimo": 79.0, "maximo": 5000.0}
    assert one(catalog.price_stats_active(t["productos"]))["valor_total_inventario"] == 315117.85
    assert [r.cantidad for r in catalog.price_histogram(t["productos"]).collect()] == [6, 3, 3, 0, 0, 0, 0, 0, 0, 1]
    sellers = catalog.inventory_by_seller(t["productos"])
    assert rows(sellers, "vendedor_id", "num_productos", "precio_promedio", "valor_inventario") == [
        (17, 3, 2500.0, 74000.0), (1, 2, 673.5, 91710.0), (2, 2, 1199.5, 55484.7), (3, 2, 224.5, 35549.55), (4, 2, 364.5, 26474.2),
    ]
    assert {r.vendedor for r in catalog.active_catalog(t["productos"], t["usuarios"].filter("id > 2")).collect()} == {
        "Usuario", "U3", "U4", "U5", "U17"}


def test_payments_and_credit(t):
    assert rows(payments.payment_methods(t["pagos"]), "metodo_pago", "usos", "monto_total") == [
        ("tarjeta", 6, 5643.99), ("transferencia", 1, 999.0)]
    assert one(credit.credit_stats(t["creditos"])) == {
        "cupo_promedio": 100000.0, "disponible_promedio": 100000.0, "cupo_usado_total": 0.0, "total_lineas": 1}
    assert sorted(rows(credit.movements_by_type(t["movimientos_credito"]), "tipo", "cantidad", "monto_total")) == [
        ("aumento_cupo", 1, 100000.0), ("pago", 1, 999.0)]
    history = credit.movement_history(t["movimientos_credito"])
    assert sorted(rows(history, "posicion", "id", "monto_con_signo", "clase")) == [
        (1, 2, 999.0, "pago"), (2, 1, 100000.0, "aumento")]


def test_quality(t):
    assert sorted(r.id_orden for r in quality.reconcile_orders(t["ordenes"], t["pagos"]).collect()) == [3, 4, 5, 6, 7]
    breaks = quality.ledger_breaks(t["movimientos_credito"]).collect()
    assert [(r.usuario_id, r.id, float(r.cupo_anterior), float(r.cupo_antes)) for r in breaks] == [(19, 2, 100000.0, 99001.0)]
    assert quality.reconcile_totals(t["ordenes"], t["orden_detalles"]).isEmpty()
    assert quality.orphans(t["pagos"], "id_orden", t["ordenes"], "x").isEmpty()


def test_users(t):
    assert rows(users.users_by_role(t["usuarios"]), "rol", "cantidad") == [("comprador", 16), ("admin", 2), ("vendedor", 1)]
    assert rows(users.registrations_by_month(t["usuarios"]), "mes", "nuevos") == [("2026-04", 19)]
    assert users.user_search(t["usuarios"], "vendedor", "U17@").count() == 1
    assert users.user_search(t["usuarios"], None, "%").count() == 0


def test_state_sums_equal_totals(t):
    assert sum(r.cantidad for r in sales.orders_by_state(t["ordenes"]).collect()) == 7
    assert sum(r.usos for r in payments.payment_methods(t["pagos"]).collect()) == 7


def test_report_round_trip(spark, t, tmp_path):
    bases = report.bases(t["usuarios"], t["productos"], t["ordenes"], t["pagos"])
    built = report.build(bases, t["orden_detalles"], t["productos"], t["creditos"])
    live = report.live(bases, t["orden_detalles"])
    path = str(tmp_path / "report")
    assert report.read(spark, path).isEmpty()
    alone = report.combined(report.read(spark, path), live).first()
    assert alone.fuente == "realtime" and alone.spark is None
    assert [(p.id, p.nombre) for p in alone.top_mostrado] == [(1, "Producto #1"), (2, "Producto #2"), (3, "Producto #3")]
    report.write(built, path)
    stored = report.read(spark, path)
    row = stored.first()
    assert row.fuente == "spark" and row.resumen.monto_total_pagado == 6642.99
    assert [(p.id, p.unidades_vendidas) for p in row.top_productos] == [(1, 5), (2, 1), (3, 1)]
    both = report.combined(stored, live).first()
    assert both.fuente == "spark+realtime" and both.realtime.total_usuarios == 19
    assert [p.nombre for p in both.top_mostrado] == ["Producto 1", "Producto 2", "Producto 3"]
