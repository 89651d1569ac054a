"""Empty tables, orphans, NULL months, ties, rounding, texts, enumerations."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests import seed
from tianguis.functions import domain, money, text
from tianguis.operators import catalog, credit, payments, sales, summary, users
from tianguis.plans import report


@pytest.fixture(scope="module")
def none(spark):
    return seed.empty(spark)


def test_everything_on_empty_tables(spark, none):
    got = summary.summary(none["usuarios"], none["productos"], none["ordenes"], none["pagos"]).first().asDict()
    assert set(got.values()) == {0}
    assert summary.admin_counters(none["usuarios"]).first().pct_activos == 0
    for df in (
        sales.top_products(none["orden_detalles"], none["productos"]), sales.revenue_by_month(none["ordenes"]),
        catalog.price_histogram(none["productos"]), catalog.inventory_by_seller(none["productos"]),
        payments.account_statement(none["ordenes"], none["pagos"]), payments.payment_application(none["ordenes"], none["pagos"]),
        credit.credit_panel(none["usuarios"], none["creditos"]), credit.movement_history(none["movimientos_credito"]),
    ):
        assert df.isEmpty()
    bases = report.bases(*[none[n] for n in ("usuarios", "productos", "ordenes", "pagos")])
    row = report.build(bases, none["orden_detalles"], none["productos"], none["creditos"]).first()
    assert row.top_productos == [] and row.resumen.total_ordenes == 0 and row.credito.total_lineas == 0


def test_unknown_and_unnamed_products_keep_a_label(spark):
    lines = spark.createDataFrame([(1, 7, 5, Decimal("2.00")), (1, 8, 3, Decimal("1.00")), (1, 9, 1, Decimal("1.00"))],
                                  "id_orden int, id_producto int, cantidad int, precio_unitario decimal(10,2)")
    products = spark.createDataFrame([(8, ""), (9, "n")], "id int, nombre string")
    assert [(r.id, r.nombre) for r in sales.top_products(lines, products).collect()] == [(7, "Producto #7"), (8, "Producto #8"), (9, "n")]
    assert [r.id for r in sales.top_products_inner(lines, products, 2).collect()] == [8, 9]


def test_null_month_and_bad_text(spark):
    orders = spark.createDataFrame([(1, Decimal("1.00"), "pagada", "2026-01-31 10:00:00"), (2, Decimal("2.00"), "pagada", "nothing"),
                                    (3, Decimal("4.00"), "pagada", None)], "id int, total decimal(10,2), estado string, fecha string")
    assert [(r.mes, r.ingresos) for r in sales.revenue_by_month(orders).collect()] == [(None, 6.0), ("2026-01", 1.0)]


def test_histogram_of_one_price(spark):
    df = spark.createDataFrame([(Decimal("10.00"),)] * 3, "precio decimal(10,2)")
    got = [(r.bin, r.cantidad) for r in catalog.price_histogram(df).collect()]
    assert got == [(i, 3 if i == 5 else 0) for i in range(10)]


def test_average_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.02"),)], "x decimal(10,2)")
    assert df.agg(money.mean(F.col("x"))).first()[0] == 0.02
    assert df.agg(money.mean(-F.col("x"))).first()[0] == -0.02


def test_instalments_leave_a_remainder(spark):
    df = spark.createDataFrame([(1, 1, Decimal("100.00"), 3)], "usuario_id int, compra_id int, monto_total decimal(12,2), cuotas_totales int")
    row = credit.instalment_plan(df).first()
    assert (row.monto_por_cuota, row.residuo) == (33.33, 0.01)
    assert [(r.numero, r.monto) for r in credit.instalment_schedule(df).collect()] == [(1, 33.33), (2, 33.33), (3, 33.33)]


def test_texts(spark):
    df = spark.createDataFrame([("pagada", Decimal("1234567.50")), ("éxito grande", Decimal("-1234.49")), ("", None)], "s string, n decimal(12,2)")
    got = [tuple(r) for r in df.select(text.capital_first(F.col("s")), text.money_text(F.col("n"))).collect()]
    assert got == [("Pagada", "$1.234.568"), ("Éxito grande", "$-1.234"), ("", "$0")]
    roles = spark.createDataFrame([("admin",), ("otro",)], "rol string")
    assert [r[0] for r in roles.select(text.label(F.col("rol"), text.ROLE_LABELS)).collect()] == ["Administradores", "otro"]


def test_case_and_accent_blind_methods(spark):
    df = spark.createDataFrame([("Tarjeta", Decimal("1.00")), ("tarjéta", Decimal("2.00")), ("efectivo", Decimal("4.00"))],
                               "metodo_pago string, monto decimal(10,2)")
    assert len(payments.payment_methods(df).collect()) == 3
    assert sorted((r.usos, r.monto_total) for r in payments.payment_methods(df, ci_ai=True).collect()) == [(1, 4.0), (2, 3.0)]


def test_enumerations_split(spark):
    df = spark.createDataFrame([("pagada",), ("perdida",), (None,)], "estado string")
    ok, bad = domain.split_enum(df, "ordenes", "estado")
    assert (ok.count(), bad.count()) == (1, 2)
    legacy = spark.createDataFrame([("al_dia",), ("vencida",)], "estado string")
    assert domain.split_enum(legacy, "cuotas_pendientes (legacy)", "estado")[0].count() == 1


def test_share_and_percent(spark):
    df = spark.createDataFrame([("comprador", "activo")] * 76 + [("vendedor", "pendiente")] * 24, "rol string, estado string")
    assert [(r.rol, r.porcentaje) for r in users.users_by_role_share(df).collect()] == [("comprador", 76.0), ("vendedor", 24.0)]
    row = summary.admin_counters(df).first()
    assert (row.pct_activos, row.barra_compradores, row.barra_vendedores, row.barra_admins) == (76, 100, 32, 0)


def test_credit_panel_without_line_and_nearly_used(spark):
    people = spark.createDataFrame([(i, f"n{i}", f"e{i}", "comprador") for i in range(4)], "id int, nombre string, email string, rol string")
    lines = spark.createDataFrame(
        [(1, Decimal("100.00"), Decimal("9.00"), 2), (2, Decimal("0.00"), Decimal("0.00"), 3), (3, Decimal("100.00"), Decimal("10.00"), 0)],
        "usuario_id int, cupo_total decimal(12,2), cupo_disponible decimal(12,2), compras_completadas int")
    got = {r.id: (r.etiqueta, r.porcentaje, r.compras_para_aumento) for r in credit.credit_panel(people, lines).collect()}
    assert got == {0: ("Sin datos de credito", None, None), 1: ("Casi agotado", 91, 1), 2: ("Cuenta activa", 0, 3), 3: ("Cuenta activa", 90, 3)}
