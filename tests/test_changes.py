"""Change logs and order intake on small cases."""

from decimal import Decimal

from tianguis.operators import changes, ledger, orders


def test_product_changes(spark):
    base = spark.createDataFrame(
        [(1, 10, "a", "d", Decimal("1.00"), 5, True, False), (2, 20, "b", "d", Decimal("2.00"), 6, True, True)],
        "id int, id_vendedor int, nombre string, descripcion string, precio decimal(12,2), cantidad int, activo boolean, aprobado boolean")
    log = spark.createDataFrame(
        [
            (1, "editar", 10, "vendedor", "a2", "x", Decimal("9.00"), 1, 1), (1, "editar", 10, "vendedor", "a3", None, Decimal("8.00"), 2, 2),
            (1, "editar", 99, "vendedor", "no", "x", Decimal("7.00"), 3, 3), (1, "aprobar", 0, "admin", None, None, None, None, 4),
            (2, "desactivar", 20, "vendedor", None, None, None, None, 5), (3, "editar", 30, "vendedor", "early", "x", Decimal("1.00"), 1, 6),
            (3, "publicar", 30, "vendedor", "c", "d", Decimal("3.00"), 7, 7), (3, "editar", 30, "vendedor", "c2", "d", Decimal("4.00"), 8, 8),
            (4, "publicar", 40, "comprador", "e", "d", Decimal("5.00"), 1, 9), (5, "aprobar", 0, "admin", None, None, None, None, 10),
        ],
        "id_producto int, tipo string, id_vendedor int, rol string, nombre string, descripcion string, precio decimal(12,2), cantidad int, n int")
    done = changes.apply_product_changes(base, log, ["n"])
    got = {r.id: (r.nombre, r.descripcion, float(r.precio), r.cantidad, r.activo, r.aprobado) for r in done.table.collect()}
    assert got == {
        1: ("a3", None, 8.0, 2, True, True), 2: ("b", "d", 2.0, 6, False, True), 3: ("c2", "d", 4.0, 8, True, True), 4: ("e", "d", 5.0, 1, True, False)}
    assert {r.n: r.motivo for r in done.rejects.collect()} == {3: changes.NOT_OWNER, 6: changes.NOT_OWNER, 10: changes.NOT_FOUND}


def test_registration(spark):
    have = spark.createDataFrame([("ana@x.com",)], "email string")
    asked = spark.createDataFrame(
        [("A", "ana@x.com", None, 1), ("B", "b@x.com", "vendedor", 3), ("B2", "b@x.com", None, 2), ("C", "Ana@X.com", "admin", 4)],
        "nombre string, email string, rol string, n int")
    done = changes.register_users(have, asked, ["n"])
    assert {(r.nombre, r.rol, r.estado) for r in done.table.collect()} == {("B2", "comprador", "activo"), ("C", "admin", "activo")}
    assert sorted(r.n for r in done.rejects.collect()) == [1, 3]
    blind = changes.register_users(have, asked, ["n"], ci_ai=True)
    assert [r.nombre for r in blind.table.collect()] == ["B2"]
    assert sorted(r.n for r in blind.rejects.collect()) == [1, 3, 4]


def test_user_changes_and_cascade(spark):
    users = spark.createDataFrame([(1, "pendiente"), (2, "activo"), (3, "activo")], "id int, estado string")
    log = spark.createDataFrame(
        [(1, "estado", "rechazado", 1), (1, "estado", "activo", 2), (1, "estado", "raro", 3), (2, "eliminar", None, 4), (2, "estado", "activo", 5),
         (9, "estado", "activo", 6), (2, "eliminar", None, 7)],
        "usuario_id int, tipo string, estado string, n int")
    done = changes.apply_user_changes(users, log, ["n"])
    assert {r.id: r.estado for r in done.table.collect()} == {1: "activo", 3: "activo"}
    assert {r.n: r.motivo for r in done.rejects.collect()} == {
        3: changes.BAD_STATE, 5: changes.USER_UNKNOWN, 6: changes.USER_UNKNOWN, 7: changes.USER_UNKNOWN}
    lines = spark.createDataFrame([(1,), (2,), (3,)], "usuario_id int")
    assert sorted(r[0] for r in changes.cascade(lines, "usuario_id", done.table).collect()) == [1, 3]


def test_intake_and_credit(spark):
    products = spark.createDataFrame([(1, "p1", Decimal("10.00"), 5), (2, "p2", Decimal("2.50"), 1)],
                                     "id int, nombre string, precio decimal(12,2), cantidad int")
    asked = spark.createDataFrame([(i, 7) for i in range(1, 6)], "id_orden int, id_comprador int")
    items = spark.createDataFrame([(1, 1, 2, 1), (1, 2, 1, 2), (2, 2, 3, 1), (2, 8, 1, 2), (3, 8, 1, 1), (3, 2, 3, 2), (5, 1, 5, 1)],
                                  "id_orden int, id_producto int, cantidad int, n int")
    done = orders.order_intake(asked, items, products, ["n"])
    assert {r.id_orden: (r.aceptada, r.total, r.motivo) for r in done.collect()} == {
        1: (True, 22.5, None), 2: (False, None, "Stock insuficiente para: p2"), 3: (False, None, "Producto 8 no encontrado"),
        4: (False, None, orders.EMPTY_ORDER), 5: (True, 50.0, None)}
    single = orders.order_intake(asked, items.filter("n = 1"), products, ["n"], single=True)
    assert {r.id_orden: r.total for r in single.collect()} == {1: 10.0, 2: 2.5, 3: None, 4: None, 5: 10.0}
    lines = spark.createDataFrame([(7, Decimal("40.00"), Decimal("40.00"), 0, "activo")],
                                  "usuario_id int, cupo_total decimal(12,2), cupo_disponible decimal(12,2), compras_completadas int, estado string")
    none = spark.createDataFrame([], "usuario_id int, id long, monto_por_cuota decimal(12,2), cuotas_totales int, cuotas_pagadas int")
    events = orders.intake_credit_events(done)
    outcomes = ledger.credit_ledger(events.withColumn("n", events.cuota_id), lines, none, ["n"])
    after = {r.id_orden: (r.aceptada, r.motivo) for r in orders.with_credit(done, outcomes).collect()}
    assert after[1] == (True, None) and after[5] == (False, ledger.NOT_ENOUGH) and after[4] == (False, orders.EMPTY_ORDER)
    assert sorted((r.id_producto, r.cantidad) for r in orders.intake_lines(done.filter("id_orden = 1"), items, products).collect()) == [(1, 2), (2, 1)]


def test_order_states(spark):
    base = spark.createDataFrame([(1, "pendiente"), (2, "pendiente")], "id int, estado string")
    log = spark.createDataFrame([(1, "pagada", 1), (1, "cancelada", 2), (1, "perdida", 3)], "id_orden int, estado string, n int")
    updated, refused = orders.order_state_updates(base, log, ["n"])
    assert {r.id: r.estado for r in updated.collect()} == {1: "cancelada", 2: "pendiente"}
    assert [r.n for r in refused.collect()] == [3]


def test_entries_meet_the_catalog_once(spark, monkeypatch):
    """Every entry is judged once: the refused ones are the rejects, the others make the table."""
    written, real = [], changes.stored

    def counted(df, purpose="filas"):
        written.append(df.count())
        return real(df, purpose)

    monkeypatch.setattr(changes, "stored", counted)
    catalog = spark.sql("select 1L id, 9L id_vendedor, 'a' nombre, 'd' descripcion, 1.00BD precio, 1 cantidad, true activo, false aprobado")
    log = spark.createDataFrame(
        [(1, "editar", 9, 1), (1, "editar", 8, 2), (1, "aprobar", 8, 3), (1, "desactivar", 9, 4), (2, "aprobar", 9, 5), (1, "otro", 9, 6)],
        "id_producto long, tipo string, id_vendedor long, momento int",
    ).selectExpr("*", "'vendedor' rol", "concat('n', momento) nombre", "'x' descripcion", "2.00BD precio", "3 cantidad")
    done = changes.apply_product_changes(catalog, log, ("momento",))
    assert [(r.nombre, r.activo, r.aprobado) for r in done.table.collect()] == [("n1", False, True)]
    assert {r.momento: r.motivo for r in done.rejects.collect()} == {2: changes.NOT_OWNER, 5: changes.NOT_FOUND, 6: changes.BAD_KIND}
    assert written == [6]
