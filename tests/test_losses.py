"""One answer whatever the size of a key, and no entry of a log that vanishes."""

import random

import pytest

from tests import seed
from tianguis.operators import changes, orders
from tianguis.plans import admission, skew
from tianguis.sources import sinks
from tianguis.sources.tables import read_table

HOT = skew.Limits(hot_rows=3, chunk_rows=4)


def fold(spark, rows, limits):
    requests = spark.createDataFrame(rows, "k long, pos long, x long")
    capacity = spark.createDataFrame([(1, 10), (2, 25), (3, 0)], "k long, capacidad long")
    out = admission.admit(requests, capacity, "k", ["pos"], "x", limits=limits)
    return sorted((tuple(r) for r in out.select("k", "pos", "x", "concedido", "antes", "despues").collect()), key=str)


@pytest.mark.parametrize("seed_no", range(3))
def test_hot_and_cold_folds_agree_on_repeated_orders_and_null_keys(spark, seed_no):
    r = random.Random(seed_no)
    rows = [(r.choice([1, 2, 3, 9, None]), r.randrange(4), r.randrange(-1, 8)) for _ in range(60)]
    cold, hot = fold(spark, rows, skew.DEFAULT), fold(spark, rows, HOT)
    assert cold == hot and len(hot) == 60
    assert all(x[5] is None or x[5] >= 0 for x in hot)


def test_row_numbers_of_a_hot_null_key(spark):
    rows = [(None if i % 2 else i % 3, i) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, v long")
    number = lambda limits: sorted((tuple(x) for x in skew.row_numbers(df, ["k"], [df["v"]], "n", limits).collect()), key=str)
    assert number(HOT) == number(skew.DEFAULT)
    before = lambda limits: sorted((tuple(x) for x in skew.previous_values(df, ["k"], ["v"], "v", "p", limits).collect()), key=str)
    assert before(HOT) == before(skew.DEFAULT)


def test_product_log_accepted_and_rejected(spark):
    products = seed.frames(spark)["productos"]
    fields = "seq long, id_producto int, tipo string, id_vendedor int, rol string, nombre string, descripcion string, precio decimal(10,2), cantidad int"
    log = [(1, 900, "publicar", 5, "vendedor"), (2, 900, "publicar", 6, "vendedor"), (3, 1, "publicar", 5, "vendedor"), (4, 900, "otro", 5, "x"), (5, 900, None, 5, "x"), (6, None, "publicar", 5, "x")]
    out = changes.apply_product_changes(products, spark.createDataFrame([(*x, "n", None, None, 1) for x in log], fields), ["seq"])
    assert sorted(r.seq for r in out.rejects.collect()) == [2, 3, 4, 5, 6]
    assert out.table.where("id = 900").count() == 1


def test_user_logs_accepted_and_rejected(spark):
    users = seed.frames(spark)["usuarios"]
    asked = spark.createDataFrame([(1, "a", None, None), (2, "b", None, None), (3, "c", "new@x", None), (4, "d", "new@x", None)], "seq long, nombre string, email string, rol string")
    out = changes.register_users(users, asked, ["seq"])
    assert sorted(r.email for r in out.table.collect()) == ["new@x"] and sorted(r.seq for r in out.rejects.collect()) == [1, 2, 4]
    some = users.first()["id"]
    log = spark.createDataFrame([(1, some, "raro", "activo"), (2, some, None, "activo"), (3, some, "estado", None)], "seq long, usuario_id int, tipo string, estado string")
    assert sorted(r.seq for r in changes.apply_user_changes(users, log, ["seq"]).rejects.collect()) == [1, 2, 3]


def test_orders_refuse_unknown_ids_and_bad_quantities(spark):
    t = seed.frames(spark)
    known = t["ordenes"].first()["id"]
    log = spark.createDataFrame([(1, known, "pagada"), (2, 987654, "pagada"), (3, known, None)], "seq long, id_orden int, estado string")
    _, refused = orders.order_state_updates(t["ordenes"], log, ["seq"])
    assert sorted(r.seq for r in refused.collect()) == [2, 3]
    product = t["productos"].where("cantidad > 1").first()["id"]
    requests = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id_orden int, id_comprador int")
    items = spark.createDataFrame([(1, product, -4, 1), (2, product, None, 1), (3, product, 1, 1)], "id_orden int, id_producto int, cantidad int, n int")
    got = {r.id_orden: r.aceptada if hasattr(r, "aceptada") else r.motivo is None for r in orders.order_intake(requests, items, t["productos"], ["n"]).collect()}
    assert got == {1: False, 2: False, 3: True}


def test_csv_with_newlines_and_quotes(spark, tmp_path):
    products = seed.frames(spark)["productos"].limit(1).selectExpr("* except (descripcion)", "'a\nb \"c\", d' as descripcion")
    sinks.export_table(products, str(tmp_path), "productos", "csv")
    got = read_table(spark, str(tmp_path), "productos", "csv").collect()
    assert [r.descripcion for r in got] == ['a\nb "c", d']
