"""Orders that take stock from each other, against a row-by-row model."""

import random

import pytest
from pyspark.sql import functions as F

from tianguis.operators import orders
from tianguis.plans import contention, skew
from tianguis.session import stored

SEQ = ("fecha",)


def model(requests, items, stock):
    """{order: (accepted, reason)} with orders (id, date) and items (order, line, product, quantity)."""
    left, out = dict(stock), {}
    for o, _ in sorted(requests, key=lambda r: (r[1], r[0])):
        mine = sorted((i for i in items if i[0] == o), key=lambda i: i[1])
        need = {}
        for _, _, p, n in mine:
            need[p] = need.get(p, 0) + max(n or 0, 0)
        why = None if mine else orders.EMPTY_ORDER
        static = {p for _, _, p, n in mine if p is None or p not in left or not n or n <= 0}
        for _, _, p, n in mine:
            if p is None:
                why = orders.NO_PRODUCT_ID
            elif p not in left:
                why = f"Producto {p} no encontrado"
            elif not n or n <= 0:
                why = orders.BAD_QUANTITY
            elif p not in static and need[p] > left[p]:
                why = f"Stock insuficiente para: P{p}"
            if why:
                break
        if why is None:
            for p, n in need.items():
                left[p] -= n
        out[o] = (why is None, why)
    return out, left


def frames(spark, requests, items, stock):
    return (
        spark.createDataFrame([(o, 1, d) for o, d in requests], "id_orden long, id_comprador long, fecha int"),
        spark.createDataFrame(items, "id_orden long, linea int, id_producto long, cantidad int"),
        spark.createDataFrame([(p, f"P{p}", n) for p, n in stock.items()], "id long, nombre string, cantidad long").withColumn(
            "precio", F.lit("1.50").cast("decimal(12,2)")
        ),
    )


def check(spark, requests, items, stock, **how):
    r, i, p = frames(spark, requests, items, stock)
    found = orders.order_intake_sequential(r, i, p, ("linea", "id_producto"), SEQ, **how)
    expected, left = model(requests, items, stock)
    assert {x.id_orden: (x.aceptada, x.motivo) for x in found.collect()} == expected
    return {x.id: x.cantidad for x in orders.stock_after_intake(p, i, found).collect()} == left


@pytest.mark.parametrize("seed,hot,head", [(1, 1000, 500), (2, 5, 500), (3, 5, 7)])
def test_contended_products(spark, seed, hot, head):
    rng = random.Random(seed)
    requests = [(o, rng.randint(0, 40)) for o in range(150)]
    items = []
    for o in range(150):
        for line in range(rng.randint(0, 4)):
            p = rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, 7, None, 99] if rng.random() < 0.15 else [1, 1, 1, 2, 3, 4, 5, 6, 7])
            items.append((o, line, p, rng.choice([1, 2, 3, 5, 8, 13, 40]) if rng.random() < 0.95 else rng.choice([0, -1, None])))
    stock = {p: rng.choice([10, 60, 200, 1000]) for p in range(1, 8)}
    assert check(spark, requests, items, stock, limits=skew.Limits(hot_rows=hot, chunk_rows=11), head=head)


def test_all_or_nothing(spark):
    """The second order fails on product 2 and leaves product 1 to the third; two lines of a product count together."""
    requests = [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    items = [(1, 1, 2, 4), (2, 1, 1, 5), (2, 2, 2, 2), (3, 1, 1, 5), (4, 1, 2, 1), (4, 2, 2, 1), (5, 1, 2, 1)]
    assert check(spark, requests, items, {1: 5, 2: 5})


def test_a_long_chain_needs_few_rounds(spark):
    """Every order hangs on the one before through a shared product; the head is folded, so rounds do not follow the chain."""
    n = 300
    requests = [(o, o) for o in range(n)]
    items = [(o, 0, o, 1) for o in range(n)] + [(o, 1, o + 1, 1) for o in range(n)]
    assert check(spark, requests, items, {p: 1 for p in range(n + 1)}, head=150)


def test_no_orders(spark):
    r, i, p = frames(spark, [(1, 1)], [(1, 0, 1, 1)], {1: 1})
    assert orders.order_intake_sequential(r.limit(0), i.limit(0), p, ("linea",), SEQ).collect() == []
    assert [x.motivo for x in orders.order_intake_sequential(r, i.limit(0), p, ("linea",), SEQ).collect()] == [orders.EMPTY_ORDER]


def test_reason_of_a_refused_order_whose_other_lines_are_settled_later(spark):
    """Order 3 fails on product 3 at once; whether its earlier line of product 1 fails too hangs on order 2, settled a round later."""
    requests = [(1, 1), (2, 2), (3, 3), (4, 4)]
    for second, reason in ((5, "P3"), (4, "P1")):
        items = [(1, 0, 2, 6), (2, 0, 1, 3), (2, 1, 2, second), (3, 0, 1, 3), (3, 1, 3, 9), (4, 0, 1, 2), (4, 1, 2, 1)]
        stock = {1: 5, 2: 10, 3: 1}
        assert check(spark, requests, items, stock)
        assert model(requests, items, stock)[0][3] == (False, f"Stock insuficiente para: {reason}")


def test_rows_leave_the_rounds(spark, monkeypatch):
    """Rows of products that can give whatever is asked are written once, however long the rounds over the others last."""
    written = []

    def counted(df, purpose="filas"):
        table = stored(df, purpose)
        written.append(table.count())
        return table

    monkeypatch.setattr(contention, "stored", counted)
    requests = [(o, o) for o in range(60)]
    items = [(o, 0, o, 1) for o in range(60)] + [(o, 1, o + 1, 1) for o in range(60)]
    items += [(o, 2 + k, 1000 + k, 1) for o in range(60) for k in range(10)]
    stock = {p: 1 for p in range(61)} | {1000 + k: 100 for k in range(10)}
    assert check(spark, requests, items, stock, head=0)
    assert len(written) > 5 and written[0] == 720 and max(written[1:]) <= 120


def test_chunks_share_tasks(spark):
    """More chunks than shuffle partitions: they rise along the order and are bounded, and no task is added for them."""
    rows = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    seen = []
    chunks = skew.in_chunks(rows, ["k"], [F.col("o")], 1000, skew.Limits(hot_rows=5, chunk_rows=10), keep=lambda d: seen.append(d) or d)
    assert seen[0].rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = [r[skew.CHUNK] for r in chunks.orderBy("o").collect()]
    assert found == sorted(found) and max(found.count(c) for c in set(found)) <= 10
