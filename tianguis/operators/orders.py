"""Orders: listing by buyer, intake of new ones, stock, state updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tianguis.functions import money
from tianguis.functions.domain import in_domain
from tianguis.plans import contention, skew
from tianguis.plans.admission import AFTER, BEFORE, GRANTED, admit

# Texts of refusals.
EMPTY_ORDER = "La orden debe tener productos"
NO_PRODUCT_ID = "ID de producto requerido"
NOT_FOUND = ("Producto ", " no encontrado")
NOT_ENOUGH = "Stock insuficiente para: "
BAD_QUANTITY = "Cantidad inválida"
NO_STOCK = "Sin stock para: "


def orders_by_user(ordenes: DataFrame, limits: skew.Limits = skew.DEFAULT) -> DataFrame:
    """Every order with its place among its buyer's, newest first."""
    rows = ordenes.select("id_comprador", "id", money.as_double("total").alias("total"), "estado", "fecha")
    return skew.row_numbers(rows, ["id_comprador"], [F.desc("fecha"), F.col("id")], "posicion", limits)


def _judged(items: DataFrame, productos: DataFrame, stock_text: str) -> DataFrame:
    """Items beside their catalog row with the reason to refuse them, NULL where there is none."""
    catalog = productos.select(
        F.col("id").alias("id_producto"), "nombre", "precio", F.col("cantidad").alias("stock"), F.lit(True).alias("hay")
    )
    why = (
        F.when(F.col("id_producto").isNull(), NO_PRODUCT_ID)
        .when(F.col("hay").isNull(), F.concat(F.lit(NOT_FOUND[0]), F.col("id_producto").cast("string"), F.lit(NOT_FOUND[1])))
        .when(~F.coalesce(F.col("cantidad") > 0, F.lit(False)), F.lit(BAD_QUANTITY))
        .when(F.col("stock") < F.col("cantidad"), F.concat(F.lit(stock_text), F.col("nombre")))
    )
    return items.join(catalog, "id_producto", "left").withColumn("motivo", why)


def order_intake(
    requests: DataFrame, items: DataFrame, productos: DataFrame, order: Sequence[str], single: bool = False
) -> DataFrame:
    """Requested orders with total, verdict and the reason of the first item that fails.

    ``requests``: id_orden, id_comprador. ``items``: id_orden, id_producto, cantidad and ``order``, the
    sequence of the items. Every item is checked against the stock the batch starts with. With ``single``
    each request buys one unit. Items are combined per order in every task before the shuffle.
    """
    wanted = items.withColumn("cantidad", F.lit(1)) if single else items
    judged = _judged(wanted, productos, NO_STOCK if single else NOT_ENOUGH)
    first = F.min(F.when(F.col("motivo").isNotNull(), F.struct(F.struct(*order).alias("o"), "motivo")))
    per_order = judged.groupBy("id_orden").agg(
        F.sum(F.col("precio") * F.col("cantidad")).alias("importe"),
        F.count("*").alias("lineas"),
        first.alias("fallo"),
    )
    why = F.when(F.col("lineas").isNull(), NO_PRODUCT_ID if single else EMPTY_ORDER).otherwise(F.col("fallo.motivo"))
    return (
        requests.join(per_order, "id_orden", "left")
        .withColumn("motivo", why)
        .select(
            "id_orden", "id_comprador",
            F.when(F.col("motivo").isNull(), F.col("importe")).cast("double").alias("total"),
            F.coalesce("lineas", F.lit(0).cast("bigint")).alias("lineas"),
            F.col("motivo").isNull().alias("aceptada"),
            F.when(F.col("motivo").isNull(), "pendiente").alias("estado"),
            "motivo",
        )
    )


def order_intake_sequential(
    requests: DataFrame, items: DataFrame, productos: DataFrame, order: Sequence[str], sequence: Sequence[str],
    limits: skew.Limits = skew.DEFAULT, head: int = contention.HEAD,
) -> DataFrame:
    """As :func:`order_intake`, but orders take stock from each other: each meets what the accepted ones before it left.

    ``requests``: id_orden, id_comprador and ``sequence``, in which orders are handled (ties by id_orden). An order is accepted
    as a whole or takes nothing. Lines of one product in an order are asked for together. The reason is that of the first
    item, by ``order``, that fails against the stock of its moment.
    """
    turn = [c for c in (*sequence, "id_orden") if c != "id_orden"] + ["id_orden"]
    lines = items.filter(F.col("id_orden").isNotNull()).select(*dict.fromkeys(["id_orden", "id_producto", "cantidad", *order]))
    count, hot = skew.row_count(lines, ["id_producto"], limits)
    good = F.coalesce(F.col("cantidad") > 0, F.lit(False))
    place = F.dense_rank().over(Window.partitionBy("id_orden").orderBy(*order))
    asked = lines.withColumn("_lugar", place).groupBy("id_orden", "id_producto").agg(
        F.sum(F.when(good, F.col("cantidad")).otherwise(0).cast("bigint")).alias("pide"),
        F.sum("cantidad").cast("bigint").alias("suma"), F.count("*").alias("lineas"),
        F.min("_lugar").alias("_primera"), F.min(F.when(~good, F.col("_lugar"))).alias("_mala"),
    )
    asked = requests.select(*turn).join(asked, "id_orden")

    # One row per product, so that a product which stands in the catalog twice counts twice as before.
    catalog = productos.groupBy(F.col("id").alias("id_producto")).agg(F.sum("precio").alias("precio"), F.count("*").alias(contention.TIMES), F.first("nombre").alias("nombre"))
    stock = productos.select(F.col("id").alias("id_producto"), F.col("cantidad").cast("bigint").alias(contention.CAPACITY))
    capacity = stock.join(catalog.drop("nombre"), "id_producto")
    known = F.col(contention.TIMES).isNotNull()

    def ready(rows: DataFrame) -> DataFrame:
        bad_line = known & F.col("_mala").isNotNull()
        return rows.select(
            *[c for c in rows.columns if c != "lineas"],
            (~known | bad_line).alias(contention.INVALID), F.when(bad_line, F.col("_mala")).otherwise(F.col("_primera")).alias(contention.RANK),
            (F.col("precio") * F.col("suma")).alias("importe"), (F.col("lineas") * F.coalesce(contention.TIMES, F.lit(1))).alias("lineas"),
        )

    done = contention.admit_all(
        asked, capacity, "id_orden", "id_producto", turn, "pide", ready, ("importe", "lineas"), limits, head, count, hot
    )
    failing = done.failing.join(catalog.select("id_producto", contention.TIMES, "nombre"), "id_producto", "left")
    text = (
        F.when(F.col("id_producto").isNull(), NO_PRODUCT_ID)
        .when(~known, F.concat(F.lit(NOT_FOUND[0]), F.col("id_producto").cast("string"), F.lit(NOT_FOUND[1])))
        .when(F.col(contention.INVALID), BAD_QUANTITY)
        .otherwise(F.concat(F.lit(NOT_ENOUGH), F.col("nombre")))
    )
    fails = F.struct(F.col(contention.RANK).alias("o"), text.alias("motivo")).alias("fallo")
    told = (
        done.first.select("id_orden", "importe", "lineas")
        .unionByName(done.verdicts.select("id_orden", F.col(contention.GRANTED).alias("concedida")), allowMissingColumns=True)
        .unionByName(failing.select("id_orden", fails), allowMissingColumns=True)
    )
    per_order = told.groupBy("id_orden").agg(
        F.sum("importe").alias("importe"), F.sum("lineas").alias("lineas"), F.max("concedida").alias("concedida"), F.min("fallo").alias("fallo")
    )
    accepted = F.coalesce("concedida", F.lit(False))
    why = F.when(F.col("lineas").isNull(), EMPTY_ORDER).when(~accepted, F.col("fallo.motivo"))
    return requests.select("id_orden", "id_comprador").join(per_order, "id_orden", "left").select(
        "id_orden", "id_comprador",
        F.when(accepted, F.col("importe")).cast("double").alias("total"),
        F.coalesce("lineas", F.lit(0).cast("bigint")).alias("lineas"),
        accepted.alias("aceptada"),
        F.when(accepted, "pendiente").alias("estado"),
        why.alias("motivo"),
    )


def stock_after_intake(productos: DataFrame, items: DataFrame, intake: DataFrame) -> DataFrame:
    """The catalog less what the accepted orders of an intake took: id, cantidad, vendidas."""
    lines = items.join(intake.filter("aceptada").select("id_orden"), "id_orden", "left_semi")
    sold = lines.groupBy(F.col("id_producto").alias("id")).agg(F.sum("cantidad").cast("bigint").alias("vendidas"))
    gone = F.coalesce("vendidas", F.lit(0).cast("bigint"))
    return productos.select("id", "cantidad").join(sold, "id", "left").select(
        "id", (F.col("cantidad") - gone).cast("bigint").alias("cantidad"), gone.alias("vendidas")
    )


def intake_lines(intake: DataFrame, items: DataFrame, productos: DataFrame) -> DataFrame:
    """The lines of accepted orders at catalog prices."""
    accepted = intake.filter("aceptada").select("id_orden")
    prices = productos.select(F.col("id").alias("id_producto"), F.col("precio").alias("precio_unitario"))
    wanted = items.select("id_orden", "id_producto", "cantidad").join(accepted, "id_orden", "left_semi")
    return wanted.join(prices, "id_producto").select("id_orden", "id_producto", "cantidad", "precio_unitario")


def intake_credit_events(intake: DataFrame, order: Sequence[str] = ("id_orden",), instalments: str | None = None) -> DataFrame:
    """What accepted orders ask of the buyers' credit lines; one instalment unless a column tells."""
    return intake.filter("aceptada").select(
        F.col("id_comprador").alias("usuario_id"), F.lit("usar").alias("tipo"),
        F.col("total").cast("decimal(12,2)").alias("monto"),
        (F.coalesce(F.col(instalments), F.lit(1)) if instalments else F.lit(1)).alias("cuotas"),
        F.col("id_orden").alias("cuota_id"), *[c for c in order if c != "cuota_id"],
    )


def with_credit(intake: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The intake after the credit lines were asked: an order they refuse is refused with their reason."""
    verdict = outcomes.select(F.col("cuota_id").alias("id_orden"), F.col("motivo").alias("_credito"))
    why = F.coalesce("motivo", "_credito")
    return (
        intake.join(verdict, "id_orden", "left")
        .withColumn("motivo", why)
        .withColumn("aceptada", F.col("motivo").isNull())
        .withColumn("total", F.when(F.col("aceptada"), F.col("total")))
        .withColumn("estado", F.when(F.col("aceptada"), F.col("estado")))
        .drop("_credito")
    )


def stock_fold(
    requests: DataFrame, productos: DataFrame, order: Sequence[str], limits: skew.Limits = skew.DEFAULT
) -> DataFrame:
    """Guarded stock decrements in order; a refused request consumes nothing."""
    capacity = productos.select(F.col("id").alias("id_producto"), F.col("cantidad").cast("bigint").alias("capacidad"))
    return admit(requests, capacity, "id_producto", order, "cantidad", limits=limits).select(
        *requests.columns, F.col(GRANTED).alias("aceptado"), F.col(BEFORE).alias("stock_antes"),
        F.col(AFTER).alias("stock_despues"),
    )


def stock_after(productos: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The catalog with the granted quantities taken off."""
    used = outcomes.filter("aceptado").groupBy(F.col("id_producto").alias("id")).agg(F.sum("cantidad").alias("_u"))
    left = (F.col("cantidad") - F.coalesce("_u", F.lit(0))).cast("bigint")
    return productos.join(used, "id", "left").withColumn("cantidad", left).drop("_u")


def order_state_updates(ordenes: DataFrame, changes: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(orders with the last valid state of the log, refused changes: bad states and unknown orders).

    ``changes``: id_orden, estado and the ``order`` columns. The last change per order is found by a
    combinable maximum, so an order with any number of changes needs no window.
    """
    ok = F.coalesce(in_domain(F.col("estado"), "ordenes", "estado"), F.lit(False))
    there = ordenes.select(F.col("id").alias("id_orden"))
    last = (
        changes.filter(ok)
        .groupBy(F.col("id_orden").alias("id"))
        .agg(F.max_by("estado", F.struct(*order)).alias("_nuevo"))
    )
    updated = ordenes.join(last, "id", "left").withColumn("estado", F.coalesce("_nuevo", "estado")).drop("_nuevo")
    unknown = changes.filter(ok).join(there, "id_orden", "left_anti").select(*changes.columns)
    return updated, changes.filter(~ok).unionByName(unknown)
