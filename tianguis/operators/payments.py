"""Payments: methods, sums per order and account statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tianguis.functions import money
from tianguis.functions.text import text_key
from tianguis.operators import ledger
from tianguis.plans import skew
from tianguis.plans.admission import AFTER, BEFORE, GRANTED, admit
from tianguis.session import stored, unsent

TOLERANCE = "0.01"  # fixed value: slack when a paid sum is compared with an order total


def payment_methods(pagos: DataFrame, ci_ai: bool = False) -> DataFrame:
    """Uses and amount per method, most used first. ``ci_ai`` joins spellings that differ in case or accent."""
    spelled = pagos.groupBy("metodo_pago").agg(F.count("*").alias("usos"), F.sum("monto").alias("monto"))
    if ci_ai:
        # Spellings are few by now; only they are compared by the collation.
        spelled = spelled.groupBy(text_key(F.col("metodo_pago"), True).alias("clave")).agg(
            F.min("metodo_pago").alias("metodo_pago"), F.sum("usos").alias("usos"), F.sum("monto").alias("monto")
        )
    return spelled.select(
        "metodo_pago", "usos", F.coalesce("monto", F.lit(0)).cast("double").alias("monto_total")
    ).orderBy(F.desc("usos"), "metodo_pago")


def paid_per_order(ordenes: DataFrame, pagos: DataFrame) -> DataFrame:
    """Sum paid for every order, 0 where nothing was paid."""
    paid = pagos.groupBy(F.col("id_orden").alias("id")).agg(F.sum("monto").alias("pagado"))
    return ordenes.select("id").join(paid, "id", "left").select(
        F.col("id").alias("id_orden"), F.coalesce("pagado", F.lit(0)).cast("double").alias("total_pagado")
    )


def account_statement(ordenes: DataFrame, pagos: DataFrame) -> DataFrame:
    """Total, paid, outstanding and settled flag per order; payments are summed before the join.

    The single payments stay rows: see :func:`statement_lines`.
    """
    paid = pagos.groupBy(F.col("id_orden").alias("id")).agg(
        F.sum("monto").alias("pagado"), F.count("*").alias("num_pagos")
    )
    got = F.coalesce(F.col("pagado"), F.lit(0).cast("decimal(12,2)"))
    settled = got >= F.col("total") - F.lit(TOLERANCE).cast("decimal(12,2)")
    return ordenes.join(paid, "id", "left").select(
        F.col("id").alias("id_orden"),
        F.col("estado").alias("estado_orden"),
        money.as_double("total").alias("monto_total_orden"),
        got.cast("double").alias("total_pagado_acumulado"),
        F.greatest(F.col("total") - got, F.lit(0)).cast("double").alias("saldo_restante"),
        F.when(settled, "liquidada").otherwise("pendiente").alias("estado_pago"),
        F.coalesce("num_pagos", F.lit(0).cast("bigint")).alias("num_pagos"),
    )


def statement_lines(ordenes: DataFrame, pagos: DataFrame) -> DataFrame:
    """The payments behind the statements, one row each, of orders that exist."""
    known = ordenes.select(F.col("id").alias("id_orden"))
    return pagos.join(known, "id_orden", "left_semi").select(
        "id_orden", "transaccion_id", "metodo_pago", money.as_double("monto").alias("monto"), "estado", "fecha_pago"
    )


# Texts of refusals.
ORDER_UNKNOWN = "Orden no encontrada"
ORDER_PAID = "La orden ya está totalmente pagada"
TOO_MUCH = "El monto excede el saldo pendiente"
BAD_AMOUNT = "Monto no válido"


def payment_application(
    ordenes: DataFrame,
    pagos: DataFrame,
    order: Sequence[str] = ("fecha_pago", "transaccion_id"),
    replay: bool = True,
    closure: DataFrame | None = None,
    previous: DataFrame | None = None,
    limits: skew.Limits = skew.DEFAULT,
) -> DataFrame:
    """Payments in order against their orders: refused once the order is paid or when they exceed the rest.

    One cent above the total is tolerated. ``replay`` starts every order as unpaid; without it an order that
    is already ``pagada`` refuses. ``previous`` (id_orden, pagado, cerrada) holds what earlier runs accepted.
    ``closure`` (id_orden, cierre_ok) tells orders whose closing failed: they stay open although fully paid.
    """
    capacity = ordenes.select(F.col("id").alias("id_orden"), "estado", money.cents("total").alias("_total"))
    holds, paid, closed = F.lit(1), F.lit(0).cast("bigint"), F.lit(False)
    if closure is not None:
        capacity = capacity.join(closure.select("id_orden", "cierre_ok"), "id_orden", "left")
        holds = F.coalesce(F.col("cierre_ok").cast("int"), F.lit(1))
    if previous is not None:
        earlier = previous.select("id_orden", money.cents("pagado").alias("_pagado"), F.col("cerrada").alias("_cerrada"))
        capacity = capacity.join(earlier, "id_orden", "left")
        paid, closed = F.coalesce("_pagado", paid), F.coalesce("_cerrada", closed)
    if not replay:
        settled = F.col("estado") == "pagada"
        paid, closed = F.when(settled, F.col("_total")).otherwise(paid), settled | closed
    capacity = capacity.select(
        "id_orden", "_total", (F.col("_total") + 1 - paid).alias("capacidad"), holds.alias("holgura"), closed.alias("cerrada")
    )
    asked = pagos.select("id_orden", "transaccion_id", *[c for c in order if c != "transaccion_id"], "monto").withColumn(
        "_x", money.cents("monto")
    )
    rows = admit(asked, capacity, "id_orden", order, "_x", limits=limits, keep=("_total", "holgura", "cerrada"))

    def is_closed(left: str) -> Column:
        return F.col("cerrada") | ((F.col("_total") > 0) & (F.col("holgura") == 1) & (F.col(left) == 1))

    why = (
        F.when(F.col(GRANTED), F.lit(None).cast("string"))
        .when(F.col("_total").isNull(), ORDER_UNKNOWN)
        .when(is_closed(BEFORE), ORDER_PAID)
        .when(F.col("_x").isNull() | (F.col("_x") <= 0), BAD_AMOUNT)
        .otherwise(TOO_MUCH)
    )
    total_paid = F.col("_total") + 1 - F.col(AFTER)
    return rows.select(
        "id_orden", "transaccion_id", *[c for c in order if c != "transaccion_id"],
        money.as_double("monto").alias("monto"),
        F.col(GRANTED).alias("aceptado"),
        why.alias("motivo"),
        money.from_cents(total_paid).alias("total_pagado_acumulado"),
        money.from_cents(F.greatest(F.col("_total") - total_paid, F.lit(0).cast("bigint"))).alias("saldo_restante"),
        F.when(F.col("_total").isNull(), F.lit(None).cast("string"))
        .when(is_closed(AFTER), "pagada")
        .otherwise("pendiente")
        .alias("estado_orden"),
    )


def closing_events(ordenes: DataFrame, applied: DataFrame, order: Sequence[str] = ("fecha_pago", "transaccion_id")) -> DataFrame:
    """The credit use each closing payment asks for: the whole total in one instalment."""
    closings = applied.filter(F.col("aceptado") & (F.col("estado_orden") == "pagada")).select("id_orden", *order)
    return closings.join(ordenes.select(F.col("id").alias("id_orden"), "id_comprador", "total"), "id_orden").select(
        F.col("id_comprador").alias("usuario_id"), F.lit("usar").alias("tipo"), F.col("total").alias("monto"),
        F.lit(1).alias("cuotas"), F.col("id_orden").alias("cuota_id"), *order,
    )


def closure_by_credit(
    ordenes: DataFrame, pagos: DataFrame, lines: DataFrame, plans: DataFrame, others: DataFrame | None = None,
    order: Sequence[str] = ("fecha_pago", "transaccion_id"), limits: skew.Limits = skew.DEFAULT, ledger_limits: skew.Limits = ledger.LEDGER_LIMITS,
) -> tuple[DataFrame, DataFrame]:
    """(orders after their payments, payments with their verdicts), where a closing payment asks the buyer's credit line.

    The payment that makes an order's sum equal its total uses the buyer's line for that total in one instalment; only if
    the line grants it is the order paid. ``others`` are further events of the lines in between, with the columns of
    :func:`closing_events`. Payments fold by order and credit by user, but they need not alternate: an order's sum meets its total at
    most once, and up to that payment no verdict asks for the line. So the closing payments are known before any line is asked,
    and only a refused closing and what comes after it (one cent of tolerance, or too much instead of paid) is judged once more,
    from the sum before it.
    """
    ordenes = unsent(stored(ordenes))
    applied = stored(payment_application(ordenes, pagos, order, limits=limits))
    events = unsent(stored(closing_events(ordenes, applied, order)))
    asked = events if others is None else events.unionByName(others.select(*events.columns))
    outcomes = ledger.credit_ledger(asked, lines, plans, order, limits=ledger_limits)
    # An event among the others may name the same plan, so closings are told by their payment.
    keys = [c for c in order]
    closings = events.select(F.col("cuota_id").alias("id_orden"), *keys)
    closure = stored(
        outcomes.filter(F.col("tipo") == ledger.USE)
        .select(F.col("cuota_id").alias("id_orden"), *keys, F.col("aceptado").alias("cierre_ok"), F.col("motivo").alias("motivo_cierre"))
        .join(closings, ["id_orden", *keys], "left_semi")
    )
    refused = closure.filter(~F.col("cierre_ok")).select("id_orden")
    # An order shows as paid from its closing payment on; what came before that does not hang on the line.
    before = applied.filter(~F.col("estado_orden").eqNullSafe("pagada"))
    since = applied.filter(F.col("estado_orden") == "pagada")
    # An order that stands twice, or was refused twice, has its payments judged as often; such ones are judged again as a whole.
    twice = ordenes.groupBy(F.col("id").alias("id_orden")).agg(F.count("*").alias("_n")).filter("_n > 1").select("id_orden", F.lit(True).alias("_dos"))
    counted = refused.groupBy("id_orden").agg(F.count("*").alias("_n")).join(twice, "id_orden", "left")
    counted = stored(counted.select("id_orden", (F.col("_dos").isNotNull() | (F.col("_n") > 1)).alias("_dos")))
    odd, once = counted.filter("_dos").select("id_orden"), unsent(counted.filter(~F.col("_dos")).select("id_orden"))
    told = stored(since.join(once.withColumn("_no", F.lit(True)), "id_orden", "left"))
    behind = told.filter("_no").drop("_no").withColumn("monto", F.col("monto").cast("decimal(12,2)"))
    its_own = ordenes.select(F.col("id").alias("id_orden"), "total")
    closing = behind.filter("aceptado").groupBy("id_orden").agg(F.sum("monto").alias("_ultimo"))
    paid = closing.join(its_own, "id_orden").groupBy("id_orden").agg((F.max("total") - F.max("_ultimo")).alias("pagado"), F.lit(False).alias("cerrada"))
    again = payment_application(
        ordenes.join(once, F.col("id") == F.col("id_orden"), "left_semi"), behind, order,
        closure=once.withColumn("cierre_ok", F.lit(False)), previous=paid, limits=limits,
    )
    verdicts = before.unionByName(told.filter("_no is null").drop("_no"))
    many = odd.count()
    if many:
        side = F.broadcast(odd) if many <= limits.broadcast_keys else odd
        whole = payment_application(
            ordenes.join(side, F.col("id") == F.col("id_orden"), "left_semi"), pagos.join(side, "id_orden", "left_semi"), order,
            closure=refused.join(side, "id_orden", "left_semi").withColumn("cierre_ok", F.lit(False)), limits=limits,
        )
        verdicts = verdicts.join(side, "id_orden", "left_anti").unionByName(stored(whole))
    verdicts = verdicts.unionByName(stored(again))
    states = order_closure(ordenes, verdicts, closure).join(closure.select("id_orden", *keys, "motivo_cierre"), "id_orden", "left")
    return states, verdicts


def order_closure(ordenes: DataFrame, applied: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """State of every order after its payments; one whose closing failed stays pendiente though fully paid."""
    per_order = applied.filter("aceptado").groupBy(F.col("id_orden").alias("id")).agg(
        F.count("*").alias("pagos_aceptados"), F.sum(F.col("monto").cast("decimal(12,2)")).alias("pagado")
    )
    rows = ordenes.select("id", "total").join(per_order, "id", "left")
    got = F.coalesce("pagado", F.lit(0).cast("decimal(12,2)"))
    full = (F.col("pagos_aceptados") > 0) & (F.abs(got - F.col("total")) < F.lit(TOLERANCE).cast("decimal(12,2)"))
    if closure is None:
        ok = F.lit(True)
    else:
        rows = rows.join(closure.select(F.col("id_orden").alias("id"), "cierre_ok"), "id", "left")
        ok = F.coalesce("cierre_ok", F.lit(True))
    full = F.coalesce(full, F.lit(False))
    return rows.select(
        F.col("id").alias("id_orden"),
        F.coalesce("pagos_aceptados", F.lit(0).cast("bigint")).alias("pagos_aceptados"),
        got.cast("double").alias("total_pagado"),
        full.alias("pagada_completa"),
        F.when(full & ok, "pagada").otherwise("pendiente").alias("estado"),
    )
