"""Every operator as a query over the star-schema tables: name -> f(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tianguis.functions import money
from tianguis.functions.domain import validate_enum
from tianguis.functions.text import capital_first, money_text
from tianguis.operators import (
    catalog, changes, credit, ledger, lookup, orders, payments, quality, sales, summary, users,
)
from tianguis.plans import report, skew
from tianguis.session import durable, shared_path
from tianguis.sources import buckets, sinks, tables
from tianguis.sources.views import MarketViews
from tianguis.streaming import jobs, kept, late, retract

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}

STOCK_FACTOR = 20  # opening stock of the stock fold, in units of p_size
LEDGER_ORDER = ("fecha", "clase", "ref")
LINE_ORDER = ("id_orden", "linea", "id_proveedor", "precio_unitario")
CHANGE_ORDER = ("momento", "n1", "n2", "n3", "precio")


def query(f: Callable[[MarketViews], DataFrame]) -> Callable[[MarketViews], DataFrame]:
    """Register ``f`` under its name without the ``q_`` that keeps imported names free."""
    _REGISTRY[f.__name__.removeprefix("q_")] = lambda spark, sf_dir: f(MarketViews(spark, sf_dir))
    return f


# Summaries


@query
def summary_users(v): return summary.summary_users(v.usuarios())


@query
def summary_products(v): return summary.summary_products(v.productos())


@query
def summary_orders(v): return summary.summary_orders(v.ordenes())


@query
def summary_payments(v): return summary.summary_payments(v.pagos())


@query
def q_summary(v): return summary.summary(v.usuarios(), v.productos(), v.ordenes(), v.pagos())


@query
def live_summary(v): return summary.live_summary(v.usuarios(), v.productos(), v.ordenes(), v.pagos())


@query
def admin_counters(v): return summary.admin_counters(v.usuarios())


# Sales


@query
def top_products(v): return sales.top_products(v.orden_detalles(), v.productos())


@query
def top_products_inner(v): return sales.top_products_inner(v.orden_detalles(), v.productos())


@query
def top_products_live(v): return sales.top_products_live(v.orden_detalles())


@query
def top_products_live_untimed(v): return sales.top_products_live(v.orden_detalles(), times_sold=False)


@query
def revenue_by_month(v): return sales.revenue_by_month(v.ordenes())


@query
def sales_by_month(v): return sales.sales_by_month(v.ordenes())


@query
def orders_by_state(v): return sales.orders_by_state(v.ordenes())


@query
def orders_by_state_amount(v): return sales.orders_by_state_amount(v.ordenes())


@query
def orders_by_user(v): return orders.orders_by_user(v.ordenes())


# Users


@query
def users_by_role(v): return users.users_by_role(v.usuarios())


@query
def users_by_role_share(v): return users.users_by_role_share(v.usuarios())


@query
def users_by_state(v): return users.users_by_state(v.usuarios())


@query
def registrations_by_month(v): return users.registrations_by_month(v.usuarios(con_fecha=True))


@query
def users_listing(v): return users.users_listing(v.usuarios(con_fecha=True))


@query
def user_search(v): return users.user_search(v.usuarios(), filtro="pendiente", texto="CUSTOMER#0")


# Catalog


@query
def active_catalog(v): return catalog.active_catalog(v.productos(), v.usuarios())


@query
def top_stock(v): return catalog.top_stock(v.productos())


@query
def price_stats(v): return catalog.price_stats(v.productos())


@query
def price_stats_active(v): return catalog.price_stats_active(v.productos())


@query
def price_histogram(v): return catalog.price_histogram(v.productos())


@query
def inventory_by_seller(v): return catalog.inventory_by_seller(v.productos())


# Payments


@query
def payment_methods(v): return payments.payment_methods(v.pagos())


@query
def paid_per_order(v): return payments.paid_per_order(v.ordenes(), v.pagos())


@query
def account_statement(v): return payments.account_statement(v.ordenes(), v.pagos())


@query
def statement_lines(v): return payments.statement_lines(v.ordenes(), v.pagos())


def _applied(v: MarketViews) -> DataFrame:
    return payments.payment_application(v.ordenes(), v.pagos())


@query
def payment_application(v): return _applied(v)


@query
def order_closure(v): return payments.order_closure(v.ordenes(), _applied(v))


def _billed(v: MarketViews) -> DataFrame:
    """Orders that bill what their payments add up to, so that their last payment closes them."""
    paid = v.pagos().groupBy(F.col("id_orden").alias("id")).agg(F.sum("monto").cast("decimal(12,2)").alias("total"))
    return v.ordenes().drop("total").join(paid, "id")


@query
def order_closure_failed(v):
    """Closures of which those of the orders marked as cancelled fail."""
    billed = _billed(v)
    closure = billed.select(F.col("id").alias("id_orden"), (F.col("estado") != "cancelada").alias("cierre_ok"))
    return payments.order_closure(billed, payments.payment_application(billed, v.pagos(), closure=closure), closure)


def _by_credit(v: MarketViews) -> tuple[DataFrame, DataFrame]:
    """Closing payments ask the buyers' lines, between the limit changes and settlements of the credit log.

    Orders bill what their payments add up to; those with an even id all but their last payment, which comes too late.
    """
    last = F.max_by("monto", F.struct("fecha_pago", "transaccion_id"))
    bill = F.sum("monto") - F.when((F.col("id_orden") % 2 == 0) & (F.count("*") > 1), last).otherwise(0)
    paid = v.pagos().groupBy("id_orden").agg(bill.cast("decimal(12,2)").alias("total")).withColumnRenamed("id_orden", "id")
    others = v.eventos_credito().filter(F.col("tipo").isin(ledger.SETTLE, ledger.ADJUST)).select(
        "usuario_id", "tipo", "monto", "cuotas", "cuota_id", F.col("fecha").alias("fecha_pago"), F.col("ref").alias("transaccion_id")
    )
    billed = v.ordenes().drop("total").join(paid, "id")
    return payments.closure_by_credit(billed, v.pagos(), v.creditos(), v.cuotas_de_apertura().filter(F.lit(False)), others)


@query
def order_closure_by_credit(v): return _by_credit(v)[0]


@query
def closure_payments(v): return _by_credit(v)[1]


# Credit


@query
def credit_stats(v): return credit.credit_stats(v.creditos())


@query
def credit_stats_by_state(v): return credit.credit_stats_by_state(v.creditos())


@query
def movements_by_type(v): return credit.movements_by_type(v.movimientos())


@query
def movement_history(v): return credit.movement_history(v.movimientos())


@query
def credit_panel(v): return credit.credit_panel(v.usuarios(), v.creditos())


@query
def pending_instalments(v): return credit.pending_instalments(v.cuotas())


@query
def pending_count(v): return credit.pending_count(v.cuotas())


@query
def instalment_plan(v): return credit.instalment_plan(v.cuotas())


@query
def instalment_schedule(v): return credit.instalment_schedule(v.cuotas())


@query
def open_credit_lines(v): return _money_out(credit.open_credit_lines(v.usuarios(), v.creditos())[0])


@query
def open_credit_movements(v): return _money_out(credit.open_credit_lines(v.usuarios(), v.creditos())[1])


def _money_out(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.col(n).cast("double").alias(n) if t.startswith("decimal") else F.col(n) for n, t in df.dtypes
    ])


def _ledger(v: MarketViews, limits: skew.Limits = ledger.LEDGER_LIMITS) -> DataFrame:
    return ledger.credit_ledger(v.eventos_credito(), v.creditos(), v.cuotas_de_apertura(), LEDGER_ORDER, limits=limits)


def _ledger_rows(v: MarketViews, limits: skew.Limits = ledger.LEDGER_LIMITS) -> DataFrame:
    return _ledger(v, limits).select(
        "usuario_id", *LEDGER_ORDER, "tipo", "cuota_id", "aceptado", "motivo", "numero",
        *[money.from_cents(c).alias(c) for c in ("antes", "despues", "cupo_total", "disponible")], "completadas",
    )


@query
def credit_ledger(v): return _ledger_rows(v)


@query
def credit_ledger_movements(v): return ledger.ledger_movements(_ledger(v), LEDGER_ORDER)


@query
def credit_ledger_lines(v):
    return ledger.ledger_lines(_ledger(v), v.creditos(), LEDGER_ORDER)


@query
def credit_ledger_plans(v):
    return ledger.ledger_plans(_ledger(v), v.cuotas_de_apertura(), LEDGER_ORDER)


# Orders and stock


def _items(v: MarketViews) -> DataFrame:
    return v.orden_detalles()


def _requests(v: MarketViews) -> DataFrame:
    return v.ordenes().select(F.col("id").alias("id_orden"), "id_comprador")


ITEM_ORDER = ("linea", "id_producto", "id_proveedor", "precio_unitario")


@query
def order_intake(v): return orders.order_intake(_requests(v), _items(v), v.productos(), ITEM_ORDER)


@query
def order_intake_single(v): return orders.order_intake(_requests(v), _items(v), v.productos(), ITEM_ORDER, single=True)


@query
def order_intake_lines(v):
    accepted = orders.order_intake(_requests(v), _items(v), v.productos(), ITEM_ORDER)
    return _money_out(orders.intake_lines(accepted, _items(v), v.productos()))


def _with_credit(v: MarketViews, single: bool) -> DataFrame:
    """Intake, then every accepted order asks its buyer's line for the whole amount, in order of the orders."""
    taken = durable(orders.order_intake(_requests(v), _items(v), v.productos(), ITEM_ORDER, single=single))
    events = orders.intake_credit_events(taken).withColumn("orden", F.col("cuota_id"))
    no_plans = v.cuotas_de_apertura().filter(F.lit(False))
    return orders.with_credit(taken, ledger.credit_ledger(events, v.creditos(), no_plans, ("orden",)))


@query
def order_intake_credit(v): return _with_credit(v, False)


@query
def order_intake_credit_single(v): return _with_credit(v, True)


@query
def stock_fold_accepted(v):
    """The catalog's own stock, taken by the lines of accepted orders only."""
    taken = orders.order_intake(_requests(v), _items(v), v.productos(), ITEM_ORDER).filter("aceptada")
    lines = v.orden_detalles().join(taken.select("id_orden"), "id_orden", "left_semi")
    return _money_out(orders.stock_fold(lines, v.productos(), LINE_ORDER))


def _stocked(v: MarketViews) -> DataFrame:
    return v.productos().withColumn("cantidad", F.col("cantidad") * STOCK_FACTOR)


def _stock_outcomes(v: MarketViews) -> DataFrame:
    return orders.stock_fold(v.orden_detalles(), _stocked(v), LINE_ORDER)


@query
def stock_fold(v): return _money_out(_stock_outcomes(v))


@query
def stock_after(v):
    return orders.stock_after(_stocked(v), _stock_outcomes(v)).select("id", "cantidad")


def _sequential(v: MarketViews, limits: skew.Limits = skew.DEFAULT) -> DataFrame:
    """Orders by date take the stock one after the other."""
    requests = v.ordenes().select(F.col("id").alias("id_orden"), "id_comprador", "fecha")
    return orders.order_intake_sequential(requests, _items(v), _stocked(v), ITEM_ORDER, ("fecha",), limits)


@query
def order_intake_sequential(v): return _sequential(v)


@query
def order_intake_sequential_hot_keys(v): return _sequential(v, _low(8))


@query
def stock_after_intake(v): return orders.stock_after_intake(_stocked(v), _items(v), _sequential(v))


@query
def order_state_updates(v):
    return _money_out(orders.order_state_updates(v.ordenes(), v.cambios_orden(), ("fecha_pago", "transaccion_id"))[0])


@query
def order_state_rejects(v):
    return orders.order_state_updates(v.ordenes(), v.cambios_orden(), ("fecha_pago", "transaccion_id"))[1]


# Change logs


def _products(v: MarketViews) -> changes.Applied:
    return changes.apply_product_changes(v.productos(), v.cambios_producto(), CHANGE_ORDER)


@query
def apply_product_changes(v): return _money_out(_products(v).table)


@query
def product_change_rejects(v):
    return _money_out(_products(v).rejects).select("id_producto", "tipo", "id_vendedor", *CHANGE_ORDER, "motivo")


BUCKETS = 16


def _in_buckets(v: MarketViews, base: DataFrame, log: DataFrame, log_key: str, apply) -> tuple[DataFrame, DataFrame]:
    """The table after the first and the second half of a log, applied to the touched buckets in place, and all refusals."""
    path, half = shared_path(v.spark, "table"), log.agg(F.percentile_approx(F.unix_seconds(F.col("momento").cast("timestamp")), 0.5)).first()[0]
    buckets.write(base, path, ["id"], BUCKETS)
    early = F.coalesce(F.unix_seconds(F.col("momento").cast("timestamp")) <= F.lit(half), F.lit(True))
    refused = [
        buckets.apply_log(v.spark, path, base.schema, ["id"], BUCKETS, log.filter(part), [log_key], apply)[0] for part in (early, ~early)
    ]
    return buckets.read(v.spark, path, base.schema), refused[0].unionByName(refused[1])


def _products_in_place(v: MarketViews) -> tuple[DataFrame, DataFrame]:
    base = v.productos()
    return _in_buckets(v, base, v.cambios_producto(), "id_producto", lambda t, log: changes.apply_product_changes(t, log, CHANGE_ORDER))


@query
def product_changes_in_place(v): return _money_out(_products_in_place(v)[0])


@query
def product_rejects_in_place(v):
    return _money_out(_products_in_place(v)[1]).select("id_producto", "tipo", "id_vendedor", *CHANGE_ORDER, "motivo")


@query
def user_changes_in_place(v):
    apply = lambda t, log: changes.apply_user_changes(t, log, ("momento", "n"))
    return _in_buckets(v, v.usuarios(), v.cambios_usuario(), "usuario_id", apply)[0]


def _registered(v: MarketViews) -> changes.Applied:
    return changes.register_users(v.emails_tomados(), v.solicitudes_registro(), ("momento", "n"))


@query
def register_users(v): return _registered(v).table


@query
def register_rejects(v): return _registered(v).rejects


def _changed_users(v: MarketViews) -> changes.Applied:
    return changes.apply_user_changes(v.usuarios(), v.cambios_usuario(), ("momento", "n"))


@query
def apply_user_changes(v): return _changed_users(v).table


@query
def user_change_rejects(v): return _changed_users(v).rejects


@query
def user_cascade(v): return _money_out(changes.cascade(v.creditos(), "usuario_id", _changed_users(v).table))


@query
def user_cascade_instalments(v): return _money_out(changes.cascade(v.cuotas(), "usuario_id", _changed_users(v).table))


@query
def user_cascade_lines(v):
    """Lines of the orders that are left once the deleted users' orders are gone."""
    left = changes.cascade(v.ordenes(), "id_comprador", _changed_users(v).table)
    return _money_out(changes.cascade(v.orden_detalles(), "id_orden", left))


@query
def log_balance(v):
    """Per log: entries, refused ones and the rest, beside SQL that counts the accepted ones by the rule that accepts them."""
    def counted(name: str, log: DataFrame, rejects: DataFrame) -> DataFrame:
        both = log.select(F.lit(1).alias("n"), F.lit(0).alias("r")).unionAll(rejects.select(F.lit(0), F.lit(1)))
        return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entradas"), F.coalesce(F.sum("r"), F.lit(0)).alias("rechazadas")).select(
            F.lit(name).alias("registro"), "entradas", "rechazadas", (F.col("entradas") - F.col("rechazadas")).alias("aceptadas")
        )

    registered = _registered(v)
    parts = (
        counted("productos", v.cambios_producto(), _products(v).rejects),
        counted("registro", v.solicitudes_registro(), registered.rejects),
        counted("registro (altas)", registered.table, registered.table.limit(0)),
        counted("usuarios", v.cambios_usuario(), _changed_users(v).rejects),
        counted("ordenes", v.cambios_orden(), orders.order_state_updates(v.ordenes(), v.cambios_orden(), ("fecha_pago", "transaccion_id"))[1]),
    )
    return reduce(DataFrame.unionByName, parts)


@query
def csv_round_trip(v):
    """Orders written as CSV and read back: the rows that type whole."""
    root = shared_path(v.spark, "csv")
    sinks.export_table(v.ordenes(), root, "ordenes", "csv")
    good, _ = tables.read_checked(v.spark, root, "ordenes")
    return _money_out(good.withColumn("fecha", F.col("fecha").cast("timestamp_ntz")))


@query
def csv_refused(v):
    """Events written as CSV and read as movements: types of event are no text to refuse, texts in the amount are."""
    root = shared_path(v.spark, "csv")
    log = v.raw("events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("usuario_id"), F.col("event_type").alias("tipo"),
        F.when(F.col("event_type") == "error", F.lit("sin monto")).otherwise(F.round("value", 2).cast("string")).alias("monto"),
    )
    sinks.export_table(log, root, "movimientos_credito", "csv")
    _, refused = tables.read_checked(v.spark, root, "movimientos_credito")
    return refused.select(F.col("id").cast("bigint").alias("id"), "monto", F.array_join("columnas", ",").alias("columnas"))


@query
def q_validate_enum(v):
    """Event types read as movement types: only mapped names belong to the domain."""
    raw = v.raw("events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "purchase", "compra").otherwise(F.col("event_type")).alias("tipo"),
    )
    return validate_enum(raw, "movimientos_credito", "tipo")


# Quality


@query
def reconcile_orders(v): return quality.reconcile_orders(v.ordenes(), v.pagos())


@query
def reconcile_totals(v): return quality.reconcile_totals(v.ordenes(), v.orden_detalles())


@query
def ledger_breaks(v):
    movements = durable(ledger.ledger_movements(_ledger(v), LEDGER_ORDER))
    return quality.ledger_breaks(movements, LEDGER_ORDER)


@query
def orphans(v):
    lines, paid, products, people = v.orden_detalles(), v.pagos(), v.productos(), v.usuarios()
    asked = v.ordenes()
    parts = (
        quality.orphans(lines, "id_orden", asked, "linea sin orden"),
        quality.orphans(paid, "id_orden", asked, "pago sin orden"),
        quality.orphans(lines, "id_producto", products, "linea sin producto"),
        quality.orphans(asked, "id_comprador", people, "orden sin comprador"),
        quality.orphans(v.movimientos(), "usuario_id", v.creditos(), "movimiento sin linea de credito", "usuario_id"),
        quality.orphans(v.cuotas(), "usuario_id", v.creditos(), "cuota sin linea de credito", "usuario_id"),
        quality.orphans(products, "id_vendedor", people, "producto sin vendedor"),
    )
    return reduce(DataFrame.unionByName, parts)


# Lookups and labels


def _asked(v: MarketViews) -> DataFrame:
    """Requested order keys: the orders that were paid in cash."""
    return v.pagos().filter(F.col("metodo_pago") == "efectivo").select("id_orden")


@query
def lookup_by_keys(v): return _money_out(lookup.lookup_by_keys(v.ordenes(), _asked(v), "id", "id_orden"))


@query
def lookup_order_lines(v): return _money_out(lookup.lookup_by_keys(v.orden_detalles(), _asked(v), "id_orden"))


@query
def lookup_order_payments(v): return _money_out(lookup.lookup_by_keys(v.pagos(), _asked(v), "id_orden"))


@query
def lookup_products(v):
    wanted = v.orden_detalles().filter(F.col("cantidad") >= 50)
    return _money_out(lookup.lookup_by_keys(v.productos(), wanted, "id", "id_producto"))


@query
def lookup_instalments(v): return _money_out(lookup.lookup_by_keys(v.cuotas(), _asked(v), "id", "id_orden"))


@query
def missing_keys(v):
    """Users that move credit without having a line."""
    return lookup.missing_keys(v.creditos(), v.movimientos(), "usuario_id")


@query
def labels(v):
    return v.ordenes().select(
        "id", capital_first(F.col("estado")).alias("estado_texto"), money_text(F.col("total")).alias("total_texto")
    )


# The same folds with limits so low that most keys are cut into chunks, over the whole tables.


def _low(rows: int) -> skew.Limits:
    return skew.Limits(hot_rows=rows, chunk_rows=1000 * rows)


@query
def orders_by_user_hot_keys(v): return orders.orders_by_user(v.ordenes(), _low(8))


@query
def stock_fold_hot_keys(v):
    return _money_out(orders.stock_fold(v.orden_detalles(), _stocked(v), LINE_ORDER, _low(30)))


@query
def payment_application_hot_keys(v): return payments.payment_application(v.ordenes(), v.pagos(), limits=_low(6))


@query
def credit_ledger_hot_keys(v): return _ledger_rows(v, _low(60))


@query
def ledger_breaks_hot_keys(v):
    movements = durable(ledger.ledger_movements(_ledger(v), LEDGER_ORDER))
    return quality.ledger_breaks(movements, LEDGER_ORDER, _low(8))


# Report


def _bases(v: MarketViews) -> report.Bases:
    return report.bases(v.usuarios(), v.productos(), v.ordenes(), v.pagos())


def _report(v: MarketViews, bases: report.Bases) -> DataFrame:
    return report.build(bases, v.orden_detalles(), v.productos(), v.creditos())


def _stored_report(v: MarketViews, bases: report.Bases) -> DataFrame:
    path = shared_path(v.spark, "report")
    report.write(_report(v, bases), path)
    return report.read(v.spark, path)


@query
def report_nested(v): return _report(v, _bases(v))


@query
def report_sections(v): return report.flatten(_stored_report(v, _bases(v)))


@query
def report_combined(v):
    bases = _bases(v)
    both = report.combined(_stored_report(v, bases), report.live(bases, v.orden_detalles()))
    return both.select("fuente", F.posexplode("top_mostrado").alias("posicion", "p")).select("fuente", "posicion", "p.*")


@query
def report_nested_order(v):
    """Where every entry of the nested report's lists stands."""
    def places(name: str, key: str) -> DataFrame:
        return nested.select(F.posexplode(name).alias("posicion", "e")).select(
            F.lit(name).alias("seccion"), "posicion", F.col(f"e.{key}").cast("string").alias("clave")
        )

    nested = durable(_report(v, _bases(v)))
    lists = {
        "top_productos": "id", "ingresos_por_mes": "mes", "distribucion_roles": "rol", "metodos_pago": "metodo",
        "estados_ordenes": "estado", "inventario_por_vendedor": "vendedor_id",
    }
    return reduce(DataFrame.unionByName, [places(n, k) for n, k in lists.items()])


@query
def report_live_top(v):
    """The top list that is shown while there is no stored report."""
    absent = report.read(v.spark, f"{v.sf_dir}/no-report")
    both = report.combined(absent, report.live(_bases(v), v.orden_detalles()))
    return both.select("fuente", F.posexplode("top_mostrado").alias("posicion", "p")).select("fuente", "posicion", "p.*")


@query
def report_live_months(v):
    absent = report.read(v.spark, f"{v.sf_dir}/no-report")
    both = report.combined(absent, report.live(_bases(v), v.orden_detalles()))
    return both.select("fuente", F.explode("realtime.ventas_por_mes").alias("m")).select("fuente", "m.*")


# Streams: every job reads the whole table as a stream of files and stops when it has seen all of it.


def _streams(v: MarketViews) -> jobs.StreamViews:
    session = jobs.stream_session(v.spark, v.spark.sparkContext.defaultParallelism)
    return jobs.StreamViews(session, v.sf_dir)


@query
def stream_movements(v):
    done = jobs.run_update(jobs.movement_windows(_streams(v).movimientos(), delay=None), shared_path(v.spark, "movements"))
    return jobs.latest(v.spark, done, ["desde", "tipo"])


@query
def stream_sales(v):
    done = jobs.run_update(jobs.sales_months(_streams(v).ordenes()), shared_path(v.spark, "sales"))
    return jobs.latest(v.spark, done, ["mes"])


@query
def stream_unique_payments(v):
    """Payments keyed by (order, line number), which the lines repeat."""
    key = F.concat_ws("-", F.col("id_orden").cast("string"), F.col("linea").cast("string"))
    paid = _streams(v).raw("lineitem").select(
        F.col("l_orderkey").alias("id_orden"), F.col("l_linenumber").alias("linea"), F.col("l_shipdate").alias("fecha_pago"),
    ).withColumn("transaccion_id", key)
    done = jobs.run_append(jobs.unique_payments(paid, delay="3650 days"), shared_path(v.spark, "unique"))
    return v.spark.read.parquet(done.path).select("id_orden", "linea", "transaccion_id")


@query
def stream_payments(v):
    streams = _streams(v)
    static = MarketViews(streams.spark, v.sf_dir).ordenes()
    done = jobs.run_payments(streams.pagos(), static, shared_path(v.spark, "payments"))
    verdicts = v.spark.read.parquet(done.path)
    return verdicts.select("id_orden", "transaccion_id", "aceptado", "total_pagado_acumulado", "estado_orden")


# The same jobs over tables cut into files: dealt by key, so in no order of time, or appended year by year.


FILES = 12


def _splits(v: MarketViews, *raw: str) -> int:
    """Files of a micro-batch, so that one holds what a task reads of the largest of these tables; planned, not read."""
    return max(v.raw(table).rdd.getNumPartitions() for table in raw)


def _in_files(v: MarketViews, table: str, key: str) -> jobs.SplitStreamViews:
    root = shared_path(v.spark, "files")
    v.raw(table).repartition(FILES, key).write.parquet(f"{root}/{table}.parquet")
    return jobs.SplitStreamViews(_streams(v).spark, root)


@query
def stream_movements_files(v):
    streams = _in_files(v, "events", "event_id")
    done = jobs.run_update(jobs.movement_windows(streams.movimientos(), delay=None), shared_path(v.spark, "movements"))
    return jobs.latest(v.spark, done, ["desde", "tipo"])


@query
def stream_sales_files(v):
    done = jobs.run_update(jobs.sales_months(_in_files(v, "orders", "o_orderkey").ordenes()), shared_path(v.spark, "sales"))
    return jobs.latest(v.spark, done, ["mes"])


@query
def stream_payments_yearly(v):
    """Every year's payments are appended and the job runs again from where it stopped; undated ones come first."""
    root, path = shared_path(v.spark, "files"), shared_path(v.spark, "payments")
    session = _streams(v).spark
    static, lines, shipped = MarketViews(session, v.sf_dir).ordenes(), v.raw("lineitem"), F.col("l_shipdate")
    first, last = lines.agg(F.min(F.year(shipped)), F.max(F.year(shipped))).first()
    years = [] if first is None else range(first, last + 1)
    begin = {y: F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (*years, (last or 0) + 1)}
    for new in (shipped.isNull(), *((shipped >= begin[y]) & (shipped < begin[y + 1]) for y in years)):
        lines.filter(new).write.mode("append").parquet(f"{root}/lineitem.parquet")
        done = jobs.run_payments(jobs.SplitStreamViews(session, root, per_trigger=1000).pagos(), static, path)
    verdicts = v.spark.read.parquet(done.path)
    return verdicts.select("id_orden", "transaccion_id", "aceptado", "total_pagado_acumulado", "estado_orden")


PERIOD_DAYS = 900


@query
def stream_payments_shuffled(v):
    """Every second order's payments come a file too late; they are held back for as long and judged as the batch judges them."""
    root, path = shared_path(v.spark, "files"), shared_path(v.spark, "payments")
    session, lines = _streams(v).spark, v.raw("lineitem")
    static, views = MarketViews(session, v.sf_dir).ordenes(), jobs.SplitStreamViews(session, root, per_trigger=1000)
    first, last = lines.agg(F.min("l_shipdate").cast("string"), F.max("l_shipdate").cast("string")).first()
    since = F.datediff("l_shipdate", F.lit(first).cast("timestamp_ntz"))
    file = F.coalesce(F.floor(since / PERIOD_DAYS) + F.col("l_orderkey") % 2, F.lit(0))
    days = 0 if first is None else v.spark.range(1).select(F.datediff(F.lit(last), F.lit(first))).first()[0]
    for n in range(days // PERIOD_DAYS + 2):
        lines.filter(file == n).write.mode("append").parquet(f"{root}/lineitem.parquet")
        done = jobs.run_payments(views.pagos(), static, path, delay=f"{2 * PERIOD_DAYS} days")
    columns = ["id_orden", "transaccion_id", "aceptado", "total_pagado_acumulado", "estado_orden"]
    waiting = jobs.held_verdicts(session, static, path, views.pagos().schema)
    return v.spark.read.parquet(done.path).select(*columns).unionByName(waiting.select(*columns))


LATE_FILES = 3


def _late_movements(v: MarketViews) -> str:
    """Events dealt into files by their id, one micro-batch each: much of a later file is past the watermark of those before."""
    root, path = shared_path(v.spark, "files"), shared_path(v.spark, "movements")
    views = jobs.SplitStreamViews(_streams(v).spark, root, per_trigger=1000)
    for n in range(LATE_FILES):
        v.raw("events").filter(F.col("event_id") % LATE_FILES == n).write.mode("append").parquet(f"{root}/events.parquet")
        late.run_movement_windows(views.movimientos(), path, delay="10 days")
    return path


@query
def stream_movements_kept(v): return late.windows(v.spark, _late_movements(v))


@query
def stream_movements_late(v):
    return _money_out(late.late(v.spark, _late_movements(v)))


@query
def stream_sales_changes(v):
    """Orders and their changes of state in files of any order: monthly sales as after all valid changes."""
    root, session = shared_path(v.spark, "files"), _streams(v).spark
    opened = v.ordenes().select("id", "total", "fecha", "estado", *[F.lit(None).cast(k).alias(c) for c, k in (("fecha_pago", "timestamp_ntz"), ("transaccion_id", "string"))])
    changed = v.cambios_orden().select(
        F.col("id_orden").alias("id"), F.lit(None).cast("decimal(12,2)").alias("total"), F.lit(None).cast("timestamp_ntz").alias("fecha"),
        "estado", "fecha_pago", "transaccion_id",
    )
    entries, each = opened.unionByName(changed), _splits(v, "orders", "lineitem")
    entries.repartition(4 * each, "estado", "id").write.parquet(root)
    stream = jobs.read_stream(session, root, entries.schema, "*.parquet", per_trigger=each)
    done = retract.run_sales(stream, shared_path(v.spark, "sales"), ("fecha_pago", "transaccion_id"))
    return retract.months(v.spark, done)


KEPT_FILES = 3


def _kept(v: MarketViews) -> tuple[str, dict]:
    """All tables fed in several micro-batches of files; only the groups of every micro-batch are kept."""
    root, path, session = shared_path(v.spark, "files"), shared_path(v.spark, "figures"), _streams(v).spark
    given = {"usuarios": v.usuarios(), "productos": v.productos(), "ordenes": v.ordenes(), "pagos": v.pagos(), "orden_detalles": v.orden_detalles()}
    raw = {"usuarios": "customer", "productos": "part", "ordenes": "orders", "pagos": "lineitem", "orden_detalles": "lineitem"}
    for name, rows in given.items():
        each = _splits(v, raw[name])
        rows.repartition(KEPT_FILES * each, *rows.columns[:1]).write.parquet(f"{root}/{name}")
        kept.run_figures(jobs.read_stream(session, f"{root}/{name}", rows.schema, "*.parquet", per_trigger=each), name, path)
    return path, {name: rows.schema for name, rows in given.items()}


@query
def summary_kept(v): return report.totals(kept.bases(v.spark, *_kept(v)))


@query
def live_kept(v):
    """The live figures, read from the kept groups alone, one row per entry."""
    shown = durable(kept.live(v.spark, *_kept(v))).select("realtime.*")
    sections = {
        "usuarios_por_rol": ("rol", "cantidad", None), "ordenes_por_estado": ("estado", "cantidad", "monto"),
        "ventas_por_mes": ("mes", "ordenes", "ingresos"), "top_productos": ("id_producto", "unidades", "ingresos"),
        "metodos_pago": ("metodo_pago", "usos", "monto_total"),
    }
    nothing = F.lit(None).cast("double")
    rows = [shown.select(F.lit("total_usuarios").alias("seccion"), F.lit("").alias("clave"), F.col("total_usuarios").alias("cantidad"), nothing.alias("monto"))]
    for name, (key, count, amount) in sections.items():
        rows.append(shown.select(F.explode(name).alias("e")).select(
            F.lit(name).alias("seccion"), F.col(f"e.{key}").cast("string").alias("clave"), F.col(f"e.{count}").cast("long").alias("cantidad"),
            (nothing if amount is None else F.col(f"e.{amount}")).alias("monto"),
        ))
    return reduce(DataFrame.unionByName, rows)


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)
