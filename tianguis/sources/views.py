"""The marketplace tables as views over a star schema of parquet files (customer, orders, lineitem, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tianguis.functions.money import cents, d2, div, div_half_up

SELLER_ID_BASE = 1_000_000_000
ADMIN_ID_BASE = 2_000_000_000


# Columns of the star schema, so that reading a table needs no schema job.
STAR_SCHEMA = {
    "region": "r_regionkey int, r_name string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _by_balance(balance: Column, negative: str, low: str, otherwise: str) -> Column:
    return F.when(balance < 0, negative).when(balance < 500, low).otherwise(otherwise)


def _mapped(c: str, mapping: dict[str, str]) -> Column:
    (first, value), *rest = mapping.items()
    out = F.when(F.col(c) == first, value)
    for key, text in rest:
        out = out.when(F.col(c) == key, text)
    return out


class MarketViews:
    """Lazy canonical tables; every method builds a plan and reads nothing."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.schema(STAR_SCHEMA[table]).parquet(f"{self.sf_dir}/{table}.parquet")

    def usuarios(self, con_fecha: bool = False) -> DataFrame:
        """Customers buy, suppliers sell, regions administer. The first order dates a buyer's registration."""
        state = _by_balance(F.col("bal"), "rechazado", "pendiente", "activo")
        buyers = self.raw("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("nombre"), F.lit("comprador").alias("rol"),
            F.col("c_acctbal").alias("bal"),
        )
        sellers = self.raw("supplier").select(
            (F.col("s_suppkey") + SELLER_ID_BASE).alias("id"), F.col("s_name").alias("nombre"),
            F.lit("vendedor").alias("rol"), F.col("s_acctbal").alias("bal"),
        )
        admins = self.raw("region").select(
            (F.col("r_regionkey").cast("bigint") + ADMIN_ID_BASE).alias("id"), F.col("r_name").alias("nombre"),
            F.lit("admin").alias("rol"), F.lit(1e9).alias("bal"),
        )
        users = buyers.unionByName(sellers).unionByName(admins).select(
            "id", "nombre", F.concat(F.lower("nombre"), F.lit("@example.com")).alias("email"), "rol",
            state.alias("estado"),
        )
        if not con_fecha:
            return users
        first_order = self.raw("orders").groupBy(F.col("o_custkey").alias("id")).agg(
            F.min("o_orderdate").alias("fecha_registro")
        )
        return users.join(first_order, "id", "left")

    def productos(self) -> DataFrame:
        """Parts; the supplier of a part's first order line sells it (NULL where it was never ordered).

        Sellers are reduced to one row per part before the join, which Catalyst drops where nobody asks for them.
        """
        first = F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey"))["l_suppkey"]
        sellers = self.raw("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
            (first + SELLER_ID_BASE).alias("id_vendedor")
        )
        return self.raw("part").join(sellers, "p_partkey", "left").select(
            F.col("p_partkey").alias("id"),
            F.col("id_vendedor"),
            F.col("p_name").alias("nombre"),
            F.col("p_type").alias("descripcion"),
            d2("p_retailprice").alias("precio"),
            F.col("p_size").alias("cantidad"),
            (F.col("p_type") != "PROMO").alias("activo"),
            (F.col("p_size") % 10 != 0).alias("aprobado"),
        )

    def ordenes(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("id_comprador"),
            d2("o_totalprice").alias("total"),
            _mapped("o_orderstatus", {"F": "pagada", "O": "pendiente", "P": "cancelada"}).alias("estado"),
            F.col("o_orderdate").alias("fecha"),
        )

    def orden_detalles(self) -> DataFrame:
        """Order lines; (id_orden, linea, id_producto, id_proveedor, precio_unitario) is a total order."""
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("id_orden"),
            F.col("l_linenumber").alias("linea"),
            F.col("l_partkey").alias("id_producto"),
            F.col("l_suppkey").alias("id_proveedor"),
            F.col("l_quantity").cast("int").alias("cantidad"),
            d2("l_extendedprice").alias("precio_unitario"),
        )

    def pagos(self) -> DataFrame:
        key = F.concat_ws(
            "|",
            *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            cents(d2("l_extendedprice")).cast("string"),
        )
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("id_orden"),
            _mapped("l_returnflag", {"A": "tarjeta", "N": "transferencia", "R": "efectivo"}).alias("metodo_pago"),
            d2("l_extendedprice").alias("monto"),
            F.concat(F.lit("TXN-"), F.upper(F.substring(F.sha2(key, 256), 1, 32))).alias("transaccion_id"),
            F.lit("exitoso").alias("estado"),
            F.col("l_shipdate").alias("fecha_pago"),
        )

    def creditos(self) -> DataFrame:
        """Credit lines in every state; customers of the machinery segment buy in cash and have none."""
        balance = F.col("c_acctbal")
        return self.raw("customer").filter(F.col("c_mktsegment") != "MACHINERY").select(
            F.col("c_custkey").alias("id"),
            F.col("c_custkey").alias("usuario_id"),
            F.lit(10000).cast("decimal(12,2)").alias("cupo_total"),
            d2(F.greatest(balance, F.lit(0.0))).alias("cupo_disponible"),
            (F.col("c_custkey") % 7).cast("int").alias("compras_completadas"),
            _by_balance(balance, "suspendido", "inactivo", "activo").alias("estado"),
        )

    def cuotas(self, priorities: tuple[str, ...] = ()) -> DataFrame:
        """Instalment plans, one per order; of some priorities only where they are given."""
        orders = self.raw("orders")
        if priorities:
            orders = orders.filter(F.col("o_orderpriority").isin(*priorities))
        key = F.col("o_orderkey")
        totals = F.when(key % 3 == 0, 1).when(key % 3 == 1, 3).otherwise(6)
        plan = orders.select(
            key.alias("id"),
            F.col("o_custkey").alias("usuario_id"),
            key.alias("compra_id"),
            d2("o_totalprice").alias("monto_total"),
            totals.alias("cuotas_totales"),
            (key % (totals + 1)).cast("int").alias("cuotas_pagadas"),
            F.col("o_orderdate").alias("fecha_compra"),
        )
        each = div_half_up(cents("monto_total"), F.col("cuotas_totales").cast("bigint"))
        plan = plan.withColumn("monto_por_cuota", (each.cast("decimal(20,0)") / 100).cast("decimal(12,2)"))
        done = F.col("cuotas_pagadas") >= F.col("cuotas_totales")
        return plan.withColumn("estado", F.when(done, "pagada").otherwise("pendiente"))

    def movimientos(self) -> DataFrame:
        kinds = {
            "purchase": "compra", "click": "pago", "signup": "aumento_cupo", "view": "ajuste_admin",
            "error": "suspension",
        }
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("usuario_id"),
            _mapped("event_type", kinds).alias("tipo"),
            d2("value").alias("monto"),
            F.col("ts").alias("fecha"),
        )

    # Logs for the table jobs, derived from whole tables.

    def eventos_credito(self) -> DataFrame:
        """Events of the credit ledger, in order (fecha, clase, ref).

        An order is a purchase (a tenth of its total in 1, 3 or 6 instalments), or, by its priority, a limit
        change or a settlement; an order line pays an instalment of its order's plan.
        """
        tenth = (div(cents("total"), F.lit(10).cast("bigint")).cast("decimal(20,0)") / 100).cast("decimal(12,2)")
        kind = _mapped("o_orderpriority", {"4-NOT SPECIFIED": "ajustar", "5-LOW": "liquidar"})
        orders = self.raw("orders").select(
            F.col("o_custkey").alias("usuario_id"),
            F.coalesce(kind, F.lit("usar")).alias("tipo"),
            d2("o_totalprice").alias("total"),
            F.col("o_orderkey").alias("clave"),
            F.col("o_orderdate").alias("fecha"),
        )
        parts = F.when(F.col("clave") % 3 == 0, 1).when(F.col("clave") % 3 == 1, 3).otherwise(6)
        own = orders.select(
            "usuario_id", "tipo",
            F.when(F.col("tipo") == "usar", tenth).when(F.col("tipo") == "ajustar", F.col("total")).alias("monto"),
            F.when(F.col("tipo") == "usar", parts).alias("cuotas"),
            F.when(F.col("tipo") == "usar", F.col("clave")).alias("cuota_id"),
            "fecha", F.lit(0).alias("clase"), F.col("clave").cast("string").alias("ref"),
        )
        buyers = orders.select(F.col("clave").alias("id_orden"), "usuario_id")
        paid = self.pagos().join(buyers, "id_orden").select(
            "usuario_id", F.lit("pagar_cuota").alias("tipo"), F.lit(None).cast("decimal(12,2)").alias("monto"),
            F.lit(None).cast("int").alias("cuotas"), F.col("id_orden").alias("cuota_id"),
            F.col("fecha_pago").alias("fecha"), F.lit(1).alias("clase"), F.col("transaccion_id").alias("ref"),
        )
        return own.unionByName(paid)

    def cuotas_de_apertura(self) -> DataFrame:
        """Plans that exist before the ledger starts: those of the orders that are no purchase in it."""
        return self.cuotas(("4-NOT SPECIFIED", "5-LOW"))

    def cambios_producto(self) -> DataFrame:
        """Product changes by line flag in order (momento, n1, n2, n3, precio); every supplier publishes a product."""
        lines = self.raw("lineitem").select(
            F.col("l_partkey").alias("id_producto"),
            _mapped("l_returnflag", {"A": "editar", "N": "aprobar", "R": "desactivar"}).alias("tipo"),
            (F.col("l_suppkey") + SELLER_ID_BASE).alias("id_vendedor"),
            F.lit("vendedor").alias("rol"),
            F.concat(F.lit("Producto "), F.col("l_partkey").cast("string"), F.lit(" v"), F.col("l_linenumber").cast("string")).alias("nombre"),
            F.col("l_linestatus").alias("descripcion"),
            d2("l_extendedprice").alias("precio"),
            F.col("l_quantity").cast("int").alias("cantidad"),
            F.col("l_shipdate").alias("momento"),
            F.col("l_orderkey").alias("n1"), F.col("l_linenumber").cast("bigint").alias("n2"), F.col("l_suppkey").alias("n3"),
        )
        key = F.col("s_suppkey")
        new = self.raw("supplier").select(
            (key + SELLER_ID_BASE).alias("id_producto"), F.lit("publicar").alias("tipo"),
            (key + SELLER_ID_BASE).alias("id_vendedor"),
            F.when(F.col("s_acctbal") < 0, "comprador").otherwise("vendedor").alias("rol"),
            F.col("s_name").alias("nombre"), F.lit("nuevo").alias("descripcion"),
            d2(F.abs("s_acctbal")).alias("precio"), F.lit(1).alias("cantidad"),
            F.lit("1990-01-01 00:00:00").cast("timestamp_ntz").alias("momento"),
            key.alias("n1"), F.lit(0).cast("bigint").alias("n2"), F.lit(0).cast("bigint").alias("n3"),
        )
        return lines.unionByName(new)

    def solicitudes_registro(self) -> DataFrame:
        """Every event asks to register its user, in order (momento, n)."""
        return self.raw("events").select(
            F.concat(F.lit("Usuario "), F.col("user_id").cast("string")).alias("nombre"),
            F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
            _mapped("event_type", {"view": "vendedor", "purchase": "comprador"}).alias("rol"),
            F.col("ts").alias("momento"), F.col("event_id").alias("n"),
        )

    def emails_tomados(self) -> DataFrame:
        """Users whose email is taken before the requests come."""
        return self.raw("supplier").select(
            F.concat(F.lit("user"), F.col("s_suppkey").cast("string"), F.lit("@example.com")).alias("email")
        )

    def cambios_usuario(self) -> DataFrame:
        """State changes by event type and deletions by large errors, in order (momento, n)."""
        drop = (F.col("event_type") == "error") & (F.col("value") >= 200)
        states = {"view": "activo", "click": "pendiente", "signup": "rechazado", "purchase": "suspendido", "error": "activo"}
        return self.raw("events").select(
            F.col("user_id").alias("usuario_id"),
            F.when(drop, "eliminar").otherwise("estado").alias("tipo"),
            F.when(~drop, _mapped("event_type", states)).alias("estado"),
            F.col("ts").alias("momento"), F.col("event_id").alias("n"),
        )

    def cambios_orden(self) -> DataFrame:
        """Order states by line flag in order (fecha_pago, transaccion_id); a returned line asks for an unknown state."""
        states = {"tarjeta": "pagada", "transferencia": "cancelada", "efectivo": "devuelta"}
        return self.pagos().select("id_orden", _mapped("metodo_pago", states).alias("estado"), "fecha_pago", "transaccion_id")
