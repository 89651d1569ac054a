"""The batch report as one nested row, its JSON form, and the envelope that joins it with live figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tianguis.functions import money
from tianguis.operators import credit, sales, summary
from tianguis.session import durable

_I, _S, _D = T.LongType(), T.StringType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


def _rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(_struct(**fields), True)


_SUMMARY = {
    **{n: _I for n in (
        "total_usuarios", "compradores", "vendedores", "admins", "usuarios_activos", "usuarios_pendientes",
        "total_productos", "productos_activos")},
    "precio_promedio": _D,
    **{n: _I for n in ("total_ordenes", "ordenes_pagadas", "ordenes_pendientes")},
    "ingresos_totales": _D, "total_pagos": _I, "monto_total_pagado": _D,
}

REPORT = _struct(
    generado_en=_S,
    spark_version=_S,
    resumen=_struct(**_SUMMARY),
    top_productos=_rows(id=_I, nombre=_S, unidades_vendidas=_I, ingresos=_D),
    ingresos_por_mes=_rows(mes=_S, ingresos=_D, num_ordenes=_I),
    distribucion_roles=_rows(rol=_S, cantidad=_I),
    metodos_pago=_rows(metodo=_S, usos=_I, monto_total=_D),
    credito=_struct(cupo_promedio=_D, disponible_promedio=_D, cupo_usado_total=_D, total_lineas=_I),
    estados_ordenes=_rows(estado=_S, cantidad=_I),
    inventario_por_vendedor=_rows(vendedor_id=_I, num_productos=_I, precio_promedio=_D, valor_inventario=_D),
)


def _section(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """A small aggregate as one row with an ordered array; its size is that of a top list or a domain."""
    keys = [c.alias(f"_{i}") for i, c in enumerate(order)]
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.agg(F.sort_array(F.collect_list(F.struct(*keys, row.alias("r")))).alias("x")).select(
        F.transform("x", lambda e: e["r"]).alias(name)
    )


def _object(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.struct("*").alias(name))


@dataclass(frozen=True)
class Bases:
    """What one pass over each table leaves for all sections that need it."""

    usuarios: DataFrame
    productos: DataFrame
    ordenes: DataFrame
    pagos: DataFrame


def grouped(table: str, rows: DataFrame) -> DataFrame:
    """``rows`` of a table by all keys its sections use. Every measure is a count or a sum, so groups of parts add up."""
    n = F.count("*").alias("n")
    if table == "usuarios":
        return rows.groupBy("rol", "estado").agg(n)
    if table == "productos":
        return rows.groupBy("id_vendedor").agg(
            n,
            F.count_if("activo").alias("activos"),
            F.sum("precio").alias("precios"),
            F.count("precio").alias("con_precio"),
            F.sum(F.col("precio") * F.col("cantidad")).alias("valor"),
        )
    if table == "ordenes":
        return rows.groupBy("estado", sales.month("fecha").alias("mes")).agg(n, F.sum("total").alias("total"))
    if table == "pagos":
        return rows.groupBy("metodo_pago").agg(n, F.sum("monto").alias("monto"))
    if table == "orden_detalles":
        return sales.sales_by_product(rows)
    raise ValueError(f"no groups are kept of {table}")


def bases(usuarios, productos, ordenes, pagos) -> Bases:
    """Group every table once, by all keys its sections use, and keep the small results.

    Without the cut each section would scan its table again, because Catalyst prunes and filters every
    copy of the aggregate differently.
    """
    given = {"usuarios": usuarios, "productos": productos, "ordenes": ordenes, "pagos": pagos}
    return Bases(**{name: durable(grouped(name, rows)) for name, rows in given.items()})


def _sum(c: Column | str, when: Column | None = None) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0))


def _mean(total: Column, count: Column) -> Column:
    whole = (total * F.lit(100)).cast("decimal(30,0)")
    return F.coalesce(money.from_cents(money.div_half_up(whole, count)), F.lit(0.0))


def totals(b: Bases) -> DataFrame:
    """The one-row summary of all tables."""
    rol, estado = F.col("rol"), F.col("estado")
    return summary.beside(
        b.usuarios.agg(
            _sum("n").alias("total_usuarios"),
            _sum("n", rol == "comprador").alias("compradores"),
            _sum("n", rol == "vendedor").alias("vendedores"),
            _sum("n", rol == "admin").alias("admins"),
            _sum("n", estado == "activo").alias("usuarios_activos"),
            _sum("n", estado == "pendiente").alias("usuarios_pendientes"),
        ),
        b.productos.agg(
            _sum("n").alias("total_productos"),
            _sum("activos").alias("productos_activos"),
            _mean(F.sum("precios"), _sum("con_precio")).alias("precio_promedio"),
        ),
        b.ordenes.agg(
            _sum("n").alias("total_ordenes"),
            _sum("n", estado == "pagada").alias("ordenes_pagadas"),
            _sum("n", estado == "pendiente").alias("ordenes_pendientes"),
            _sum("total", estado == "pagada").cast("double").alias("ingresos_totales"),
        ),
        b.pagos.agg(_sum("n").alias("total_pagos"), _sum("monto").cast("double").alias("monto_total_pagado")),
    )


def _roles(b: Bases) -> DataFrame:
    return b.usuarios.groupBy("rol").agg(F.sum("n").alias("cantidad"))


def _states(b: Bases) -> DataFrame:
    return b.ordenes.groupBy("estado").agg(F.sum("n").alias("cantidad"), _sum("total").cast("double").alias("monto"))


def _methods(b: Bases, name: str) -> DataFrame:
    return b.pagos.select(
        F.col("metodo_pago").alias(name), F.col("n").alias("usos"), F.coalesce("monto", F.lit(0)).cast("double").alias("monto_total")
    )


def build(b: Bases, detalles: DataFrame, productos: DataFrame, creditos: DataFrame, k: int = 5) -> DataFrame:
    """One row with every section. Nothing is collected to the driver."""
    spark = detalles.sparkSession
    paid = F.col("estado") == "pagada"
    months = b.ordenes.filter(paid).select("mes", F.coalesce("total", F.lit(0)).cast("double").alias("ingresos"), F.col("n").alias("num_ordenes"))
    sellers = b.productos.orderBy(F.desc("n"), "id_vendedor").limit(k).select(
        F.col("id_vendedor").alias("vendedor_id"), F.col("n").alias("num_productos"),
        _mean(F.col("precios"), F.col("con_precio")).alias("precio_promedio"),
        F.coalesce("valor", F.lit(0)).cast("double").alias("valor_inventario"),
    )
    top = sales.top_products(detalles, productos, k).select("id", "nombre", "unidades_vendidas", "ingresos")
    parts = summary.beside(
        _object(totals(b), "resumen"),
        _section(top, "top_productos", -F.col("unidades_vendidas"), F.col("id")),
        _section(months, "ingresos_por_mes", F.col("mes")),
        _section(_roles(b), "distribucion_roles", -F.col("cantidad"), F.col("rol")),
        _section(_methods(b, "metodo"), "metodos_pago", -F.col("usos"), F.col("metodo")),
        _object(credit.credit_stats(creditos), "credito"),
        _section(_states(b).select("estado", "cantidad"), "estados_ordenes", F.col("estado")),
        _section(sellers, "inventario_por_vendedor", -F.col("num_productos"), F.col("vendedor_id")),
    )
    stamped = parts.withColumn("generado_en", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    stamped = stamped.withColumn("spark_version", F.lit(spark.version))
    return stamped.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REPORT.fields])


def write(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored report with ``fuente``; no row where there is none yet."""
    try:
        found = spark.read.schema(REPORT).json(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in (err.getCondition() or str(err)):
            raise
        found = spark.createDataFrame([], REPORT)
    return found.withColumn("fuente", F.lit("spark"))


def live(b: Bases, detalles: DataFrame) -> DataFrame:
    """The live figures as one row with one struct ``realtime``."""
    return live_of(b, sales.sales_by_product(detalles))


def live_of(b: Bases, sold: DataFrame) -> DataFrame:
    """The same from sales that are grouped by product already."""
    top = sales.best_live(sold, times_sold=False)
    paid = F.col("estado") == "pagada"
    months = b.ordenes.groupBy("mes").agg(F.sum("n").alias("ordenes"), _sum("total", paid).cast("double").alias("ingresos"))
    parts = summary.beside(
        b.usuarios.agg(_sum("n").alias("total_usuarios")),
        _section(_roles(b), "usuarios_por_rol", F.col("rol")),
        _section(_states(b), "ordenes_por_estado", F.col("estado")),
        _section(months, "ventas_por_mes", F.col("mes")),
        _section(top, "top_productos", -F.col("unidades"), F.col("id_producto")),
        _section(_methods(b, "metodo_pago"), "metodos_pago", F.col("metodo_pago")),
    )
    return _object(parts, "realtime")


def combined(batch: DataFrame, realtime: DataFrame) -> DataFrame:
    """One row: the batch report where there is one, the live figures, and the top list to show.

    The batch top list is shown unless it is missing or empty.
    """
    stored = batch.select([f.name for f in REPORT.fields])
    both = summary.beside(realtime, _object(stored, "spark"))
    batch_top = F.transform(
        F.col("spark.top_productos"),
        lambda p: F.struct(p["id"].alias("id"), p["nombre"].alias("nombre"), p["unidades_vendidas"].alias("unidades"), p["ingresos"].alias("ingresos")),
    )
    live_top = F.transform(
        F.col("realtime.top_productos"),
        lambda p: F.struct(
            p["id_producto"].alias("id"), F.concat(F.lit("Producto #"), p["id_producto"].cast("string")).alias("nombre"),
            p["unidades"].alias("unidades"), p["ingresos"].alias("ingresos"),
        ),
    )
    has_batch = F.col("spark").isNotNull()
    return both.select(
        F.when(has_batch, "spark+realtime").otherwise("realtime").alias("fuente"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("generado_en"),
        "spark", "realtime",
        F.when(F.coalesce(F.size("spark.top_productos"), F.lit(0)) > 0, batch_top).otherwise(live_top).alias("top_mostrado"),
    )


def flatten(report: DataFrame) -> DataFrame:
    """The report as (seccion, clave, medida, valor) rows."""
    long_rows = []
    for field in REPORT.fields:
        if isinstance(field.dataType, T.StructType):
            entries = _measures(field.name, F.lit(""), F.col(field.name), field.dataType.names)
        elif isinstance(field.dataType, T.ArrayType):
            entries = _list_measures(field)
        else:
            continue
        long_rows.append(entries)
    return report.select(F.explode(F.concat(*long_rows)).alias("e")).select("e.*")


def _list_measures(field: T.StructField) -> Column:
    key, *rest = field.dataType.elementType.fields
    numbers = [f.name for f in rest if not isinstance(f.dataType, T.StringType)]
    per_row = F.transform(F.col(field.name), lambda e: _measures(field.name, e[key.name].cast("string"), e, numbers))
    return F.flatten(per_row)


def _measures(section: str, key: Column, row: Column, names: list[str]) -> Column:
    return F.array(*[_entry(section, key, n, row[n]) for n in names])


def _entry(section: str, key: Column, measure: str, value: Column) -> Column:
    return F.struct(
        F.lit(section).alias("seccion"), key.alias("clave"), F.lit(measure).alias("medida"), value.cast("double").alias("valor")
    )
