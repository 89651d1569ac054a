"""Canonical tables, their types and the domains of their enumerated columns."""

from __future__ import annotations

from pyspark.sql import types as T

# Keys are 64-bit: order lines outgrow 2^31.
_KEY = T.LongType()
_INT, _STR, _BOOL, _TS = T.IntegerType(), T.StringType(), T.BooleanType(), T.TimestampType()
_M10, _M12 = T.DecimalType(10, 2), T.DecimalType(12, 2)


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in columns])


# One StructType serves the three user shapes: a column a source lacks is read as NULL.
USUARIOS = _table(
    ("id", _KEY), ("nombre", _STR), ("email", _STR), ("usuario", _STR), ("rol", _STR), ("estado", _STR),
    ("fecha_registro", _TS), ("cupo_total", _M10), ("cupo_disponible", _M10), ("cupo_usado", _M10),
    ("veces_cupo_completo", _INT), ("compras_completadas", _INT),
)
PRODUCTOS = _table(
    ("id", _KEY), ("id_vendedor", _KEY), ("nombre", _STR), ("descripcion", _STR), ("precio", _M10),
    ("cantidad", _INT), ("activo", _BOOL), ("aprobado", _BOOL), ("fecha_creacion", _TS),
)
ORDENES = _table(("id", _KEY), ("id_comprador", _KEY), ("total", _M10), ("estado", _STR), ("fecha", _TS))
ORDEN_DETALLES = _table(
    ("id", _KEY), ("id_orden", _KEY), ("id_producto", _KEY), ("cantidad", _INT), ("precio_unitario", _M10)
)
PAGOS = _table(
    ("id", _KEY), ("id_orden", _KEY), ("metodo_pago", _STR), ("monto", _M10), ("transaccion_id", _STR),
    ("estado", _STR), ("fecha_pago", _TS),
)
CREDITOS = _table(
    ("id", _KEY), ("usuario_id", _KEY), ("cupo_total", _M12), ("cupo_disponible", _M12),
    ("compras_completadas", _INT), ("estado", _STR), ("fecha_creacion", _TS),
)
CUOTAS = _table(
    ("id", _KEY), ("usuario_id", _KEY), ("compra_id", _KEY), ("monto_total", _M12), ("monto_por_cuota", _M12),
    ("cuotas_totales", _INT), ("cuotas_pagadas", _INT), ("estado", _STR), ("fecha_compra", _TS),
)
MOVIMIENTOS = _table(
    ("id", _KEY), ("usuario_id", _KEY), ("tipo", _STR), ("monto", _M12), ("cuotas", _INT), ("cupo_antes", _M12),
    ("cupo_despues", _M12), ("descripcion", _STR), ("fecha", _TS),
)

TABLES: dict[str, T.StructType] = {
    "usuarios": USUARIOS,
    "productos": PRODUCTOS,
    "ordenes": ORDENES,
    "orden_detalles": ORDEN_DETALLES,
    "pagos": PAGOS,
    "creditos": CREDITOS,
    "cuotas_pendientes": CUOTAS,
    "movimientos_credito": MOVIMIENTOS,
}

# The domains of the enumerated columns.
DOMAINS: dict[tuple[str, str], tuple[str, ...]] = {
    ("usuarios", "rol"): ("admin", "comprador", "vendedor"),
    ("usuarios", "estado"): ("activo", "pendiente", "rechazado"),
    ("ordenes", "estado"): ("pendiente", "pagada", "cancelada"),
    ("creditos", "estado"): ("activo", "inactivo", "suspendido"),
    ("cuotas_pendientes", "estado"): ("pendiente", "pagada", "vencida"),
    ("cuotas_pendientes (legacy)", "estado"): ("al_dia", "en_mora"),
    ("movimientos_credito", "tipo"): ("compra", "pago", "aumento_cupo", "ajuste_admin", "suspension"),
    ("pagos", "metodo_pago"): ("tarjeta", "transferencia", "efectivo"),
}

# Columns read as "newest first" clusters when a fact table is exported.
MONTH_COLUMN = {
    "ordenes": "fecha",
    "pagos": "fecha_pago",
    "movimientos_credito": "fecha",
    "cuotas_pendientes": "fecha_compra",
}
