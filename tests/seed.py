"""Seed rows of a small marketplace as typed frames."""

from datetime import datetime
from decimal import Decimal

from tianguis.schema import TABLES
from tianguis.sources.tables import conform

PRODUCTS = [
    (1, 1, "999.00", 50), (2, 1, "348.00", 120), (3, 2, "1299.99", 30), (4, 2, "1099.00", 15), (5, 3, "99.00", 200),
    (6, 3, "349.99", 45), (7, 4, "149.99", 80), (8, 4, "579.00", 25), (9, 5, "399.99", 60), (10, 5, "79.00", 100),
    (11, 17, "1500.00", 12), (12, 17, "1000.00", 6), (13, 17, "5000.00", 10),
]
ORDERS = [
    (1, 16, "999.00", "pagada", "2026-04-05 04:14:44"), (2, 18, "999.00", "pagada", "2026-04-08 17:06:37"),
    (3, 19, "999.00", "pendiente", "2026-04-21 18:40:48"), (4, 19, "348.00", "pendiente", "2026-04-21 19:39:47"),
    (5, 19, "999.00", "pendiente", "2026-04-21 23:54:27"), (6, 19, "1299.99", "pendiente", "2026-04-22 01:12:59"),
    (7, 19, "999.00", "pendiente", "2026-04-22 01:20:27"),
]
LINES = [
    (1, 1, 1, 1, "999.00"), (2, 2, 1, 1, "999.00"), (3, 3, 1, 1, "999.00"), (4, 4, 2, 1, "348.00"), (5, 5, 1, 1, "999.00"),
    (6, 6, 3, 1, "1299.99"), (7, 7, 1, 1, "999.00"),
]
PAYMENTS = [
    (1, 1, "tarjeta", "999.00"), (2, 2, "tarjeta", "999.00"), (3, 3, "tarjeta", "999.00"), (4, 4, "tarjeta", "348.00"),
    (5, 5, "transferencia", "999.00"), (6, 6, "tarjeta", "1299.99"), (7, 7, "tarjeta", "999.00"),
]


def _ts(text):
    return datetime.fromisoformat(text)


def frames(spark):
    d = Decimal
    made = {
        "productos": spark.createDataFrame(
            [(i, s, f"Producto {i}", "a, b", d(p), q, True, True) for i, s, p, q in PRODUCTS],
            "id int, id_vendedor int, nombre string, descripcion string, precio decimal(10,2), cantidad int, activo boolean, aprobado boolean",
        ),
        "ordenes": spark.createDataFrame(
            [(i, b, d(t), s, _ts(f)) for i, b, t, s, f in ORDERS],
            "id int, id_comprador int, total decimal(10,2), estado string, fecha timestamp",
        ),
        "orden_detalles": spark.createDataFrame(
            [(i, o, p, q, d(u)) for i, o, p, q, u in LINES],
            "id int, id_orden int, id_producto int, cantidad int, precio_unitario decimal(10,2)",
        ),
        "pagos": spark.createDataFrame(
            [(i, o, m, d(a), f"TXN-{i}", "exitoso", _ts(ORDERS[i - 1][4])) for i, o, m, a in PAYMENTS],
            "id int, id_orden int, metodo_pago string, monto decimal(10,2), transaccion_id string, estado string, fecha_pago timestamp",
        ),
        "creditos": spark.createDataFrame(
            [(1, 19, d("100000.00"), d("100000.00"), 0, "activo")],
            "id int, usuario_id int, cupo_total decimal(12,2), cupo_disponible decimal(12,2), compras_completadas int, estado string",
        ),
        "movimientos_credito": spark.createDataFrame(
            [
                (1, 19, "aumento_cupo", d("100000.00"), d("0.00"), d("100000.00"), _ts("2026-04-22 01:20:12")),
                (2, 19, "pago", d("999.00"), d("99001.00"), d("100000.00"), _ts("2026-04-22 01:51:25")),
            ],
            "id int, usuario_id int, tipo string, monto decimal(12,2), cupo_antes decimal(12,2), cupo_despues decimal(12,2), fecha timestamp",
        ),
        "usuarios": spark.createDataFrame(
            [(i, f"U{i}", f"u{i}@example.com", "admin" if i <= 2 else "vendedor" if i == 17 else "comprador", "activo",
              _ts("2026-04-01 00:00:00")) for i in range(1, 20)],
            "id int, nombre string, email string, rol string, estado string, fecha_registro timestamp",
        ),
        "cuotas_pendientes": spark.createDataFrame([], TABLES["cuotas_pendientes"]),
    }
    return {name: conform(df, TABLES[name]) for name, df in made.items()}


def empty(spark):
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
