"""The same results in DuckDB SQL, written independently over the same parquet tables."""

from __future__ import annotations

VIEWS = {
    "usuarios": """
      SELECT id, nombre, lower(nombre) || '@example.com' AS email, rol,
             CASE WHEN bal < 0 THEN 'rechazado' WHEN bal < 500 THEN 'pendiente' ELSE 'activo' END AS estado,
             f.fecha_registro
      FROM (SELECT c_custkey AS id, c_name AS nombre, 'comprador' AS rol, c_acctbal AS bal FROM customer
            UNION ALL SELECT 1000000000 + s_suppkey, s_name, 'vendedor', s_acctbal FROM supplier
            UNION ALL SELECT 2000000000 + r_regionkey, r_name, 'admin', 1e9 FROM region) u
      LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS fecha_registro FROM orders GROUP BY 1) f ON f.o_custkey = u.id""",
    "productos": """
      SELECT p_partkey AS id, id_vendedor, p_name AS nombre, p_type AS descripcion,
             CAST(p_retailprice AS DECIMAL(12,2)) AS precio, p_size AS cantidad, p_type <> 'PROMO' AS activo,
             p_size % 10 <> 0 AS aprobado FROM part
      LEFT JOIN (SELECT l_partkey, 1000000000 + arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS id_vendedor FROM lineitem GROUP BY 1)
      ON l_partkey = p_partkey""",
    "ordenes": """
      SELECT o_orderkey AS id, o_custkey AS id_comprador, CAST(o_totalprice AS DECIMAL(12,2)) AS total,
             CASE o_orderstatus WHEN 'F' THEN 'pagada' WHEN 'O' THEN 'pendiente' WHEN 'P' THEN 'cancelada' END AS estado,
             o_orderdate AS fecha, o_orderpriority AS prioridad FROM orders""",
    "detalles": """
      SELECT l_orderkey AS id_orden, l_linenumber AS linea, l_partkey AS id_producto, l_suppkey AS id_proveedor,
             CAST(l_quantity AS INT) AS cantidad, CAST(l_extendedprice AS DECIMAL(12,2)) AS precio_unitario FROM lineitem""",
    "pagos": """
      SELECT l_orderkey AS id_orden,
             CASE l_returnflag WHEN 'A' THEN 'tarjeta' WHEN 'N' THEN 'transferencia' WHEN 'R' THEN 'efectivo' END AS metodo_pago,
             CAST(l_extendedprice AS DECIMAL(12,2)) AS monto,
             'TXN-' || upper(substr(sha256(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' ||
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT)), 1, 32)) AS transaccion_id,
             'exitoso' AS estado, l_shipdate AS fecha_pago FROM lineitem""",
    "creditos": """
      SELECT c_custkey AS id, c_custkey AS usuario_id, CAST(10000 AS DECIMAL(12,2)) AS cupo_total,
             CAST(greatest(c_acctbal, 0) AS DECIMAL(12,2)) AS cupo_disponible, CAST(c_custkey % 7 AS INT) AS compras_completadas,
             CASE WHEN c_acctbal < 0 THEN 'suspendido' WHEN c_acctbal < 500 THEN 'inactivo' ELSE 'activo' END AS estado
      FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "cuotas": """
      SELECT id, usuario_id, id AS compra_id, monto_total,
             (2 * CAST(monto_total * 100 AS BIGINT) + n) // (2 * n) AS cada, n AS cuotas_totales,
             CAST(id % (n + 1) AS INT) AS cuotas_pagadas, fecha_compra,
             CASE WHEN id % (n + 1) >= n THEN 'pagada' ELSE 'pendiente' END AS estado, prioridad
      FROM (SELECT o_orderkey AS id, o_custkey AS usuario_id, CAST(o_totalprice AS DECIMAL(12,2)) AS monto_total,
                   CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 6 END AS n, o_orderdate AS fecha_compra,
                   o_orderpriority AS prioridad FROM orders)""",
    "movimientos": """
      SELECT event_id AS id, user_id AS usuario_id,
             CASE event_type WHEN 'purchase' THEN 'compra' WHEN 'click' THEN 'pago' WHEN 'signup' THEN 'aumento_cupo'
               WHEN 'view' THEN 'ajuste_admin' WHEN 'error' THEN 'suspension' END AS tipo,
             CAST(value AS DECIMAL(12,2)) AS monto, ts AS fecha FROM events""",
    "vendidos": """
      SELECT id_producto, count(*) AS veces, CAST(sum(cantidad) AS BIGINT) AS unidades,
             CAST(sum(cantidad * precio_unitario) AS DOUBLE) AS ingresos FROM detalles GROUP BY 1""",
    "pagado": "SELECT id_orden, sum(monto) AS pagado, count(*) AS n FROM pagos GROUP BY 1",
    "estado_cuenta": """
      SELECT o.id AS id_orden, o.estado AS estado_orden, CAST(o.total AS DOUBLE) AS monto_total_orden,
             CAST(coalesce(p.pagado, 0) AS DOUBLE) AS total_pagado_acumulado,
             CAST(greatest(o.total - coalesce(p.pagado, 0), 0) AS DOUBLE) AS saldo_restante,
             CASE WHEN coalesce(p.pagado, 0) >= o.total - 0.01 THEN 'liquidada' ELSE 'pendiente' END AS estado_pago,
             coalesce(p.n, 0) AS num_pagos
      FROM ordenes o LEFT JOIN pagado p ON p.id_orden = o.id""",
    "pedidas": "SELECT DISTINCT id_orden FROM pagos WHERE metodo_pago = 'efectivo'",
    "r_usuarios": """
      SELECT count(*) AS total_usuarios, count(*) FILTER (rol = 'comprador') AS compradores,
             count(*) FILTER (rol = 'vendedor') AS vendedores, count(*) FILTER (rol = 'admin') AS admins,
             count(*) FILTER (estado = 'activo') AS usuarios_activos,
             count(*) FILTER (estado = 'pendiente') AS usuarios_pendientes FROM usuarios""",
    "r_productos": """
      SELECT count(*) AS total_productos, count(*) FILTER (activo) AS productos_activos,
             ((2 * CAST(sum(precio) * 100 AS HUGEINT) + count(*)) // (2 * count(*))) / 100.0 AS precio_promedio FROM productos""",
    "r_ordenes": """
      SELECT count(*) AS total_ordenes, count(*) FILTER (estado = 'pagada') AS ordenes_pagadas,
             count(*) FILTER (estado = 'pendiente') AS ordenes_pendientes,
             CAST(coalesce(sum(total) FILTER (estado = 'pagada'), 0) AS DOUBLE) AS ingresos_totales FROM ordenes""",
    "r_pagos": "SELECT count(*) AS total_pagos, CAST(coalesce(sum(monto), 0) AS DOUBLE) AS monto_total_pagado FROM pagos",
    "mejores": """
      SELECT row_number() OVER (ORDER BY unidades DESC, id_producto) AS rank, v.id_producto AS id,
             coalesce(nullif(p.nombre, ''), 'Producto #' || v.id_producto) AS nombre,
             unidades AS unidades_vendidas, ingresos
      FROM (SELECT * FROM vendidos ORDER BY unidades DESC, id_producto LIMIT 5) v
      LEFT JOIN productos p ON p.id = v.id_producto""",
    "por_mes": """
      SELECT strftime(fecha, '%Y-%m') AS mes, CAST(sum(total) AS DOUBLE) AS ingresos, count(*) AS num_ordenes
      FROM ordenes WHERE estado = 'pagada' GROUP BY 1""",
    "ventas_mes": """
      SELECT strftime(fecha, '%Y-%m') AS mes, count(*) AS num_ordenes,
             CAST(sum(CASE WHEN estado = 'pagada' THEN total ELSE 0 END) AS DOUBLE) AS ingresos FROM ordenes GROUP BY 1""",
    "metodos": """
      SELECT metodo_pago, count(*) AS usos, CAST(sum(monto) AS DOUBLE) AS monto_total FROM pagos GROUP BY 1""",
    "r_credito": """
      SELECT ((2 * CAST(sum(cupo_total) * 100 AS HUGEINT) + count(*)) // (2 * count(*))) / 100.0 AS cupo_promedio,
             ((2 * CAST(sum(cupo_disponible) * 100 AS HUGEINT) + count(*)) // (2 * count(*))) / 100.0 AS disponible_promedio,
             CAST(sum(cupo_total) - sum(cupo_disponible) AS DOUBLE) AS cupo_usado_total, count(*) AS total_lineas
      FROM creditos""",
    "inventario": """
      SELECT id_vendedor AS vendedor_id, count(*) AS num_productos,
             ((2 * CAST(sum(precio) * 100 AS HUGEINT) + count(*)) // (2 * count(*))) / 100.0 AS precio_promedio,
             CAST(sum(precio * cantidad) AS DOUBLE) AS valor_inventario
      FROM productos GROUP BY 1 ORDER BY num_productos DESC, id_vendedor LIMIT 5""",
    # Folds: one step per round over the rank of the event inside its key.
    "pasos_stock": """
      SELECT d.*, row_number() OVER (PARTITION BY id_producto ORDER BY id_orden, linea, id_proveedor, precio_unitario) AS i
      FROM detalles d""",
    "stock": """
      SELECT id AS id_producto, 0::BIGINT AS i, NULL::BIGINT AS id_orden, NULL::INT AS linea, NULL::BIGINT AS id_proveedor,
             NULL::INT AS cantidad, NULL::DECIMAL(12,2) AS precio_unitario, false AS aceptado,
             (cantidad * 20)::BIGINT AS stock_antes, (cantidad * 20)::BIGINT AS stock_despues FROM productos
      UNION ALL
      SELECT s.id_producto, p.i, p.id_orden, p.linea, p.id_proveedor, p.cantidad, p.precio_unitario,
             p.cantidad > 0 AND p.cantidad <= s.stock_despues, s.stock_despues,
             CASE WHEN p.cantidad > 0 AND p.cantidad <= s.stock_despues THEN s.stock_despues - p.cantidad ELSE s.stock_despues END
      FROM stock s JOIN pasos_stock p ON p.id_producto = s.id_producto AND p.i = s.i + 1""",
    "pasos_pago": """
      SELECT p.*, CAST(monto * 100 AS BIGINT) AS x, row_number() OVER (PARTITION BY id_orden ORDER BY fecha_pago, transaccion_id) AS i
      FROM pagos p""",
    "aplicados": """
      SELECT id AS id_orden, 0::BIGINT AS i, CAST(total * 100 AS BIGINT) AS t, 0::BIGINT AS acc, false AS cerrada,
             NULL::VARCHAR AS transaccion_id, NULL::TIMESTAMP AS fecha_pago, NULL::DECIMAL(12,2) AS monto,
             false AS aceptado, NULL::VARCHAR AS motivo FROM ordenes
      UNION ALL
      SELECT id_orden, i, t, CASE WHEN why IS NULL THEN acc + x ELSE acc END,
             cerrada OR (why IS NULL AND acc + x = t), transaccion_id, fecha_pago, monto, why IS NULL, why
      FROM (SELECT a.id_orden, p.i, a.t, a.acc, a.cerrada, p.transaccion_id, p.fecha_pago, p.monto, p.x,
                   CASE WHEN a.cerrada THEN 'La orden ya está totalmente pagada'
                        WHEN p.x <= 0 THEN 'Monto no válido'
                        WHEN a.acc + p.x > a.t + 1 THEN 'El monto excede el saldo pendiente' END AS why
            FROM aplicados a JOIN pasos_pago p ON p.id_orden = a.id_orden AND p.i = a.i + 1)""",
    "pasos_credito": """
      SELECT *, row_number() OVER (PARTITION BY usuario_id ORDER BY fecha, clase, ref) AS i FROM (
        SELECT id_comprador AS usuario_id,
               CASE prioridad WHEN '4-NOT SPECIFIED' THEN 'ajustar' WHEN '5-LOW' THEN 'liquidar' ELSE 'usar' END AS tipo,
               CASE WHEN prioridad = '4-NOT SPECIFIED' THEN CAST(total * 100 AS BIGINT)
                    WHEN prioridad <> '5-LOW' THEN CAST(total * 100 AS BIGINT) // 10 END AS x,
               CASE WHEN prioridad NOT IN ('4-NOT SPECIFIED', '5-LOW')
                    THEN CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 6 END END AS cuotas,
               CASE WHEN prioridad NOT IN ('4-NOT SPECIFIED', '5-LOW') THEN id END AS cuota_id,
               fecha, 0 AS clase, CAST(id AS VARCHAR) AS ref FROM ordenes
        UNION ALL
        SELECT o.id_comprador, 'pagar_cuota', NULL, NULL, p.id_orden, p.fecha_pago, 1, p.transaccion_id
        FROM pagos p JOIN ordenes o ON o.id = p.id_orden)""",
    "planes_apertura": """
      SELECT usuario_id, id, cada, cuotas_totales, cuotas_pagadas FROM cuotas WHERE prioridad IN ('4-NOT SPECIFIED', '5-LOW')""",
    "libro": """
      SELECT e.usuario_id, 0::BIGINT AS i, coalesce(CAST(c.cupo_total * 100 AS BIGINT), 0) AS t,
             coalesce(CAST(c.cupo_disponible * 100 AS BIGINT), 0) AS d, coalesce(c.compras_completadas, 0) AS c,
             c.usuario_id IS NOT NULL AS existe, coalesce(c.estado = 'activo', false) AS activo, coalesce(q.planes, []) AS planes,
             NULL::VARCHAR AS tipo, NULL::BIGINT AS cuota_id, NULL::INT AS cuotas, NULL::TIMESTAMP AS fecha, NULL::INT AS clase,
             NULL::VARCHAR AS ref, NULL::VARCHAR AS motivo, NULL::BIGINT AS antes, NULL::BIGINT AS despues,
             NULL::INT AS numero, NULL::BIGINT AS mov
      FROM (SELECT DISTINCT usuario_id FROM pasos_credito) e
      LEFT JOIN creditos c ON c.usuario_id = e.usuario_id
      LEFT JOIN (SELECT usuario_id, list({'p': CAST(id AS BIGINT), 'v': CAST(cada AS BIGINT), 'n': CAST(cuotas_totales AS INT), 'k': CAST(cuotas_pagadas AS INT)}) AS planes
                 FROM planes_apertura GROUP BY 1) q ON q.usuario_id = e.usuario_id
      UNION ALL
      SELECT usuario_id, i,
             CASE WHEN why IS NOT NULL THEN t WHEN tipo = 'ajustar' THEN x WHEN sube THEN least(t + 5000000, 50000000) ELSE t END,
             CASE WHEN why IS NOT NULL THEN d WHEN sube THEN least(t + 5000000, 50000000) ELSE dm END,
             CASE WHEN completa THEN c + 1 ELSE c END,
             existe OR (why IS NULL AND tipo = 'ajustar'), activo OR (why IS NULL AND tipo = 'ajustar' AND NOT existe),
             CASE WHEN why IS NOT NULL THEN planes
                  WHEN tipo = 'usar' THEN list_append(planes, {'p': cuota_id, 'v': (2 * x + cuotas) // (2 * cuotas), 'n': cuotas, 'k': 0::INT})
                  WHEN tipo = 'pagar_cuota' THEN list_transform(planes, lambda z: CASE WHEN z.p = cuota_id THEN {'p': z.p, 'v': z.v, 'n': z.n, 'k': (z.k + 1)::INT} ELSE z END)
                  WHEN tipo = 'liquidar' THEN list_transform(planes, lambda z: {'p': z.p, 'v': z.v, 'n': z.n, 'k': greatest(z.k, z.n)})
                  ELSE planes END,
             tipo, cuota_id, cuotas, fecha, clase, ref, why, d,
             CASE WHEN why IS NOT NULL THEN d ELSE dm END,
             CASE WHEN why IS NULL AND tipo = 'pagar_cuota' THEN plan.k + 1 END,
             CASE WHEN why IS NULL THEN CASE tipo WHEN 'usar' THEN x WHEN 'pagar_cuota' THEN plan.v WHEN 'liquidar' THEN t - d END END
      FROM (SELECT *, coalesce(completa AND (c + 1) % 3 = 0, false) AS sube FROM (
        SELECT *, coalesce(why IS NULL AND tipo = 'pagar_cuota' AND plan.k + 1 >= plan.n, false) AS completa,
               CASE tipo WHEN 'usar' THEN d - x WHEN 'pagar_cuota' THEN least(d + plan.v, t) WHEN 'liquidar' THEN t WHEN 'ajustar' THEN x END AS dm
        FROM (SELECT *, CASE tipo
                 WHEN 'usar' THEN CASE WHEN x IS NULL OR x <= 0 OR cuotas IS NULL OR cuotas <= 0 THEN 'Faltan datos requeridos'
                                       WHEN NOT existe OR NOT activo THEN 'Cuenta de crédito no activa'
                                       WHEN x > d THEN 'Cupo insuficiente' END
                 WHEN 'pagar_cuota' THEN CASE WHEN plan IS NULL THEN 'Acceso denegado' WHEN NOT existe THEN 'Usuario no tiene crédito registrado'
                                              WHEN plan.k >= plan.n THEN 'Cuota ya pagada' END
                 WHEN 'liquidar' THEN CASE WHEN NOT existe THEN 'Usuario no tiene crédito registrado' WHEN t - d <= 0 THEN 'No tienes deudas pendientes' END
                 WHEN 'ajustar' THEN CASE WHEN x IS NULL OR x < 5000000 THEN 'El cupo minimo es $50.000' END END AS why
          FROM (SELECT l.usuario_id, e.i, l.t, l.d, l.c, l.existe, l.activo, l.planes, e.tipo, e.x, e.cuotas, e.cuota_id, e.fecha, e.clase, e.ref,
                       CASE WHEN e.tipo = 'pagar_cuota' THEN list_filter(l.planes, lambda z: z.p = e.cuota_id)[1] END AS plan
                FROM libro l JOIN pasos_credito e ON e.usuario_id = l.usuario_id AND e.i = l.i + 1))))""",
    "movimientos_libro": """
      SELECT usuario_id, fecha, clase, ref, CASE tipo WHEN 'usar' THEN 'compra' ELSE 'pago' END AS tipo, mov / 100.0 AS monto,
             antes / 100.0 AS cupo_antes, despues / 100.0 AS cupo_despues,
             CASE tipo WHEN 'usar' THEN 'Compra en ' || cuotas || ' cuotas - Orden #' || cuota_id
               WHEN 'pagar_cuota' THEN 'Pago cuota ' || numero || ' de ' || list_filter(planes, lambda z: z.p = cuota_id)[1].n
               ELSE 'Liquidación total de deuda' END AS descripcion
      FROM libro WHERE i > 0 AND motivo IS NULL AND tipo <> 'ajustar'""",
    "ultimo_libro": "SELECT * FROM libro QUALIFY row_number() OVER (PARTITION BY usuario_id ORDER BY i DESC) = 1",
    "cambios_producto": """
      SELECT l_partkey AS id_producto, CASE l_returnflag WHEN 'A' THEN 'editar' WHEN 'N' THEN 'aprobar' WHEN 'R' THEN 'desactivar' END AS tipo,
             1000000000 + l_suppkey AS id_vendedor, 'Producto ' || l_partkey || ' v' || l_linenumber AS nombre,
             l_linestatus AS descripcion, CAST(l_extendedprice AS DECIMAL(12,2)) AS precio, CAST(l_quantity AS INT) AS cantidad,
             l_shipdate AS momento, l_orderkey AS n1, CAST(l_linenumber AS BIGINT) AS n2, l_suppkey AS n3 FROM lineitem""",
    "ediciones": """
      SELECT c.* FROM cambios_producto c JOIN productos p ON p.id = c.id_producto AND p.id_vendedor = c.id_vendedor
      WHERE c.tipo = 'editar' QUALIFY row_number() OVER (PARTITION BY c.id_producto ORDER BY momento DESC, n1 DESC, n2 DESC, n3 DESC, c.precio DESC) = 1""",
    "solicitudes": """
      SELECT 'Usuario ' || user_id AS nombre, 'user' || user_id || '@example.com' AS email,
             CASE event_type WHEN 'view' THEN 'vendedor' WHEN 'purchase' THEN 'comprador' END AS rol, ts AS momento, event_id AS n,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
             'user' || user_id || '@example.com' IN (SELECT 'user' || s_suppkey || '@example.com' FROM supplier) AS tomado
      FROM events""",
    "cambios_usuario": """
      SELECT user_id AS usuario_id, CASE WHEN event_type = 'error' AND value >= 200 THEN 'eliminar' ELSE 'estado' END AS tipo,
             CASE WHEN event_type = 'error' AND value >= 200 THEN NULL WHEN event_type IN ('view', 'error') THEN 'activo'
                  WHEN event_type = 'click' THEN 'pendiente' WHEN event_type = 'signup' THEN 'rechazado' ELSE 'suspendido' END AS estado,
             ts AS momento, event_id AS n FROM events""",
    "bajas": "SELECT usuario_id, min((momento, n)) AS baja FROM cambios_usuario WHERE tipo = 'eliminar' GROUP BY 1",
    "ultimos": """
      SELECT usuario_id, estado FROM cambios_usuario WHERE tipo = 'estado' AND estado <> 'suspendido'
      QUALIFY row_number() OVER (PARTITION BY usuario_id ORDER BY momento DESC, n DESC) = 1""",
    "revisados": """
      SELECT d.*, p.nombre, p.precio, CASE WHEN p.id IS NULL THEN 'Producto ' || d.id_producto || ' no encontrado'
               WHEN p.cantidad < d.cantidad THEN 'Stock insuficiente para: ' || p.nombre END AS motivo,
             CASE WHEN p.id IS NULL THEN 'Producto ' || d.id_producto || ' no encontrado'
               WHEN p.cantidad < 1 THEN 'Sin stock para: ' || p.nombre END AS motivo_uno
      FROM detalles d LEFT JOIN productos p ON p.id = d.id_producto""",
    "pedidos": """
      SELECT id_orden, sum(precio * cantidad) AS importe, sum(precio) AS importe_uno, count(*) AS lineas,
             arg_min(motivo, (linea, id_producto, id_proveedor, precio_unitario)) FILTER (motivo IS NOT NULL) AS motivo,
             arg_min(motivo_uno, (linea, id_producto, id_proveedor, precio_unitario)) FILTER (motivo_uno IS NOT NULL) AS motivo_uno
      FROM revisados GROUP BY 1""",
    "intake": """
      SELECT o.id AS id_orden, o.id_comprador, CASE WHEN q.lineas IS NOT NULL AND q.motivo IS NULL THEN CAST(q.importe AS DOUBLE) END AS total,
             coalesce(q.lineas, 0) AS lineas, q.lineas IS NOT NULL AND q.motivo IS NULL AS aceptada,
             CASE WHEN q.lineas IS NOT NULL AND q.motivo IS NULL THEN 'pendiente' END AS estado,
             CASE WHEN q.lineas IS NULL THEN 'La orden debe tener productos' ELSE q.motivo END AS motivo
      FROM ordenes o LEFT JOIN pedidos q ON q.id_orden = o.id""",
    "pasos_aceptados": """
      SELECT d.*, row_number() OVER (PARTITION BY d.id_producto ORDER BY d.id_orden, linea, id_proveedor, precio_unitario) AS i
      FROM detalles d JOIN intake n ON n.id_orden = d.id_orden WHERE n.aceptada""",
    "stock_aceptado": """
      SELECT id AS id_producto, 0::BIGINT AS i, NULL::BIGINT AS id_orden, NULL::INT AS linea, NULL::BIGINT AS id_proveedor,
             NULL::INT AS cantidad, NULL::DECIMAL(12,2) AS precio_unitario, false AS aceptado,
             cantidad::BIGINT AS stock_antes, cantidad::BIGINT AS stock_despues FROM productos
      UNION ALL
      SELECT s.id_producto, p.i, p.id_orden, p.linea, p.id_proveedor, p.cantidad, p.precio_unitario, p.cantidad <= s.stock_despues,
             s.stock_despues, CASE WHEN p.cantidad <= s.stock_despues THEN s.stock_despues - p.cantidad ELSE s.stock_despues END
      FROM stock_aceptado s JOIN pasos_aceptados p ON p.id_producto = s.id_producto AND p.i = s.i + 1""",
    "cierres": """
      SELECT o.id AS id_orden, o.estado <> 'cancelada' AS cierra, CAST(sum(p.monto) * 100 AS BIGINT) AS t
      FROM ordenes o JOIN pagos p ON p.id_orden = o.id GROUP BY 1, 2""",
    "cobrados": """
      SELECT id_orden, 0::BIGINT AS i, t, 0::BIGINT AS acc, false AS cerrada, cierra, 0::BIGINT AS aceptados FROM cierres
      UNION ALL
      SELECT c.id_orden, p.i, c.t, CASE WHEN NOT c.cerrada AND p.x > 0 AND c.acc + p.x <= c.t + 1 THEN c.acc + p.x ELSE c.acc END,
             c.cerrada OR (c.cierra AND p.x > 0 AND c.acc + p.x = c.t), c.cierra,
             c.aceptados + CASE WHEN NOT c.cerrada AND p.x > 0 AND c.acc + p.x <= c.t + 1 THEN 1 ELSE 0 END
      FROM cobrados c JOIN pasos_pago p ON p.id_orden = c.id_orden AND p.i = c.i + 1""",
    # Orders one after the other: the stock of all products is a list, by the place of the product.
    "lugares": "SELECT id AS id_producto, row_number() OVER (ORDER BY id) AS p, nombre, precio, (cantidad * 20)::BIGINT AS hay FROM productos",
    "pedidas_orden": """
      SELECT d.id_orden, o.fecha, d.id_producto, l.p, l.nombre, sum(d.cantidad)::BIGINT AS x, sum(l.precio * d.cantidad) AS importe, count(*) AS lineas,
             min((linea, d.id_producto, id_proveedor, precio_unitario)) AS primera
      FROM detalles d JOIN ordenes o ON o.id = d.id_orden LEFT JOIN lugares l ON l.id_producto = d.id_producto GROUP BY ALL""",
    "turnos": """
      SELECT id_orden, row_number() OVER (ORDER BY fecha, id_orden) AS i, list({'p': p, 'x': x} ORDER BY primera) AS pide
      FROM pedidas_orden GROUP BY id_orden, fecha HAVING bool_and(p IS NOT NULL)""",
    "plegado": """
      SELECT list_reduce(list({'pide': pide, 's': NULL::BIGINT[], 'out': NULL::BIGINT[]} ORDER BY i), lambda a, o:
               {'pide': NULL::STRUCT(p BIGINT, x BIGINT)[],
                's': CASE WHEN len(list_filter(o.pide, lambda z: z.x > a.s[z.p])) > 0 THEN a.s
                     ELSE list_transform(a.s, lambda v, k: v - CASE WHEN list_contains(list_transform(o.pide, lambda z: z.p), k)
                                                                   THEN list_filter(o.pide, lambda z: z.p = k)[1].x ELSE 0 END) END,
                'out': list_append(a.out, list_filter(o.pide, lambda z: z.x > a.s[z.p])[1].p)},
             {'pide': NULL::STRUCT(p BIGINT, x BIGINT)[], 's': (SELECT list(hay ORDER BY p) FROM lugares), 'out': []::BIGINT[]}) AS z FROM turnos""",
    "veredictos": """
      SELECT t.id_orden, u.falla IS NULL AS concedida, l.nombre FROM turnos t
      JOIN (SELECT generate_subscripts(z.out, 1) AS i, unnest(z.out) AS falla FROM plegado) u ON u.i = t.i LEFT JOIN lugares l ON l.p = u.falla""",
    "intake_seguido": """
      SELECT o.id AS id_orden, o.id_comprador, CASE WHEN e.concedida THEN CAST(q.importe AS DOUBLE) END AS total, coalesce(q.lineas, 0)::BIGINT AS lineas,
             coalesce(e.concedida, false) AS aceptada, CASE WHEN e.concedida THEN 'pendiente' END AS estado,
             CASE WHEN q.lineas IS NULL THEN 'La orden debe tener productos' WHEN NOT e.concedida THEN 'Stock insuficiente para: ' || e.nombre END AS motivo
      FROM ordenes o LEFT JOIN (SELECT id_orden, sum(importe) AS importe, sum(lineas) AS lineas FROM pedidas_orden GROUP BY 1) q ON q.id_orden = o.id
      LEFT JOIN veredictos e ON e.id_orden = o.id""",
    # Closings that ask the buyer's line.
    "facturadas": """
      SELECT o.id, o.id_comprador, p.t FROM ordenes o JOIN (
        SELECT id_orden, CAST(sum(monto) * 100 AS BIGINT) - CASE WHEN id_orden % 2 = 0 AND count(*) > 1
                 THEN CAST(arg_max(monto, (fecha_pago, transaccion_id)) * 100 AS BIGINT) ELSE 0 END AS t FROM pagos GROUP BY 1) p ON p.id_orden = o.id""",
    "corridos": """
      SELECT p.*, f.t, f.id_comprador, CAST(sum(monto) OVER (PARTITION BY id_orden ORDER BY fecha_pago, transaccion_id ROWS UNBOUNDED PRECEDING) * 100 AS BIGINT) AS acc
      FROM pagos p JOIN facturadas f ON f.id = p.id_orden""",
    "pasos_cierre": """
      SELECT *, row_number() OVER (PARTITION BY usuario_id ORDER BY fecha, ref) AS i FROM (
        SELECT id_comprador AS usuario_id, 'usar' AS tipo, t AS x, id_orden, fecha_pago AS fecha, transaccion_id AS ref FROM corridos WHERE acc = t
        UNION ALL SELECT usuario_id, tipo, x, NULL, fecha, ref FROM pasos_credito WHERE tipo IN ('ajustar', 'liquidar'))""",
    "libro_cierre": """
      SELECT e.usuario_id, 0::BIGINT AS i, coalesce(CAST(c.cupo_total * 100 AS BIGINT), 0) AS t, coalesce(CAST(c.cupo_disponible * 100 AS BIGINT), 0) AS d,
             c.usuario_id IS NOT NULL AS existe, coalesce(c.estado = 'activo', false) AS activo, NULL::BIGINT AS id_orden, NULL::VARCHAR AS motivo
      FROM (SELECT DISTINCT usuario_id FROM pasos_cierre) e LEFT JOIN creditos c ON c.usuario_id = e.usuario_id
      UNION ALL
      SELECT usuario_id, i, CASE WHEN tipo = 'ajustar' AND x >= 5000000 THEN x ELSE t END,
             CASE WHEN tipo = 'usar' AND why IS NULL THEN d - x WHEN tipo = 'ajustar' AND x >= 5000000 THEN x WHEN tipo = 'liquidar' AND existe THEN t ELSE d END,
             existe OR (tipo = 'ajustar' AND x >= 5000000), activo OR (NOT existe AND tipo = 'ajustar' AND x >= 5000000), id_orden, why
      FROM (SELECT l.usuario_id, p.i, l.t, l.d, l.existe, l.activo, p.tipo, p.x, p.id_orden,
                   CASE WHEN p.tipo <> 'usar' THEN NULL WHEN NOT l.existe OR NOT l.activo THEN 'Cuenta de crédito no activa' WHEN p.x > l.d THEN 'Cupo insuficiente' END AS why
            FROM libro_cierre l JOIN pasos_cierre p ON p.usuario_id = l.usuario_id AND p.i = l.i + 1)""",
    "cierre_credito": "SELECT id_orden, motivo FROM libro_cierre WHERE id_orden IS NOT NULL",
    "plazos": """
      SELECT m.*, m.id % 3 AS lote, m.fecha IS NULL OR coalesce(date_trunc('hour', fecha) + INTERVAL 1 HOUR <= t.tope - INTERVAL 10 DAY, false) AS tarde
      FROM movimientos m LEFT JOIN (SELECT f, (SELECT max(fecha) FROM movimientos WHERE id % 3 < f) AS tope FROM range(3) r(f)) t ON t.f = m.id % 3""",
    "h": """
      SELECT CASE WHEN min(c) = max(c) THEN min(c) - 50 ELSE min(c) END AS lo, CASE WHEN min(c) = max(c) THEN max(c) + 50 ELSE max(c) END AS hi
      FROM (SELECT CAST(precio * 100 AS BIGINT) AS c FROM productos)""",
}

NEEDS = {
    "vendidos": ["detalles"], "pagado": ["pagos"], "estado_cuenta": ["ordenes", "pagado"], 
    "pedidas": ["pagos"], "r_usuarios": ["usuarios"], "r_productos": ["productos"], "r_ordenes": ["ordenes"], "r_pagos": ["pagos"],
    "mejores": ["vendidos", "productos"], "por_mes": ["ordenes"], "ventas_mes": ["ordenes"], "metodos": ["pagos"],
    "r_credito": ["creditos"], "inventario": ["productos"], "pasos_stock": ["detalles"], "stock": ["pasos_stock", "productos"],
    "pasos_pago": ["pagos"], "aplicados": ["pasos_pago", "ordenes"], "pasos_credito": ["ordenes", "pagos"],
    "planes_apertura": ["cuotas"], "libro": ["pasos_credito", "creditos", "planes_apertura"], "movimientos_libro": ["libro"],
    "ultimo_libro": ["libro"], "ediciones": ["cambios_producto", "productos"], "bajas": ["cambios_usuario"],
    "ultimos": ["cambios_usuario"], "revisados": ["detalles", "productos"], "pedidos": ["revisados"], "intake": ["ordenes", "pedidos"],
    "h": ["productos"], "pasos_aceptados": ["detalles", "intake"], "stock_aceptado": ["pasos_aceptados", "productos"],
    "lugares": ["productos"], "pedidas_orden": ["detalles", "ordenes", "lugares"], "turnos": ["pedidas_orden"],
    "plegado": ["turnos", "lugares"], "veredictos": ["turnos", "plegado", "lugares"], "intake_seguido": ["ordenes", "pedidas_orden", "veredictos"],
    "facturadas": ["ordenes", "pagos"], "corridos": ["pagos", "facturadas"], "pasos_cierre": ["corridos", "pasos_credito"],
    "libro_cierre": ["pasos_cierre", "creditos"], "cierre_credito": ["libro_cierre"],
    "plazos": ["movimientos"],
    "cierres": ["ordenes", "pagos"], "cobrados": ["cierres", "pasos_pago"],
}


def _with(sql: str, *views: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in views:
        add(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{sql.strip()}"


def _percent(n: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN (2 * {n} * 100 + {whole}) // (2 * {whole}) ELSE 0 END"


_ROLES = "greatest(compradores, vendedores, admins, 1)"
_LEDGER_TABLE = """
  coalesce(u.t, CAST(c.cupo_total * 100 AS BIGINT)) / 100.0 AS cupo_total,
  coalesce(u.d, CAST(c.cupo_disponible * 100 AS BIGINT)) / 100.0 AS cupo_disponible,
  coalesce(u.c, c.compras_completadas) AS compras_completadas"""
_OUT_OF = "CAST(monto_total AS DOUBLE) AS monto_total"
_DAYS = "CAST(precio_unitario AS DOUBLE) AS precio_unitario"


def all_oracles() -> dict[str, str]:
    oracles = _oracles()
    for name in ("orders_by_user", "stock_fold", "order_intake_sequential", "payment_application", "credit_ledger", "ledger_breaks"):
        oracles[f"{name}_hot_keys"] = oracles[name]
    for name in ("stream_movements", "stream_sales"):
        oracles[f"{name}_files"] = oracles[name]
    oracles["product_changes_in_place"], oracles["user_changes_in_place"] = oracles["apply_product_changes"], oracles["apply_user_changes"]
    oracles["product_rejects_in_place"], oracles["summary_kept"] = oracles["product_change_rejects"], oracles["summary"]
    oracles["stream_payments_yearly"] = oracles["stream_payments_shuffled"] = oracles["stream_payments"]
    return oracles


def _oracles() -> dict[str, str]:
    return {
        "summary_users": _with("SELECT * FROM r_usuarios", "r_usuarios"),
        "summary_products": _with("SELECT * FROM r_productos", "r_productos"),
        "summary_orders": _with("SELECT * FROM r_ordenes", "r_ordenes"),
        "summary_payments": _with("SELECT * FROM r_pagos", "r_pagos"),
        "summary": _with("SELECT * FROM r_usuarios, r_productos, r_ordenes, r_pagos", "r_usuarios", "r_productos", "r_ordenes", "r_pagos"),
        "live_summary": _with(
            """SELECT total_usuarios, productos_activos AS total_productos, total_ordenes, ordenes_pagadas, ingresos_totales,
               total_pagos, monto_total_pagado FROM r_usuarios, r_productos, r_ordenes, r_pagos""",
            "r_usuarios", "r_productos", "r_ordenes", "r_pagos"),
        "admin_counters": _with(
            f"""SELECT *, {_percent('activos', 'total')} AS pct_activos, {_percent('pendientes', 'total')} AS pct_pendientes,
               {_percent('rechazados', 'total')} AS pct_rechazados, {_percent('compradores', 'total')} AS pct_compradores,
               {_percent('vendedores', 'total')} AS pct_vendedores, {_percent('compradores', _ROLES)} AS barra_compradores,
               {_percent('vendedores', _ROLES)} AS barra_vendedores, {_percent('admins', _ROLES)} AS barra_admins
               FROM (SELECT count(*) AS total, count(*) FILTER (estado = 'activo') AS activos, count(*) FILTER (estado = 'pendiente') AS pendientes,
               count(*) FILTER (estado = 'rechazado') AS rechazados, count(*) FILTER (rol = 'comprador') AS compradores,
               count(*) FILTER (rol = 'vendedor') AS vendedores, count(*) FILTER (rol = 'admin') AS admins FROM usuarios)""", "usuarios"),
        "top_products": _with("SELECT * FROM mejores", "mejores"),
        "top_products_inner": _with(
            """SELECT p.id, p.nombre, unidades AS total_vendido FROM vendidos v JOIN productos p ON p.id = v.id_producto
               ORDER BY unidades DESC, p.id LIMIT 5""", "vendidos", "productos"),
        "top_products_live": _with(
            """SELECT id_producto, veces AS veces_vendido, unidades, ingresos FROM vendidos ORDER BY unidades DESC, id_producto LIMIT 5""",
            "vendidos"),
        "top_products_live_untimed": _with(
            "SELECT id_producto, unidades, ingresos FROM vendidos ORDER BY unidades DESC, id_producto LIMIT 5", "vendidos"),
        "revenue_by_month": _with("SELECT * FROM por_mes", "por_mes"),
        "sales_by_month": _with("SELECT * FROM ventas_mes", "ventas_mes"),
        "orders_by_state": _with("SELECT estado, count(*) AS cantidad FROM ordenes GROUP BY 1", "ordenes"),
        "orders_by_state_amount": _with(
            "SELECT estado, count(*) AS cantidad, CAST(sum(total) AS DOUBLE) AS monto FROM ordenes GROUP BY 1", "ordenes"),
        "orders_by_user": _with(
            """SELECT id_comprador, id, CAST(total AS DOUBLE) AS total, estado, fecha,
               row_number() OVER (PARTITION BY id_comprador ORDER BY fecha DESC, id) AS posicion FROM ordenes""", "ordenes"),
        "users_by_role": _with("SELECT rol, count(*) AS cantidad FROM usuarios GROUP BY 1", "usuarios"),
        "users_by_role_share": _with(
            """SELECT rol, CASE rol WHEN 'comprador' THEN 'Compradores' WHEN 'vendedor' THEN 'Vendedores' WHEN 'admin' THEN 'Administradores' END AS etiqueta,
               n AS cantidad, ((2 * n * 1000 + t) // (2 * t)) / 10.0 AS porcentaje
               FROM (SELECT rol, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS t FROM usuarios GROUP BY 1)""", "usuarios"),
        "users_by_state": _with("SELECT estado, count(*) AS cantidad FROM usuarios GROUP BY 1", "usuarios"),
        "registrations_by_month": _with(
            """SELECT strftime(fecha_registro, '%Y-%m') AS mes, count(*) AS nuevos FROM usuarios GROUP BY 1
               ORDER BY mes DESC NULLS LAST LIMIT 6""", "usuarios"),
        "users_listing": _with(
            """SELECT *, CASE estado WHEN 'activo' THEN 'permitido' ELSE estado END AS access_status FROM usuarios""", "usuarios"),
        "user_search": _with(
            """SELECT id, nombre, email, rol, estado FROM usuarios WHERE estado = 'pendiente'
               AND (contains(lower(nombre), 'customer#0') OR contains(lower(email), 'customer#0'))""", "usuarios"),
        "active_catalog": _with(
            """SELECT p.id, p.id_vendedor, p.nombre, p.descripcion, CAST(p.precio AS DOUBLE) AS precio, p.cantidad,
               coalesce(nullif(u.nombre, ''), 'Usuario') AS vendedor FROM productos p LEFT JOIN usuarios u ON u.id = p.id_vendedor
               WHERE p.activo AND p.aprobado""", "productos", "usuarios"),
        "top_stock": _with(
            """SELECT id, nombre, CAST(precio AS DOUBLE) AS precio, cantidad, CAST(precio * cantidad AS DOUBLE) AS valor_inventario
               FROM productos WHERE activo ORDER BY cantidad DESC, id LIMIT 8""", "productos"),
        "price_stats": _with(
            """SELECT precio_promedio AS promedio, m.maximo, m.minimo FROM r_productos,
               (SELECT CAST(max(precio) AS DOUBLE) AS maximo, CAST(min(precio) AS DOUBLE) AS minimo FROM productos) m""",
            "r_productos", "productos"),
        "price_stats_active": _with(
            """SELECT ((2 * CAST(sum(precio) * 100 AS HUGEINT) + count(*)) // (2 * count(*))) / 100.0 AS precio_promedio,
               CAST(min(precio) AS DOUBLE) AS precio_minimo, CAST(max(precio) AS DOUBLE) AS precio_maximo,
               CAST(sum(precio * cantidad) AS DOUBLE) AS valor_total_inventario FROM productos WHERE activo""", "productos"),
        "price_histogram": _with(
            """SELECT CAST(b.bin AS INT) AS bin, lo::DOUBLE / 100 + b.bin * ((hi - lo)::DOUBLE / 1000) AS desde,
               count(c.i) AS cantidad FROM h, range(10) b(bin)
               LEFT JOIN (SELECT least((CAST(precio * 100 AS BIGINT) - lo) * 10 // (hi - lo), 9) AS i FROM productos, h) c ON c.i = b.bin
               GROUP BY b.bin, lo, hi""", "h"),
        "inventory_by_seller": _with("SELECT * FROM inventario", "inventario"),
        "payment_methods": _with("SELECT * FROM metodos", "metodos"),
        "paid_per_order": _with(
            """SELECT o.id AS id_orden, CAST(coalesce(pagado, 0) AS DOUBLE) AS total_pagado FROM ordenes o LEFT JOIN pagado p ON p.id_orden = o.id""",
            "ordenes", "pagado"),
        "account_statement": _with("SELECT * FROM estado_cuenta", "estado_cuenta"),
        "statement_lines": _with(
            """SELECT id_orden, transaccion_id, metodo_pago, CAST(monto AS DOUBLE) AS monto, estado, fecha_pago FROM pagos
               WHERE id_orden IN (SELECT id FROM ordenes)""", "pagos", "ordenes"),
        "payment_application": _with(
            """SELECT id_orden, transaccion_id, fecha_pago, CAST(monto AS DOUBLE) AS monto, aceptado, motivo, acc / 100.0 AS total_pagado_acumulado,
               greatest(t - acc, 0) / 100.0 AS saldo_restante, CASE WHEN cerrada THEN 'pagada' ELSE 'pendiente' END AS estado_orden
               FROM aplicados WHERE i > 0""", "aplicados"),
        "order_closure": _with(
            """SELECT id_orden, count(*) FILTER (aceptado) AS pagos_aceptados, max(acc) / 100.0 AS total_pagado,
               bool_or(cerrada) AS pagada_completa, CASE WHEN bool_or(cerrada) THEN 'pagada' ELSE 'pendiente' END AS estado
               FROM aplicados GROUP BY 1""", "aplicados"),
        "order_closure_failed": _with(
            """SELECT id_orden, max(aceptados) AS pagos_aceptados, max(acc) / 100.0 AS total_pagado, max(acc) = max(t) AND max(aceptados) > 0 AS pagada_completa,
               CASE WHEN max(acc) = max(t) AND max(aceptados) > 0 AND bool_and(cierra) THEN 'pagada' ELSE 'pendiente' END AS estado
               FROM cobrados GROUP BY 1""", "cobrados"),
        "order_closure_by_credit": _with(
            """SELECT f.id AS id_orden, count(*) FILTER (c.acc <= f.t) AS pagos_aceptados, f.t / 100.0 AS total_pagado, true AS pagada_completa,
               CASE WHEN any_value(k.motivo) IS NULL THEN 'pagada' ELSE 'pendiente' END AS estado, max(c.fecha_pago) FILTER (c.acc = f.t) AS fecha_pago,
               max(c.transaccion_id) FILTER (c.acc = f.t) AS transaccion_id, any_value(k.motivo) AS motivo_cierre
               FROM facturadas f JOIN corridos c ON c.id_orden = f.id JOIN cierre_credito k ON k.id_orden = f.id GROUP BY f.id, f.t""",
            "facturadas", "corridos", "cierre_credito"),
        "closure_payments": _with(
            """SELECT c.id_orden, transaccion_id, fecha_pago, CAST(monto AS DOUBLE) AS monto, acc <= t AS aceptado,
               CASE WHEN acc > t THEN CASE WHEN k.motivo IS NULL THEN 'La orden ya está totalmente pagada' ELSE 'El monto excede el saldo pendiente' END END AS motivo,
               least(acc, t) / 100.0 AS total_pagado_acumulado, greatest(t - acc, 0) / 100.0 AS saldo_restante,
               CASE WHEN acc >= t AND k.motivo IS NULL THEN 'pagada' ELSE 'pendiente' END AS estado_orden
               FROM corridos c JOIN cierre_credito k ON k.id_orden = c.id_orden""", "corridos", "cierre_credito"),
        "credit_stats": _with("SELECT * FROM r_credito", "r_credito"),
        "credit_stats_by_state": _with(
            """SELECT estado, count(*) AS total_lineas,
               ((2 * CAST(sum(cupo_total) * 100 AS HUGEINT) + count(*)) // (2 * count(*))) / 100.0 AS cupo_promedio,
               ((2 * CAST(sum(cupo_disponible) * 100 AS HUGEINT) + count(*)) // (2 * count(*))) / 100.0 AS disponible_promedio,
               CAST(sum(cupo_total - cupo_disponible) AS DOUBLE) AS cupo_usado_total, count(*) AS cantidad FROM creditos GROUP BY 1""", "creditos"),
        "movements_by_type": _with(
            "SELECT tipo, count(*) AS cantidad, CAST(sum(monto) AS DOUBLE) AS monto_total FROM movimientos GROUP BY 1", "movimientos"),
        "movement_history": _with(
            """SELECT usuario_id, row_number() OVER (PARTITION BY usuario_id ORDER BY fecha DESC, id DESC) AS posicion, id, tipo,
               CAST(monto AS DOUBLE) AS monto, fecha, CAST(CASE WHEN tipo = 'compra' THEN -monto ELSE monto END AS DOUBLE) AS monto_con_signo,
               CASE tipo WHEN 'compra' THEN 'compra' WHEN 'pago' THEN 'pago' ELSE 'aumento' END AS clase
               FROM movimientos QUALIFY posicion <= 20""", "movimientos"),
        "credit_panel": _with(
            """SELECT id, nombre, email, CAST(cupo_total AS DOUBLE) AS cupo_total, CAST(cupo_disponible AS DOUBLE) AS cupo_disponible,
               u / 100.0 AS cupo_usado, (2 * u * 100 + t) // (2 * t) AS porcentaje, ((2 * u * 1000 + t) // (2 * t)) / 10.0 AS porcentaje_1,
               CASE WHEN t IS NULL THEN 'Sin datos de credito' WHEN u * 100 > t * 90 THEN 'Casi agotado' ELSE 'Cuenta activa' END AS etiqueta,
               compras_completadas, 3 - compras_completadas % 3 AS compras_para_aumento
               FROM (SELECT b.id, b.nombre, b.email, c.cupo_total, c.cupo_disponible, c.compras_completadas, CAST(c.cupo_total * 100 AS BIGINT) AS t,
                     greatest(CAST((c.cupo_total - c.cupo_disponible) * 100 AS BIGINT), CASE WHEN c.id IS NOT NULL THEN 0 END) AS u
                     FROM usuarios b LEFT JOIN creditos c ON c.usuario_id = b.id WHERE b.rol = 'comprador')""", "usuarios", "creditos"),
        "pending_instalments": _with(
            f"""SELECT usuario_id, id, compra_id, {_OUT_OF}, cuotas_totales, cuotas_pagadas,
               cuotas_totales - cuotas_pagadas AS cuotas_restantes, fecha_compra,
               row_number() OVER (PARTITION BY usuario_id ORDER BY fecha_compra DESC, id) AS posicion FROM cuotas WHERE estado = 'pendiente'""", "cuotas"),
        "pending_count": _with(
            "SELECT usuario_id, count(*) AS cuotas_pendientes FROM cuotas WHERE estado = 'pendiente' GROUP BY 1", "cuotas"),
        "instalment_plan": _with(
            f"""SELECT usuario_id, compra_id, {_OUT_OF}, cada / 100.0 AS monto_por_cuota, cuotas_totales, 0 AS cuotas_pagadas,
               'pendiente' AS estado, (CAST(monto_total * 100 AS BIGINT) - cada * cuotas_totales) / 100.0 AS residuo FROM cuotas""", "cuotas"),
        "instalment_schedule": _with(
            """SELECT usuario_id, compra_id, CAST(unnest(range(1, cuotas_totales + 1)) AS INT) AS numero, cada / 100.0 AS monto FROM cuotas""", "cuotas"),
        "open_credit_lines": _with(
            """SELECT id AS usuario_id, 100000.0::DOUBLE AS cupo_total, 100000.0::DOUBLE AS cupo_disponible, 0 AS compras_completadas, 'activo' AS estado
               FROM usuarios WHERE rol = 'comprador' AND id NOT IN (SELECT usuario_id FROM creditos)""", "usuarios", "creditos"),
        "open_credit_movements": _with(
            """SELECT id AS usuario_id, 'aumento_cupo' AS tipo, 100000.0::DOUBLE AS monto, 0.0::DOUBLE AS cupo_antes, 100000.0::DOUBLE AS cupo_despues,
               'Apertura de línea de crédito inicial' AS descripcion
               FROM usuarios WHERE rol = 'comprador' AND id NOT IN (SELECT usuario_id FROM creditos)""", "usuarios", "creditos"),
        "credit_ledger": _with(
            """SELECT usuario_id, fecha, clase, ref, tipo, cuota_id, motivo IS NULL AS aceptado, motivo, numero, antes / 100.0 AS antes,
               despues / 100.0 AS despues, CASE WHEN existe THEN t END / 100.0 AS cupo_total, CASE WHEN existe THEN d END / 100.0 AS disponible,
               c AS completadas FROM libro WHERE i > 0""", "libro"),
        "credit_ledger_movements": _with("SELECT * FROM movimientos_libro", "movimientos_libro"),
        "credit_ledger_lines": _with(
            f"""SELECT coalesce(c.usuario_id, u.usuario_id) AS usuario_id, {_LEDGER_TABLE}, coalesce(c.estado, 'activo') AS estado
               FROM creditos c FULL JOIN (SELECT * FROM ultimo_libro WHERE existe) u ON u.usuario_id = c.usuario_id""", "creditos", "ultimo_libro"),
        "credit_ledger_plans": _with(
            """SELECT usuario_id, z.p AS cuota_id, z.v / 100.0 AS monto_por_cuota, z.n AS cuotas_totales, z.k AS cuotas_pagadas,
               CASE WHEN z.k >= z.n THEN 'pagada' ELSE 'pendiente' END AS estado FROM (SELECT usuario_id, unnest(planes) AS z FROM ultimo_libro)""", "ultimo_libro"),
        "order_intake": _with("SELECT * FROM intake", "intake"),
        "order_intake_single": _with(
            """SELECT o.id AS id_orden, o.id_comprador, CASE WHEN q.lineas IS NOT NULL AND q.motivo_uno IS NULL THEN CAST(q.importe_uno AS DOUBLE) END AS total,
               coalesce(q.lineas, 0) AS lineas, q.lineas IS NOT NULL AND q.motivo_uno IS NULL AS aceptada,
               CASE WHEN q.lineas IS NOT NULL AND q.motivo_uno IS NULL THEN 'pendiente' END AS estado,
               CASE WHEN q.lineas IS NULL THEN 'ID de producto requerido' ELSE q.motivo_uno END AS motivo
               FROM ordenes o LEFT JOIN pedidos q ON q.id_orden = o.id""", "ordenes", "pedidos"),
        "order_intake_credit": _intake_credit("importe", "motivo", "La orden debe tener productos"),
        "order_intake_credit_single": _intake_credit("importe_uno", "motivo_uno", "ID de producto requerido"),
        "stock_fold_accepted": _with(
            f"""SELECT id_orden, linea, id_producto, id_proveedor, cantidad, {_DAYS}, aceptado, stock_antes, stock_despues FROM stock_aceptado WHERE i > 0""",
            "stock_aceptado"),
        "order_intake_sequential": _with("SELECT * FROM intake_seguido", "intake_seguido"),
        "stock_after_intake": _with(
            """SELECT l.id_producto AS id, l.hay - coalesce(v.n, 0) AS cantidad, coalesce(v.n, 0)::BIGINT AS vendidas FROM lugares l
               LEFT JOIN (SELECT p.id_producto, sum(p.x)::BIGINT AS n FROM pedidas_orden p JOIN veredictos e ON e.id_orden = p.id_orden
                          WHERE e.concedida GROUP BY 1) v ON v.id_producto = l.id_producto""", "lugares", "pedidas_orden", "veredictos"),
        "order_intake_lines": _with(
            """SELECT r.id_orden, r.id_producto, r.cantidad, CAST(r.precio AS DOUBLE) AS precio_unitario FROM revisados r
               JOIN intake i ON i.id_orden = r.id_orden WHERE i.aceptada""", "revisados", "intake"),
        "stock_fold": _with(
            f"""SELECT id_orden, linea, id_producto, id_proveedor, cantidad, {_DAYS}, aceptado, stock_antes, stock_despues FROM stock WHERE i > 0""", "stock"),
        "stock_after": _with("SELECT id_producto AS id, min(stock_despues) AS cantidad FROM stock GROUP BY 1", "stock"),
        "order_state_updates": _with(
            """SELECT o.id, o.id_comprador, CAST(o.total AS DOUBLE) AS total, coalesce(u.estado, o.estado) AS estado, o.fecha FROM ordenes o
               LEFT JOIN (SELECT id_orden, CASE metodo_pago WHEN 'tarjeta' THEN 'pagada' ELSE 'cancelada' END AS estado FROM pagos
                          WHERE metodo_pago <> 'efectivo' QUALIFY row_number() OVER (PARTITION BY id_orden ORDER BY fecha_pago DESC, transaccion_id DESC) = 1) u
               ON u.id_orden = o.id""", "ordenes", "pagos"),
        "order_state_rejects": _with(
            "SELECT id_orden, 'devuelta' AS estado, fecha_pago, transaccion_id FROM pagos WHERE metodo_pago = 'efectivo'", "pagos"),
        "apply_product_changes": _with(
            """SELECT p.id, p.id_vendedor, CASE WHEN e.n1 IS NULL THEN p.nombre ELSE e.nombre END AS nombre,
               CASE WHEN e.n1 IS NULL THEN p.descripcion ELSE e.descripcion END AS descripcion,
               CAST(CASE WHEN e.n1 IS NULL THEN p.precio ELSE e.precio END AS DOUBLE) AS precio,
               CASE WHEN e.n1 IS NULL THEN p.cantidad ELSE e.cantidad END AS cantidad,
               p.activo AND NOT EXISTS (SELECT 1 FROM cambios_producto c WHERE c.tipo = 'desactivar' AND c.id_producto = p.id AND c.id_vendedor = p.id_vendedor) AS activo,
               p.aprobado OR EXISTS (SELECT 1 FROM cambios_producto c WHERE c.tipo = 'aprobar' AND c.id_producto = p.id) AS aprobado
               FROM productos p LEFT JOIN ediciones e ON e.id_producto = p.id
               UNION ALL SELECT 1000000000 + s_suppkey, 1000000000 + s_suppkey, s_name, 'nuevo', CAST(CAST(abs(s_acctbal) AS DECIMAL(12,2)) AS DOUBLE), 1,
               true, NOT s_acctbal < 0 FROM supplier""", "productos", "ediciones"),
        "product_change_rejects": _with(
            """SELECT c.id_producto, c.tipo, c.id_vendedor, c.momento, c.n1, c.n2, c.n3, CAST(c.precio AS DOUBLE) AS precio, 'No autorizado' AS motivo
               FROM cambios_producto c JOIN productos p ON p.id = c.id_producto
               WHERE c.tipo IN ('editar', 'desactivar') AND c.id_vendedor IS DISTINCT FROM p.id_vendedor""", "cambios_producto", "productos"),
        "register_users": _with(
            """SELECT nombre, email, coalesce(rol, 'comprador') AS rol, CASE WHEN rol = 'vendedor' THEN 'pendiente' ELSE 'activo' END AS estado, momento, n
               FROM solicitudes WHERE i = 1 AND NOT tomado""", "solicitudes"),
        "register_rejects": _with(
            """SELECT nombre, email, rol, momento, n, 'El email ya está registrado' AS motivo FROM solicitudes WHERE i > 1 OR tomado""", "solicitudes"),
        "apply_user_changes": _with(
            """SELECT u.id, u.nombre, u.email, u.rol, coalesce(x.estado, u.estado) AS estado FROM usuarios u LEFT JOIN ultimos x ON x.usuario_id = u.id
               WHERE u.id NOT IN (SELECT usuario_id FROM bajas)""", "usuarios", "ultimos", "bajas"),
        "user_change_rejects": _with(
            """SELECT * FROM (SELECT c.*, CASE WHEN c.tipo = 'estado' AND c.estado = 'suspendido' THEN 'Estado no válido'
               WHEN u.id IS NULL OR (c.momento, c.n) > b.baja THEN 'Usuario no encontrado' END AS motivo
               FROM cambios_usuario c LEFT JOIN usuarios u ON u.id = c.usuario_id LEFT JOIN bajas b ON b.usuario_id = c.usuario_id)
               WHERE motivo IS NOT NULL""", "cambios_usuario", "usuarios", "bajas"),
        "user_cascade": _with(
            """SELECT id, usuario_id, CAST(cupo_total AS DOUBLE) AS cupo_total, CAST(cupo_disponible AS DOUBLE) AS cupo_disponible, compras_completadas, estado
               FROM creditos WHERE usuario_id NOT IN (SELECT usuario_id FROM bajas)""", "creditos", "bajas"),
        "user_cascade_instalments": _with(
            f"""SELECT id, usuario_id, compra_id, {_OUT_OF}, cuotas_totales, cuotas_pagadas, fecha_compra, cada / 100.0 AS monto_por_cuota, estado FROM cuotas c
               WHERE usuario_id IN (SELECT id FROM usuarios) AND usuario_id NOT IN (SELECT usuario_id FROM bajas)""", "cuotas", "usuarios", "bajas"),
        "user_cascade_lines": _with(
            f"""SELECT id_orden, linea, id_producto, id_proveedor, cantidad, {_DAYS} FROM detalles WHERE id_orden IN (SELECT id FROM ordenes
               WHERE id_comprador IN (SELECT id FROM usuarios) AND id_comprador NOT IN (SELECT usuario_id FROM bajas))""",
            "detalles", "ordenes", "usuarios", "bajas"),
        "log_balance": _balance(),
        "csv_round_trip": _with(
            "SELECT id, id_comprador, CAST(total AS DOUBLE) AS total, estado, fecha FROM ordenes", "ordenes"),
        "csv_refused": "SELECT event_id AS id, 'sin monto' AS monto, 'monto' AS columnas FROM events WHERE event_type = 'error'",
        "validate_enum": """SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 'compra' ELSE event_type END AS tipo,
               event_type = 'purchase' AS valido FROM events""",
        "reconcile_orders": _with(
            """SELECT id_orden, monto_total_orden, total_pagado_acumulado FROM estado_cuenta WHERE estado_pago = 'liquidada' AND estado_orden = 'pendiente'""",
            "estado_cuenta"),
        "reconcile_totals": _with(
            """SELECT o.id AS id_orden, CAST(o.total AS DOUBLE) AS total, CAST(coalesce(s, 0) AS DOUBLE) AS suma_lineas,
               CAST(coalesce(s, 0) - o.total AS DOUBLE) AS diferencia FROM ordenes o
               LEFT JOIN (SELECT id_orden, sum(cantidad * precio_unitario) AS s FROM detalles GROUP BY 1) d ON d.id_orden = o.id
               WHERE o.total <> coalesce(s, 0)""", "ordenes", "detalles"),
        "ledger_breaks": _with(
            """SELECT usuario_id, fecha, clase, ref, cupo_anterior, cupo_antes FROM (SELECT *,
               lag(cupo_despues) OVER (PARTITION BY usuario_id ORDER BY fecha, clase, ref) AS cupo_anterior FROM movimientos_libro)
               WHERE cupo_anterior <> cupo_antes""", "movimientos_libro"),
        "orphans": _with(
            " UNION ALL ".join(
                f"SELECT '{text}' AS relacion, {key} AS clave, count(*) AS filas FROM {child} c "
                f"WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = c.{key}) GROUP BY 2"
                for text, child, key, parent, pk in (
                    ("linea sin orden", "detalles", "id_orden", "ordenes", "id"),
                    ("pago sin orden", "pagos", "id_orden", "ordenes", "id"),
                    ("linea sin producto", "detalles", "id_producto", "productos", "id"),
                    ("orden sin comprador", "ordenes", "id_comprador", "usuarios", "id"),
                    ("movimiento sin linea de credito", "movimientos", "usuario_id", "creditos", "usuario_id"),
                    ("cuota sin linea de credito", "cuotas", "usuario_id", "creditos", "usuario_id"),
                    ("producto sin vendedor", "productos", "id_vendedor", "usuarios", "id"),
                )
            ),
            "detalles", "pagos", "ordenes", "productos", "movimientos", "creditos", "cuotas", "usuarios"),
        "lookup_by_keys": _with(
            """SELECT id, id_comprador, CAST(total AS DOUBLE) AS total, estado, fecha FROM ordenes WHERE id IN (SELECT id_orden FROM pedidas)""",
            "ordenes", "pedidas"),
        "lookup_order_lines": _with(
            f"""SELECT id_orden, linea, id_producto, id_proveedor, cantidad, {_DAYS} FROM detalles WHERE id_orden IN (SELECT id_orden FROM pedidas)""",
            "detalles", "pedidas"),
        "lookup_order_payments": _with(
            """SELECT id_orden, metodo_pago, CAST(monto AS DOUBLE) AS monto, transaccion_id, estado, fecha_pago FROM pagos
               WHERE id_orden IN (SELECT id_orden FROM pedidas)""", "pagos", "pedidas"),
        "lookup_products": _with(
            """SELECT id, id_vendedor, nombre, descripcion, CAST(precio AS DOUBLE) AS precio, cantidad, activo, aprobado FROM productos
               WHERE id IN (SELECT id_producto FROM detalles WHERE cantidad >= 50)""", "productos", "detalles"),
        "lookup_instalments": _with(
            f"""SELECT id, usuario_id, compra_id, {_OUT_OF}, cuotas_totales, cuotas_pagadas, fecha_compra, cada / 100.0 AS monto_por_cuota, estado FROM cuotas
               WHERE id IN (SELECT id_orden FROM pedidas)""", "cuotas", "pedidas"),
        "missing_keys": _with(
            "SELECT DISTINCT usuario_id FROM movimientos WHERE usuario_id NOT IN (SELECT usuario_id FROM creditos)", "movimientos", "creditos"),
        "labels": _with(
            """SELECT id, upper(estado[1]) || estado[2:] AS estado_texto,
               '$' || replace(format('{:,}', (2 * CAST(total * 100 AS BIGINT) + 100) // 200), ',', '.') AS total_texto FROM ordenes""", "ordenes"),
        "report_sections": _with(_report_sql(), "r_usuarios", "r_productos", "r_ordenes", "r_pagos", "mejores", "por_mes", "usuarios", "metodos",
                                 "r_credito", "ordenes", "inventario"),
        "report_combined": _with(
            """SELECT 'spark+realtime' AS fuente, CAST(rank - 1 AS INT) AS posicion, id, nombre, unidades_vendidas AS unidades, ingresos FROM mejores""", "mejores"),
        "report_nested_order": _with(
            """SELECT 'top_productos' AS seccion, CAST(rank - 1 AS INT) AS posicion, CAST(id AS VARCHAR) AS clave FROM mejores
               UNION ALL SELECT 'ingresos_por_mes', CAST(row_number() OVER (ORDER BY mes) - 1 AS INT), mes FROM por_mes
               UNION ALL SELECT 'distribucion_roles', CAST(row_number() OVER (ORDER BY n DESC, rol) - 1 AS INT), rol
                 FROM (SELECT rol, count(*) AS n FROM usuarios GROUP BY 1)
               UNION ALL SELECT 'metodos_pago', CAST(row_number() OVER (ORDER BY usos DESC, metodo_pago) - 1 AS INT), metodo_pago FROM metodos
               UNION ALL SELECT 'estados_ordenes', CAST(row_number() OVER (ORDER BY estado) - 1 AS INT), estado FROM (SELECT DISTINCT estado FROM ordenes)
               UNION ALL SELECT 'inventario_por_vendedor', CAST(row_number() OVER (ORDER BY num_productos DESC, vendedor_id) - 1 AS INT),
                 CAST(vendedor_id AS VARCHAR) FROM inventario""", "mejores", "por_mes", "usuarios", "metodos", "ordenes", "inventario"),
        "report_live_top": _with(
            """SELECT 'realtime' AS fuente, CAST(row_number() OVER (ORDER BY unidades DESC, id_producto) - 1 AS INT) AS posicion, id_producto AS id,
               'Producto #' || id_producto AS nombre, unidades, ingresos FROM (SELECT * FROM vendidos ORDER BY unidades DESC, id_producto LIMIT 5)""", "vendidos"),
        "stream_movements": _with(
            """SELECT date_trunc('hour', fecha) AS desde, tipo, count(*) AS cantidad, CAST(sum(monto) AS DOUBLE) AS monto_total
               FROM movimientos GROUP BY 1, 2""", "movimientos"),
        "stream_movements_kept": _with(
            """SELECT date_trunc('hour', fecha) AS desde, tipo, count(*) AS cantidad, CAST(sum(monto) AS DOUBLE) AS monto_total
               FROM plazos WHERE NOT tarde GROUP BY 1, 2""", "plazos"),
        "stream_movements_late": _with(
            """SELECT id, usuario_id, tipo, CAST(monto AS DOUBLE) AS monto, fecha, CAST(lote AS INT) AS lote,
               CASE WHEN fecha IS NULL THEN 'Sin fecha' ELSE 'Fuera de plazo' END AS motivo FROM plazos WHERE tarde""", "plazos"),
        "stream_sales_changes": _with(
            """SELECT strftime(fecha, '%Y-%m') AS mes, count(*) AS num_ordenes, CAST(sum(CASE WHEN estado = 'pagada' THEN total ELSE 0 END) AS DOUBLE) AS ingresos
               FROM (SELECT o.fecha, o.total, coalesce(u.e, o.estado) AS estado FROM ordenes o LEFT JOIN (
                       SELECT id_orden, arg_max(e, (fecha_pago, transaccion_id)) AS e FROM (
                         SELECT *, CASE metodo_pago WHEN 'tarjeta' THEN 'pagada' WHEN 'transferencia' THEN 'cancelada' END AS e FROM pagos)
                       WHERE e IS NOT NULL GROUP BY 1) u ON u.id_orden = o.id) GROUP BY 1""", "ordenes", "pagos"),
        "stream_sales": _with("SELECT * FROM ventas_mes", "ventas_mes"),
        "stream_unique_payments": """SELECT DISTINCT l_orderkey AS id_orden, l_linenumber AS linea, l_orderkey || '-' || l_linenumber AS transaccion_id
               FROM lineitem""",
        "stream_payments": _with(
            """SELECT id_orden, transaccion_id, aceptado, acc / 100.0 AS total_pagado_acumulado,
               CASE WHEN cerrada THEN 'pagada' ELSE 'pendiente' END AS estado_orden FROM aplicados WHERE i > 0""", "aplicados"),
        "live_kept": _with(
            """SELECT 'total_usuarios' AS seccion, '' AS clave, count(*) AS cantidad, CAST(NULL AS DOUBLE) AS monto FROM usuarios
               UNION ALL SELECT 'usuarios_por_rol', rol, count(*), NULL FROM usuarios GROUP BY rol
               UNION ALL SELECT 'ordenes_por_estado', estado, count(*), CAST(coalesce(sum(total), 0) AS DOUBLE) FROM ordenes GROUP BY estado
               UNION ALL SELECT 'ventas_por_mes', mes, num_ordenes, ingresos FROM ventas_mes
               UNION ALL SELECT 'top_productos', CAST(id_producto AS VARCHAR), unidades, ingresos
                 FROM (SELECT * FROM vendidos ORDER BY unidades DESC, id_producto LIMIT 5)
               UNION ALL SELECT 'metodos_pago', metodo_pago, count(*), CAST(coalesce(sum(monto), 0) AS DOUBLE) FROM pagos GROUP BY metodo_pago""",
            "usuarios", "ordenes", "ventas_mes", "vendidos", "pagos"),
        "report_live_months": _with(
            "SELECT 'realtime' AS fuente, mes, num_ordenes AS ordenes, ingresos FROM ventas_mes", "ventas_mes"),
    }


def _intake_credit(amount: str, why: str, empty: str) -> str:
    """Orders in order of their keys against the buyer's line, one step per round; what the line refuses is refused."""
    return _with(f"""
      , pedidos_credito AS (SELECT o.id AS id_orden, o.id_comprador, coalesce(q.lineas, 0) AS lineas,
          CASE WHEN q.lineas IS NULL THEN '{empty}' ELSE q.{why} END AS motivo, CAST(q.{amount} * 100 AS BIGINT) AS x
          FROM ordenes o LEFT JOIN pedidos q ON q.id_orden = o.id),
      turnos AS (SELECT *, row_number() OVER (PARTITION BY id_comprador ORDER BY id_orden) AS i FROM pedidos_credito WHERE motivo IS NULL),
      cargos AS (
        SELECT t.id_comprador, 0::BIGINT AS i, CAST(max(c.cupo_disponible) * 100 AS BIGINT) AS d, coalesce(max(c.estado) = 'activo', false) AS activo,
               NULL::BIGINT AS id_orden, NULL::VARCHAR AS nego
        FROM turnos t LEFT JOIN creditos c ON c.usuario_id = t.id_comprador GROUP BY 1
        UNION ALL
        SELECT id_comprador, i, CASE WHEN no IS NULL THEN d - x ELSE d END, activo, id_orden, no FROM (
          SELECT t.*, g.d, g.activo, CASE WHEN t.x <= 0 THEN 'Faltan datos requeridos' WHEN NOT g.activo THEN 'Cuenta de crédito no activa'
                 WHEN t.x > g.d THEN 'Cupo insuficiente' END AS no
          FROM cargos g JOIN turnos t ON t.id_comprador = g.id_comprador AND t.i = g.i + 1))
      SELECT p.id_orden, p.id_comprador, CASE WHEN coalesce(p.motivo, k.nego) IS NULL THEN p.x / 100.0 END AS total, p.lineas,
             coalesce(p.motivo, k.nego) IS NULL AS aceptada, CASE WHEN coalesce(p.motivo, k.nego) IS NULL THEN 'pendiente' END AS estado,
             coalesce(p.motivo, k.nego) AS motivo
      FROM pedidos_credito p LEFT JOIN cargos k ON k.id_orden = p.id_orden""", "ordenes", "pedidos", "creditos")


def _balance() -> str:
    """Accepted entries are counted by the rule that accepts them, not as the rest."""
    yes = {
        "productos": """c.tipo = 'aprobar' OR c.id_vendedor = p.id_vendedor FROM cambios_producto c LEFT JOIN productos p ON p.id = c.id_producto
                        UNION ALL SELECT true FROM supplier""",
        "registro": "i = 1 AND NOT tomado FROM solicitudes",
        "usuarios": """u.id IS NOT NULL AND (b.baja IS NULL OR (c.momento, c.n) <= b.baja) AND (c.tipo = 'eliminar' OR c.estado <> 'suspendido')
                       FROM cambios_usuario c LEFT JOIN usuarios u ON u.id = c.usuario_id LEFT JOIN bajas b ON b.usuario_id = c.usuario_id""",
        "ordenes": "metodo_pago <> 'efectivo' AND id_orden IN (SELECT id FROM ordenes) FROM pagos",
    }
    parts = [
        f"""SELECT '{name}' AS registro, count(*) AS entradas, count(*) FILTER (NOT coalesce(si, false)) AS rechazadas,
            count(*) FILTER (si) AS aceptadas FROM (SELECT {rule}) t(si)""" for name, rule in yes.items()
    ]
    parts.append("SELECT 'registro (altas)', count(*), 0, count(*) FROM solicitudes WHERE i = 1 AND NOT tomado")
    return _with(" UNION ALL ".join(parts), "cambios_producto", "productos", "solicitudes", "cambios_usuario", "usuarios", "bajas", "pagos", "ordenes")


def _report_sql() -> str:
    def rows(section: str, source: str, key: str, *measures: str) -> list[str]:
        return [f"SELECT '{section}' AS seccion, {key} AS clave, '{m}' AS medida, CAST({m} AS DOUBLE) AS valor FROM {source}" for m in measures]

    roles = "(SELECT rol, count(*) AS cantidad FROM usuarios GROUP BY 1)"
    states = "(SELECT estado, count(*) AS cantidad FROM ordenes GROUP BY 1)"
    parts = [
        *rows("resumen", "r_usuarios", "''", "total_usuarios", "compradores", "vendedores", "admins", "usuarios_activos", "usuarios_pendientes"),
        *rows("resumen", "r_productos", "''", "total_productos", "productos_activos", "precio_promedio"),
        *rows("resumen", "r_ordenes", "''", "total_ordenes", "ordenes_pagadas", "ordenes_pendientes", "ingresos_totales"),
        *rows("resumen", "r_pagos", "''", "total_pagos", "monto_total_pagado"),
        *rows("top_productos", "mejores", "CAST(id AS VARCHAR)", "unidades_vendidas", "ingresos"),
        *rows("ingresos_por_mes", "por_mes", "mes", "ingresos", "num_ordenes"),
        *rows("distribucion_roles", roles, "rol", "cantidad"),
        *rows("metodos_pago", "metodos", "metodo_pago", "usos", "monto_total"),
        *rows("credito", "r_credito", "''", "cupo_promedio", "disponible_promedio", "cupo_usado_total", "total_lineas"),
        *rows("estados_ordenes", states, "estado", "cantidad"),
        *rows("inventario_por_vendedor", "inventario", "CAST(vendedor_id AS VARCHAR)", "num_productos", "precio_promedio", "valor_inventario"),
    ]
    return "\nUNION ALL ".join(parts)
