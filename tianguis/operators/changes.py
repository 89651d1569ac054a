"""Change logs applied to base tables. Last writers are found by combinable maxima, not by windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tianguis.functions.domain import in_domain
from tianguis.functions.text import text_key
from tianguis.session import stored

# Texts of refusals.
NOT_OWNER = "No autorizado"
NOT_FOUND = "No encontrado"
EMAIL_TAKEN = "El email ya está registrado"
BAD_STATE = "Estado no válido"
USER_UNKNOWN = "Usuario no encontrado"
# Texts of our own, for entries that would otherwise vanish.
NO_EMAIL = "Email requerido"
BAD_KIND = "Tipo de cambio no válido"
ALREADY_PUBLISHED = "El producto ya existe"

PUBLISH, EDIT, DEACTIVATE, APPROVE = "publicar", "editar", "desactivar", "aprobar"


@dataclass(frozen=True)
class Applied:
    """The table after the log, and the refused entries with their reason."""

    table: DataFrame
    rejects: DataFrame


def apply_product_changes(productos: DataFrame, changes: DataFrame, order: Sequence[str]) -> Applied:
    """Publish, edit, deactivate and approve in the order of the log.

    ``changes``: id_producto, tipo, id_vendedor (who asks), rol, nombre, descripcion, precio, cantidad and
    the ``order`` columns. Only the owner edits or deactivates; a product published by a seller is approved.
    The owner never changes, so every entry is judged by its product's row alone, and the accepted ones are then reduced to
    one row per product.
    """
    o = F.struct(*order)
    log = changes.withColumn("o", o)
    owner = F.col("id_vendedor") == F.col("dueno")
    base = productos.select("id", F.col("id_vendedor").alias("dueno"), F.lit(None).cast(log.schema["o"].dataType).alias("desde"))

    published = (
        log.filter((F.col("tipo") == PUBLISH) & F.col("id_producto").isNotNull())
        .groupBy(F.col("id_producto").alias("id"))
        .agg(F.min(F.struct("o", "id_vendedor", "rol", "nombre", "descripcion", "precio", "cantidad")).alias("p"))
        .join(productos.select("id"), "id", "left_anti")
    )
    known = base.unionByName(published.select("id", F.col("p.id_vendedor").alias("dueno"), F.col("p.o").alias("desde")))

    # The place in the log is put together again after the join, so that the entries do not carry it twice. The judged entries
    # are written once: the refused ones are the rejects, the others make the table.
    judged = changes.filter(~F.col("tipo").eqNullSafe(PUBLISH)).join(known, F.col("id_producto") == F.col("id"), "left").withColumn("o", o)
    missing = F.col("id").isNull() | (F.col("desde").isNotNull() & (F.col("o") <= F.col("desde")))
    why = (
        F.when(F.col("tipo").isin(EDIT, DEACTIVATE) & (missing | ~owner), NOT_OWNER).when(missing, NOT_FOUND)
    )
    kinds = F.coalesce(F.col("tipo").isin(PUBLISH, EDIT, DEACTIVATE, APPROVE), F.lit(False))
    why = F.when(~kinds, BAD_KIND).otherwise(why)
    counts = ~missing & ((F.col("tipo") == APPROVE) | owner)
    judged = stored(judged.select(*changes.columns, why.alias("motivo"), F.coalesce(counts, F.lit(False)).alias("_vale")))
    rejects = judged.filter(F.col("motivo").isNotNull())

    fields = F.struct("o", "nombre", "descripcion", "precio", "cantidad")

    def latest(kind: str, what):
        return F.max(F.when(F.col("tipo") == kind, what))

    effects = (
        judged.filter(F.col("_vale") & F.col("motivo").isNull())
        .withColumn("o", o)
        .groupBy(F.col("id_producto").alias("id"))
        .agg(
            latest(EDIT, fields).alias("edit"),
            latest(DEACTIVATE, F.lit(True)).isNotNull().alias("off"),
            latest(APPROVE, F.lit(True)).isNotNull().alias("yes"),
        )
    )
    new = published.select(
        "id", "p.id_vendedor", "p.nombre", "p.descripcion", "p.precio", "p.cantidad",
        F.lit(True).alias("activo"), (F.col("p.rol") == "vendedor").alias("aprobado"),
    )
    columns = ["id", "id_vendedor", "nombre", "descripcion", "precio", "cantidad", "activo", "aprobado"]

    def edited(name: str):
        return F.when(F.col("edit").isNotNull(), F.col(f"edit.{name}")).otherwise(F.col(name)).alias(name)

    table = (
        productos.select(*columns)
        .unionByName(new.select(*columns))
        .join(effects, "id", "left")
        .select(
            "id", "id_vendedor", *[edited(c) for c in ("nombre", "descripcion", "precio", "cantidad")],
            (F.col("activo") & ~F.coalesce("off", F.lit(False))).alias("activo"),
            (F.col("aprobado") | F.coalesce("yes", F.lit(False))).alias("aprobado"),
        )
    )
    # Of several publications of a product the first counts, and none if the catalog has it.
    again = (
        log.filter(F.col("tipo") == PUBLISH)
        .join(published.select(F.col("id").alias("id_producto"), F.col("p.o").alias("primera")), "id_producto", "left")
        .filter(F.col("primera").isNull() | (F.col("o") != F.col("primera")))
        .withColumn("motivo", F.lit(ALREADY_PUBLISHED))
    )
    columns = [*changes.columns, "motivo"]
    return Applied(table, rejects.select(*columns).unionByName(again.select(*columns)))


def register_users(usuarios: DataFrame, requests: DataFrame, order: Sequence[str], ci_ai: bool = False) -> Applied:
    """New users: the first request per free email wins; a seller waits for approval.

    ``requests``: nombre, email, rol and the ``order`` columns. ``ci_ai`` compares emails without regard to
    case and accents.
    """
    asked = requests.withColumn("clave", text_key(F.col("email"), ci_ai))
    taken = usuarios.select(text_key(F.col("email"), ci_ai).alias("clave")).distinct()
    first = asked.filter(F.col("clave").isNotNull()).groupBy("clave").agg(F.min(F.struct(F.struct(*order).alias("o"), "nombre", "email", "rol")).alias("r"))
    winners = first.join(taken, "clave", "left_anti")
    table = winners.select(
        "r.nombre", "r.email",
        F.coalesce("r.rol", F.lit("comprador")).alias("rol"),
        F.when(F.col("r.rol") == "vendedor", "pendiente").otherwise("activo").alias("estado"),
        *[F.col(f"r.o.{c}").alias(c) for c in order],
    )
    # A request loses when its email was free but another came first, or was never free.
    rejects = (
        asked.join(winners.select("clave", F.col("r.o").alias("ganador")), "clave", "left")
        .filter(F.col("ganador").isNull() | (F.struct(*order) != F.col("ganador")))
        .select(*requests.columns, F.when(F.col("clave").isNull(), NO_EMAIL).otherwise(EMAIL_TAKEN).alias("motivo"))
    )
    return Applied(table, rejects)


SET_STATE, DELETE = "estado", "eliminar"


def apply_user_changes(usuarios: DataFrame, changes: DataFrame, order: Sequence[str]) -> Applied:
    """State changes and deletions in the order of the log.

    ``changes``: usuario_id, tipo (estado, eliminar), estado and the ``order`` columns. A deleted user is gone
    for every later entry.
    """
    log = changes.withColumn("o", F.struct(*order))
    state = F.coalesce(in_domain(F.col("estado"), "usuarios", "estado"), F.lit(False))
    kind = F.coalesce(F.col("tipo").isin(SET_STATE, DELETE), F.lit(False))
    valid = kind & ((F.col("tipo") == DELETE) | state)
    effects = (
        log.filter(valid)
        .groupBy(F.col("usuario_id").alias("id"))
        .agg(
            F.min(F.when(F.col("tipo") == DELETE, F.col("o"))).alias("baja"),
            F.max(F.when(F.col("tipo") == SET_STATE, F.struct("o", "estado"))).alias("ultimo"),
        )
    )
    table = (
        usuarios.join(effects, "id", "left")
        .filter(F.col("baja").isNull())
        .withColumn("estado", F.coalesce("ultimo.estado", "estado"))
        .select(*usuarios.columns)
    )
    users = usuarios.select("id").join(effects.select("id", "baja"), "id", "left")
    why = F.when(~kind, BAD_KIND).when(~valid, BAD_STATE).when(
        F.col("id").isNull() | (F.col("baja").isNotNull() & (F.col("o") > F.col("baja"))), USER_UNKNOWN
    )
    rejects = log.join(users, F.col("usuario_id") == F.col("id"), "left").withColumn("motivo", why)
    return Applied(table, rejects.filter(F.col("motivo").isNotNull()).select(*changes.columns, "motivo"))


def cascade(children: DataFrame, on: str, remaining: DataFrame, key: str = "id") -> DataFrame:
    """Child rows whose parent is still there."""
    return children.join(remaining.select(F.col(key).alias(on)), on, "left_semi")
