"""Display texts: fallback names, label maps, money text, first-letter capital."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Plural labels of the roles and display class of the movement types.
ROLE_LABELS = {"comprador": "Compradores", "vendedor": "Vendedores", "admin": "Administradores"}
MOVEMENT_CLASSES = {"compra": "compra", "pago": "pago"}
MOVEMENT_CLASS_DEFAULT = "aumento"
SELLER_DEFAULT = "Usuario"


def label(c: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """Mapped text, or ``default`` (the raw value when not given)."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[c], c if default is None else default)


def product_name(name: Column, product_id: Column) -> Column:
    """Name, or a label with the id where the name is missing or empty."""
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Producto #"), product_id.cast("string")))


def capital_first(c: Column) -> Column:
    """Upper-case the first letter and leave the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2147483647))


def money_text(c: Column) -> Column:
    """Amount without decimals and with dots between thousands, half a unit rounded away from zero."""
    whole = F.round(F.coalesce(c, F.lit(0)).cast("decimal(30,2)"), 0)
    return F.concat(F.lit("$"), F.translate(F.format_number(whole, 0), ",", "."))


def text_key(c: Column, ci_ai: bool = False) -> Column:
    """Comparison key of a text: as it is, or without regard to case and accents."""
    return F.collate(c, "UNICODE_CI_AI") if ci_ai else c
