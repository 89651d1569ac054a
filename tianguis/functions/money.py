"""Exact money: DECIMAL inside a plan, DOUBLE only in the last projection."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def d2(c: ColumnOrName) -> Column:
    return _col(c).cast("decimal(12,2)")


def cents(c: ColumnOrName) -> Column:
    """Whole cents of a DECIMAL amount."""
    return (_col(c) * F.lit(100)).cast("bigint")


def from_cents(c: ColumnOrName) -> Column:
    return _col(c).cast("double") / F.lit(100.0)


def div(a: Column, b: Column) -> Column:
    """Integer division that truncates."""
    return F.call_function("div", a, b)


def div_half_up(a: Column, b: Column) -> Column:
    """Integer ``a / b`` rounded half away from zero; NULL where ``b`` is 0."""
    safe = F.nullif(b, F.lit(0))
    magnitude = div(F.lit(2) * F.abs(a) + safe, F.lit(2) * safe)
    return F.when(a < 0, -magnitude).otherwise(magnitude)


def total(amount: Column) -> Column:
    """Sum of a DECIMAL amount as DOUBLE, 0 over no rows."""
    return F.coalesce(F.sum(amount), F.lit(0)).cast("double")


def mean(amount: Column) -> Column:
    """Average of a DECIMAL(p,2) amount rounded to cents without a floating step, 0 over no rows."""
    whole = (F.sum(amount) * F.lit(100)).cast("decimal(30,0)")
    return F.coalesce(from_cents(div_half_up(whole, F.count(amount))), F.lit(0.0))


def as_double(c: ColumnOrName) -> Column:
    return _col(c).cast("double")
