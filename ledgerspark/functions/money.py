"""Money and small column helpers. Money is DECIMAL(18,2): sums are exact and don't depend on order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(value: Column) -> Column:
    return value.cast(MONEY)


def round2(value: Column) -> Column:
    """To cents as a double; a tie goes up, also below zero (floor(x * 100 + 0.5) / 100)."""
    return F.floor(value.cast("double") * 100 + 0.5) / 100


def ratio2(total: Column, count: Column) -> Column:
    """round2(total / count) without a binary fraction in between: whole cents over a whole number."""
    cents = (total * 100).cast("long")
    return F.floor((2 * cents + count) / (2 * count)) / 100


def amount_when(condition: Column, amount: Column) -> Column:
    """Exact sum of the amounts where the condition holds, 0 without any, as a double."""
    return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0)).cast("double")


def count_when(condition: Column) -> Column:
    return F.count(F.when(condition, 1)).cast("long")
