"""Scalar expressions of the audit records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100 to one decimal, half to even; null for a whole of 0."""
    return F.bround(F.try_divide(part, whole) * 100, 1)


def qualified_name(table: Column | str, column: Column | str) -> Column:
    """table.column"""
    return F.concat(table if isinstance(table, Column) else F.lit(table), F.lit("."), column if isinstance(column, Column) else F.lit(column))


def status(orphans: Column) -> Column:
    """OK without orphans, else their number."""
    return F.when(orphans == 0, F.lit("OK")).otherwise(F.concat(orphans.cast("string"), F.lit(" orphans")))


def one_decimal(c: Column) -> Column:
    """A number with one decimal, as text: the decimal nearest to the double's exact value, ties to even; nan for null and NaN.

    Twenty times the value is summed without error (16 times and 4 times are exact), so that a value near a tie falls to its own side.
    """
    x = F.abs(c.cast("double"))
    a, b = x * 16, x * 4
    total = a + b
    back = total - a
    rest = (a - (total - back)) + (b - back)
    tenths = F.floor(total / 2)
    over = total - tenths * 2.0
    up = (over > 1) | ((over == 1) & ((rest > 0) | ((rest == 0) & (tenths % 2 == 1))))
    n = tenths + F.when(up, 1).otherwise(0)
    sign = F.when((c < 0) | F.startswith(c.cast("double").cast("string"), F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))
    return F.when(c.isNull() | F.isnan(c.cast("double")), F.lit("nan")).when(x == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(text)
