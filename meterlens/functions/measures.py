"""Aggregate expressions that work on raw readings and on the hourly rollup alike."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_rollup(df: DataFrame, column: str) -> bool:
    return f"{column}_count" in df.columns


#: Doubles are summed as whole numbers and parts of one over 10 to the power of this.
DIGITS = 9


def exact_sum(value: Column) -> Column:
    """Sum of a column of doubles that does not depend on the order of the rows, and is that of their
    decimal numbers: whole numbers and their parts, of nine digits, are summed as integers, and
    joined as one decimal. With values that are no numbers, are too large for this, or sum up to more
    than integers hold, it is the ordinary sum."""
    fits = F.abs(value) < 2.0**53
    whole = F.when(fits, F.floor(value))
    parts = F.when(fits, F.round((value - whole.cast("double")) * 10.0**DIGITS).cast("long"))
    wholes, rest = (F.try_sum(x).cast("decimal(28,0)") for x in (whole, parts))
    total = (wholes + rest * F.lit(Decimal(1).scaleb(-DIGITS))).cast("double")
    plain = F.count(F.when(~fits, 1)) > 0
    return F.when(plain, F.sum(value)).otherwise(F.coalesce(total, F.sum(value)))


def total_of(df: DataFrame, column: str, value: Column | None = None) -> Column:
    """Sum of a column of the table, or of ``value`` made of it; the same for any order of rows."""
    value = F.col(column) if value is None else value
    kind = df.schema[column].dataType
    return exact_sum(value) if isinstance(kind, T.DoubleType) else F.sum(value)


def measure(df: DataFrame, kind: str, column: str, where: Column | None = None) -> Column:
    """``max``, ``sum`` or ``avg`` of ``column`` as double, optionally over the rows
    matching ``where`` only.

    On a rollup the stored partial results are combined. The average is sum over
    count, so that it is the same number from either source.
    """

    def pick(name: str) -> Column:
        return F.col(name) if where is None else F.when(where, F.col(name))

    rollup = is_rollup(df, column)
    if kind == "max":
        return F.max(pick(f"{column}_max" if rollup else column)).cast("double")
    summed = f"{column}_sum" if rollup else column
    total = total_of(df, summed, pick(summed)).cast("double")
    if kind == "sum":
        return total
    if kind == "avg":
        count = F.sum(pick(f"{column}_count")) if rollup else F.count(pick(column))
        return F.try_divide(total, count)
    raise ValueError(f"unknown aggregate {kind!r}")
