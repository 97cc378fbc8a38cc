"""Column expressions that read numbers out of message text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the longest prefix of a text that is a decimal number.
NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def _without_first(text: Column, bracket: str) -> Column:
    # Anchored, so only the first occurrence can match.
    return F.regexp_replace(text, rf"^([^\{bracket}]*)\{bracket}", "$1")


def _number_text(text: Column) -> Column:
    """Numeric prefix of a bracketed reading such as ``[0,26]``; empty if there is none.

    A comma is a decimal point. Only the first could be part of the number, so all may
    be replaced.
    """
    bare = _without_first(_without_first(text, "["), "]")
    return F.regexp_extract(F.translate(bare, ",", "."), NUMBER_PREFIX, 1)


def bracketed_number(text: Column) -> Column:
    """``[0.214]`` or ``[0,26]`` as double. Missing or empty text is 0, text without a
    number (``[]``) is NULL."""
    number = _number_text(text).try_cast("double")
    return F.when(text.isNull() | (text == ""), F.lit(0.0)).otherwise(number)


def fraction_digits(number: Column) -> Column:
    """Digits after the decimal point of a number written without trailing zeros; empty
    if it is whole."""
    plain = number.cast("string")
    # Very small and large numbers print with an exponent; a decimal writes them out.
    exact = number.try_cast("decimal(38,18)").cast("string")
    written = F.when(plain.contains("E"), exact).otherwise(plain)
    return F.rtrim(F.split_part(written, F.lit("."), F.lit(2)), F.lit("0"))


def fraction_digits_as_sent(text: Column) -> Column:
    """Digits after the decimal point of a bracketed reading, trailing zeros included."""
    return F.regexp_extract(_number_text(text), r"\.(\d+)", 1)


def device_number_in(name: Column) -> Column:
    """First run of digits in a device name, NULL if there is none."""
    return F.regexp_extract(name, r"\d+", 0).try_cast("int")


def reading_key(name: Column) -> Column:
    """Reading name with its first space as ``_``, lower case."""
    at = F.instr(name, " ")
    return F.lower(F.when(at > 0, F.overlay(name, F.lit("_"), at)).otherwise(name))
