"""Time buckets and their labels.

Grouping uses small integer or date keys; the text label is built from the keys
after the aggregation, once per bucket instead of once per row.
Field access (``hour``, ``to_date``) is used rather than ``date_format``, which
would first move a zone-less timestamp through the session time zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(ts: Column, tz: str | None = None) -> Column:
    """UTC wall clock moved to ``tz`` (a zone name or an offset such as ``+07:00``)."""
    return ts if tz is None else F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def _two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def hour_label(hour: Column) -> Column:
    return F.concat(_two_digits(hour), F.lit(":00:00"))


def hour_span_label(hour: Column) -> Column:
    return F.concat(_two_digits(hour), F.lit(":00-"), _two_digits(hour), F.lit(":59"))


def day_label(day: Column) -> Column:
    return day.cast("string")


def month_label(month_start: Column) -> Column:
    return F.substring(month_start.cast("string"), 1, 7)


def second_label(second_of_day: Column) -> Column:
    return F.concat_ws(
        ":",
        _two_digits(F.floor(second_of_day / 3600)),
        _two_digits(F.floor(second_of_day / 60) % 60),
        _two_digits(second_of_day % 60),
    )


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


@dataclass(frozen=True)
class Grain:
    """How one bucket size is keyed and labelled."""

    key: object
    label: object


GRAINS: dict[str, Grain] = {
    "second": Grain(second_of_day, second_label),
    "hour": Grain(F.hour, hour_label),
    "hour_span": Grain(F.hour, hour_span_label),
    "day": Grain(F.to_date, day_label),
    "month": Grain(lambda ts: F.trunc(F.to_date(ts), "month"), month_label),
}


def grain(name: str) -> Grain:
    try:
        return GRAINS[name]
    except KeyError:
        raise ValueError(f"unknown grain {name!r}; expected one of {sorted(GRAINS)}") from None


def bucket_key(ts: Column, grain_name: str, tz: str | None = None) -> Column:
    return grain(grain_name).key(local_time(ts, tz))


def bucket_label(key: Column, grain_name: str) -> Column:
    return grain(grain_name).label(key)


def bucket(ts: Column, grain_name: str, tz: str | None = None) -> Column:
    """Label of the bucket of ``ts``: ``HH:mm:ss``, ``HH:00:00``, ``HH:00-HH:59``,
    ``yyyy-MM-dd`` or ``yyyy-MM``."""
    return bucket_label(bucket_key(ts, grain_name, tz), grain_name)
