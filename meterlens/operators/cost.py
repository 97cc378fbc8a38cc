"""Energy cost per hour, day or month, and energy of a custom range."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions.measures import measure
from meterlens.operators.compare import FIRST, Anchor, compare
from meterlens.operators.summary import device_measures
from meterlens.operators.totals import for_device, grouped_report
from meterlens.plans.modes import Mode, in_window, resolve_period
from meterlens.schema import COST_DEVICES, DEFAULT_TARIFF, RAW_LIMIT, USUAL, Limit, row_limit

COST_GRAIN = {"hour": "hour_span", "day": "day", "month": "month", "custom": "day"}


def cost_window(
    grain: str,
    as_of: date | None = None,
    start: date | None = None,
    end: date | None = None,
    same_year: bool = False,
) -> Mode:
    """Hours of today, days of this calendar month in any year (``same_year=True``: of
    this year only), months of this year, or days of a custom range."""
    if grain == "hour":
        return Mode.today(as_of)
    if grain == "day":
        return Mode.of_month(as_of) if same_year else Mode.month_of_any_year(as_of)
    if grain == "month":
        return Mode.of_year(as_of)
    if grain == "custom":
        if start is None or end is None:
            raise ValueError("a custom range requires start and end")
        return resolve_period(start=start, end=end)
    raise ValueError(f"unknown grain {grain!r}; expected one of {sorted(COST_GRAIN)}")


def _priced(kw_sum, grain: str, tariff: float | None):
    # A custom range reports energy, not cost. The price is linear, so it is
    # applied once per bucket instead of once per reading.
    if grain == "custom" or tariff is None:
        return kw_sum
    return kw_sum * F.lit(tariff) / F.lit(1000)


def _required_device(device: int | None) -> int:
    if device is None:
        raise ValueError("device is required")
    return device


def energy_cost(
    power: DataFrame,
    grain: str,
    as_of: date | None = None,
    device: int | None = None,
    start: date | None = None,
    end: date | None = None,
    tariff: float | None = DEFAULT_TARIFF,
    same_year: bool = False,
    limit: Limit = USUAL,
) -> DataFrame:
    """``(timestamp, value)``: cost of one device per bucket; a custom range gives the
    kw sums of its newest 250 days (``limit=None``: of all)."""
    device = _required_device(device)
    mode = cost_window(grain, as_of, start, end, same_year)
    value = _priced(measure(power, "sum", "kw"), grain, tariff)
    limit = row_limit(limit, RAW_LIMIT if grain == "custom" else None)
    return grouped_report(for_device(power, device), mode, COST_GRAIN[grain], {"value": value}, limit)


def energy_compare(
    power: DataFrame,
    grain: str,
    as_of: date | None = None,
    start: date | None = None,
    end: date | None = None,
    same_year: bool = False,
    anchor: Anchor = FIRST,
) -> DataFrame:
    """``(timestamp, value1, value2)``: kw sums of devices 1 and 2 per bucket, unpriced."""
    mode = cost_window(grain, as_of, start, end, same_year)
    return compare(power, "kw", "sum", mode, COST_DEVICES, anchor, grain=COST_GRAIN[grain])


def energy_total(
    power: DataFrame,
    grain: str,
    as_of: date | None = None,
    device: int | None = None,
    start: date | None = None,
    end: date | None = None,
    tariff: float | None = DEFAULT_TARIFF,
    same_year: bool = False,
) -> DataFrame:
    """Whole-window figure of one device: ``value1`` (cost), or ``total_kW, avg_kW`` for
    a custom range."""
    device = _required_device(device)
    mode = cost_window(grain, as_of, start, end, same_year)
    readings = in_window(for_device(power, device), mode)
    kw_sum = measure(power, "sum", "kw")
    if grain == "custom":
        return readings.agg(kw_sum.alias("total_kW"), measure(power, "avg", "kw").alias("avg_kW"))
    return readings.agg(_priced(kw_sum, grain, tariff).alias("value1"))


def energy_compare_total(
    power: DataFrame,
    grain: str,
    as_of: date | None = None,
    start: date | None = None,
    end: date | None = None,
    same_year: bool = False,
) -> DataFrame:
    """``(value1, value2)``: whole-window kw sums of devices 1 and 2, unpriced."""
    mode = cost_window(grain, as_of, start, end, same_year)
    return device_measures(power, mode, COST_DEVICES, {"value": "sum"}, "kw")
