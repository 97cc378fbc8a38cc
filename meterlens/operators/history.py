"""Merged history: six series of power and temperature on one time axis."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions.measures import measure
from meterlens.operators.series import bucketed
from meterlens.plans.modes import resolve_mode

# Output series and the power column each one is the maximum of, in display order.
HISTORY_SERIES = ("volt", "kva", "watt", "freq", "temp", "ampere")
HISTORY_POWER = {"freq": "freq", "kva": "kva", "volt": "volt1", "ampere": "amp1", "watt": "kw"}


def history(
    power: DataFrame,
    temp: DataFrame,
    start: date | None = None,
    end: date | None = None,
    as_of: date | None = None,
    nested: bool = False,
) -> DataFrame:
    """Long ``(series, date, time_label, value)``; time_label is NULL in range mode.

    Power buckets drive the axis: a temperature bucket without power readings is
    dropped, a power bucket without temperature has a NULL value. The join is of one row
    per bucket on either side. ``nested=True`` gives one row per series with its points in
    time order.
    """
    mode = resolve_mode(start, end, as_of)
    left = bucketed(
        power, mode, {name: measure(power, "max", col) for name, col in HISTORY_POWER.items()}
    )
    right = bucketed(temp, mode, {"temp": measure(temp, "avg", "temp")})
    if mode.kind == "range":
        merged = left.join(right, "date", "left").withColumn(
            "time_label", F.lit(None).cast("string")
        )
    else:
        merged = left.join(right.drop("date"), "time_label", "left")
    long = merged.unpivot(["date", "time_label"], list(HISTORY_SERIES), "series", "value")
    if not nested:
        return long.select("series", "date", "time_label", "value").orderBy(
            "date", "time_label", "series"
        )
    # One point per bucket of the window, so the collected lists are short.
    return long.groupBy("series").agg(
        F.sort_array(F.collect_list(F.struct("date", "time_label", "value"))).alias("points")
    )
