"""Live series: the maximum of one metric per hour of a day, or per day of a range."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions.buckets import bucket_key, bucket_label
from meterlens.functions.measures import measure
from meterlens.plans.modes import Mode, in_window, resolve_mode
from meterlens.plans.rollup import check_zone
from meterlens.schema import metric as metric_of


def time_grain(mode: Mode) -> str:
    return "day" if mode.kind == "range" else "hour"


def bucketed(df: DataFrame, mode: Mode, measures: dict, tz: str | None = None) -> DataFrame:
    """Aggregate a window per hour or day into ``(time_label, date, ...)`` or ``(date, ...)``.

    An hourly window covers exactly one day, so the date is a constant there and
    the hour alone is the grouping key.
    """
    grain = time_grain(mode)
    grouped = (
        in_window(df, mode, tz)
        .groupBy(bucket_key(F.col("timestamp"), grain, tz).alias("bucket"))
        .agg(*[column.alias(name) for name, column in measures.items()])
    )
    label = bucket_label(F.col("bucket"), grain)
    if grain == "day":
        keys = [label.alias("date")]
    else:
        keys = [label.alias("time_label"), F.lit(mode.lo.isoformat()).alias("date")]
    return grouped.select(*keys, *measures)


def series(
    df: DataFrame,
    metric: str,
    start: date | None = None,
    end: date | None = None,
    as_of: date | None = None,
    tz: str | None = None,
) -> DataFrame:
    """``(time_label, <metric>, date)`` for today or one day, ``(date, <metric>)`` for a range."""
    m = metric_of(metric)
    mode = resolve_mode(start, end, as_of)
    if m.live_device is not None:
        df = df.where(F.col("no_device") == m.live_device)
    check_zone(df, tz, mode)
    name = m.column if tz is not None else m.live_name
    result = bucketed(df, mode, {name: measure(df, "max", m.column)}, tz)
    return result.orderBy("date" if mode.kind == "range" else "time_label")
