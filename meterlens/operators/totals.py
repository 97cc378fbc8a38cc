"""Bucketed reports of one series, and of the three phases side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions.buckets import bucket_key, bucket_label
from meterlens.functions.measures import measure
from meterlens.operators.latest import latest_raw
from meterlens.plans.modes import Mode, in_window
from meterlens.schema import (
    MONTH_LIMIT,
    RAW_LIMIT,
    TOTAL_AGGREGATE,
    USUAL,
    Limit,
    device_number,
    row_limit,
)
from meterlens.schema import metric as metric_of

MODE_GRAIN = {"range": "day", "month": "day", "year": "month", "month_any_year": "day"}


def mode_grain(mode: Mode) -> str:
    try:
        return MODE_GRAIN[mode.kind]
    except KeyError:
        raise ValueError(f"mode {mode.kind!r} has no bucket size") from None


def for_device(df: DataFrame, device: int | None) -> DataFrame:
    return df if device is None else df.where(F.col("no_device") == device_number(device))


def grouped_report(
    df: DataFrame, mode: Mode, grain: str, measures: dict, limit: int | None = None
) -> DataFrame:
    """Aggregate per bucket; with ``limit`` keep the newest buckets. Oldest first."""
    grouped = (
        in_window(df, mode)
        .groupBy(bucket_key(F.col("timestamp"), grain).alias("bucket"))
        .agg(*[column.alias(name) for name, column in measures.items()])
    )
    if limit is not None:
        grouped = grouped.orderBy(F.col("bucket").desc()).limit(limit)
    return grouped.orderBy("bucket").select(
        bucket_label(F.col("bucket"), grain).alias("timestamp"), *measures
    )


# Usual limits: a month has at most 31 day buckets, so none applies there.
USUAL_LIMIT = {"today": RAW_LIMIT, "range": RAW_LIMIT, "year": MONTH_LIMIT}


def phases(
    power: DataFrame, metric: str, mode: Mode, device: int | None = None, limit: Limit = USUAL
) -> DataFrame:
    """``(timestamp, value3, value2, value1)``: averages of the three phases per
    bucket, or the raw readings of today. ``limit``: the newest 250 readings or days, or
    12 months, unless given; None for all."""
    limit = row_limit(limit, USUAL_LIMIT.get(mode.kind))
    m = metric_of(metric)
    if not m.phases:
        raise ValueError(f"{metric!r} has no phases")
    power = for_device(power, device)
    columns = {f"value{k}": m.phases[k - 1] for k in (3, 2, 1)}
    if mode.kind == "today":
        return latest_raw(power, mode, columns, limit)
    averages = {name: measure(power, "avg", column) for name, column in columns.items()}
    return grouped_report(power, mode, mode_grain(mode), averages, limit)


def total(
    df: DataFrame, metric: str, mode: Mode, device: int | None = None, limit: Limit = USUAL
) -> DataFrame:
    """``(timestamp, value)``; kva per month of a year also carries ``year`` and ``month``.
    ``limit`` as for :func:`phases`."""
    limit = row_limit(limit, USUAL_LIMIT.get(mode.kind))
    m = metric_of(metric)
    if metric not in TOTAL_AGGREGATE:
        raise ValueError(f"{metric!r} is reported per phase; use phases()")
    df = for_device(df, device)
    if mode.kind == "today":
        return latest_raw(df, mode, {"value": m.column}, limit)
    value = {"value": measure(df, TOTAL_AGGREGATE[metric][mode.kind], m.column)}
    report = grouped_report(df, mode, mode_grain(mode), value, limit)
    if metric == "kva" and mode.kind == "year":
        report = report.select(
            F.substring("timestamp", 1, 4).cast("int").alias("year"),
            F.substring("timestamp", 6, 2).cast("int").alias("month"),
            "timestamp",
            "value",
        )
    return report
