"""Devices side by side on one time axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlens.functions.buckets import bucket_key, bucket_label, second_of_day
from meterlens.functions.measures import measure
from meterlens.operators.latest import latest_per_device
from meterlens.operators.totals import mode_grain
from meterlens.plans.modes import Mode, in_window
from meterlens.schema import COMPARE_AGGREGATE, POWER_DEVICES, RAW_LIMIT, USUAL, Limit, row_limit
from meterlens.schema import metric as metric_of


# Default anchor: the first of the compared devices.
FIRST = "first"
Anchor = int | None | str


def _anchor(anchor: Anchor, devices: tuple[int, ...]) -> int | None:
    if anchor == FIRST:
        return devices[0]
    if anchor is not None and anchor not in devices:
        raise ValueError(f"anchor {anchor!r} is not one of the compared devices {devices}")
    return anchor


def _is_device(number: int) -> Column:
    return F.col("no_device") == number


def compare(
    df: DataFrame,
    column: str,
    agg: str,
    mode: Mode,
    devices: tuple[int, ...] = POWER_DEVICES,
    anchor: Anchor = FIRST,
    limit: Limit = USUAL,
    order: str = "label",
    grain: str | None = None,
) -> DataFrame:
    """``(timestamp, value1, value2, ...)`` with one value per device, gaps as 0.

    Buckets without a row of the ``anchor`` device (the first one, unless given) are
    dropped; ``anchor=None`` keeps every bucket. ``limit`` keeps only the newest buckets
    *of each device* before aligning, so a device whose buckets are older shows 0; usually
    there is none.

    All devices are aggregated in one pass over the table, not one scan per
    device followed by joins. Mode "today" without a ``grain`` aligns raw
    readings instead, see :func:`compare_latest`.
    """
    if mode.kind == "today" and grain is None:
        n = row_limit(limit, RAW_LIMIT)
        return compare_latest(df, column, devices, anchor, n, order)
    anchor, limit = _anchor(anchor, devices), row_limit(limit, None)
    grain = grain or mode_grain(mode)
    readings = in_window(df, mode).where(F.col("no_device").isin(*devices))
    key = bucket_key(F.col("timestamp"), grain).alias("bucket")
    if limit is None:
        values = [measure(df, agg, column, _is_device(k)) for k in devices]
        grouped = readings.groupBy(key)
    else:
        # Few rows from here on: one per device and bucket of the window.
        newest = Window.partitionBy("no_device").orderBy(F.col("bucket").desc())
        per_device = (
            readings.groupBy("no_device", key)
            .agg(measure(df, agg, column).alias("value"))
            .withColumn("_rank", F.row_number().over(newest))
            .where(F.col("_rank") <= limit)
        )
        values = [F.max(F.when(_is_device(k), F.col("value"))) for k in devices]
        grouped = per_device.groupBy("bucket")
    names = [f"value{i}" for i, _ in enumerate(devices, 1)]
    present = F.lit(True) if anchor is None else F.bool_or(_is_device(anchor))
    aligned = grouped.agg(
        *[F.coalesce(v, F.lit(0.0)).alias(n) for v, n in zip(values, names)],
        present.alias("_present"),
    )
    return (
        aligned.where("_present")
        .orderBy("bucket")
        .select(bucket_label(F.col("bucket"), grain).alias("timestamp"), *names)
    )


def compare_latest(
    df: DataFrame,
    column: str,
    devices: tuple[int, ...] = POWER_DEVICES,
    anchor: Anchor = FIRST,
    n: int | None = RAW_LIMIT,
    order: str = "label",
) -> DataFrame:
    """Align the top ``n`` raw readings (None: all) of each device on their label: the time
    of day, or with ``order="latest"`` the full time.

    Of several readings of a device with the same label the newest (by timestamp, then id)
    counts, so a label gives one row and a device at most ``n``.
    """
    anchor = _anchor(anchor, devices)
    top = latest_per_device(df, n, order, [column], devices)
    if order == "label":
        label = bucket_label(second_of_day(F.col("timestamp")), "second")
    else:
        label = F.date_trunc("second", "timestamp").cast("string")
    newest = F.struct("timestamp", *(["id"] if "id" in df.columns else []), column)
    by_label = top.groupBy(label.alias("label")).agg(
        *[
            F.max(F.when(_is_device(k), newest))[column].cast("double").alias(f"v{k}")
            for k in devices
        ],
        (F.lit(True) if anchor is None else F.bool_or(_is_device(anchor))).alias("_present"),
    )
    return (
        by_label.where("_present")
        .select(
            F.col("label").alias("timestamp"),
            *[F.coalesce(f"v{k}", F.lit(0.0)).alias(f"value{i}") for i, k in enumerate(devices, 1)],
        )
        .orderBy(F.col("timestamp").desc())
    )


def compare_metric(
    df: DataFrame,
    metric: str,
    mode: Mode,
    phase: int = 1,
    anchor: Anchor = FIRST,
    order: str = "label",
    limit: Limit = USUAL,
) -> DataFrame:
    """:func:`compare` with the column, aggregate, devices and limit of a metric.

    Phase metrics (volt, current) compare one ``phase`` over the devices and usually keep
    the newest 250 buckets per device in range mode.
    """
    m = metric_of(metric)
    column, usual = m.column, RAW_LIMIT if mode.kind == "today" else None
    if m.phases:
        if phase not in (1, 2, 3):
            raise ValueError(f"phase must be 1, 2 or 3, got {phase!r}")
        column = m.phases[phase - 1]
        usual = RAW_LIMIT if mode.kind in ("today", "range") else None
    limit = row_limit(limit, usual)
    return compare(
        df, column, COMPARE_AGGREGATE[metric], mode, m.devices, anchor, limit, order
    )
