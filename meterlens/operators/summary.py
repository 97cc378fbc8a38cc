"""Totals and averages of a whole window in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlens.functions.buckets import bucket_key, bucket_label
from meterlens.functions.measures import measure
from meterlens.operators.totals import USUAL_LIMIT, for_device, mode_grain
from meterlens.plans.modes import Mode, in_window
from meterlens.schema import POWER_DEVICES, USUAL, Limit, row_limit


def device_measures(
    df: DataFrame, mode: Mode, devices: tuple[int, ...], measures: dict[str, str], column: str
) -> DataFrame:
    """One row with ``<prefix>1, <prefix>2, ...`` per device, for every prefix and aggregate
    in ``measures``. One scan; a device without readings has NULL, not 0."""
    readings = in_window(df, mode).where(F.col("no_device").isin(*devices))
    return readings.agg(
        *[
            measure(df, kind, column, F.col("no_device") == k).alias(f"{prefix}{i}")
            for prefix, kind in measures.items()
            for i, k in enumerate(devices, 1)
        ]
    )


def summary(
    power: DataFrame,
    mode: Mode,
    devices: tuple[int, ...] | None = None,
    device: int | None = None,
    arrays: bool = False,
) -> DataFrame:
    """Total and average kw of the window.

    With ``devices``: ``total1..n, average1..n``, one per device. Without: the
    total over all readings, or of one ``device``, as ``total1, average1``.
    ``arrays=True`` packs them into two array columns of at least three entries.
    """
    if devices is None:
        readings = in_window(for_device(power, device), mode)
        row = readings.agg(
            measure(power, "sum", "kw").alias("total1"),
            measure(power, "avg", "kw").alias("average1"),
        )
        width = 1
    else:
        row = device_measures(power, mode, devices, {"total": "sum", "average": "avg"}, "kw")
        width = len(devices)
    if not arrays:
        return row
    padding = [F.lit(None).cast("double")] * (3 - width)
    return row.select(
        *[
            F.array(*[F.col(f"{name}{i}") for i in range(1, width + 1)], *padding).alias(name)
            for name in ("total", "average")
        ]
    )


def series_and_summary(
    power: DataFrame, mode: Mode, device: int | None = None, limit: Limit = USUAL
) -> DataFrame:
    """``(kind, timestamp, value, average)``: the kw total and average of every bucket (kind
    "series") and of the whole window (kind "summary", no timestamp), from one scan.

    ``limit`` keeps the newest 250 days or 12 months of the series unless given; the summary
    always covers the window."""
    grain, limit = mode_grain(mode), row_limit(limit, USUAL_LIMIT.get(mode.kind))
    rows = (
        in_window(for_device(power, device), mode)
        .withColumn("bucket", bucket_key(F.col("timestamp"), grain))
        .rollup("bucket")
        .agg(
            measure(power, "sum", "kw").alias("value"),
            measure(power, "avg", "kw").alias("average"),
            F.grouping("bucket").alias("whole"),
        )
    )
    if limit is not None:
        # One row per bucket by now.
        newest = Window.partitionBy("whole").orderBy(F.col("bucket").desc())
        rows = rows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= limit)
    return rows.orderBy("whole", "bucket").select(
        F.when(F.col("whole") == 1, "summary").otherwise("series").alias("kind"),
        bucket_label(F.col("bucket"), grain).alias("timestamp"),
        "value",
        "average",
    )


def dashboard(power: DataFrame, as_of=None) -> DataFrame:
    """Today's kw total of devices 1 to 3 as ``value1..value3``."""
    return device_measures(power, Mode.today(as_of), POWER_DEVICES, {"value": "sum"}, "kw")
