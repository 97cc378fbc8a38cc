"""Newest raw readings: the top N of a day, and the top N per device."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlens.functions.buckets import bucket_label, second_of_day
from meterlens.plans.modes import Mode, in_window
from meterlens.schema import RAW_LIMIT

# The day in the path of a file.
DAY_FOLDER = re.compile(r"/dt=(\d{4}-\d{2}-\d{2})/")

# Rows of one device that a task of the first ranking step gets, about.
ROWS_PER_SLOT = 1_000_000


def _newest_first(df: DataFrame, order: str, columns: list[str]) -> list[Column]:
    if order == "label":
        keys = [second_of_day(F.col("timestamp"))]
    elif order == "latest":
        keys = [F.col("timestamp")]
    else:
        raise ValueError(f"order must be 'label' or 'latest', got {order!r}")
    if "id" in df.columns:
        keys.append(F.col("id"))
    # The values come last, so that the cut is the same even when ids repeat.
    return [key.desc() for key in keys + [F.col(c) for c in columns]]


def latest_raw(
    df: DataFrame, mode: Mode, columns: dict[str, str], n: int | None = RAW_LIMIT
) -> DataFrame:
    """The ``n`` newest readings of a one-day window (None: all), oldest first, as
    ``(timestamp 'HH:mm:ss', <aliases>)``. Each task keeps only its own ``n`` best rows."""
    window = in_window(df, mode)
    top = window
    if n is not None:
        top = window.orderBy(*_newest_first(window, "label", list(columns.values()))).limit(n)
    label = bucket_label(second_of_day(F.col("timestamp")), "second")
    return top.select(
        label.alias("timestamp"),
        *[F.col(column).cast("double").alias(name) for name, column in columns.items()],
    ).orderBy("timestamp")


def _since_cutoff(df: DataFrame, n: int, order: str) -> DataFrame:
    """Rows of each device from the newest hour of day (or day) on that leaves at least
    ``n`` rows, or all rows of a device that has fewer. For a few given devices only:
    the cutoffs, one row per device, are broadcast.

    Counting is one hash aggregation over two columns; it spares sorting the whole table
    for a few rows per device.
    """
    if order == "label":
        bucket = F.coalesce(F.hour("timestamp"), F.lit(-1))
    else:
        day = F.col("dt") if "dt" in df.columns else F.to_date("timestamp")
        bucket = F.coalesce(day, F.lit("0001-01-01").cast("date"))
    rows = df.withColumn("_bucket", bucket)
    newer = (
        Window.partitionBy("no_device")
        .orderBy(F.desc("_bucket"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    cutoff = (
        rows.groupBy("no_device", "_bucket")
        .count()
        .withColumn("_newer", F.coalesce(F.sum("count").over(newer), F.lit(0)))
        .where(F.col("_newer") < n)
        .groupBy(F.col("no_device").alias("_device"))
        .agg(F.min("_bucket").alias("_from"))
    )
    since = (F.col("no_device") == F.col("_device")) & (F.col("_bucket") >= F.col("_from"))
    return rows.join(F.broadcast(cutoff), since, "left_semi")


def _newest_days(df: DataFrame, n: int, devices: tuple[int, ...]) -> DataFrame | None:
    """Rows since the day from which on every device has at least ``n``. The days are walked from the
    newest on, twice as many at each step, so at most twice what is needed is counted, and all
    days only if some device has fewer rows. None if the folders of the table do not tell its days."""
    found = {DAY_FOLDER.search(path) for path in df.inputFiles()}
    days = sorted({m[1] for m in found if m}, reverse=True)
    if not days or None in found:
        return None
    step = 1
    while True:
        since = F.col("dt") >= F.lit(days[min(step, len(days)) - 1]).cast("date")
        if step >= len(days):
            return df
        counts = df.where(since).groupBy("no_device").count().collect()
        if sum(r["count"] >= n for r in counts) == len(set(devices)):
            return df.where(since)
        step *= 2


def latest_per_device(
    df: DataFrame,
    n: int | None = RAW_LIMIT,
    order: str = "label",
    columns: list[str] | None = None,
    devices: tuple[int, ...] | None = None,
) -> DataFrame:
    """The ``n`` top readings (None: all) of every device, or of the given ``devices``.

    ``order="label"`` ranks by time of day over all days, ``order="latest"`` by
    the full timestamp. A count per device and hour of day (or day) first leaves out
    the rows that cannot be among the top ``n``; it is one aggregation, and what it
    hands on is a row per device. With ``order="latest"`` on a table with days the newest
    days are counted at once, as many as it takes, and no others are read. The rest is ranked in two steps, whatever ``n`` is:
    within (device, slot of input partitions), then over the survivors of each device,
    so a device that holds most of the table is ranked by many tasks.
    """
    columns = columns or [c for c in df.columns if c not in ("id", "no_device", "timestamp", "dt")]
    keys = _newest_first(df, order, columns)
    kept = [c for c in ("id", "no_device", "timestamp") if c in df.columns] + columns
    day = ["dt"] if "dt" in df.columns and order == "latest" else []
    candidates = df.select(*kept, *day)
    if devices is not None:
        candidates = candidates.where(F.col("no_device").isin(*devices))
    if n is None:
        return candidates.drop("dt")
    if devices is not None:
        newest = _newest_days(candidates, n, devices) if day else None
        candidates = _since_cutoff(candidates, n, order) if newest is None else newest
    # About as many slots as the rows that n leaves over need; a row stays with its input task.
    slots = max(64, -(-n * 64 // ROWS_PER_SLOT))
    placed = candidates.select(*kept, (F.spark_partition_id() % slots).alias("_slot"))
    by_slot = Window.partitionBy("no_device", "_slot").orderBy(*keys)
    by_device = Window.partitionBy("no_device").orderBy(*keys)
    return (
        placed.withColumn("_rank", F.row_number().over(by_slot))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(by_device))
        .where(F.col("_rank") <= n)
        .drop("_slot", "_rank")
    )


def daily_tops(df: DataFrame, n: int = RAW_LIMIT) -> DataFrame:
    """The readings (with their ``dt``) that are among the top ``n`` of their device and day by time of
    day. On them :func:`latest_per_device` with ``order="label"`` and up to ``n``
    rows gives the same as on all readings, as do the comparisons of "today"; so they can be
    kept beside a table, by :func:`meterlens.plans.rollup.merge_rollup`, and are a small part of it.

    They are ranked in two steps like there: a device and day that holds most of the table is
    ranked by many tasks. Without ids, readings of one second are told apart by their values."""
    day = F.col("dt") if "dt" in df.columns else F.to_date("timestamp")
    values = [c for c in df.columns if c not in ("id", "no_device", "timestamp", "dt")]
    keys = _newest_first(df, "label", values)
    slots = max(64, -(-n * 64 // ROWS_PER_SLOT))
    placed = df.withColumn("dt", day).withColumn("_slot", F.spark_partition_id() % slots)
    by_slot = Window.partitionBy("no_device", "dt", "_slot").orderBy(*keys)
    by_day = Window.partitionBy("no_device", "dt").orderBy(*keys)
    return (
        placed.withColumn("_rank", F.row_number().over(by_slot))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(by_day))
        .where(F.col("_rank") <= n)
        .drop("_slot", "_rank")
    )
