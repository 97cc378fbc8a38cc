"""Hourly partial results, so that repeated reports do not rescan raw readings.

Every bucketed report (hour, day, month, year; max, sum and average) can be given
the rollup in place of the readings and returns the same result: sums and counts
add up, maxima combine, and an average is sum over count. The size of the rollup
depends on devices and hours only, not on how often a device reports. Reports of
raw readings (today's top 250) need the readings. A time-zone shift has to be a whole number of
slots, at every moment of the window: hours, or quarters of an hour, which all zones in use have.
Other shifts are refused.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.functions.measures import total_of
from meterlens.plans.modes import Mode
from meterlens.sources.scratch import scratch_dir
from meterlens.sources.tables import names_in, remove

KEYS = ("id", "no_device", "timestamp", "dt")
QUARTER = "quarter"


def hourly_rollup(readings: DataFrame) -> DataFrame:
    """``(no_device, timestamp, dt, <column>_sum, _count, _max ...)`` per device and hour;
    ``timestamp`` is the start of the hour."""
    return _rollup(readings, None)


def quarter_rollup(readings: DataFrame) -> DataFrame:
    """The same per device and quarter of an hour (``quarter`` 0 to 3), for reports in any zone."""
    return _rollup(readings, F.floor(F.minute("timestamp") / 15).cast("int"))


def _rollup(readings: DataFrame, quarter: Column | None) -> DataFrame:
    columns = [c for c in readings.columns if c not in KEYS]
    ts = F.col("timestamp")
    slot = [] if quarter is None else [quarter.alias(QUARTER)]
    grouped = readings.groupBy(
        "no_device", F.to_date(ts).alias("dt"), F.hour(ts).alias("_hour"), *slot
    ).agg(
        *[total_of(readings, c).alias(f"{c}_sum") for c in columns],
        *[F.count(c).alias(f"{c}_count") for c in columns],
        *[F.max(c).alias(f"{c}_max") for c in columns],
    )
    minutes = F.lit(0) if quarter is None else F.col(QUARTER) * 15
    start = F.make_dt_interval(hours=F.col("_hour"), mins=minutes)
    return grouped.withColumn("timestamp", F.col("dt").cast("timestamp_ntz") + start).drop("_hour")


def check_zone(df: DataFrame, tz: str | None, mode: Mode | None = None) -> None:
    """A rollup has whole slots of UTC, so it can be shifted by whole slots only. The shift is looked
    at for every hour of the window (of the years 1970 to 2069 for one without bounds)."""
    if tz is None or not any(c.endswith("_count") for c in df.columns):
        return
    bounded = mode is not None and mode.lo is not None and mode.hi is not None
    lo, hi = (mode.lo, mode.hi) if bounded else (date(1970, 1, 1), date(2070, 1, 1))
    hours = ((hi - lo).days + 2) * 24
    start = F.lit(str(lo - timedelta(days=1))).cast("timestamp_ntz")
    utc = start + F.make_dt_interval(hours=F.col("id").cast("int"))
    minute = F.minute(F.convert_timezone(F.lit("UTC"), F.lit(tz), utc))
    found = df.sparkSession.range(hours).select(minute.alias("m")).distinct().collect()
    slot = 15 if QUARTER in df.columns else 60
    if any(r["m"] % slot for r in found):
        raise ValueError(
            f"a rollup of {slot} minutes cannot be shifted to {tz}; use quarter_rollup or the readings"
        )


def merge_rollup(
    spark: SparkSession, readings: DataFrame, path: str, days: Iterable[date], make=hourly_rollup
) -> None:
    """Compute the given days from the readings anew and put them in the place of what the stored
    rollup has of them, also if nothing is left. Other days of their months are taken from the rollup,
    so no other readings are read. May be repeated."""
    days = sorted(set(days))
    if not days:
        return
    day = F.col("dt") if "dt" in readings.columns else F.to_date("timestamp")
    fresh = make(readings.where(day.isin(days)))
    months = sorted({f"{d:%Y-%m}" for d in days})
    there = set(names_in(spark, path, "month="))
    old = [f"{path}/month={m}" for m in months if m in there]
    if old:
        rest = spark.read.schema(fresh.schema).parquet(*old).select(fresh.columns)
        fresh = fresh.unionByName(rest.where(~F.col("dt").isin(days)))
    # Written aside first: a month is read and replaced.
    aside = scratch_dir(spark, "merged")
    fresh.write.parquet(aside)
    write_rollup(spark.read.schema(fresh.schema).parquet(aside), path)
    left = {f"{r['m']}" for r in spark.read.schema(fresh.schema).parquet(aside).select(
        F.substring(F.col("dt").cast("string"), 1, 7).alias("m")
    ).distinct().collect()}
    remove(spark, [aside, *[f"{path}/month={m}" for m in months if m in there and m not in left]])


def refresh_rollup(readings: DataFrame, path: str, days: Iterable[date]) -> None:
    """Compute the months of the given days from the readings and replace them as a whole;
    other months stay."""
    months = sorted({d.replace(day=1) for d in days})
    if months:
        day = F.col("dt") if "dt" in readings.columns else F.to_date("timestamp")
        write_rollup(hourly_rollup(readings.where(F.trunc(day, "month").isin(months))), path)


def write_rollup(rollup: DataFrame, path: str) -> None:
    """Replace the months present in ``rollup``, which has to hold them whole, and keep the
    others. See :func:`refresh_rollup` for parts. A day has few rows, so a file holds a month."""
    (
        rollup.withColumn("month", F.substring(F.col("dt").cast("string"), 1, 7))
        .hint("rebalance", F.col("month"))
        .sortWithinPartitions("month", "dt", "no_device")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(path)
    )


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("month")
