"""Time windows of the reports, and the filter that applies them.

A window is kept as a half-open date range, so that it reaches the Parquet scan
as ``timestamp >= lo AND timestamp < hi`` and, on tables partitioned by ``dt``,
as a partition filter. ``year(timestamp) = y`` would do neither.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session_today() -> date:
    """Current date in the session time zone (plain local date without a session)."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return date.today()
    return spark.sql("SELECT current_date()").collect()[0][0]


@dataclass(frozen=True)
class Mode:
    """``lo`` inclusive, ``hi`` exclusive; ``month`` set only for any-year windows."""

    kind: str
    lo: date | None = None
    hi: date | None = None
    month: int | None = None

    @staticmethod
    def today(as_of: date | None = None) -> Mode:
        day = as_of or session_today()
        return Mode("today", day, day + timedelta(days=1))

    @staticmethod
    def day(day: date) -> Mode:
        return Mode("day", day, day + timedelta(days=1))

    @staticmethod
    def range(start: date, end: date) -> Mode:
        """Both ends inclusive."""
        return Mode("range", start, end + timedelta(days=1))

    @staticmethod
    def of_month(as_of: date | None = None) -> Mode:
        first = (as_of or session_today()).replace(day=1)
        return Mode("month", first, (first + timedelta(days=31)).replace(day=1))

    @staticmethod
    def of_year(as_of: date | None = None) -> Mode:
        first = (as_of or session_today()).replace(month=1, day=1)
        return Mode("year", first, first.replace(year=first.year + 1))

    @staticmethod
    def month_of_any_year(as_of: date | None = None) -> Mode:
        """The calendar month of ``as_of`` in every year; not a single range."""
        return Mode("month_any_year", month=(as_of or session_today()).month)


def resolve_mode(
    start: date | None = None, end: date | None = None, as_of: date | None = None
) -> Mode:
    """Nothing given: today; start: that day; start and end: the range; end alone: error."""
    if end is not None and start is None:
        raise ValueError("end requires start")
    if start is None:
        return Mode.today(as_of)
    if end is None:
        return Mode.day(start)
    return Mode.range(start, end)


def resolve_period(
    period: str | None = None,
    start: date | None = None,
    end: date | None = None,
    as_of: date | None = None,
) -> Mode:
    """Window of the bucketed reports: an end date decides first, then ``period``
    ("month" or "year"), else today. A start date alone has no effect here."""
    if end is not None:
        if start is None:
            raise ValueError("end requires start")
        return Mode.range(start, end)
    if period == "month":
        return Mode.of_month(as_of)
    if period == "year":
        return Mode.of_year(as_of)
    return Mode.today(as_of)


def in_window(df: DataFrame, mode: Mode, tz: str | None = None) -> DataFrame:
    """Rows whose ``timestamp`` (shifted to ``tz`` if given) lies in the window.

    The bounds are shifted back to UTC instead of shifting the column, so the
    filter stays a pushable comparison with constants.
    """
    has_dt = "dt" in df.columns
    ts = F.col("timestamp")
    if mode.kind == "month_any_year":
        local = ts if tz is None else F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)
        df = df.where(F.month(local) == mode.month)
        # A partition column may carry any deterministic filter, so whole days are skipped.
        return df.where(F.month("dt") == mode.month) if has_dt and tz is None else df

    def bound(day: date):
        local = F.lit(datetime(day.year, day.month, day.day)).cast("timestamp_ntz")
        return local if tz is None else F.convert_timezone(F.lit(tz), F.lit("UTC"), local)

    lo, hi = bound(mode.lo), bound(mode.hi)
    df = df.where((ts >= lo) & (ts < hi))
    if has_dt:
        last = hi - F.expr("INTERVAL 1 MICROSECOND")
        df = df.where(F.col("dt").between(F.to_date(lo), F.to_date(last)))
    return df
