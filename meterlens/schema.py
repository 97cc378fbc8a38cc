"""Table schemas and the metric catalogue.

Fixed values of the data model live here: column names, device numbers, the
energy tariff, row limits, and which aggregate each metric uses in which mode.
The aggregate table is irregular on purpose; it is part of the required results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

POWER_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("no_device", T.IntegerType()),
        T.StructField("kva", T.DoubleType()),
        T.StructField("kw", T.DoubleType()),
        T.StructField("volt1", T.DoubleType()),
        T.StructField("volt2", T.DoubleType()),
        T.StructField("volt3", T.DoubleType()),
        T.StructField("amp1", T.DoubleType()),
        T.StructField("amp2", T.DoubleType()),
        T.StructField("amp3", T.DoubleType()),
        T.StructField("freq", T.DoubleType()),
        T.StructField("timestamp", T.TimestampNTZType()),
    ]
)

TEMP_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("no_device", T.IntegerType()),
        T.StructField("temp", T.DoubleType()),
        T.StructField("timestamp", T.TimestampNTZType()),
    ]
)

# Arrival time is an instant; a reading stores it as wall clock of the session zone.
MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)

# Fixed values.
TOPIC_PME5 = "PM/E5"
TOPIC_DEVICE_LIST = "toho"
DEFAULT_TARIFF = 1300
RAW_LIMIT = 250
MONTH_LIMIT = 12
SAMPLE_INTERVAL = "10 seconds"
POWER_DEVICES = (1, 2, 3)
TEMP_DEVICES = (1, 2)
COST_DEVICES = (1, 2)


# Default of ``limit`` arguments: the limit that a report usually has. ``None`` gives the
# complete result, a number that many of the newest rows.
USUAL = "usual"
Limit = int | None | str


def row_limit(limit: Limit, usual: int | None) -> int | None:
    """The number of rows that a ``limit`` argument stands for."""
    if limit == USUAL:
        return usual
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0):
        raise ValueError(f"limit must be a number of rows or None, got {limit!r}")
    return limit


@dataclass(frozen=True)
class Metric:
    """One measured quantity.

    ``live_name`` is the output column of the live series, ``live_device`` the
    device the live series is fixed to (None: all devices together).
    """

    table: str
    column: str
    live_name: str
    live_device: int | None = None
    phases: tuple[str, ...] = ()
    devices: tuple[int, ...] = POWER_DEVICES


METRICS: dict[str, Metric] = {
    "volt": Metric("power", "volt1", "volt", phases=("volt1", "volt2", "volt3")),
    "current": Metric("power", "amp1", "amp", phases=("amp1", "amp2", "amp3")),
    "watt": Metric("power", "kw", "value", live_device=1),
    "kva": Metric("power", "kva", "KVA"),
    "freq": Metric("power", "freq", "freq"),
    "temp": Metric("temp", "temp", "temp", devices=TEMP_DEVICES),
}

# Aggregate of the single-series report per metric and mode.
TOTAL_AGGREGATE: dict[str, dict[str, str]] = {
    "watt": {"range": "sum", "month": "sum", "year": "sum"},
    "kva": {"range": "sum", "month": "avg", "year": "avg"},
    "freq": {"range": "avg", "month": "avg", "year": "avg"},
    "temp": {"range": "avg", "month": "avg", "year": "avg"},
}

# Aggregate of the device comparison per metric (the same in range, month and year).
COMPARE_AGGREGATE: dict[str, str] = {
    "volt": "avg",
    "current": "avg",
    "watt": "sum",
    "kva": "sum",
    "freq": "sum",
    "temp": "sum",
}


def metric(name: str) -> Metric:
    try:
        return METRICS[name]
    except KeyError:
        raise ValueError(f"unknown metric {name!r}; expected one of {sorted(METRICS)}") from None


def device_number(device: int) -> int:
    """A device filter must be a real integer; text or a missing value is refused."""
    if isinstance(device, bool) or not isinstance(device, int):
        raise ValueError(f"device must be an integer, got {device!r}")
    return device
