"""JSON messages to typed reading rows.

Both message kinds are decoded with column expressions only, so the same code
runs on a batch and on a stream, and a row never leaves the JVM. The JSON text is
parsed once, by ``parse_*``; the results can be sampled before decoding.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions.parsing import (
    bracketed_number,
    device_number_in,
    fraction_digits,
    fraction_digits_as_sent,
    reading_key,
)
from meterlens.schema import POWER_SCHEMA, TEMP_SCHEMA

# Only standard JSON is read; what does not fit the format is kept in _corrupt.
JSON_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}

# Message formats and the names in them.
PME5_FORMAT = "PME5 ARRAY<STRUCT<server_name STRING, name STRING, data STRING>>, _corrupt STRING"
PME5_METER = "PM2100"
PME5_TEMPERATURE = "E5CC"
PME5_READINGS = {
    "kva": "kVArh",
    "kw": "kWh",
    "volt1": "Voltage",
    "amp1": "Ampere",
    "freq": "Frequency",
}
DEVICE_LIST_FORMAT = (
    "data ARRAY<STRUCT<name STRING, values ARRAY<STRUCT<name STRING, raw_data STRING>>>>, "
    "_corrupt STRING"
)
DEVICE_LIST_POWER = "Power Meter"
DEVICE_LIST_TEMPERATURE = "Temperature"
DEVICE_LIST_READINGS = {
    "kva": "kva",
    "kw": "kw",
    "volt1": "v1",
    "volt2": "v2",
    "volt3": "v3",
    "amp1": "t_current",
    "amp2": "s_current",
    "amp3": "r_current",
    "freq": "frequency",
}


# Names of message columns that the reading rows shall have as well.
Keep = tuple[str, ...]


class Decoded(NamedTuple):
    power: DataFrame
    temp: DataFrame
    quarantine: DataFrame


def _compute(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row. As a generator it stays a step of its
    own; an ordinary column would be computed again in every filter pushed below it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _parse(messages: DataFrame, fmt: str) -> DataFrame:
    # A message is one object. The parser alone would accept the literal null, and text
    # after the object.
    text = F.btrim(F.col("payload"), F.lit(" \t\r\n"))
    parsed = F.when(
        text.startswith("{") & text.endswith("}"), F.from_json("payload", fmt, JSON_OPTIONS)
    )
    return _compute(messages, "message", parsed)


def _lookup(names: Column, values: Column, name: str) -> Column:
    """Value at the position of ``name``, NULL if absent."""
    return F.get(values, (F.array_position(names, name) - 1).cast("int"))


def _readable() -> Column:
    return F.col("message").isNotNull() & F.col("message._corrupt").isNull()


def _without(parsed: DataFrame, valid: Column) -> DataFrame:
    return parsed.where(~F.coalesce(valid, F.lit(False))).drop("message")


def _as_table(df: DataFrame, schema, columns: dict[str, Column], keep: Keep = ()) -> DataFrame:
    """Select the table's columns in order, then those to ``keep``; columns without an
    expression are NULL."""
    return df.select(
        *[
            columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ],
        *keep,
    )


def parse_pme5(messages: DataFrame) -> DataFrame:
    """Adds the parsed ``message`` column."""
    return _parse(messages, PME5_FORMAT)


def valid_pme5(parsed: DataFrame) -> DataFrame:
    return parsed.where(_readable())


def unreadable_pme5(parsed: DataFrame) -> DataFrame:
    return _without(parsed, _readable())


def pme5_power(parsed: DataFrame, skip_empty: bool = False, keep: Keep = ()) -> DataFrame:
    """One power row of device 1 per message; a missing reading is 0.

    A message without any reading still gives an all-zero row, unless
    ``skip_empty``. Phases 2 and 3 are not measured and stay NULL.
    """
    readings = F.coalesce(F.col("message.PME5"), F.array())
    if skip_empty:
        parsed = parsed.where(F.size(readings) > 0)
    meters = parsed.select(
        "seq",
        "ts",
        *keep,
        F.filter(readings, lambda r: r["server_name"] == PME5_METER).alias("meter"),
    ).select(
        "seq", "ts", *keep, F.col("meter.name").alias("names"), F.col("meter.data").alias("texts")
    )
    texts = meters.select(
        "seq",
        "ts",
        *keep,
        *[_lookup(F.col("names"), F.col("texts"), n).alias(c) for c, n in PME5_READINGS.items()],
    )
    columns = {c: bracketed_number(F.col(c)) for c in PME5_READINGS}
    columns |= {"id": F.col("seq"), "no_device": F.lit(1), "timestamp": F.col("ts")}
    return _as_table(texts, POWER_SCHEMA, columns, keep)


def pme5_temp(parsed: DataFrame, keep_zeros: bool = False, keep: Keep = ()) -> DataFrame:
    """One temperature row of device 1 per message whose controller reading has a fraction.

    The controller reports whole degrees behind the point: ``[0,26]`` is 26. By default
    the number is written without trailing zeros first, so ``[0.20]`` is 2;
    ``keep_zeros=True`` reads the digits as sent (20).
    """
    readings = F.coalesce(F.col("message.PME5"), F.array())
    text = _lookup(readings["server_name"], readings["data"], PME5_TEMPERATURE)
    if keep_zeros:
        temps = _compute(parsed, "digits", fraction_digits_as_sent(text))
    else:
        temps = _compute(parsed, "number", bracketed_number(text))
        temps = temps.withColumn("digits", fraction_digits(F.col("number")))
    columns = {
        "id": F.col("seq"),
        "no_device": F.lit(1),
        "temp": F.col("digits").try_cast("double"),
        "timestamp": F.col("ts"),
    }
    return _as_table(temps, TEMP_SCHEMA, columns, keep).where(F.col("temp").isNotNull())


def decode_pme5(
    messages: DataFrame, keep_zeros: bool = False, skip_empty: bool = False
) -> Decoded:
    """Power rows, temperature rows, and the messages that are not readable JSON."""
    parsed = parse_pme5(messages)
    valid = valid_pme5(parsed)
    return Decoded(
        pme5_power(valid, skip_empty), pme5_temp(valid, keep_zeros), unreadable_pme5(parsed)
    )


def _is_power(device: Column) -> Column:
    return device["name"].startswith(DEVICE_LIST_POWER)


def _is_temperature(device: Column) -> Column:
    return device["name"].startswith(DEVICE_LIST_TEMPERATURE)


def _complete_device_list() -> Column:
    """A message is taken whole or not at all: every device needs a name, every known
    device its value list, every power reading a name."""
    return F.forall(
        F.col("message.data"),
        lambda d: d["name"].isNotNull()
        & (
            ~(_is_power(d) | _is_temperature(d))
            | (_is_temperature(d) & d["values"].isNotNull())
            | F.coalesce(F.forall(d["values"], lambda v: v["name"].isNotNull()), F.lit(False))
        ),
    )


def parse_device_list(messages: DataFrame) -> DataFrame:
    """Adds the parsed ``message`` column."""
    return _parse(messages, DEVICE_LIST_FORMAT)


def valid_device_list(parsed: DataFrame) -> DataFrame:
    return parsed.where(_readable() & _complete_device_list())


def unreadable_device_list(parsed: DataFrame) -> DataFrame:
    return _without(parsed, _readable() & _complete_device_list())


def device_list_power(parsed: DataFrame, keep: Keep = ()) -> DataFrame:
    """One power row per power meter in a message; a missing reading is 0, and of
    readings with the same name the last one counts."""
    devices = parsed.select("seq", "ts", *keep, F.explode("message.data").alias("device"))
    # Reversed, so that the first match is the last reading of that name.
    values = F.reverse("device.values")
    meters = devices.where(_is_power(F.col("device"))).select(
        "seq",
        "ts",
        *keep,
        F.col("device.name").alias("name"),
        F.transform(values, lambda v: reading_key(v["name"])).alias("keys"),
        values["raw_data"].alias("data"),
    )
    columns = {
        c: F.coalesce(_lookup(F.col("keys"), F.col("data"), key).try_cast("double"), F.lit(0.0))
        for c, key in DEVICE_LIST_READINGS.items()
    }
    columns |= {
        "id": F.col("seq"),
        "no_device": device_number_in(F.col("name")),
        "timestamp": F.col("ts"),
    }
    return _as_table(meters, POWER_SCHEMA, columns, keep)


def device_list_temp(parsed: DataFrame, keep: Keep = ()) -> DataFrame:
    """One temperature row per value of every temperature controller in a message."""
    devices = parsed.select("seq", "ts", *keep, F.explode("message.data").alias("device"))
    values = devices.where(_is_temperature(F.col("device"))).select(
        "seq",
        "ts",
        *keep,
        F.col("device.name").alias("name"),
        F.explode("device.values").alias("value"),
    )
    columns = {
        "id": F.col("seq"),
        "no_device": device_number_in(F.col("name")),
        "temp": F.col("value.raw_data").try_cast("double"),
        "timestamp": F.col("ts"),
    }
    return _as_table(values, TEMP_SCHEMA, columns, keep)


def decode_device_list(messages: DataFrame) -> Decoded:
    """Power rows, temperature rows, and the messages that cannot be taken whole."""
    parsed = parse_device_list(messages)
    valid = valid_device_list(parsed)
    return Decoded(
        device_list_power(valid), device_list_temp(valid), unreadable_device_list(parsed)
    )
