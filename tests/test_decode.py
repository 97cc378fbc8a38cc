from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meterlens import decode_device_list, decode_pme5
from meterlens.functions.parsing import device_number_in, reading_key
from meterlens.schema import MESSAGE_SCHEMA, POWER_SCHEMA, TEMP_SCHEMA

AT = datetime(2024, 1, 1, 12)

# text sent, number, temperature
NUMBERS = [
    ("[0.214]", 0.214, 214.0),
    ("[0,26]", 0.26, 26.0),
    ("[0.260]", 0.26, 26.0),
    ("[0.20]", 0.2, 2.0),
    ("[25]", 25.0, None),
    ("[25.0]", 25.0, None),
    ("[1,234.5]", 1.234, 234.0),
    ("[12abc]", 12.0, None),
    ("[-3.5]", -3.5, 5.0),
    ("[]", None, None),
    ("", 0.0, None),
    (None, 0.0, None),
    ("[0.0004]", 0.0004, 4.0),
    ("[12345678.25]", 12345678.25, 25.0),
    (" [ 7.5 ]", 7.5, 5.0),
    ("[.5]", 0.5, 5.0),
    ("[[5]]", None, None),
    ("[1.5e2]", 150.0, None),
]


def pme5(*readings) -> str:
    return json.dumps(
        {"PME5": [dict(zip(("server_name", "name", "data"), r)) for r in readings]}
    )


def messages(spark, payloads):
    rows = [("t", p, AT, i) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, MESSAGE_SCHEMA)


def test_numbers_and_temperatures(spark):
    payloads = [
        pme5(("PM2100", "Voltage", text), ("E5CC", "Temperature", text)) for text, _, _ in NUMBERS
    ]
    decoded = decode_pme5(messages(spark, payloads))
    volts = {r.id: r.volt1 for r in decoded.power.collect()}
    temps = {r.id: r.temp for r in decoded.temp.collect()}
    assert volts == {i: number for i, (_, number, _) in enumerate(NUMBERS)}
    assert temps == {i: t for i, (_, _, t) in enumerate(NUMBERS) if t is not None}
    assert decoded.quarantine.count() == 0
    for df, schema in ((decoded.power, POWER_SCHEMA), (decoded.temp, TEMP_SCHEMA)):
        assert df.dtypes == [(f.name, f.dataType.simpleString()) for f in schema]


def test_keep_zeros(spark):
    payloads = [pme5(("E5CC", "T", text)) for text in ("[0.20]", "[0,260]", "[25]", "[]")]
    kept = decode_pme5(messages(spark, payloads), keep_zeros=True).temp
    assert {r.id: r.temp for r in kept.collect()} == {0: 20.0, 1: 260.0}


def test_pme5_readings_are_picked_by_server_and_first_name(spark):
    payload = pme5(
        ("E5CC", "Voltage", "[1]"),
        ("PM2100", "Voltage", "[2]"),
        ("PM2100", "Voltage", "[3]"),
        ("PM2100", "kWh", "[4]"),
        ("PM2100", "kVArh", "[5]"),
        ("PM2100", "PowerFactor", "[6]"),
        ("PM2100", "Frequency", "[7]"),
        ("PM2100", "Ampere", None),
    )
    (row,) = decode_pme5(messages(spark, [payload])).power.collect()
    assert (row.no_device, row.volt1, row.kw, row.kva, row.freq, row.amp1) == (1, 2, 4, 5, 7, 0)
    assert (row.volt2, row.volt3, row.amp2, row.amp3) == (None, None, None, None)
    assert row.timestamp == AT


def test_pme5_without_readings(spark):
    payloads = ["{}", ' {"PME5":[]}\r\n', '{"PME5":null}', '{"PME5":[{"server_name":"PM2100"}]}']
    source = messages(spark, payloads)
    assert [r.volt1 for r in decode_pme5(source).power.collect()] == [0.0] * 4
    assert [r.id for r in decode_pme5(source, skip_empty=True).power.collect()] == [3]
    assert decode_pme5(source).temp.count() == 0


@pytest.mark.parametrize(
    "payload",
    [
        '{"PME5":[',
        "",
        "not json",
        "null",
        " null\n",
        None,
        '{"PME5":"x"}',
        "{'PME5':[]}",
        '{"PME5":[]} x',
        "[]",
        "7",
    ],
)
def test_pme5_unreadable(spark, payload):
    decoded = decode_pme5(messages(spark, [payload, "{}"]))
    assert [r.seq for r in decoded.quarantine.collect()] == [0]
    assert [r.id for r in decoded.power.collect()] == [1]


def device(name, *values):
    return {"name": name, "values": [{"name": n, "raw_data": v} for n, v in values]}


def test_device_list(spark):
    payload = json.dumps(
        {
            "data": [
                device(
                    "Power Meter 12 (hall 3)",
                    ("KVA", 1.5),
                    ("KW", 1),
                    ("kw", "2.5"),
                    ("V1", 220),
                    ("T Current", 5.1),
                    ("S Current", 5.2),
                    ("R Current", None),
                    ("Freq", 50),
                ),
                device("Power Meter", ("V3", 219)),
                device("Temperature Controller", ("Temperature 1", 35.2), ("Temperature 2", None)),
                device("Temperature 7", ("x", "36")),
                device("Gateway", ("KW", 99)),
            ]
        }
    )
    decoded = decode_device_list(messages(spark, [payload]))
    first, second = decoded.power.collect()
    assert (first.no_device, first.kva, first.kw, first.volt1) == (12, 1.5, 2.5, 220.0)
    assert (first.amp1, first.amp2, first.amp3, first.freq) == (5.1, 5.2, 0.0, 0.0)
    assert (second.no_device, second.volt3, second.kw) == (None, 219.0, 0.0)
    temps = sorted(((r.no_device, r.temp) for r in decoded.temp.collect()), key=str)
    assert temps == [(7, 36.0), (None, 35.2), (None, None)]


def test_device_list_is_taken_whole_or_not_at_all(spark):
    good = device("Power Meter 1", ("KW", 1))
    payloads = [
        json.dumps({"data": [good]}),
        json.dumps({"data": []}),
        json.dumps({"data": [good, {"values": []}]}),
        json.dumps({"data": [good, {"name": "Temperature 1"}]}),
        json.dumps({"data": [good, {"name": "Gateway"}]}),
        json.dumps({"data": [good, device("Power Meter 2", (None, 1))]}),
        json.dumps({"data": [good, device("Temperature 2", (None, 1))]}),
        "{}",
        "null",
    ]
    decoded = decode_device_list(messages(spark, payloads))
    assert sorted(r.id for r in decoded.power.collect()) == [0, 4, 6]
    assert [r.id for r in decoded.temp.collect()] == [6]
    assert sorted(r.seq for r in decoded.quarantine.collect()) == [2, 3, 5, 7, 8]


def test_names(spark):
    names = spark.createDataFrame(
        [("T Current",), ("a b c",), ("KW",), ("Power Meter 3 of 9",)], "name string"
    )
    rows = names.select(reading_key(F.col("name")), device_number_in(F.col("name"))).collect()
    assert [tuple(r) for r in rows] == [
        ("t_current", None),
        ("a_b c", None),
        ("kw", None),
        ("power_meter 3 of 9", 3),
    ]


def test_json_is_parsed_once(spark):
    for decoded in (decode_pme5(messages(spark, ["{}"])), decode_device_list(messages(spark, ["{}"]))):
        for df in (decoded.power, decoded.temp):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("from_json(") == 1
