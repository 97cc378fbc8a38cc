from __future__ import annotations

from datetime import date, datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meterlens import Mode, bucket, in_window, resolve_mode, resolve_period
from meterlens.schema import TEMP_SCHEMA
from meterlens.sources.tables import read_table, table_path, write_readings

D1, D2 = date(2024, 1, 5), date(2024, 1, 7)


def test_resolve_mode():
    assert resolve_mode(as_of=D1) == Mode("today", D1, date(2024, 1, 6))
    assert resolve_mode(D1) == Mode("day", D1, date(2024, 1, 6))
    assert resolve_mode(D1, D2) == Mode("range", D1, date(2024, 1, 8))
    with pytest.raises(ValueError):
        resolve_mode(None, D2)


def test_resolve_period():
    assert resolve_period("month", D1, D2) == Mode.range(D1, D2)
    assert resolve_period("month", as_of=date(2024, 12, 31)) == Mode(
        "month", date(2024, 12, 1), date(2025, 1, 1)
    )
    assert resolve_period("year", D1, as_of=D2) == Mode("year", date(2024, 1, 1), date(2025, 1, 1))
    assert resolve_period(start=D1, as_of=D2) == Mode.today(D2)
    with pytest.raises(ValueError):
        resolve_period(end=D2)


@pytest.fixture(scope="module")
def readings(spark):
    start = datetime(2023, 1, 30, 22, 30)
    rows = [(i, 1, float(i), start + timedelta(hours=7 * i)) for i in range(1500)]
    return spark.createDataFrame(rows, TEMP_SCHEMA).coalesce(1).cache()


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize(
    "mode, plain",
    [
        (Mode.day(date(2023, 3, 4)), "to_date(timestamp) = DATE'2023-03-04'"),
        (
            Mode.range(date(2023, 3, 4), date(2023, 3, 9)),
            "to_date(timestamp) BETWEEN DATE'2023-03-04' AND DATE'2023-03-09'",
        ),
        (Mode.of_month(date(2023, 12, 9)), "month(timestamp) = 12 AND year(timestamp) = 2023"),
        (Mode.of_year(date(2023, 12, 9)), "year(timestamp) = 2023"),
        (Mode.month_of_any_year(date(2030, 2, 9)), "month(timestamp) = 2"),
    ],
)
def test_window_equals_plain_predicate(readings, mode, plain):
    want = ids(readings.where(plain))
    assert want and ids(in_window(readings, mode)) == want
    with_day = readings.withColumn("dt", F.to_date("timestamp"))
    assert ids(in_window(with_day, mode)) == want
    shifted = readings.where(plain.replace("timestamp", "(timestamp + INTERVAL 7 HOURS)"))
    assert ids(in_window(with_day, mode, "+07:00")) == ids(shifted)


def test_bucket_labels_do_not_depend_on_the_session_zone(spark):
    # 02:30 does not exist on this day in the zone below.
    row = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 02:30:07.5' AS ts")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        grains = ["second", "hour", "hour_span", "day", "month"]
        got = row.select(*[bucket(F.col("ts"), g).alias(g) for g in grains]).collect()[0]
        assert tuple(got) == ("02:30:07", "02:00:00", "02:00-02:59", "2024-03-31", "2024-03")
        jakarta = row.select(bucket(F.col("ts"), "second", "Asia/Jakarta")).collect()[0][0]
        assert jakarta == "09:30:07"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_unknown_names_are_refused(readings):
    with pytest.raises(ValueError):
        bucket(F.col("timestamp"), "week")


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_reach_the_scan(spark, readings, tmp_path):
    root = str(tmp_path)
    weeks = readings.where("timestamp BETWEEN '2023-02-25' AND '2023-03-10'")
    write_readings(weeks, table_path(root, "temp_control"), "b0")
    table = read_table(spark, root, "temp_control")
    plan = physical(in_window(table, Mode.of_month(date(2023, 3, 9))))
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert "GreaterThanOrEqual(timestamp,2023-03-01T00:00)" in plan
    one_day = physical(in_window(table, Mode.day(date(2023, 3, 4))))
    assert "(dt#" in one_day and ">= 2023-03-04), (dt" in one_day and "<= 2023-03-04)]" in one_day
    shifted = physical(in_window(table, Mode.day(date(2023, 3, 4)), "+07:00"))
    assert "GreaterThanOrEqual(timestamp,2023-03-03T17:00)" in shifted
    assert ">= 2023-03-03), (dt" in shifted and "<= 2023-03-04)]" in shifted
    any_year = physical(in_window(table, Mode.month_of_any_year(date(2023, 3, 9))))
    assert "(month(dt" in any_year.split("PartitionFilters:")[1]


def test_writing_a_batch_again_replaces_it(spark, readings, tmp_path):
    root = str(tmp_path)
    path = table_path(root, "temp_control")
    first, second = readings.where("id < 40"), readings.where("id BETWEEN 40 AND 79")
    write_readings(first, path, "b0")
    write_readings(second, path, "b1")
    write_readings(second, path, "b1")
    assert ids(read_table(spark, root, "temp_control")) == list(range(80))


def test_files_are_ordered_by_device_and_time(spark, tmp_path):
    rows = [(i, i % 4, 1.0, datetime(2024, 1, 1 + i % 2, 0, 59 - i)) for i in range(60)]
    df = spark.createDataFrame(rows, TEMP_SCHEMA).coalesce(1)
    write_readings(df, str(tmp_path), "b0")
    files = list(tmp_path.rglob("*.parquet"))
    assert len(files) == 2
    for file in files:
        written = pq.ParquetFile(file).read(["no_device", "timestamp"]).to_pylist()
        keys = [(r["no_device"], r["timestamp"]) for r in written]
        assert len(keys) == 30 and keys == sorted(keys)
