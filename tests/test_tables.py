"""Stored tables: listing, compaction, registration."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest

from meterlens import Mode, latest_per_device, series
from meterlens.schema import TEMP_SCHEMA
from meterlens.sources.scratch import scratch_dir
from meterlens.sources.tables import compact, create_tables, exists, read_table, write_readings

FIRST = datetime(2024, 3, 1)


@pytest.fixture
def root(spark, tmp_path):
    """Ten days in three batches each."""
    for batch in range(3):
        rows = [
            (n, n % 2, float(n % 17), FIRST + timedelta(hours=n)) for n in range(batch, 240, 3)
        ]
        write_readings(
            spark.createDataFrame(rows, TEMP_SCHEMA), f"{tmp_path}/temp_control", f"b{batch}"
        )
    return str(tmp_path)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def days_of(df):
    return {p.split("dt=")[1][:10] for p in df.inputFiles()}


def test_a_window_lists_its_days_only(spark, root):
    one = read_table(spark, root, "temp_control", Mode.day(date(2024, 3, 4)))
    assert days_of(one) == {"2024-03-03", "2024-03-04", "2024-03-05"}
    whole = read_table(spark, root, "temp_control")
    assert len(days_of(whole)) == 10
    for window in (Mode.day(date(2024, 3, 4)), Mode.range(date(2024, 3, 2), date(2024, 3, 6))):
        part = read_table(spark, root, "temp_control", window)
        args = (window.lo,) if window.kind == "day" else (window.lo, window.hi - timedelta(days=1))
        assert rows_of(series(part, "temp", *args)) == rows_of(series(whole, "temp", *args))
    nothing = read_table(spark, root, "temp_control", Mode.day(date(1999, 1, 1)))
    assert nothing.columns == whole.columns and nothing.count() == 0
    assert read_table(spark, root, "temp_control", Mode.month_of_any_year(date(2024, 3, 1))).count() == 240


def test_latest_readings_come_from_the_newest_days(spark, root):
    whole = read_table(spark, root, "temp_control")
    got = latest_per_device(whole, 20, "latest", devices=(0, 1))
    want = latest_per_device(whole.drop("dt"), 20, "latest", devices=(0, 1))
    assert rows_of(got) == rows_of(want) and got.count() == 40
    # 24 readings a day: the last two days hold 20 of each device.
    assert "(dt#" in (plan := got._jdf.queryExecution().executedPlan().toString())
    assert "2024-03-09" in plan and got.columns == want.columns
    assert latest_per_device(whole, 20, "latest", devices=(7,)).count() == 0


def test_compaction_keeps_all_rows(spark, root):
    before = rows_of(read_table(spark, root, "temp_control"))
    for day in (date(2024, 3, 4), date(2024, 3, 4), date(1999, 1, 1)):
        compact(spark, root, "temp_control", day)
    assert rows_of(read_table(spark, root, "temp_control")) == before
    folder = f"{root}/temp_control/dt=2024-03-04"
    assert exists(spark, f"{folder}/batch=compacted") and not exists(spark, f"{folder}/batch=b0")


def test_a_stopped_compaction_is_taken_up(spark, root):
    before = rows_of(read_table(spark, root, "temp_control"))
    folder = f"{root}/temp_control/dt=2024-03-04"
    rows = spark.read.schema(TEMP_SCHEMA).parquet(folder).select(*TEMP_SCHEMA.names)
    rows.write.parquet(f"{root}/_compacting/temp_control/dt=2024-03-04")
    compact(spark, root, "temp_control", date(2024, 3, 4))
    assert rows_of(read_table(spark, root, "temp_control")) == before


def test_only_the_given_days_are_registered(spark, root):
    try:
        create_tables(spark, root, [date(2024, 3, 4), date(1999, 1, 1)])
        assert spark.table("temp_control").count() == 24
        create_tables(spark, root)
        assert spark.table("temp_control").count() == 240
    finally:
        for table in ("power_meter", "temp_control"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_no_local_scratch_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        scratch_dir(Session, "x")
