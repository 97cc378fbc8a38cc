from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meterlens import (
    Mode,
    compare,
    compare_latest,
    energy_compare,
    energy_cost,
    energy_total,
    history,
    latest_per_device,
    phases,
    series,
    summary,
    total,
)
from meterlens.functions.measures import exact_sum
from meterlens.operators.latest import daily_tops
from meterlens.plans.rollup import (
    hourly_rollup,
    merge_rollup,
    quarter_rollup,
    read_rollup,
    refresh_rollup,
    write_rollup,
)
from meterlens.schema import POWER_SCHEMA, TEMP_SCHEMA

START, DAYS = date(2023, 1, 1), 400
RANGE = Mode.range(START, START + timedelta(days=DAYS))


@pytest.fixture(scope="module")
def power(spark):
    """Readings of four devices with silent days, NULL readings and equal times of day."""
    rng = random.Random(7)
    rows = []
    for day in range(DAYS):
        for dev in (1, 2, 3, 4):
            if rng.random() < 0.35:
                continue
            for _ in range(rng.randint(1, 3)):
                at = datetime(2023, 1, 1) + timedelta(
                    days=day, hours=rng.randint(0, 23), minutes=rng.choice((0, 30))
                )
                kw = None if rng.random() < 0.1 else rng.randint(0, 40) / 4
                rows.append(
                    (len(rows), dev, 1.0, kw, 220.0 + rng.randint(0, 9), 221.0, 222.0)
                    + (1.0, 2.0, 3.0, 50.0, at)
                )
    return spark.createDataFrame(rows, POWER_SCHEMA).repartition(6).cache()


def rows_of(df):
    columns = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def joined(power, agg, limit, day="day"):
    """Plain form: one aggregate per device, left joined to device 1."""
    per_device = []
    for k in (1, 2, 3):
        d = (
            power.where(f"no_device = {k}")
            .groupBy(F.to_date("timestamp").cast("string").alias("timestamp"))
            .agg(agg("kw").alias(f"v{k}"))
        )
        if limit:
            d = d.orderBy(F.desc("timestamp")).limit(limit)
        per_device.append(d)
    d1, d2, d3 = per_device
    joined = d1.join(d2, "timestamp", "left").join(d3, "timestamp", "left")
    return joined.select(
        "timestamp", *[F.coalesce(f"v{k}", F.lit(0.0)).alias(f"value{k}") for k in (1, 2, 3)]
    )


@pytest.mark.parametrize("limit", [None, 30, 250])
@pytest.mark.parametrize("kind, agg", [("sum", F.sum), ("avg", F.avg)])
def test_compare_equals_left_joins(power, limit, kind, agg):
    got = compare(power, "kw", kind, RANGE, limit=limit)
    assert rows_of(got) == rows_of(joined(power, agg, limit))


def test_compare_without_anchor_keeps_every_bucket(power):
    got = compare(power, "kw", "sum", RANGE, anchor=None)
    days = power.where("no_device <= 3").select(F.to_date("timestamp")).distinct().count()
    assert got.count() == days > compare(power, "kw", "sum", RANGE).count()


def test_compare_scans_once(power, tmp_path):
    power.write.parquet(f"{tmp_path}/p")
    stored = power.sparkSession.read.parquet(f"{tmp_path}/p")
    for df in (
        compare(stored, "kw", "sum", RANGE),
        compare(stored, "volt1", "avg", RANGE, limit=250),
        summary(stored, RANGE, (1, 2, 3)),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1
        assert "Join" not in plan


@pytest.mark.parametrize("devices", [None, (1, 2, 3, 4)])
@pytest.mark.parametrize("order", ["label", "latest"])
@pytest.mark.parametrize("n", [40, 10_000])
def test_latest_per_device_equals_plain_ranking(power, order, devices, n):
    key = F.date_format("timestamp", "HH:mm:ss") if order == "label" else F.col("timestamp")
    plain = Window.partitionBy("no_device").orderBy(key.desc(), F.desc("id"))
    want = power.withColumn("rn", F.row_number().over(plain)).where(f"rn <= {n}").select("id")
    got = latest_per_device(power, n, order, devices=devices)
    assert rows_of(got.select("id")) == rows_of(want)


@pytest.mark.parametrize("order", ["label", "latest"])
def test_compare_latest_takes_one_reading_per_label(power, order):
    fmt = "HH:mm:ss" if order == "label" else "yyyy-MM-dd HH:mm:ss"
    newest = Window.partitionBy("no_device", "label").orderBy(F.desc("timestamp"), F.desc("id"))
    top = (
        latest_per_device(power, 60, order)
        .withColumn("label", F.date_format("timestamp", fmt))
        .withColumn("rn", F.row_number().over(newest))
        .where("rn = 1")
    )
    sides = [
        top.where(f"no_device = {k}").select("label", F.col("kw").alias(f"v{k}"))
        for k in (1, 2, 3)
    ]
    plain = sides[0].join(sides[1], "label", "left").join(sides[2], "label", "left")
    want = plain.select(
        F.col("label").alias("timestamp"),
        *[F.coalesce(f"v{k}", F.lit(0.0)).alias(f"value{k}") for k in (1, 2, 3)],
    )
    got = compare_latest(power, "kw", n=60, order=order)
    assert rows_of(got) == rows_of(want)
    assert 0 < got.count() <= 60


def test_many_readings_of_one_label_give_one_row(spark):
    at = datetime(2024, 1, 1, 23, 59, 59)
    rows = [
        (n, k, *[float(n)] * 9, at + timedelta(days=n % 250)) for k in (1, 2, 3) for n in range(250)
    ]
    got = compare_latest(spark.createDataFrame(rows, POWER_SCHEMA), "kw").collect()
    assert [tuple(r) for r in got] == [("23:59:59", 249.0, 249.0, 249.0)]


def test_the_anchor_is_one_of_the_devices(power):
    both = compare(power, "kw", "sum", RANGE, devices=(2, 3))
    assert rows_of(both) == rows_of(compare(power, "kw", "sum", RANGE, devices=(2, 3), anchor=2))
    assert both.count() > 0
    assert compare_latest(power, "kw", devices=(2, 3)).count() > 0
    for call in (compare, compare_latest):
        with pytest.raises(ValueError):
            args = ("kw", "sum", RANGE) if call is compare else ("kw",)
            call(power, *args, devices=(2, 3), anchor=1)


def test_limits(power):
    year = Mode.range(date(2022, 1, 1), date(2024, 12, 31))
    days = power.where(F.col("timestamp").between("2022-01-01", "2025-01-01")).select(
        F.to_date("timestamp")
    ).distinct().count()
    assert total(power, "watt", year, limit=None).count() == days
    assert total(power, "watt", year, limit=3).count() == min(3, days)
    assert total(power, "watt", year, limit=0).count() == 0
    assert latest_per_device(power, None).count() == power.count()
    today = Mode.today()
    assert compare(power, "kw", "sum", today, limit=0).count() == 0
    assert compare(power, "kw", "sum", today, limit=None).count() >= compare(
        power, "kw", "sum", today
    ).count()
    with pytest.raises(ValueError):
        total(power, "watt", year, limit="all")


def test_a_rollup_keeps_whole_days_and_refuses_half_hours(spark, power, tmp_path):
    path = str(tmp_path / "rollup")
    days = [r.d for r in power.select(F.to_date("timestamp").alias("d")).distinct().collect()]
    refresh_rollup(power, path, days)
    refresh_rollup(power, path, days[:1])
    refresh_rollup(power, path, [])
    stored = read_rollup(spark, path)
    assert stored.count() == hourly_rollup(power).count()
    with pytest.raises(ValueError):
        series(stored, "volt", date(2023, 1, 1), tz="+05:30")
    assert series(stored, "volt", date(2023, 1, 1), tz="+07:00") is not None


def test_rollup_gives_the_same_reports(spark, power, tmp_path):
    # Sums of quarters are exact, so both ways give equal doubles.
    write_rollup(hourly_rollup(power), f"{tmp_path}/hourly")
    rollup = read_rollup(spark, f"{tmp_path}/hourly")
    year = Mode.of_year(date(2023, 5, 1))
    for report in (
        lambda df: total(df, "watt", year),
        lambda df: total(df, "kva", year, 2),
        lambda df: phases(df, "volt", RANGE),
        lambda df: compare(df, "kw", "avg", RANGE, limit=250),
        lambda df: summary(df, year, (1, 2, 3)),
        lambda df: energy_cost(df, "hour", date(2023, 3, 1), 1),
        lambda df: energy_cost(df, "day", date(2023, 1, 9), 1),
        lambda df: energy_compare(df, "month", date(2023, 1, 9)),
    ):
        assert rows_of(report(rollup)) == rows_of(report(power))
    # Writing some days again keeps the others.
    write_rollup(hourly_rollup(power.where("timestamp < '2023-02-01'")), f"{tmp_path}/hourly")
    assert rows_of(total(read_rollup(spark, f"{tmp_path}/hourly"), "watt", year)) == rows_of(
        total(power, "watt", year)
    )


def test_any_year_month_and_same_year(power):
    both = energy_cost(power, "day", date(2023, 1, 9), 1)
    one = energy_cost(power, "day", date(2023, 1, 9), 1, same_year=True)
    labels = [r.timestamp for r in both.collect()]
    assert labels == sorted(labels) and labels[0].startswith("2023-01")
    assert labels[-1].startswith("2024-01") and one.count() < both.count()


def test_tariff(power):
    day = date(2023, 1, 9)
    (cost,) = energy_total(power, "month", day, 1).collect()
    (plain,) = energy_total(power, "month", day, 1, tariff=None).collect()
    assert cost.value1 == pytest.approx(plain.value1 * 1.3)


def test_summary_arrays_and_silent_devices(power):
    day = Mode.today(date(1999, 1, 1))
    assert tuple(summary(power, day, (1, 2, 3)).collect()[0]) == (None,) * 6
    (row,) = summary(power, RANGE, arrays=True).collect()
    (plain,) = summary(power, RANGE).collect()
    assert row.total == [plain.total1, None, None]
    assert row.average == [plain.average1, None, None]
    (row,) = summary(power, RANGE, (1, 2, 3), arrays=True).collect()
    assert len(row.total) == 3 and None not in row.total


def test_history_nested(spark, power):
    temp = spark.createDataFrame(
        [(1, 1, 20.0, datetime(2023, 1, 2, 3)), (2, 2, 30.0, datetime(2023, 1, 2, 9))], TEMP_SCHEMA
    )
    start, end = date(2023, 1, 1), date(2023, 1, 9)
    flat = history(power, temp, start, end)
    nested = {r.series: r.points for r in history(power, temp, start, end, nested=True).collect()}
    assert set(nested) == {"volt", "kva", "watt", "freq", "temp", "ampere"}
    for name, points in nested.items():
        want = [(r.date, r.time_label, r.value) for r in flat.where(F.col("series") == name).collect()]
        assert [tuple(p) for p in points] == want
    assert {p.date: p.value for p in nested["temp"]}["2023-01-02"] == 25.0
    assert all(p.value is None for p in nested["temp"] if p.date != "2023-01-02")


@pytest.mark.parametrize("device", ["2", "abc", 1.0, True])
def test_device_must_be_a_number(power, device):
    with pytest.raises(ValueError):
        total(power, "watt", RANGE, device)


def test_bad_arguments(power):
    day = date(2023, 1, 1)
    with pytest.raises(ValueError):
        energy_cost(power, "day", day)
    with pytest.raises(ValueError):
        energy_cost(power, "custom", device=1, start=day)
    with pytest.raises(ValueError):
        energy_cost(power, "week", day, 1)
    with pytest.raises(ValueError):
        phases(power, "watt", RANGE)
    with pytest.raises(ValueError):
        total(power, "volt", RANGE)
    with pytest.raises(ValueError):
        total(power, "speed", RANGE)
    with pytest.raises(ValueError):
        latest_per_device(power, order="newest")


def test_quarters_fit_any_zone_and_hours_are_refused_in_time(spark, tmp_path):
    """Lord Howe shifts by half an hour in summer only, so a window decides."""
    rows = [
        (1, 1, float(n), datetime(2024, 7, 1) + timedelta(minutes=20 * n)) for n in range(3 * 24 * 4)
    ]
    temp = spark.createDataFrame(rows, TEMP_SCHEMA)
    window = (date(2024, 7, 1), date(2024, 7, 4))
    for zone in ("Australia/Lord_Howe", "+05:30", "Asia/Kathmandu", "America/St_Johns", "+07:00"):
        want = rows_of(series(temp, "temp", *window, tz=zone))
        assert rows_of(series(quarter_rollup(temp), "temp", *window, tz=zone)) == want
        if zone == "+07:00":
            assert rows_of(series(hourly_rollup(temp), "temp", *window, tz=zone)) == want
        else:
            with pytest.raises(ValueError, match="quarter_rollup"):
                series(hourly_rollup(temp), "temp", *window, tz=zone)
    summer = (date(2024, 1, 1), date(2024, 1, 4))
    assert series(hourly_rollup(temp), "temp", *summer, tz="Australia/Lord_Howe").count() == 0


def test_days_are_merged_into_a_rollup(spark, power, tmp_path):
    path = f"{tmp_path}/hourly"
    day = F.to_date("timestamp")
    days = sorted(r[0] for r in power.select(day).distinct().collect() if r[0])
    old = power.where(day != days[3]).withColumn("kw", F.when(day != days[5], F.col("kw")))
    write_rollup(hourly_rollup(old), path)
    for _ in range(2):
        merge_rollup(spark, power, path, [days[3], days[5]])
    columns = hourly_rollup(power).columns
    assert rows_of(read_rollup(spark, path).select(columns)) == rows_of(hourly_rollup(power))
    merge_rollup(spark, power.where(day != days[0]), path, days[:1])
    assert read_rollup(spark, path).where(F.col("dt") == days[0]).count() == 0


def test_tops_of_days_give_the_same_comparisons(spark, power):
    tops = daily_tops(power, 5)
    for n in (1, 5):
        for order in ("label",):
            want = rows_of(latest_per_device(power, n, order))
            assert rows_of(latest_per_device(tops.drop("dt"), n, order)) == want
    assert daily_tops(power, 1).count() < power.count()
    assert daily_tops(power.limit(0)).count() == 0


def test_sums_of_doubles_do_not_depend_on_the_order(spark):
    rng = random.Random(3)
    values = [round(rng.uniform(-1e5, 1e5), rng.choice((1, 2, 6))) for _ in range(3000)]
    want = float(sum(Decimal(repr(v)) for v in values))
    for seed in range(3):
        rng.shuffle(values)
        rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(5 + seed)
        assert rows.agg(exact_sum(F.col("v"))).first()[0] == want
    odd = spark.createDataFrame([(1e300,), (1.5,), (float("inf"),)], "v double")
    assert odd.agg(exact_sum(F.col("v"))).first()[0] == float("inf")
    assert math.isnan(spark.sql("SELECT double('nan') AS v").agg(exact_sum(F.col("v"))).first()[0])
    none = spark.createDataFrame([(None,)], "v double")
    assert none.agg(exact_sum(F.col("v"))).first()[0] is None
