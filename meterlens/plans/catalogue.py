"""Registered queries: every operator over the fixture views."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.functions.buckets import bucket
from meterlens.operators.compare import compare, compare_metric
from meterlens.operators.cost import (
    COST_GRAIN,
    energy_compare,
    energy_compare_total,
    energy_cost,
    energy_total,
)
from meterlens.operators.decode import decode_device_list, decode_pme5, parse_pme5, valid_pme5
from meterlens.operators.history import history
from meterlens.operators.latest import daily_tops, latest_per_device
from meterlens.operators.series import series
from meterlens.operators.summary import dashboard, series_and_summary, summary
from meterlens.operators.totals import phases, total
from meterlens.plans import fixtures as fx
from meterlens.plans.modes import Mode
from meterlens.plans.rollup import hourly_rollup, quarter_rollup, read_rollup, write_rollup
from meterlens.schema import (
    METRICS,
    POWER_DEVICES,
    POWER_SCHEMA,
    SAMPLE_INTERVAL,
    TEMP_SCHEMA,
    TOPIC_DEVICE_LIST,
    TOPIC_PME5,
    TOTAL_AGGREGATE,
)
from meterlens.sources.scratch import scratch_dir
from meterlens.sources.tables import (
    block,
    compact,
    create_tables,
    json_rows,
    read_table,
    remove,
    table_path,
    write_readings,
)
from meterlens.streaming.ingest import ingest
from meterlens.streaming.sample import sample_latest

Query = Callable[[SparkSession, str], DataFrame]

# Windows of the fixture views: hours and raw readings on the short views, months,
# years and long ranges on the long ones.
MODES = {
    "range": Mode.range(*fx.RANGE_LONG),
    "month": Mode.of_month(fx.AS_OF_LONG),
    "year": Mode.of_year(fx.AS_OF_LONG),
    "today": Mode.today(fx.AS_OF),
}
SERIES_WINDOWS = {
    "today": {"as_of": fx.AS_OF},
    "day": {"start": fx.DAY},
    "range": {"start": fx.RANGE[0], "end": fx.RANGE[1]},
}
HISTORY_LONG = {"start": fx.RANGE_LONG[0], "end": fx.RANGE_LONG[1]}
PHASE_METRICS = [name for name, m in METRICS.items() if m.phases]
COST_DEVICE = 1

VIEWS = {
    "power": (fx.POWER_METER, fx.POWER_METER_LONG),
    "temp": (fx.TEMP_CONTROL, fx.TEMP_CONTROL_LONG),
}


def short_view(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return fx.spark_view(spark, sf, VIEWS[table][0])


def long_view(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return fx.spark_view(spark, sf, VIEWS[table][1])


def view_of(kind: str):
    return short_view if kind in ("today", "hour") else long_view


def _series_queries() -> dict[str, Query]:
    queries: dict[str, Query] = {}
    for window, args in SERIES_WINDOWS.items():
        for name, m in METRICS.items():
            queries[f"series_{name}_{window}"] = lambda spark, sf, name=name, m=m, args=args: series(
                short_view(spark, sf, m.table), name, **args
            )
        queries[f"series_volt_tz_{window}"] = lambda spark, sf, args=args: series(
            short_view(spark, sf, "power"), "volt", **args, tz="+07:00"
        )
        queries[f"history_{window}"] = lambda spark, sf, args=args: history(
            short_view(spark, sf, "power"), short_view(spark, sf, "temp"), **args
        )
    queries["history_range_long"] = lambda spark, sf: history(
        long_view(spark, sf, "power"), long_view(spark, sf, "temp"), **HISTORY_LONG
    )
    return queries


def _report_queries() -> dict[str, Query]:
    queries: dict[str, Query] = {}
    for kind, mode in MODES.items():
        view = view_of(kind)
        for suffix, device in (("", None), ("_dev2", 2)):
            if kind == "today" and device == 2:
                mode = Mode.today(fx.AS_OF_DEVICE_2)
            for name in PHASE_METRICS:
                queries[f"phases_{name}_{kind}{suffix}"] = (
                    lambda spark, sf, name=name, mode=mode, view=view, device=device: phases(
                        view(spark, sf, "power"), name, mode, device
                    )
                )
            for name in TOTAL_AGGREGATE:
                queries[f"total_{name}_{kind}{suffix}"] = (
                    lambda spark, sf, name=name, mode=mode, view=view, device=device: total(
                        view(spark, sf, METRICS[name].table), name, mode, device
                    )
                )
        mode = MODES[kind]
        for name, m in METRICS.items():
            queries[f"compare_{name}_{kind}"] = (
                lambda spark, sf, name=name, m=m, mode=mode, view=view: compare_metric(
                    view(spark, sf, m.table), name, mode
                )
            )
        queries[f"summary_watt_{kind}_single"] = lambda spark, sf, mode=mode, view=view: summary(
            view(spark, sf, "power"), mode
        )
        queries[f"summary_watt_{kind}_all"] = lambda spark, sf, mode=mode, view=view: summary(
            view(spark, sf, "power"), mode, POWER_DEVICES
        )
    for kind in ("range", "year"):
        queries[f"series_and_summary_watt_{kind}"] = (
            lambda spark, sf, mode=MODES[kind]: series_and_summary(long_view(spark, sf, "power"), mode)
        )
    queries["dashboard"] = lambda spark, sf: dashboard(short_view(spark, sf, "power"), fx.AS_OF)
    return queries


def _option_queries() -> dict[str, Query]:
    """Documented options that differ from the defaults above."""
    return {
        "compare_volt_range_phase3": lambda spark, sf: compare_metric(
            long_view(spark, sf, "power"), "volt", MODES["range"], phase=3
        ),
        "compare_watt_today_latest": lambda spark, sf: compare_metric(
            short_view(spark, sf, "power"), "watt", MODES["today"], order="latest"
        ),
        "compare_watt_days_any_anchor": lambda spark, sf: compare(
            short_view(spark, sf, "power"), "kw", "sum", Mode.range(*fx.RANGE), anchor=None
        ),
        "compare_watt_days_anchor1": lambda spark, sf: compare(
            short_view(spark, sf, "power"), "kw", "sum", Mode.range(*fx.RANGE)
        ),
        "compare_watt_days_devices23": lambda spark, sf: compare(
            short_view(spark, sf, "power"), "kw", "sum", Mode.range(*fx.RANGE), devices=(2, 3)
        ),
        "total_watt_range_complete": lambda spark, sf: total(
            long_view(spark, sf, "power"), "watt", MODES["range"], limit=None
        ),
        "total_watt_today_complete": lambda spark, sf: total(
            short_view(spark, sf, "power"), "watt", MODES["today"], limit=None
        ),
        "total_watt_today_newest50": lambda spark, sf: total(
            short_view(spark, sf, "power"), "watt", MODES["today"], limit=50
        ),
        "latest_per_device_1500": lambda spark, sf: latest_per_device(
            short_view(spark, sf, "power"), 1500, columns=["kw"], devices=(1, 2, 3, 4)
        ).select("no_device", "id", F.col("kw").cast("double").alias("kw")),
        "latest_per_device": lambda spark, sf: latest_per_device(
            short_view(spark, sf, "power"), columns=["kw"]
        ).select("no_device", "id", F.col("kw").cast("double").alias("kw")),
        "cost_day_same_year": lambda spark, sf: energy_cost(
            long_view(spark, sf, "power"), "day", fx.AS_OF_LONG, COST_DEVICE, same_year=True
        ),
    }


def _cost_queries() -> dict[str, Query]:
    queries: dict[str, Query] = {}
    for grain in COST_GRAIN:
        view = view_of(grain)
        args = {"as_of": fx.AS_OF if grain == "hour" else fx.AS_OF_LONG}
        if grain == "custom":
            args = {"start": fx.RANGE_LONG[0], "end": fx.RANGE_LONG[1]}
        for suffix, operator, device in (
            ("single", energy_cost, {"device": COST_DEVICE}),
            ("all", energy_compare, {}),
            ("total_single", energy_total, {"device": COST_DEVICE}),
            ("total_all", energy_compare_total, {}),
        ):
            queries[f"cost_{grain}_{suffix}"] = (
                lambda spark, sf, view=view, operator=operator, grain=grain, args={**args, **device}:
                operator(view(spark, sf, "power"), grain, **args)
            )
    return queries


def _rollup_queries() -> dict[str, Query]:
    """The hourly rollup, and reports computed from it."""

    built: dict[tuple[str, str, str], str] = {}

    def rollup(
        spark: SparkSession, sf: str, table: str = "power", view=long_view, make=hourly_rollup
    ) -> DataFrame:
        """What is stored beside the readings; it is built by the first report that asks for it."""
        key = (spark.sparkContext.applicationId, sf, table, make.__name__)
        if key not in built:
            path = scratch_dir(spark, "rollup")
            write_rollup(make(view(spark, sf, table)), path)
            built[key] = path
        return read_rollup(spark, built[key])

    def kept_up(spark: SparkSession, sf: str) -> DataFrame:
        """The rollup that an ingest keeps up while late messages replace rows of days it has."""
        root = scratch_dir(spark, "ingest")
        kept = {f"{root}/hourly": hourly_rollup}
        parts = _late_half_first(spark, sf)
        _run_stream(spark, root, parts, TOPIC_PME5, every="2 hours", kept_up=kept)
        rows = read_rollup(spark, f"{root}/hourly/temp_control").drop("dt")
        return _with_time_text(rows, "timestamp")

    tops = {
        f"tops_compare_{name}_today": (
            lambda spark, sf, name=name, m=m: compare_metric(
                rollup(spark, sf, m.table, short_view, daily_tops), name, MODES["today"]
            )
        )
        for name, m in METRICS.items()
    }
    return {
        **tops,
        "rollup_kept_up_temp": kept_up,
        "rollup_series_volt_quarter_zone": lambda spark, sf: series(
            rollup(spark, sf, "power", short_view, quarter_rollup), "volt", *fx.RANGE, tz="+05:30"
        ),
        "rollup_temp_hourly": lambda spark, sf: _with_time_text(
            hourly_rollup(short_view(spark, sf, "temp"))
            .drop("dt")
            .withColumn("temp_sum", F.col("temp_sum").cast("double"))
            .withColumn("temp_max", F.col("temp_max").cast("double")),
            "timestamp",
        ),
        "rollup_history_range_long": lambda spark, sf: history(
            rollup(spark, sf), rollup(spark, sf, "temp"), **HISTORY_LONG
        ),
        "rollup_total_kva_year": lambda spark, sf: total(rollup(spark, sf), "kva", MODES["year"]),
        "rollup_phases_volt_range": lambda spark, sf: phases(
            rollup(spark, sf), "volt", MODES["range"]
        ),
        "rollup_compare_volt_range": lambda spark, sf: compare_metric(
            rollup(spark, sf), "volt", MODES["range"]
        ),
        "rollup_summary_watt_year_all": lambda spark, sf: summary(
            rollup(spark, sf), MODES["year"], POWER_DEVICES
        ),
        "rollup_cost_day_all": lambda spark, sf: energy_compare(
            rollup(spark, sf), "day", fx.AS_OF_LONG
        ),
    }


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return fx.spark_view(spark, sf, fx.MESSAGES)


def device_list_messages(spark: SparkSession, sf: str) -> DataFrame:
    return fx.spark_view(spark, sf, fx.MESSAGES_DEVICE_LIST)


def _with_time_text(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as text, so that engines compare the same value."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def _sampled(spark: SparkSession, sf: str, every: str) -> DataFrame:
    sampled = sample_latest(valid_pme5(parse_pme5(messages(spark, sf))), every)
    return _with_time_text(
        sampled.select("topic", "window_start", "ts", "seq", "payload"), "window_start", "ts"
    )


def _ingested(
    spark: SparkSession,
    sf: str,
    parts: list[DataFrame],
    topic: str,
    root: str | None = None,
    **sampling,
) -> DataFrame:
    """Land the parts one after the other, run the stream to the end after each, and read both
    tables back."""
    root = root or scratch_dir(spark, "ingest")
    _run_stream(spark, root, parts, topic, **sampling)
    power = read_table(spark, f"{root}/tables", "power_meter").withColumn("kind", F.lit("power"))
    temp = read_table(spark, f"{root}/tables", "temp_control").withColumn("kind", F.lit("temp"))
    return _with_time_text(
        power.unionByName(temp, allowMissingColumns=True).drop("dt"), "timestamp"
    )


def _run_stream(
    spark: SparkSession, root: str, parts: list[DataFrame], topic: str, **options
) -> None:
    for rows in parts:
        landed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
        landed.write.mode("append").parquet(f"{root}/landing")
        ingest(
            spark,
            f"{root}/landing",
            f"{root}/tables",
            f"{root}/checkpoint",
            topic,
            trigger={"availableNow": True},
            **options,
        ).awaitTermination()


def _unreadable(spark: SparkSession, sf: str) -> DataFrame:
    """What an ingest that keeps them has put aside."""
    root = scratch_dir(spark, "ingest")
    rows = [messages(spark, sf)]
    _run_stream(spark, root, rows, TOPIC_PME5, every="1 hour", keep_unreadable=True)
    return spark.read.parquet(f"{root}/tables/unreadable").select("topic", "seq", "payload")


def _late_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """The later half of each day, then one day compacted, then the earlier half, which replaces rows
    of the compacted day."""
    root = scratch_dir(spark, "ingest")
    later, earlier = _late_half_first(spark, sf)
    # Slots are days, so that day's rows are all written again.
    _run_stream(spark, root, [later], TOPIC_PME5, every="1 hour")
    for table in ("power_meter", "temp_control"):
        compact(spark, f"{root}/tables", table, fx.DAY)
    return _ingested(spark, sf, [earlier], TOPIC_PME5, root, every="1 hour")


def _failed_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A stream whose first batch fails for want of a place to write, started again."""
    root = scratch_dir(spark, "ingest")
    block(spark, f"{root}/tables/_staged")
    try:
        _run_stream(spark, root, [messages(spark, sf)], TOPIC_PME5, every="1 hour")
    except StreamingQueryException:
        remove(spark, [f"{root}/tables/_staged"])
    return _ingested(spark, sf, [messages(spark, sf).limit(0)], TOPIC_PME5, root, every="1 hour")


def _late_half_first(spark: SparkSession, sf: str) -> list[DataFrame]:
    """All messages in two files, the later half of the day first."""
    rows, late = messages(spark, sf), F.hour("ts") >= 12
    return [rows.where(late), rows.where(~late)]


def _ingest_queries() -> dict[str, Query]:
    queries: dict[str, Query] = {
        "quarantine": lambda spark, sf: decode_pme5(messages(spark, sf)).quarantine.select(
            "topic", "seq", "payload"
        ),
        "quarantine_device_list": lambda spark, sf: decode_device_list(
            device_list_messages(spark, sf)
        ).quarantine.select("topic", "seq", "payload"),
        "sample_latest": lambda spark, sf: _sampled(spark, sf, SAMPLE_INTERVAL),
        "sample_latest_hour": lambda spark, sf: _sampled(spark, sf, "1 hour"),
        "ingest_stream": lambda spark, sf: _ingested(
            spark, sf, [messages(spark, sf)], TOPIC_PME5, every=SAMPLE_INTERVAL
        ),
        "ingest_stream_late": lambda spark, sf: _ingested(
            spark, sf, _late_half_first(spark, sf), TOPIC_PME5, every="1 hour"
        ),
        "ingest_stream_late_compacted": _late_compacted,
        "ingest_stream_failed_batch": _failed_batch,
        "ingest_stream_unreadable": _unreadable,
        "ingest_stream_device_list": lambda spark, sf: _ingested(
            spark, sf, [device_list_messages(spark, sf)], TOPIC_DEVICE_LIST
        ),
        "ingest_stream_spacing": lambda spark, sf: _ingested(
            spark, sf, [messages(spark, sf)], TOPIC_PME5, min_gap_seconds=600
        ),
        "ingest_stream_spacing_keys": lambda spark, sf: _ingested(
            spark,
            sf,
            [messages(spark, sf)],
            TOPIC_PME5,
            min_gap_seconds=3600,
            keys=("topic", "seq % 16"),
        ),
    }
    for table in ("power", "temp"):
        queries[f"decode_pme5_{table}"] = lambda spark, sf, table=table: _with_time_text(
            getattr(decode_pme5(messages(spark, sf)), table), "timestamp"
        )
        queries[f"decode_device_list_{table}"] = lambda spark, sf, table=table: _with_time_text(
            getattr(decode_device_list(device_list_messages(spark, sf)), table), "timestamp"
        )
    return queries


def _written(spark: SparkSession, sf: str) -> str:
    """The short views as stored tables: every day in two batches, one day then compacted."""
    root = scratch_dir(spark, "tables")
    for table, kind in (("power_meter", "power"), ("temp_control", "temp")):
        rows = short_view(spark, sf, kind)
        schema = POWER_SCHEMA if kind == "power" else TEMP_SCHEMA
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        for n in (0, 1):
            write_readings(rows.where(F.col("id") % 2 == n), table_path(root, table), f"part-{n}")
        compact(spark, root, table, fx.DAY)
    return root


def _table_queries() -> dict[str, Query]:
    """Reports over stored tables, of which only the folders of the window are listed."""
    window = Mode.range(*fx.RANGE)

    def power(spark, sf, mode=window):
        return read_table(spark, _written(spark, sf), "power_meter", mode)

    def registered(spark, sf):
        root, database = _written(spark, sf), f"meterlens_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {database}")
        count = (fx.RANGE[1] - fx.RANGE[0]).days + 1
        days = [fx.RANGE[0] + timedelta(days=n) for n in range(count)]
        create_tables(spark, root, days, database)
        return series(spark.table(f"{database}.power_meter"), "volt", *fx.RANGE)

    def merged(spark, sf):
        root = _written(spark, sf)
        tables = [read_table(spark, root, t, window) for t in ("power_meter", "temp_control")]
        return history(*tables, *fx.RANGE)

    def clock(spark, sf):
        label = bucket(F.col("timestamp"), "second", "+05:30").alias("label")
        return short_view(spark, sf, "temp").groupBy(label).agg(F.count("*").alias("n"))

    def before_today(spark, sf):
        rows = short_view(spark, sf, "power").where(F.col("timestamp") < F.lit(Mode.today().lo))
        return rows.groupBy("no_device").agg(F.count("*").alias("n"))

    def before_moved_today(spark, sf):
        """The readings moved so that a day in their midst is today."""
        rows = short_view(spark, sf, "power")
        shift = F.make_dt_interval(days=F.datediff(F.current_date(), F.lit(fx.AS_OF)))
        moved = rows.withColumn("timestamp", F.col("timestamp") + shift)
        moved = moved.where(F.col("timestamp") < F.lit(Mode.today().lo))
        return moved.groupBy("no_device").agg(F.count("*").alias("n"))

    def arrays(spark, sf):
        row = summary(long_view(spark, sf, "power"), MODES["year"], POWER_DEVICES, arrays=True)
        return row.select(
            F.size("total").cast("long").alias("n"),
            *[F.col("total")[k].alias(f"total{k + 1}") for k in range(3)],
            *[F.col("average")[k].alias(f"average{k + 1}") for k in range(3)],
        )

    return {
        "table_series_volt_range": lambda spark, sf: series(power(spark, sf), "volt", *fx.RANGE),
        "table_series_volt_day": lambda spark, sf: series(
            power(spark, sf, Mode.day(fx.DAY)), "volt", fx.DAY
        ),
        "table_registered_volt_range": registered,
        "table_history_range": merged,
        "bucket_second_in_zone": clock,
        "readings_before_today": before_today,
        "readings_before_moved_today": before_moved_today,
        "summary_watt_year_arrays": arrays,
        "json_rows": lambda spark, sf: json_rows(
            latest_per_device(short_view(spark, sf, "power"), columns=["kw"]).select("no_device", "id")
        ),
        "decode_pme5_power_without_list": lambda spark, sf: _with_time_text(
            decode_pme5(fx.spark_view(spark, sf, fx.MESSAGES_WITHOUT_LIST)).power, "timestamp"
        ),
    }


def queries() -> dict[str, Query]:
    return {
        **_series_queries(),
        **_report_queries(),
        **_cost_queries(),
        **_option_queries(),
        **_rollup_queries(),
        **_ingest_queries(),
        **_table_queries(),
    }
