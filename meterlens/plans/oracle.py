"""SQL text of the registered queries, for the comparison with DuckDB.

Written in the plain form of each definition (one subquery per device, then left
joins), independent of how the operators compute it.
"""

from __future__ import annotations

from datetime import date

from meterlens.plans import fixtures as fx

DAY_FMT, MONTH_FMT = "%Y-%m-%d", "%Y-%m"
HOUR_FMT, SPAN_FMT, SECOND_FMT = "%H:00:00", "%H:00-%H:59", "%H:%M:%S"

VOLT, AMP = ("volt1", "volt2", "volt3"), ("amp1", "amp2", "amp3")


def _views(*names: str) -> str:
    texts = {
        "pm": fx.POWER_METER,
        "tc": fx.TEMP_CONTROL,
        "pml": fx.POWER_METER_LONG,
        "tcl": fx.TEMP_CONTROL_LONG,
    }
    return "WITH " + ",\n".join(f"{n} AS ({fx.duckdb_text(texts[n])})" for n in names)


def _on(day: date, ts: str = "timestamp") -> str:
    return f"CAST({ts} AS DATE) = DATE '{day}'"


def _between(days: tuple[date, date], ts: str = "timestamp") -> str:
    return f"CAST({ts} AS DATE) BETWEEN DATE '{days[0]}' AND DATE '{days[1]}'"


def _month(day: date) -> str:
    return f"month(timestamp) = {day.month} AND year(timestamp) = {day.year}"


def _year(day: date) -> str:
    return f"year(timestamp) = {day.year}"


def _any_year(day: date) -> str:
    return f"month(timestamp) = {day.month}"


WINDOWS = {
    "range": _between(fx.RANGE_LONG),
    "month": _month(fx.AS_OF_LONG),
    "year": _year(fx.AS_OF_LONG),
    "today": _on(fx.AS_OF),
}
FORMATS = {"range": DAY_FMT, "month": DAY_FMT, "year": MONTH_FMT}


def _agg(kind: str, column: str) -> str:
    if kind == "avg":
        return f"CAST(SUM({column}) AS DOUBLE) / COUNT({column})"
    return f"CAST({kind.upper()}({column}) AS DOUBLE)"


def _label(fmt: str, ts: str = "timestamp") -> str:
    return f"strftime({ts}, '{fmt}')"


def _series() -> dict[str, str]:
    sql: dict[str, str] = {}
    metrics = {
        "volt": ("pm", "volt1", "volt", ""),
        "current": ("pm", "amp1", "amp", ""),
        "watt": ("pm", "kw", "value", " AND no_device = 1"),
        "kva": ("pm", "kva", "KVA", ""),
        "freq": ("pm", "freq", "freq", ""),
        "temp": ("tc", "temp", "temp", ""),
    }
    days = {"today": fx.AS_OF, "day": fx.DAY}
    for name, (view, column, out, device) in metrics.items():
        head = _views(view)
        for kind, day in days.items():
            sql[f"series_{name}_{kind}"] = (
                f"{head} SELECT {_label(HOUR_FMT)} AS time_label, "
                f"{_agg('max', column)} AS \"{out}\", {_label(DAY_FMT)} AS date "
                f"FROM {view} WHERE {_on(day)}{device} GROUP BY 1, 3 ORDER BY 1"
            )
        sql[f"series_{name}_range"] = (
            f"{head} SELECT {_label(DAY_FMT)} AS date, {_agg('max', column)} AS \"{out}\" "
            f"FROM {view} WHERE {_between(fx.RANGE)}{device} GROUP BY 1 ORDER BY 1"
        )
    shifted = "(timestamp + INTERVAL 7 HOURS)"
    for kind, day in days.items():
        sql[f"series_volt_tz_{kind}"] = (
            f"{_views('pm')} SELECT {_label(HOUR_FMT, shifted)} AS time_label, "
            f"{_agg('max', 'volt1')} AS volt1, {_label(DAY_FMT, shifted)} AS date "
            f"FROM pm WHERE {_on(day, shifted)} GROUP BY 1, 3 ORDER BY 1"
        )
    sql["series_volt_tz_range"] = (
        f"{_views('pm')} SELECT {_label(DAY_FMT, shifted)} AS date, "
        f"{_agg('max', 'volt1')} AS volt1 "
        f"FROM pm WHERE {_between(fx.RANGE, shifted)} GROUP BY 1 ORDER BY 1"
    )
    return sql


def _history() -> dict[str, str]:
    maxima = ", ".join(
        f"{_agg('max', c)} AS {n}"
        for n, c in (
            ("volt", "volt1"),
            ("kva", "kva"),
            ("watt", "kw"),
            ("freq", "freq"),
            ("ampere", "amp1"),
        )
    )

    def merged(power: str, temp: str, where: str, hourly: bool) -> str:
        keys = f"{_label(DAY_FMT)} AS date"
        keys += f", {_label(HOUR_FMT)} AS time_label" if hourly else ""
        by, using = ("1, 2", "date, time_label") if hourly else ("1", "date")
        label = "time_label" if hourly else "CAST(NULL AS VARCHAR)"
        union = "\nUNION ALL ".join(
            f"SELECT '{s}' AS series, date, {label} AS time_label, {s} AS value FROM m"
            for s in ("volt", "kva", "watt", "freq", "temp", "ampere")
        )
        return (
            f"{_views(power, temp)},\n"
            f"p AS (SELECT {keys}, {maxima} FROM {power} WHERE {where} GROUP BY {by}),\n"
            f"t AS (SELECT {keys}, {_agg('avg', 'temp')} AS temp FROM {temp} "
            f"WHERE {where} GROUP BY {by}),\n"
            f"m AS (SELECT * FROM p LEFT JOIN t USING ({using}))\n{union}"
        )

    return {
        "history_today": merged("pm", "tc", _on(fx.AS_OF), True),
        "history_day": merged("pm", "tc", _on(fx.DAY), True),
        "history_range": merged("pm", "tc", _between(fx.RANGE), False),
        "history_range_long": merged("pml", "tcl", _between(fx.RANGE_LONG), False),
    }


def _newest_then_ascending(body: str, limit: int | None) -> str:
    if limit is None:
        return f"{body} ORDER BY timestamp"
    return f"SELECT * FROM ({body} ORDER BY timestamp DESC LIMIT {limit}) ORDER BY timestamp"


def _bucket_report(view: str, values: dict, kind: str, device: str, extra: str = "") -> str:
    limit = {"range": 250, "year": 12}.get(kind)
    columns = ", ".join(f"{expr} AS {name}" for name, expr in values.items())
    groups = "GROUP BY ALL"
    body = (
        f"SELECT {extra}{_label(FORMATS[kind])} AS timestamp, {columns} FROM {view} "
        f"WHERE {WINDOWS[kind]}{device} {groups}"
    )
    prefix, query = _views(view), _newest_then_ascending(body, limit)
    return f"{prefix} {query}"


def _raw_report(view: str, values: dict, device: str) -> str:
    day = fx.AS_OF_DEVICE_2 if device else fx.AS_OF
    columns = ", ".join(f"CAST({c} AS DOUBLE) AS {name}" for name, c in values.items())
    return (
        f"{_views(view)} SELECT timestamp, {', '.join(values)} FROM ("
        f"SELECT id, {_label(SECOND_FMT)} AS timestamp, {columns} FROM {view} AS v "
        f"WHERE {_on(day, 'v.timestamp')}{device} ORDER BY 2 DESC, id DESC LIMIT 250"
        f") ORDER BY timestamp"
    )


def _reports() -> dict[str, str]:
    sql: dict[str, str] = {}
    phases = {"volt": VOLT, "current": AMP}
    totals = {
        "watt": ("kw", {"range": "sum", "month": "sum", "year": "sum"}),
        "kva": ("kva", {"range": "sum", "month": "avg", "year": "avg"}),
        "freq": ("freq", {"range": "avg", "month": "avg", "year": "avg"}),
        "temp": ("temp", {"range": "avg", "month": "avg", "year": "avg"}),
    }
    for suffix, device in (("", ""), ("_dev2", " AND no_device = 2")):
        for name, columns in phases.items():
            for kind in FORMATS:
                values = {f"value{k}": _agg("avg", columns[k - 1]) for k in (3, 2, 1)}
                sql[f"phases_{name}_{kind}{suffix}"] = _bucket_report("pml", values, kind, device)
            raw = {f"value{k}": columns[k - 1] for k in (3, 2, 1)}
            sql[f"phases_{name}_today{suffix}"] = _raw_report("pm", raw, device)
        for name, (column, aggs) in totals.items():
            view, raw_view = ("tcl", "tc") if name == "temp" else ("pml", "pm")
            for kind, agg in aggs.items():
                extra = ""
                if (name, kind) == ("kva", "year"):
                    extra = (
                        "CAST(year(timestamp) AS INTEGER) AS year, "
                        "CAST(month(timestamp) AS INTEGER) AS month, "
                    )
                sql[f"total_{name}_{kind}{suffix}"] = _bucket_report(
                    view, {"value": _agg(agg, column)}, kind, device, extra
                )
            sql[f"total_{name}_today{suffix}"] = _raw_report(raw_view, {"value": column}, device)
    return sql


def _left_joins(devices, subquery, order: str = "timestamp") -> str:
    """``subquery(k)`` gives (timestamp, v) of one device; device 1 anchors."""
    joins = " ".join(
        f"LEFT JOIN ({subquery(k)}) AS d{k} ON d1.timestamp = d{k}.timestamp"
        for k in devices
        if k != 1
    )
    values = ", ".join(f"CAST(COALESCE(d{k}.v, 0) AS DOUBLE) AS value{k}" for k in devices)
    return (
        f"SELECT d1.timestamp AS timestamp, {values} "
        f"FROM ({subquery(1)}) AS d1 {joins} ORDER BY {order}"
    )


def _compare_buckets(view, column, agg, where, fmt, devices, limit=None) -> str:
    def one(k: int) -> str:
        text = (
            f"SELECT {_label(fmt)} AS timestamp, {_agg(agg, column)} AS v FROM {view} "
            f"WHERE {where} AND no_device = {k} GROUP BY 1"
        )
        return text if limit is None else f"{text} ORDER BY 1 DESC LIMIT {limit}"

    return f"{_views(view)} {_left_joins(devices, one)}"


def _compare_raw(view, column, devices, newest: str = "2 DESC, id DESC", fmt=SECOND_FMT) -> str:
    """Of the newest 250 readings of a device, the newest one of each label."""

    def one(k: int) -> str:
        return (
            f"SELECT timestamp, v FROM (SELECT id, {_label(fmt, 'w.timestamp')} AS timestamp, "
            f"w.timestamp AS full_time, {column} AS v FROM {view} AS w WHERE no_device = {k} "
            f"ORDER BY {newest} LIMIT 250) "
            f"QUALIFY row_number() OVER (PARTITION BY timestamp ORDER BY full_time DESC, id DESC) = 1"
        )

    return f"{_views(view)} {_left_joins(devices, one, 'timestamp DESC')}"


def _comparisons() -> dict[str, str]:
    sql: dict[str, str] = {}
    metrics = {
        "volt": ("volt1", "avg"),
        "current": ("amp1", "avg"),
        "watt": ("kw", "sum"),
        "kva": ("kva", "sum"),
        "freq": ("freq", "sum"),
        "temp": ("temp", "sum"),
    }
    for name, (column, agg) in metrics.items():
        view, raw_view = ("tcl", "tc") if name == "temp" else ("pml", "pm")
        devices = (1, 2) if name == "temp" else (1, 2, 3)
        for kind, fmt in FORMATS.items():
            limit = 250 if kind == "range" and agg == "avg" else None
            sql[f"compare_{name}_{kind}"] = _compare_buckets(
                view, column, agg, WINDOWS[kind], fmt, devices, limit
            )
        sql[f"compare_{name}_today"] = _compare_raw(raw_view, column, devices)
    sql["compare_volt_range_phase3"] = _compare_buckets(
        "pml", "volt3", "avg", WINDOWS["range"], DAY_FMT, (1, 2, 3), 250
    )
    sql["compare_watt_today_latest"] = _compare_raw(
        "pm", "kw", (1, 2, 3), "w.timestamp DESC, id DESC", "%Y-%m-%d %H:%M:%S"
    )
    for kind, device, view in (("range", "", "pml"), ("today", "", "pm")):
        values = "SUM(kw)" if kind == "range" else "kw"
        fmt = DAY_FMT if kind == "range" else SECOND_FMT
        group = " GROUP BY 1" if kind == "range" else ""
        sql[f"total_watt_{kind}_complete"] = (
            f"{_views(view)} SELECT {_label(fmt, 'v.timestamp')} AS timestamp, "
            f"CAST({values} AS DOUBLE) AS value FROM {view} AS v "
            f"WHERE {WINDOWS[kind].replace('timestamp', 'v.timestamp')}{group}"
        )
    sql["total_watt_today_newest50"] = _raw_report("pm", {"value": "kw"}, "").replace(
        "LIMIT 250", "LIMIT 50"
    )
    sql["latest_per_device_1500"] = (
        f"{_views('pm')} SELECT no_device, id, CAST(kw AS DOUBLE) AS kw FROM pm "
        f"QUALIFY row_number() OVER (PARTITION BY no_device "
        f"ORDER BY {_label(SECOND_FMT)} DESC, id DESC) <= 1500"
    )
    sql["compare_watt_days_devices23"] = (
        f"{_views('pm')} SELECT a.timestamp, a.v AS value1, coalesce(b.v, 0) AS value2 FROM "
        + " LEFT JOIN ".join(
            f"(SELECT {_label(DAY_FMT)} AS timestamp, {_agg('sum', 'kw')} AS v FROM pm "
            f"WHERE {_between(fx.RANGE)} AND no_device = {k} GROUP BY 1) {name}"
            for k, name in ((2, "a"), (3, "b"))
        )
        + " ON a.timestamp = b.timestamp"
    )
    sql["compare_watt_days_anchor1"] = _compare_buckets(
        "pm", "kw", "sum", _between(fx.RANGE), DAY_FMT, (1, 2, 3)
    )
    by_device = ", ".join(
        f"CAST(COALESCE(SUM(kw) FILTER (WHERE no_device = {k}), 0) AS DOUBLE) AS value{k}"
        for k in (1, 2, 3)
    )
    sql["compare_watt_days_any_anchor"] = (
        f"{_views('pm')} SELECT {_label(DAY_FMT)} AS timestamp, {by_device} FROM pm "
        f"WHERE {_between(fx.RANGE)} AND no_device IN (1, 2, 3) GROUP BY 1 ORDER BY 1"
    )
    sql["latest_per_device"] = (
        f"{_views('pm')} SELECT no_device, id, CAST(kw AS DOUBLE) AS kw FROM pm "
        f"QUALIFY row_number() OVER (PARTITION BY no_device "
        f"ORDER BY {_label(SECOND_FMT)} DESC, id DESC) <= 250"
    )
    return sql


def _scalars(view, column, where, devices, outputs: dict[str, str]) -> str:
    """One scalar subquery per device and output prefix."""
    columns = ", ".join(
        f"(SELECT {_agg(agg, column)} FROM {view} WHERE {where} AND no_device = {k}) "
        f"AS {prefix}{k}"
        for prefix, agg in outputs.items()
        for k in devices
    )
    return f"{_views(view)} SELECT {columns}"


def _summaries() -> dict[str, str]:
    sql: dict[str, str] = {}
    for kind, where in WINDOWS.items():
        view = "pm" if kind == "today" else "pml"
        sql[f"summary_watt_{kind}_all"] = _scalars(
            view, "kw", where, (1, 2, 3), {"total": "sum", "average": "avg"}
        )
        sql[f"summary_watt_{kind}_single"] = (
            f"{_views(view)} SELECT {_agg('sum', 'kw')} AS total1, {_agg('avg', 'kw')} AS average1 "
            f"FROM {view} WHERE {where}"
        )
    for kind, limit in (("range", 250), ("year", 12)):
        figures = f"{_agg('sum', 'kw')} AS value, {_agg('avg', 'kw')} AS average"
        sql[f"series_and_summary_watt_{kind}"] = (
            f"{_views('pml')} SELECT * FROM (SELECT 'series' AS kind, {_label(FORMATS[kind])} AS timestamp, "
            f"{figures} FROM pml WHERE {WINDOWS[kind]} GROUP BY 2 ORDER BY 2 DESC LIMIT {limit}) UNION ALL "
            f"SELECT 'summary', NULL, {figures} FROM pml WHERE {WINDOWS[kind]}"
        )
    sql["dashboard"] = _scalars("pm", "kw", _on(fx.AS_OF), (1, 2, 3), {"value": "sum"})
    return sql


def _costs() -> dict[str, str]:
    sql: dict[str, str] = {}
    grains = {
        "hour": ("pm", _on(fx.AS_OF), SPAN_FMT),
        "day": ("pml", _any_year(fx.AS_OF_LONG), DAY_FMT),
        "month": ("pml", _year(fx.AS_OF_LONG), MONTH_FMT),
        "custom": ("pml", _between(fx.RANGE_LONG), DAY_FMT),
    }
    for grain, (view, where, fmt) in grains.items():
        price = "" if grain == "custom" else " * 1300 / 1000"
        one = f"{where} AND no_device = 1"
        body = (
            f"SELECT {_label(fmt)} AS timestamp, {_agg('sum', 'kw')}{price} AS value "
            f"FROM {view} WHERE {one} GROUP BY 1"
        )
        limit = 250 if grain == "custom" else None
        sql[f"cost_{grain}_single"] = f"{_views(view)} {_newest_then_ascending(body, limit)}"
        sql[f"cost_{grain}_all"] = _compare_buckets(view, "kw", "sum", where, fmt, (1, 2))
        total = f"{_agg('sum', 'kw')}{price} AS value1"
        if grain == "custom":
            total = f"{_agg('sum', 'kw')} AS \"total_kW\", {_agg('avg', 'kw')} AS \"avg_kW\""
        sql[f"cost_{grain}_total_single"] = f"{_views(view)} SELECT {total} FROM {view} WHERE {one}"
        sql[f"cost_{grain}_total_all"] = _scalars(view, "kw", where, (1, 2), {"value": "sum"})
    sql["cost_day_same_year"] = (
        f"{_views('pml')} SELECT {_label(DAY_FMT)} AS timestamp, "
        f"{_agg('sum', 'kw')} * 1300 / 1000 AS value FROM pml "
        f"WHERE {_month(fx.AS_OF_LONG)} AND no_device = 1 GROUP BY 1 ORDER BY 1"
    )
    return sql


# Text of one message, as the message fixture builds it.
PME5_PAYLOAD = """concat(
 '{"PME5":[{"server_name":"PM2100","name":"Voltage","data":"[', CAST(220 + event_id % 11 AS VARCHAR), ']"},',
 '{"server_name":"PM2100","name":"kWh","data":"[', CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), ']"},',
 '{"server_name":"E5CC","name":"Temperature","data":"[0,', CAST(20 + event_id % 15 AS VARCHAR), ']"}]}')"""


def _ingest() -> dict[str, str]:
    at = "CAST(ts AS VARCHAR)"
    null = "CAST(NULL AS DOUBLE)"

    def pme5_power(source: str) -> str:
        return (
            f"SELECT event_id AS id, CAST(1 AS INTEGER) AS no_device, 0.0::DOUBLE AS kva, "
            f"CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS kw, "
            f"CAST(220 + event_id % 11 AS DOUBLE) AS volt1, {null} AS volt2, {null} AS volt3, "
            f"0.0::DOUBLE AS amp1, {null} AS amp2, {null} AS amp3, 0.0::DOUBLE AS freq, "
            f"{at} AS timestamp FROM {source}"
        )

    def pme5_temp(source: str) -> str:
        return (
            f"SELECT event_id AS id, CAST(1 AS INTEGER) AS no_device, "
            f"CAST(rtrim(CAST(20 + event_id % 15 AS VARCHAR), '0') AS DOUBLE) AS temp, "
            f"{at} AS timestamp FROM {source}"
        )

    list_power = (
        f"SELECT event_id AS id, CAST(user_id % 4 + 1 AS INTEGER) AS no_device, "
        f"CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS kva, user_id + 0.5::DOUBLE AS kw, "
        f"CAST(220 + event_id % 11 AS DOUBLE) AS volt1, CAST(219 + event_id % 13 AS DOUBLE) AS volt2, "
        f"CAST(221 + event_id % 7 AS DOUBLE) AS volt3, CAST(user_id % 17 AS DOUBLE) AS amp1, "
        f"CAST(user_id % 19 AS DOUBLE) AS amp2, CAST(user_id % 23 AS DOUBLE) AS amp3, "
        f"CASE WHEN event_id % 3 = 0 THEN 0 ELSE 49 + event_id % 3 END::DOUBLE AS freq, "
        f"{at} AS timestamp FROM events WHERE event_id % 50 <> 0"
    )
    list_temp = " UNION ALL ".join(
        f"SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 2 END::INTEGER AS no_device, "
        f"{value} AS temp, {at} AS timestamp FROM events WHERE event_id % 50 <> 0"
        for value in ("(20 + event_id % 15)::DOUBLE", "(30 + event_id % 9) + 0.25::DOUBLE")
    )

    def both(power: str, temp: str, head: str = "") -> str:
        only_power = "kva, kw, volt1, volt2, volt3, amp1, amp2, amp3, freq"
        nulls = ", ".join(f"{null} AS {c}" for c in only_power.split(", "))
        return (
            f"{head} SELECT 'power' AS kind, id, no_device, {only_power}, {null} AS temp, timestamp "
            f"FROM ({power}) UNION ALL "
            f"SELECT 'temp' AS kind, id, no_device, {nulls}, temp, timestamp FROM ({temp})"
        )

    valid = "events WHERE event_id % 50 <> 0"

    def sampled(width: str) -> str:
        return (
            f"SELECT time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01') AS w, "
            f"arg_max(event_id, (ts, event_id)) AS event_id FROM {valid} GROUP BY 1"
        )

    def sample_report(width: str) -> str:
        return (
            f"SELECT 'PM/E5' AS topic, CAST(w AS VARCHAR) AS window_start, {at} AS ts, "
            f"event_id AS seq, {PME5_PAYLOAD} AS payload "
            f"FROM ({sampled(width)}) JOIN events USING (event_id)"
        )

    kept = f"WITH kept AS (SELECT e.* FROM ({sampled('10 seconds')}) JOIN events e USING (event_id))"
    kept_hour = f"WITH kept AS (SELECT e.* FROM ({sampled('1 hour')}) JOIN events e USING (event_id))"

    # Each write is due at the first tick with a message, or a gap after the last write.
    def spaced(gap: int, key: str) -> str:
        return f"""WITH RECURSIVE ticks AS (
  SELECT {key} AS k, CAST(floor(epoch(ts)) AS BIGINT) + 1 AS tick,
         arg_max(event_id, (ts, event_id)) AS event_id
  FROM {valid} GROUP BY 1, 2),
writes AS (
  SELECT k, min(tick) AS due FROM ticks GROUP BY k
  UNION ALL
  SELECT w.k, greatest(w.due + {gap}, n.tick)
  FROM writes w, LATERAL (SELECT min(tick) AS tick FROM ticks t WHERE t.k = w.k AND t.tick > w.due) n
  WHERE n.tick IS NOT NULL),
kept AS (
  SELECT e.* FROM writes w ASOF JOIN ticks t ON w.k = t.k AND w.due >= t.tick
  JOIN events e USING (event_id))"""

    return {
        "decode_pme5_power": pme5_power(valid),
        "decode_pme5_temp": pme5_temp(valid),
        "decode_device_list_power": list_power,
        "decode_device_list_temp": list_temp,
        "quarantine": (
            "SELECT 'PM/E5' AS topic, event_id AS seq, '{\"PME5\":[' AS payload "
            "FROM events WHERE event_id % 50 = 0"
        ),
        "quarantine_device_list": (
            "SELECT 'toho' AS topic, event_id AS seq, '{\"data\":[{\"name\"' AS payload "
            "FROM events WHERE event_id % 50 = 0"
        ),
        "ingest_stream_unreadable": (
            "SELECT 'PM/E5' AS topic, event_id AS seq, '{\"PME5\":[' AS payload "
            "FROM events WHERE event_id % 50 = 0"
        ),
        "sample_latest": sample_report("10 seconds"),
        "sample_latest_hour": sample_report("1 hour"),
        "ingest_stream": both(pme5_power("kept"), pme5_temp("kept"), kept),
        "ingest_stream_device_list": both(list_power, list_temp),
        "ingest_stream_late": both(pme5_power("kept"), pme5_temp("kept"), kept_hour),
        "ingest_stream_late_compacted": both(pme5_power("kept"), pme5_temp("kept"), kept_hour),
        "ingest_stream_failed_batch": both(pme5_power("kept"), pme5_temp("kept"), kept_hour),
        "ingest_stream_spacing": both(pme5_power("kept"), pme5_temp("kept"), spaced(600, "0")),
        "ingest_stream_spacing_keys": both(
            pme5_power("kept"), pme5_temp("kept"), spaced(3600, "event_id % 16")
        ),
    }


def _rollups(direct: dict[str, str]) -> dict[str, str]:
    """Reports from the rollup must equal the reports from the readings."""
    names = (
        "history_range_long",
        "total_kva_year",
        "phases_volt_range",
        "compare_volt_range",
        "summary_watt_year_all",
        "cost_day_all",
    )
    sql = {f"rollup_{name}": direct[name] for name in names}
    for name in ("volt", "current", "watt", "kva", "freq", "temp"):
        sql[f"tops_compare_{name}_today"] = direct[f"compare_{name}_today"]
    zone = "(timestamp + INTERVAL 330 MINUTE)"
    sql["rollup_series_volt_quarter_zone"] = (
        f"{_views('pm')} SELECT {_label(DAY_FMT, zone)} AS date, {_agg('max', 'volt1')} AS volt1 "
        f"FROM pm WHERE {_between(fx.RANGE, zone)} GROUP BY 1"
    )
    sql["rollup_kept_up_temp"] = (
        "SELECT CAST(1 AS INTEGER) AS no_device, CAST(date_trunc('hour', ts) AS VARCHAR) AS timestamp, "
        "CAST(SUM(temp) AS DOUBLE) AS temp_sum, COUNT(temp) AS temp_count, MAX(temp) AS temp_max FROM "
        "(SELECT e.ts, CAST(rtrim(CAST(20 + event_id % 15 AS VARCHAR), '0') AS DOUBLE) AS temp FROM "
        "(SELECT time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '1970-01-01') AS w, "
        "arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_id % 50 <> 0 GROUP BY 1) "
        "JOIN events e USING (event_id)) GROUP BY 2"
    )
    hour = "CAST(date_trunc('hour', timestamp) AS VARCHAR)"
    sql["rollup_temp_hourly"] = (
        f"{_views('tc')} SELECT no_device, {hour} AS timestamp, {_agg('sum', 'temp')} AS temp_sum, "
        f"COUNT(temp) AS temp_count, {_agg('max', 'temp')} AS temp_max FROM tc GROUP BY 1, 2"
    )
    return sql


def _stored(direct: dict[str, str]) -> dict[str, str]:
    """Reports over stored tables must equal those over the views."""
    zeros = ", ".join(f"0.0::DOUBLE AS {c}" for c in ("kva", "kw", "volt1"))
    null = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("volt2", "volt3", "amp2", "amp3"))
    return {
        "table_series_volt_range": direct["series_volt_range"],
        "table_registered_volt_range": direct["series_volt_range"],
        "table_series_volt_day": direct["series_volt_day"],
        "table_history_range": direct["history_range"],
        "bucket_second_in_zone": (
            f"{_views('tc')} SELECT "
            f"{_label(SECOND_FMT, 'timestamp + INTERVAL 330 MINUTE')} AS label, count(*) AS n "
            f"FROM tc GROUP BY 1"
        ),
        "readings_before_today": (
            f"{_views('pm')} SELECT no_device, count(*) AS n FROM pm "
            f"WHERE timestamp < current_date GROUP BY 1"
        ),
        "readings_before_moved_today": (
            f"{_views('pm')} SELECT no_device, count(*) AS n FROM pm "
            f"WHERE timestamp + to_days(CAST(current_date - DATE '{fx.AS_OF}' AS INTEGER)) < current_date "
            "GROUP BY 1"
        ),
        "summary_watt_year_arrays": (
            f"SELECT CAST(3 AS BIGINT) AS n, * FROM ({direct['summary_watt_year_all']})"
        ),
        "json_rows": (
            "SELECT '{\"no_device\":' || no_device || ',\"id\":' || id || '}' AS json "
            f"FROM ({direct['latest_per_device']})"
        ),
        "decode_pme5_power_without_list": (
            f"SELECT event_id AS id, CAST(1 AS INTEGER) AS no_device, {zeros}, 0.0::DOUBLE AS amp1, "
            f"0.0::DOUBLE AS freq, {null}, CAST(ts AS VARCHAR) AS timestamp "
            f"FROM events WHERE event_id % 50 <> 0"
        ),
    }


def oracle_sql() -> dict[str, str]:
    direct = {
        **_series(),
        **_history(),
        **_reports(),
        **_comparisons(),
        **_summaries(),
        **_costs(),
        **_ingest(),
    }
    return {**direct, **_rollups(direct), **_stored(direct)}

