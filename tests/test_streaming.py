from __future__ import annotations

import json
import random
from datetime import UTC, date, datetime, timedelta

import pytest

from meterlens import Mode, sample_latest
from meterlens.operators.decode import decode_pme5
from meterlens.schema import MESSAGE_SCHEMA, TOPIC_DEVICE_LIST, TOPIC_PME5
from meterlens.sources.messages import read_messages
from meterlens.sources.scratch import scratch_dir
from meterlens.sources.tables import (
    Unit,
    batch_folders,
    compact,
    create_tables,
    exists,
    json_rows,
    names_in,
    read_table,
)
from meterlens.streaming.ingest import ingest, quarantine
from meterlens.streaming.spacing import chosen, sample_spacing, space, ticks

T0 = datetime(2024, 1, 1, 23, 58)
ONCE = {"availableNow": True}


def message(topic, second, seq, payload=None):
    volts = json.dumps(
        {"PME5": [{"server_name": "PM2100", "name": "Voltage", "data": f"[{seq}]"}]}
    )
    return (topic, volts if payload is None else payload, T0 + timedelta(seconds=second), seq)


def land(spark, folder, rows):
    spark.createDataFrame(rows, MESSAGE_SCHEMA).repartition(3).write.mode("append").parquet(folder)


def seconds(ts):
    return (ts - T0).total_seconds()


def traffic(n=300, seed=3, bad=True):
    """Bursts and pauses, equal times, and some unreadable messages."""
    rng = random.Random(seed)
    rows, at = [], 0.0
    for seq in range(n):
        at += rng.choice((0, 0.2, 0.4, 1, 3, 9, 10, 11, 40))
        payload = "{" if bad and rng.random() < 0.1 else None
        rows.append(message(TOPIC_PME5, at, seq, payload))
    return rows


def latest_per_interval(rows, width):
    best = {}
    for topic, payload, ts, seq in rows:
        if payload != "{":
            key = int(seconds(ts) // width)
            best[key] = max(best.get(key, (ts, seq)), (ts, seq))
    return sorted(seq for _, seq in best.values())


def spaced(rows, gap):
    """Sequential form: a tick per second writes the latest message once ``gap`` has passed."""
    ticks = {}
    for _, _, ts, seq in sorted(rows, key=lambda r: (r[2], r[3])):
        ticks[int(seconds(ts) // 1) + 1] = seq
    written, last, buffer = [], None, None
    for tick in range(1, max(ticks) + gap + 2):
        buffer = ticks.get(tick, buffer)
        if buffer is not None and (last is None or tick - last >= gap):
            written.append((tick, buffer))
            last, buffer = tick, None
    return written


def test_sample_latest_batch(spark):
    rows = traffic(bad=False)
    got = sample_latest(spark.createDataFrame(rows, MESSAGE_SCHEMA))
    assert sorted(r.seq for r in got.collect()) == latest_per_interval(rows, 10)


def test_sample_latest_keeps_topics_apart(spark):
    rows = [message("a", 1, 1), message("b", 2, 2), message("a", 1, 3)]
    got = sample_latest(spark.createDataFrame(rows, MESSAGE_SCHEMA)).collect()
    assert sorted((r.topic, r.seq) for r in got) == [("a", 3), ("b", 2)]


def run_parts(spark, tmp_path, parts, **args):
    """Land the parts one after the other, with a run of the stream after each."""
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    for part in parts:
        land(spark, source, part)
        ingest(spark, source, out, checkpoint, trigger=ONCE, **args).awaitTermination()
    ingest(spark, source, out, checkpoint, trigger=ONCE, **args).awaitTermination()
    return out


def written(spark, out, table="power_meter"):
    return sorted(r.id for r in read_table(spark, out, table).select("id").collect())


def test_sampled_ingest_in_any_order(spark, tmp_path):
    """Files come late and out of order; every interval has its latest message, the last too."""
    rows = traffic()
    for n, order in enumerate(((0, 1, 2), (2, 0, 1), (1, 2, 0))):
        parts = [rows[:100], rows[100:200], rows[200:]]
        other = [message("other", 5, 9000)]
        out = run_parts(
            spark,
            tmp_path / str(n),
            [parts[k] + other for k in order],
            every="10 seconds",
            slots=("day", "hour", "day")[n],
        )
        assert written(spark, out) == latest_per_interval(rows, 10)


def test_three_messages_write_three_intervals(spark, tmp_path):
    rows = [message(TOPIC_PME5, s, s) for s in (1, 11, 21)]
    assert written(spark, run_parts(spark, tmp_path / "a", [rows], every="10 seconds")) == [1, 11, 21]
    out = run_parts(spark, tmp_path / "b", [rows], min_gap_seconds=10)
    assert written(spark, out) == [1, 11, 21]


def test_late_files_after_a_fast_clock(spark, tmp_path):
    """A far later time does not close what is older."""
    parts = [
        [message(TOPIC_PME5, s, s) for s in (1, 11, 21)],
        [message(TOPIC_PME5, s, s) for s in (30, 900)],
        [message(TOPIC_PME5, s, s) for s in (45, 62)],
    ]
    out = run_parts(spark, tmp_path, parts, every="10 seconds")
    assert written(spark, out) == [1, 11, 21, 30, 45, 62, 900]


def test_a_replaced_message_takes_its_temperature_with_it(spark, tmp_path):
    temp = {"PME5": [{"server_name": "E5CC", "name": "T", "data": "[0,25]"}]}
    first = [message(TOPIC_PME5, 1, 1, json.dumps(temp)), message(TOPIC_PME5, 11, 2)]
    out = run_parts(spark, tmp_path, [first, [message(TOPIC_PME5, 3, 3)]], every="10 seconds")
    assert written(spark, out) == [2, 3]
    assert written(spark, out, "temp_control") == []


def test_sampling_by_key(spark, tmp_path):
    rows = [message(TOPIC_PME5, s, s) for s in range(20)]
    out = run_parts(spark, tmp_path, [rows], every="10 seconds", keys=("topic", "seq % 2"))
    assert written(spark, out) == [8, 9, 18, 19]


def test_spacing_equals_sequential_loop(spark):
    """Two topics in one batch."""
    rows = traffic(bad=False)
    twin = [("b", p, ts, seq) for _, p, ts, seq in traffic(120, seed=5, bad=False)]
    got = sample_spacing(spark.createDataFrame(rows + twin, MESSAGE_SCHEMA).repartition(5)).collect()
    for topic, sent in ((TOPIC_PME5, rows), ("b", twin)):
        found = sorted((int(seconds(r.written_at)), r.seq) for r in got if r.topic == topic)
        assert found == spaced(sent, 10)


def test_spaced_ingest_over_several_runs(spark, tmp_path):
    """Three files one after the other, so writes fall due between batches, in two keys."""
    rows = traffic(bad=False)
    keys = ("topic", "seq % 2")
    out = run_parts(
        spark, tmp_path, [rows[:100], rows[100:200], rows[200:]], min_gap_seconds=10, keys=keys
    )
    want = [seq for k in (0, 1) for _, seq in spaced([r for r in rows if r[3] % 2 == k], 10)]
    assert written(spark, out) == sorted(want)
    assert spark.read.parquet(f"{out}/late").count() == 0


def test_what_comes_too_late_for_the_spacing_is_visible(spark, tmp_path):
    parts = [
        [message(TOPIC_PME5, s, s) for s in (1, 21, 41)],
        [message(TOPIC_PME5, 900, 900)],
        [message(TOPIC_PME5, s, s) for s in (61, 81)],
    ]
    out = run_parts(spark, tmp_path, parts, min_gap_seconds=10)
    assert written(spark, out) == [1, 21, 41, 900]
    assert sorted(r.seq for r in spark.read.parquet(f"{out}/late").collect()) == [61, 81]


def test_topics_share_the_tables(spark, tmp_path):
    """Two streams write the same days of the same tables without replacing each other."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    device_list = json.dumps(
        {
            "data": [
                {"name": "Power Meter 2", "values": [{"name": "KW", "raw_data": 3}]},
                {"name": "Temperature 1", "values": [{"name": "T", "raw_data": 31.5}]},
            ]
        }
    )
    bad = message(TOPIC_DEVICE_LIST, 4, 4, "{")
    land(
        spark,
        source,
        [
            message(TOPIC_PME5, 1, 1),
            message(TOPIC_PME5, 200, 2),
            message(TOPIC_DEVICE_LIST, 3, 3, device_list),
            bad,
        ],
    )
    for topic in (TOPIC_PME5, TOPIC_DEVICE_LIST):
        for _ in range(2):
            ingest(spark, source, out, f"{tmp_path}/{topic}", topic, trigger=ONCE).awaitTermination()
    power = read_table(spark, out, "power_meter").collect()
    assert sorted((r.id, r.no_device, str(r.dt)) for r in power) == [
        (1, 1, "2024-01-01"),
        (2, 1, "2024-01-02"),
        (3, 2, "2024-01-01"),
    ]
    assert [r.temp for r in read_table(spark, out, "temp_control").collect()] == [31.5]
    quarantine(
        spark, source, out, f"{tmp_path}/quarantine", TOPIC_DEVICE_LIST, trigger=ONCE
    ).awaitTermination()
    assert [r.seq for r in spark.read.parquet(f"{out}/quarantine").collect()] == [4]
    create_tables(spark, out)
    create_tables(spark, out)
    assert spark.table("power_meter").where("dt = DATE'2024-01-01'").count() == 2
    for table in ("power_meter", "temp_control"):
        spark.sql(f"DROP TABLE {table}")


def test_a_repeated_batch_is_written_once(spark, tmp_path, monkeypatch):
    """The second table fails in the first attempt; the batch is then repeated."""
    import meterlens.streaming.ingest as module

    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    temp = {"server_name": "E5CC", "name": "T", "data": "[0,25]"}
    land(spark, source, [message(TOPIC_PME5, s, s, json.dumps({"PME5": [temp]})) for s in range(20)])
    write, calls = module.write_readings, []

    def failing(df, path, batch):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("disk full")
        write(df, path, batch)

    monkeypatch.setattr(module, "write_readings", failing)
    with pytest.raises(Exception, match="disk full"):
        ingest(spark, source, out, checkpoint, trigger=ONCE).awaitTermination()
    ingest(spark, source, out, checkpoint, trigger=ONCE).awaitTermination()
    assert len(calls) == 4
    for table in ("power_meter", "temp_control"):
        assert read_table(spark, out, table).count() == 20


def test_ingest_arguments(spark, tmp_path):
    where = [f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint")]
    with pytest.raises(ValueError):
        ingest(spark, *where, topic="weather")
    with pytest.raises(ValueError):
        ingest(spark, *where, every="10 seconds", min_gap_seconds=10)


def test_json_landing(spark, tmp_path):
    rows = [message(TOPIC_PME5, 1, 1), message("other", 2, 2)]
    spark.createDataFrame(rows, MESSAGE_SCHEMA).write.json(f"{tmp_path}/in")
    got = read_messages(spark, f"{tmp_path}/in", TOPIC_PME5, "json")
    assert [r.volt1 for r in decode_pme5(got).power.collect()] == [1.0]


def test_json_rows(spark):
    df = spark.sql("SELECT 'a' AS label, CAST(NULL AS DOUBLE) AS value")
    assert json_rows(df).collect()[0].json == '{"label":"a","value":null}'


def test_scratch_is_the_shared_folder_if_there_is_one(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first.startswith(f"{shared}/x-") and first != second


def test_scratch_folders_are_cleared(spark, monkeypatch):
    from meterlens.sources import scratch

    monkeypatch.setattr(scratch, "_named", {})  # not those of other tests
    folders = [scratch_dir(spark, "x") for _ in range(2)]
    spark.range(3).write.parquet(folders[0])
    assert scratch.clear_scratch(spark) == 2 and scratch.clear_scratch(spark) == 0
    assert not any(exists(spark, f) for f in folders)


def test_unreadable_messages_of_the_same_parse(spark, tmp_path):
    rows = traffic()
    bad = sorted(r[3] for r in rows if r[1] == "{")
    for n, sampling in enumerate(({}, {"every": "10 seconds"}, {"min_gap_seconds": 10})):
        out = run_parts(
            spark, tmp_path / str(n), [rows[:150], rows[150:]], keep_unreadable=True, **sampling
        )
        assert sorted(r.seq for r in spark.read.parquet(f"{out}/unreadable").collect()) == bad
    assert written(spark, f"{tmp_path}/1/out") == latest_per_interval(rows, 10)


def test_a_late_message_after_compaction(spark, tmp_path):
    """Rows of the compacted batch go when their slot is written again, also if nothing is left."""
    rows = [message(TOPIC_PME5, s, s) for s in range(100, 105)]
    out = run_parts(spark, tmp_path, [rows], every="1 second")
    day = T0.date()
    compact(spark, out, "power_meter", day)
    assert written(spark, out) == [100, 101, 102, 103, 104]
    out = run_parts(spark, tmp_path, [[message(TOPIC_PME5, 102.5, 200)]], every="1 second")
    assert written(spark, out) == [100, 101, 103, 104, 200]
    # A second slot of that day: nothing of it was compacted.
    late = Mode.day(day)
    assert sorted(r.id for r in read_table(spark, out, "power_meter", late).collect()) == [100, 101, 103, 104, 200]
    compact(spark, out, "power_meter", day)
    assert written(spark, out) == [100, 101, 103, 104, 200]
    assert not exists(spark, f"{out}/_late/power_meter/dt={day}")


def test_a_compacted_temperature_goes_with_its_message(spark, tmp_path):
    temp = {"PME5": [{"server_name": "E5CC", "name": "T", "data": "[0,25]"}]}
    first = [message(TOPIC_PME5, 1, 1, json.dumps(temp))]
    out = run_parts(spark, tmp_path, [first], every="10 seconds")
    for table in ("power_meter", "temp_control"):
        compact(spark, out, table, T0.date())
    assert written(spark, out, "temp_control") == [1]
    out = run_parts(spark, tmp_path, [[message(TOPIC_PME5, 3, 3)]], every="10 seconds")
    assert written(spark, out) == [3] and written(spark, out, "temp_control") == []
    create_tables(spark, out, [T0.date()])
    try:
        assert spark.table("power_meter").count() == 1 and spark.table("temp_control").count() == 0
    finally:
        for table in ("power_meter", "temp_control"):
            spark.sql(f"DROP TABLE {table}")


def test_both_tables_of_a_batch_or_neither(spark, tmp_path, monkeypatch):
    """A failure between the two writes shows nothing of the batch; one after the commit all of it."""
    import meterlens.streaming.ingest as module

    temp = {"server_name": "E5CC", "name": "T", "data": "[0,25]"}

    def sent(*numbers):
        return [message(TOPIC_PME5, s, s, json.dumps({"PME5": [temp]})) for s in numbers]

    def both():
        return [written(spark, out, t) for t in ("power_meter", "temp_control")]

    out = run_parts(spark, tmp_path, [sent(1, 2)])
    write, publish, calls = module.write_readings, Unit.publish, []

    def failing(df, path, batch):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("disk full")
        write(df, path, batch)

    monkeypatch.setattr(module, "write_readings", failing)
    with pytest.raises(Exception, match="disk full"):
        run_parts(spark, tmp_path, [sent(3, 4)])
    assert both() == [[1, 2], [1, 2]]

    def stopped(unit):
        raise RuntimeError("stopped")

    monkeypatch.setattr(Unit, "publish", stopped)
    with pytest.raises(Exception, match="stopped"):
        run_parts(spark, tmp_path, [])
    assert both() == [[1, 2, 3, 4], [1, 2, 3, 4]]
    monkeypatch.setattr(Unit, "publish", publish)
    run_parts(spark, tmp_path, [])
    assert both() == [[1, 2, 3, 4], [1, 2, 3, 4]]
    assert names_in(spark, f"{out}/_staged") == []


def latest_per_hour(rows):
    best = {}
    for _, _, ts, seq in rows:
        slot = ts.replace(minute=0, second=0, microsecond=0)
        best[slot] = max(best.get(slot, (ts, seq)), (ts, seq))
    return sorted(seq for _, seq in best.values())


def test_a_batch_reads_its_own_slots(spark, tmp_path, monkeypatch):
    import meterlens.streaming.ingest as module

    rows = [message(TOPIC_PME5, 3600 * n, n) for n in range(50)]
    out = run_parts(spark, tmp_path, [rows], every="1 hour", slots="hour")
    kept, read = module._kept_slots, []

    def seen(spark, work, slots, like):
        found = kept(spark, work, slots, like)
        read.extend(found.inputFiles())
        return found

    monkeypatch.setattr(module, "_kept_slots", seen)
    run_parts(spark, tmp_path, [[message(TOPIC_PME5, 3600 * 20 + 1, 100)]], every="1 hour", slots="hour")
    assert len({path.split("slot=")[1][:10] for path in read}) == 1
    assert written(spark, out) == [n for n in range(50) if n != 20] + [100]
    # Closed slots are found by a message that comes for them, and by no other.
    checkpoint = f"{tmp_path}/checkpoint"
    assert module.close_slots(spark, checkpoint, date(2024, 1, 3)) == 25
    late = [message(TOPIC_PME5, 3600 * 10 - 60, 300), message(TOPIC_PME5, 3600 * 12, 301)]
    run_parts(spark, tmp_path, [late], every="1 hour", slots="hour")
    assert written(spark, out) == latest_per_hour(rows + [message(TOPIC_PME5, 3600 * 20 + 1, 100), *late])


def test_batches_bounded_by_bytes_and_archived(spark, tmp_path):
    source, out, checkpoint, archive = (f"{tmp_path}/{n}" for n in ("in", "out", "check", "old"))
    large = [message(TOPIC_PME5, n, n) for n in range(5000)]
    spark.createDataFrame(large, MESSAGE_SCHEMA).coalesce(1).write.parquet(source)
    for n in range(6):
        small = [message(TOPIC_PME5, 6000 + n, 6000 + n)]
        spark.createDataFrame(small, MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(source)
    options = {"max_bytes_per_trigger": 20_000, "archive_dir": archive}
    query = ingest(spark, source, out, checkpoint, trigger=ONCE, **options)
    query.awaitTermination()
    batches = {batch for _, batch in batch_folders(spark, f"{out}/power_meter")}
    assert len(batches) >= 2
    assert read_table(spark, out, "power_meter").count() == 5006
    # Files of a batch are moved when a later batch has begun.
    ingest(spark, source, out, checkpoint, trigger=ONCE, **options).awaitTermination()
    left = [n for n in names_in(spark, source, "part-")]
    assert len(left) < 7


def test_one_key_is_spaced_by_many_tasks(spark, tmp_path, request):
    """Dense and sparse stretches of one key, cut into short segments."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is tiny
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rng = random.Random(8)
    for gap in (1, 7, 40):
        at, times = 0, []
        for _ in range(3000):
            at += rng.choice((1, 1, 1, 2, 3, gap, gap + 1, 3 * gap, 200))
            times.append(at)
        table = spark.createDataFrame([("k", t, None) for t in times], "key string, tick long, last long")
        work = f"{tmp_path}/{gap}"
        got = chosen(table.repartition(7), gap, 50, work).collect()
        want = spaced([("k", "", T0 + timedelta(seconds=t - 1), t) for t in times], gap)
        assert sorted((r.due, r.tick) for r in got) == want
        segments = spark.read.parquet(work).select("part", "ticks").collect()
        assert len({r.part for r in segments}) >= 4
        assert max(len(r.ticks) for r in segments) <= max(50, 4 * gap)
        assert sum(r.kind == "open" for r in got) == 1


def test_spacing_over_steps_in_short_segments(spark):
    """State of the step before, messages before it, and of its second."""
    rng = random.Random(9)
    rows = traffic(400, seed=12, bad=False)
    rows = [(t, p, ts, seq) for t, p, ts, seq in rows]
    keys = ("topic", "seq % 3")
    frame = spark.createDataFrame(rows, MESSAGE_SCHEMA)
    cut = [0, 130, 131, 300, 400]
    state, found = None, []
    for begin, end in zip(cut, cut[1:], strict=False):
        part = spark.createDataFrame(rng.sample(rows[begin:end], end - begin), MESSAGE_SCHEMA)
        step = space(ticks(part, keys), state, 10, 5).collect()
        found += [(r.due, r.seq) for r in step if r.kind == "written"]
        assert not [r for r in step if r.kind == "late"]
        state = spark.createDataFrame(
            [r for r in step if r.kind == "open"], space(ticks(frame, keys), None, 10).schema
        )
    found += [(r.due, r.seq) for r in state.collect()]
    base = int(T0.replace(tzinfo=UTC).timestamp())
    want = []
    for k in range(3):
        want += spaced([r for r in rows if r[3] % 3 == k], 10)
    assert sorted((due - base, seq) for due, seq in found) == sorted(want)
