"""Keep the latest message, at most one per key and minimum gap.

Unlike fixed intervals, the spacing counts from the last message written: after an idle time
the next message is written at the following one-second tick, and while messages keep coming
the latest one is written every ``min_gap``.

Which ticks are written is found from the ticks alone, without the messages. Ticks are sorted by
ranges of (key, tick), so a key of any size is spread over tasks, and cut into segments of bounded
length. What happens within a segment depends on one number: when the message open behind its first
tick falls due, which is that tick or one of the next ``min_gap - 1`` seconds. So a segment is a map
from each of these to the time due behind its last tick; where ticks lie far enough apart all of them
meet. The maps are followed along each key, one step per segment, and then every segment gives its
writes by itself.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.sources.scratch import scratch_dir
from meterlens.streaming.sample import sample_latest

TICK = "1 second"

#: What the step gives out: writes that are settled, the message of each key that a later one may
#: still replace, and messages that come after what they would have changed is settled.
WRITTEN, OPEN, LATE = "written", "open", "late"
STEP = ["kind", "key", "due", "last", "tick", "topic", "payload", "micros", "seq"]

#: Ticks of a key in one segment, at least; a segment has several times ``min_gap`` of them, so that
#: its map is no longer than itself.
SEGMENT_TICKS = 50_000

_SEGMENT = (
    "part int, place long, key string, ticks array<long>, last long, first long, final long, "
    "dues array<long>, lasts array<long>"
)
_ENTRY = "part int, place long, due long, last long, next long"
_CHOICE = "key string, tick long, kind string, due long, last long"


def ticks(messages: DataFrame, keys: tuple[str, ...] = ("topic",)) -> DataFrame:
    """The latest message per key and second, with the tick that ends the second."""
    key = F.to_json(F.array(*[F.expr(k).cast("string") for k in keys]))
    latest = sample_latest(messages.select("topic", "payload", "ts", "seq", key.alias("key")), TICK, ("key",))
    return latest.select(
        "key",
        (F.unix_seconds(F.col("window_start").cast("timestamp")) + 1).alias("tick"),
        "topic",
        "payload",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        "seq",
    )


def follow(times: list[int], due: int, last: int | None, gap: int):
    """The writes of a segment: (place of the message, time, write before) each, from the time at
    which the message open behind the first tick falls due; the last one is still open."""
    while True:
        behind = bisect_right(times, due)
        yield behind - 1, due, last
        if behind == len(times):
            return
        last, due = due, max(times[behind], due + gap)


def segment_map(times: list[int], gap: int) -> tuple[list[int], list[int | None]]:
    """For each time at which the message behind the first tick may fall due: the time due behind
    the last tick, and the last write settled in the segment, if any."""
    found: dict[int, tuple[int, int | None]] = {}
    for begin in range(times[0], times[0] + gap):
        path, due = [], begin
        while due not in found:
            path.append(due)
            behind = bisect_right(times, due)
            if behind == len(times):
                found[due] = due, None
                path.pop()
                break
            due = max(times[behind], due + gap)
        for before in reversed(path):
            end, last = found[due]
            found[before] = end, before if last is None else last
            due = before
    ends = [found[times[0] + k] for k in range(gap)]
    return [e for e, _ in ends], [last for _, last in ends]


def _segments(gap: int, most: int):
    """Sorted ticks to segments. Only keys that have several, or may have more in another task, need
    maps: the first and the last one of a task, and those that are cut."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        key, times, before, alone = None, [], None, False

        def row(mapped: bool) -> pa.RecordBatch:
            nonlocal place
            dues, lasts = segment_map(times, gap) if mapped else (None, None)
            values = [part, place, key, times, before, times[0], times[-1], dues, lasts]
            place += 1
            return pa.RecordBatch.from_pylist(
                [dict(zip(_names, values, strict=True))], pa.schema(_arrow)
            )

        for batch in batches:
            for now, tick, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if times and now != key:
                    yield row(not alone)
                    times, alone, before = [], True, None
                elif len(times) >= most:
                    yield row(True)
                    times, alone, before = [], False, None
                key, before = now, last if last is not None else before
                times.append(tick)
        if times:
            yield row(True)

    return segments


_arrow = [
    ("part", pa.int32()), ("place", pa.int64()), ("key", pa.string()), ("ticks", pa.list_(pa.int64())),
    ("last", pa.int64()), ("first", pa.int64()), ("final", pa.int64()),
    ("dues", pa.list_(pa.int64())), ("lasts", pa.list_(pa.int64())),
]
_names = [name for name, _ in _arrow]


def _start(first: int, last: int | None, gap: int) -> int:
    return first if last is None else max(first, last + gap)


def _entries(gap: int):
    """The maps of a key's segments, one after the other: when the message behind the first tick of
    each falls due, the write before it, and the first tick of the next one."""

    def entries(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("place", "ascending")])
        rows, out = table.to_pylist(), []
        due, last = _start(rows[0]["first"], rows[0]["last"], gap), rows[0]["last"]
        for n, row in enumerate(rows):
            following = rows[n + 1]["first"] if n + 1 < len(rows) else None
            out.append((row["part"], row["place"], due, last, following))
            at = due - row["first"]
            end = row["dues"][at]
            if row["lasts"][at] is not None:
                last = row["lasts"][at]
            if following is not None:
                # The open message is settled before the next tick, or replaced by it.
                last, due = (end, max(following, end + gap)) if end < following else (last, end)
        kinds = [pa.int32(), *[pa.int64()] * 4]
        columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
        return pa.table(columns, ["part", "place", "due", "last", "next"])

    return entries


def _choices(gap: int):
    """Segments to their writes."""

    def choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                times, due, last = row["ticks"], row["due"], row["before"]
                if due is None:
                    due, last = _start(row["first"], row["last"], gap), row["last"]
                out = [(times[n], WRITTEN, at, was) for n, at, was in follow(times, due, last, gap)]
                tick, _, at, was = out[-1]
                if row["next"] is None:
                    out[-1] = tick, OPEN, at, was
                elif at >= row["next"]:
                    out.pop()
                columns = [pa.array([row["key"]] * len(out), pa.string())]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
                columns += [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "tick", "kind", "due", "last"])

    return choices


def chosen(
    times: DataFrame, gap: int, segment_ticks: int = SEGMENT_TICKS, work: str | None = None
) -> DataFrame:
    """``key, tick, kind, due, last`` of the ticks that are written or left open, from rows of key,
    tick and last (the write before the first tick of a key, if any). Ticks of a key differ. The
    segments are written to the folder ``work`` (a new scratch folder unless given)."""
    spark = times.sparkSession
    most = max(segment_ticks, 4 * gap)
    segments = (
        times.select("key", "tick", "last")
        .repartitionByRange("key", "tick")
        .sortWithinPartitions("key", "tick")
        .mapInArrow(_segments(gap, most), _SEGMENT)
    )
    # The entries are made of the segments and go back to them, so these are made once.
    work = work or scratch_dir(spark, "segments")
    segments.write.mode("overwrite").parquet(work)
    segments = spark.read.schema(_SEGMENT).parquet(work)
    mapped = segments.where("dues IS NOT NULL").drop("ticks")
    entries = mapped.groupBy("key").applyInArrow(_entries(gap), _ENTRY)
    return segments.join(
        entries.withColumnRenamed("last", "before"), ["part", "place"], "left"
    ).select("key", "ticks", "last", "first", "due", "before", "next").mapInArrow(_choices(gap), _CHOICE)


def space(
    arrived: DataFrame,
    state: DataFrame | None,
    min_gap_seconds: int,
    segment_ticks: int = SEGMENT_TICKS,
    work: str | None = None,
) -> DataFrame:
    """The settled writes, the open message of every key, and late messages, as ``STEP`` rows.

    ``arrived`` comes from :func:`ticks`; ``state`` holds the open rows of the step before. A
    key without new messages keeps its open row."""
    gap = min_gap_seconds
    message = ["tick", "topic", "payload", "micros", "seq"]
    none = F.lit(None).cast("long")
    if state is None:
        rows = arrived.select("key", *message, none.alias("last"))
        return _with_messages(rows, gap, segment_ticks, work)
    was = state.select("key", "last", *[F.col(c).alias(f"open_{c}") for c in message])
    # One open row per key: a hot key makes one side skewed only, which a join can split.
    met = arrived.join(was, "key", "left")
    later = met.where("open_tick IS NULL OR tick > open_tick").select("key", *message, none.alias("last"))
    # A message before the open one came too late, unless that would have replaced it anyway.
    due = F.when(F.col("last").isNull(), F.col("tick")).otherwise(
        F.greatest("tick", F.col("last") + gap)
    )
    late = met.where((F.col("tick") < F.col("open_tick")) & (due < F.col("open_tick"))).select(
        F.lit(LATE).alias("kind"), "key", none.alias("due"), "last", *message
    )
    # One of the same second takes the open one's place if it is newer.
    same = met.where("tick = open_tick").select("key", F.struct(*message[1:]).alias("same"))
    newer = F.struct("same.micros", "same.seq") > F.struct("open_micros", "open_seq")

    def either(name: str) -> Column:
        old = F.col(f"open_{name}")
        return F.when(newer, F.col(f"same.{name}")).otherwise(old).alias(name)

    opened = was.join(same, "key", "left").select(
        "key", F.col("open_tick").alias("tick"), *map(either, message[1:]), "last"
    )
    rows = opened.unionByName(later)
    return _with_messages(rows, gap, segment_ticks, work).unionByName(late)


def _with_messages(rows: DataFrame, gap: int, segment_ticks: int, work: str | None) -> DataFrame:
    """The chosen ticks with their messages."""
    found = chosen(rows, gap, segment_ticks, work)
    return rows.drop("last").join(found, ["key", "tick"]).select(*STEP)


def messages_of(step: DataFrame) -> DataFrame:
    """The messages in the rows of a step."""
    return step.select("topic", "payload", F.timestamp_micros("micros").alias("ts"), "seq")


def sample_spacing(
    messages: DataFrame, min_gap_seconds: int = 10, keys: tuple[str, ...] = ("topic",)
) -> DataFrame:
    """``(topic, payload, ts, seq, written_at)`` of a batch, with the writes of a key at least
    ``min_gap_seconds`` apart. For streams see :func:`meterlens.streaming.ingest.ingest`."""
    step = space(ticks(messages, keys), None, min_gap_seconds)
    return step.select(
        "topic",
        "payload",
        F.timestamp_micros("micros").alias("ts"),
        "seq",
        F.timestamp_seconds("due").alias("written_at"),
    )
