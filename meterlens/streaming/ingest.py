"""Streams from landed messages to the reading tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterlens.operators.decode import (
    device_list_power,
    device_list_temp,
    parse_device_list,
    parse_pme5,
    pme5_power,
    pme5_temp,
    unreadable_device_list,
    unreadable_pme5,
    valid_device_list,
    valid_pme5,
)
from meterlens.plans.modes import Mode
from meterlens.plans.rollup import merge_rollup
from meterlens.schema import TOPIC_DEVICE_LIST, TOPIC_PME5
from meterlens.sources.messages import stream_messages
from meterlens.sources.tables import (
    Unit,
    exists,
    move_folder,
    names_in,
    read_table,
    remove,
    table_path,
    write_readings,
)
from meterlens.streaming.sample import sample_latest
from meterlens.streaming.spacing import LATE, OPEN, messages_of, space, ticks

DECODERS = {
    TOPIC_PME5: (parse_pme5, valid_pme5, unreadable_pme5, pme5_power, pme5_temp),
    TOPIC_DEVICE_LIST: (
        parse_device_list,
        valid_device_list,
        unreadable_device_list,
        device_list_power,
        device_list_temp,
    ),
}


# Files of a landing folder in one batch, unless the caller says otherwise: a first run over a
# long backlog works in steps.
FILES_PER_BATCH = 1000


def _decoder(topic: str):
    if topic not in DECODERS:
        raise ValueError(f"unknown topic {topic!r}; expected one of {sorted(DECODERS)}")
    return DECODERS[topic]


def _query_id(messages: DataFrame) -> str:
    """The id of the running stream; it is kept in the checkpoint."""
    return messages.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


#: Folders, and what of the readings is kept there day by day.
Kept = dict[str, Callable[[DataFrame], DataFrame]]


class Writer:
    """Batch writers for ``foreachBatch``. What a batch writes to both tables is one unit: readers see
    all of it or nothing. Its folders have keys made of the query's id and of what they cover, so a
    batch repeated after a failure replaces its own rows and no other query's."""

    def __init__(self, out_dir: str, checkpoint: str, topic: str, kept_up: Kept | None = None):
        self.out_dir, self.work = out_dir, f"{checkpoint.rstrip('/')}/work"
        self.kept_up = kept_up or {}
        self.parse, self.valid, self.unreadable, self.power_of, self.temp_of = _decoder(topic)

    def _tables(self):
        return (("power_meter", self.power_of), ("temp_control", self.temp_of))

    def _unit(self, spark: SparkSession, query: str, number: int) -> Unit | None:
        """The unit of a batch, or None if the batch has been written already; a unit that counts,
        but was not put in place, is."""
        unit = Unit(spark, self.out_dir, f"{query}-{number}")
        if unit.committed:
            days = unit.days(unit.gone())
            unit.publish()
            self._keep_up(spark, days)
            return None
        unit.begin()
        return unit

    def _commit(self, unit: Unit, gone: list[tuple[str, date, str]] | tuple = ()) -> None:
        days = unit.days(gone)
        unit.commit(gone)
        self._keep_up(unit.spark, days)

    def _keep_up(self, spark: SparkSession, days: dict[str, set[date]]) -> None:
        """Compute the changed days of what is kept beside the tables anew, from these days only."""
        for folder, make in self.kept_up.items():
            for table, changed in days.items():
                if changed:
                    window = Mode.range(min(changed), max(changed))
                    readings = read_table(spark, self.out_dir, table, window)
                    merge_rollup(spark, readings, table_path(folder, table), changed, make)

    def _staged(self, spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that is made once, also if the batch is repeated."""
        path = f"{self.work}/{name}"
        if not exists(spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def with_unreadable(
        self, write: Callable[[DataFrame, int], None]
    ) -> Callable[[DataFrame, int], None]:
        """Parsed messages are split: the readable ones go on to ``write``, the others to
        ``<out_dir>/unreadable``, one folder a batch. They are parsed once for all."""

        def split(parsed: DataFrame, number: int) -> None:
            parsed = parsed.persist()
            try:
                folder = f"{self.out_dir}/unreadable/batch={_query_id(parsed)}-{number}"
                self.unreadable(parsed).write.mode("overwrite").parquet(folder)
                write(self.valid(parsed), number)
            finally:
                parsed.unpersist()

        return split

    def every_message(self, messages: DataFrame, number: int) -> None:
        """Each message gives its rows."""
        query = _query_id(messages)
        unit = self._unit(messages.sparkSession, query, number)
        if unit is None:
            return
        # Each task writes a short time range: few files per day, narrow statistics in each,
        # and a day with most of the rows is still split. One shuffle serves both tables.
        ranges = messages.select("message", "seq", "ts").repartitionByRange("ts", "seq").persist()
        try:
            for table, rows_of in self._tables():
                write_readings(rows_of(ranges), unit.table(table), f"{query}-{number}")
        finally:
            ranges.unpersist()
        self._commit(unit)

    def latest(
        self, every: str, keys: tuple[str, ...], slots: str
    ) -> Callable[[DataFrame, int], None]:
        """The latest message of each key and interval, at once and however late others come.

        The slots (days or hours) that a batch touches are found first. What was kept of these, and
        of no others, is read again, merged with the batch, and written in its place, to the kept
        messages and to both tables."""

        def write(messages: DataFrame, number: int) -> None:
            spark, query = messages.sparkSession, _query_id(messages)
            unit = self._unit(spark, query, number)
            if unit is None:
                return
            kept = f"{self.work}/{KEPT}"
            slot = F.date_format(F.date_trunc(slots, "window_start"), "yyyyMMddHH").alias("slot")

            def sampled(rows: DataFrame) -> DataFrame:
                return sample_latest(rows, every, keys).select("*", slot)

            new = self._staged(spark, f"new-{number}", lambda: sampled(messages.drop("payload")))
            touched = [r["slot"] for r in new.select("slot").distinct().collect()]

            def merged() -> DataFrame:
                old = _kept_slots(spark, self.work, touched, new)
                return new if old is None else sampled(new.unionByName(old).drop("window_start", "slot"))

            rows = self._staged(spark, f"merged-{number}", merged)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "slot"
            ).parquet(kept)
            width, gone = timedelta(seconds=_seconds(spark, every)), []
            for table, rows_of in self._tables():
                readings = rows_of(rows, keep=("slot",))
                named = readings.withColumn("batch", F.concat(F.lit(f"{query}-"), "slot"))
                write_readings(named.drop("slot"), unit.table(table))
                # A slot whose rows have all been replaced by messages without such readings.
                there = {
                    (r["day"], r["slot"])
                    for r in readings.select(F.to_date("timestamp").alias("day"), "slot")
                    .distinct()
                    .collect()
                }
                gone += [
                    (table, day, f"{query}-{slot_}")
                    for slot_ in touched
                    for day in _days(slot_, width)
                    if (day, slot_) not in there
                ]
            self._commit(unit, gone)
            remove(spark, [f"{self.work}/{n}-{number - 1}" for n in ("new", "merged")])

        return write

    def spaced(self, min_gap_seconds: int, keys: tuple[str, ...]) -> Callable[[DataFrame, int], None]:
        """Writes of each key at least so far apart. The open message of a key is in the tables
        from the start and is replaced when a later one takes its place; messages that come after
        what they would have changed go to ``<out_dir>/late``."""

        def write(messages: DataFrame, number: int) -> None:
            spark, query = messages.sparkSession, _query_id(messages)
            unit = self._unit(spark, query, number)
            if unit is None:
                return
            before = f"{self.work}/step-{number - 1}"
            state = None
            if number and exists(spark, before):
                state = spark.read.parquet(before).where(F.col("kind") == OPEN)
            segments = f"{self.work}/segments-{number}"
            step = self._staged(
                spark,
                f"step-{number}",
                lambda: space(ticks(messages, keys), state, min_gap_seconds, work=segments),
            )
            late = messages_of(step.where(F.col("kind") == LATE))
            late.write.mode("overwrite").parquet(f"{self.out_dir}/late/batch={query}-{number}")
            named = F.when(F.col("kind") == OPEN, f"{query}-open").otherwise(f"{query}-{number}")
            chosen = step.where(F.col("kind") != LATE)
            rows = chosen.select("topic", "payload", F.timestamp_micros("micros").alias("ts"), "seq", named.alias("batch"))
            parsed, gone = self.valid(self.parse(rows)), []
            for table, rows_of in self._tables():
                readings = rows_of(parsed, keep=("batch",))
                write_readings(readings, unit.table(table))
                if state is not None:
                    opened = readings.where(F.col("batch") == f"{query}-open")
                    days = opened.select(F.to_date("timestamp").alias("day")).distinct()
                    was = state.select(F.to_date(F.timestamp_micros("micros")).alias("day"))
                    left = was.distinct().join(days, "day", "left_anti").collect()
                    gone += [(table, r["day"], f"{query}-open") for r in left]
            self._commit(unit, gone)
            remove(spark, [f"{self.work}/step-{number - 2}", segments])

        return write


#: Folders with the messages kept of each slot, and with those of slots that were closed.
KEPT, CLOSED = "kept", "closed"


def _kept_slots(
    spark: SparkSession, work: str, slots: list[str], like: DataFrame
) -> DataFrame | None:
    """What was kept of some slots; no other folder is read."""
    here = set(names_in(spark, f"{work}/{KEPT}", "slot="))
    rows = None
    for name, wanted in (
        (KEPT, [s for s in slots if s in here]),
        (CLOSED, [s for s in slots if s not in here and exists(spark, f"{work}/{CLOSED}/slot={s}")]),
    ):
        if wanted:
            folders = [f"{work}/{name}/slot={s}" for s in sorted(wanted)]
            reader = spark.read.schema(like.schema).option("basePath", f"{work}/{name}")
            found = reader.parquet(*folders).select(like.columns)
            rows = found if rows is None else rows.unionByName(found)
    return rows


def close_slots(spark: SparkSession, checkpoint: str, before: date) -> int:
    """Put the messages kept of the slots before a day aside, so that the folder of open ones stays
    short; how many slots were. A message that comes for such a slot later finds them there."""
    work, moved = f"{checkpoint.rstrip('/')}/work", 0
    for slot in names_in(spark, f"{work}/{KEPT}", "slot="):
        if slot < before.strftime("%Y%m%d"):
            move_folder(spark, f"{work}/{KEPT}/slot={slot}", f"{work}/{CLOSED}/slot={slot}")
            moved += 1
    return moved


def _seconds(spark: SparkSession, every: str) -> int:
    length = spark.range(1).select(F.expr(f"INTERVAL '{every}'").cast("interval day to second"))
    return int(length.first()[0].total_seconds())


def _days(slot: str, width: timedelta) -> list[date]:
    """The days on which a message of an interval that begins in this slot can lie."""
    first = date(int(slot[:4]), int(slot[4:6]), int(slot[6:8]))
    return [first + timedelta(days=n) for n in range(width.days + 2)]


def ingest(
    spark: SparkSession,
    source_dir: str,
    out_dir: str,
    checkpoint: str,
    topic: str = TOPIC_PME5,
    every: str | None = None,
    min_gap_seconds: int | None = None,
    keys: tuple[str, ...] = ("topic",),
    slots: str = "day",
    trigger: dict | None = None,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = FILES_PER_BATCH,
    keep_unreadable: bool = False,
    max_bytes_per_trigger: int | None = None,
    archive_dir: str | None = None,
    kept_up: Kept | None = None,
) -> StreamingQuery:
    """Decode a topic of a landing folder into the tables under ``out_dir``.

    Unreadable messages are left out first (``keep_unreadable`` writes them to
    ``<out_dir>/unreadable``; see also :func:`quarantine`), then the rest is sampled: ``every`` keeps the latest message per interval, ``min_gap_seconds`` keeps
    writes at least that far apart, neither keeps all. Both sample each key by itself;
    ``keys`` are SQL expressions over topic, payload, ts and seq. Nothing waits for a later
    message, and none is dropped for coming late: an interval's message is replaced when a
    later one turns up, in whichever batch. A failed batch is repeated from the checkpoint.

    ``max_bytes_per_trigger`` bounds a batch by bytes instead of files; files that have been
    read are moved to ``archive_dir`` if given, so that the landing folder stays short.

    ``kept_up`` maps folders to functions of readings, such as ``hourly_rollup`` or ``daily_tops``; with
    each batch the changed days of what they give are computed anew there, for both tables.

    With ``every``, a batch rewrites the ``slots`` that it touches: days, or "hour" where a day's
    intervals of all keys are too many to be written again with each batch.
    """
    if every is not None and min_gap_seconds is not None:
        raise ValueError("give either every or min_gap_seconds")
    if slots not in ("day", "hour"):
        raise ValueError(f"slots must be 'day' or 'hour', got {slots!r}")
    writer = Writer(out_dir, checkpoint, topic, kept_up)
    messages = stream_messages(
        spark, source_dir, topic, fmt, max_files_per_trigger, max_bytes_per_trigger, archive_dir
    )
    readings = writer.parse(messages)
    if every is not None:
        _seconds(spark, every)
        write = writer.latest(every, keys, slots)
    elif min_gap_seconds is not None:
        write = writer.spaced(min_gap_seconds, keys)
    else:
        write = writer.every_message
    if keep_unreadable:
        write = writer.with_unreadable(write)
    else:
        readings = writer.valid(readings)
    stream = (
        readings.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (stream.trigger(**trigger) if trigger is not None else stream).start()


def quarantine(
    spark: SparkSession,
    source_dir: str,
    out_dir: str,
    checkpoint: str,
    topic: str = TOPIC_PME5,
    trigger: dict | None = None,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = FILES_PER_BATCH,
) -> StreamingQuery:
    """Append the unreadable messages of a topic to ``<out_dir>/quarantine``."""
    parse, _, unreadable, _, _ = _decoder(topic)
    messages = stream_messages(spark, source_dir, topic, fmt, max_files_per_trigger)
    writer = (
        unreadable(parse(messages))
        .writeStream.format("parquet")
        .option("path", table_path(out_dir, "quarantine"))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if trigger is not None:
        writer = writer.trigger(**trigger)
    return writer.start()
