"""Reading tables on storage.

Layout: ``<root>/<table>/dt=<day>/batch=<key>/*.parquet``. The day comes first, so a
time window prunes folders; the batch key makes a repeated write of the same batch
replace its own files and nothing else.

Batches of several tables that belong together are a :class:`Unit`. Its folders are written beside the
tables, under ``_staged``; a marker makes all of them count at once, and then they are moved to
their places. Until that is done, :func:`read_table` takes them from where they are.

:func:`compact` makes one batch of those of a day; each row keeps the key of the batch that it came
from, as ``origin``. When such a batch is written again later, rows of the compacted one
with its key no longer count, and the next call of ``compact`` drops them. ``_late`` names the days
with such batches, so that no other day is looked at more closely.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.plans.modes import Mode
from meterlens.schema import POWER_SCHEMA, TEMP_SCHEMA

TABLES: dict[str, T.StructType] = {"power_meter": POWER_SCHEMA, "temp_control": TEMP_SCHEMA}
PARTITIONS = T.StructType([T.StructField("dt", T.DateType()), T.StructField("batch", T.StringType())])


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


#: The batch of a compacted day, and the column with the key of the batch that a row came from.
COMPACTED, ORIGIN = "compacted", "origin"


def read_table(spark: SparkSession, root: str, table: str, mode: Mode | None = None) -> DataFrame:
    """Reading table with its ``dt`` column. The schema is given, so no file is opened to infer
    it. With a ``mode`` only the folders of its days are listed, however many days the table
    has; without one, and for a month of any year, all are."""
    path = table_path(root, table)
    schema = T.StructType(TABLES[table].fields + PARTITIONS.fields)
    changed, late = _pending(spark, root, table), _late_days(spark, root, table)
    if not changed and not late and (mode is None or mode.lo is None):
        return spark.read.schema(schema).option("basePath", path).parquet(path).drop("batch")
    days = {day for day in [*names_in(spark, path, "dt="), *(day for day, _ in changed)]}
    if mode is not None and mode.lo is not None:
        # A day more on either side, for windows in another time zone.
        first = mode.lo - timedelta(days=1)
        days = {d for d in days if str(first) <= d and (not mode.hi or d <= str(mode.hi))}
    special = days & (late | {day for day, _ in changed})
    rows = _special_days(spark, root, table, special, changed).drop("batch", ORIGIN)
    folders = [f"{path}/dt={day}" for day in sorted(days - special)]
    if folders:
        plain = spark.read.schema(schema).option("basePath", path).parquet(*folders).drop("batch")
        rows = plain.unionByName(rows) if special else plain
    return rows


def _special_days(
    spark: SparkSession,
    root: str,
    table: str,
    days: Iterable[str],
    changed: dict[tuple[str, str], str | None],
) -> DataFrame:
    """Rows of days with batches that are not yet in place or replace rows of a compacted one, with
    their batch and origin."""
    path = table_path(root, table)
    fields = [*TABLES[table].fields, T.StructField(ORIGIN, T.StringType()), *PARTITIONS.fields]
    schema = T.StructType(fields)
    live: list[str] = []
    staged: dict[str, list[str]] = {}
    replaced: list[tuple[str, str]] = []
    for day in sorted(days):
        here = {(day, batch) for batch in names_in(spark, f"{path}/dt={day}", "batch=")}
        for key in sorted(here | {k for k in changed if k[0] == day}):
            folder = changed[key] if key in changed else f"{path}/dt={day}/batch={key[1]}"
            if key[1] != COMPACTED and (key not in changed or folder != _MERGED):
                replaced.append(key)
            if folder is None or folder == _MERGED:
                continue
            if key in changed:
                staged.setdefault(folder, []).append(f"{folder}/dt={day}/batch={key[1]}")
            elif not exists(spark, f"{folder}/{_GONE}"):
                live.append(folder)
    rows = spark.createDataFrame([], schema)
    for base, folders in [(path, live), *staged.items()]:
        if folders:
            reader = spark.read.schema(schema).option("basePath", base)
            rows = rows.unionByName(reader.parquet(*folders))
    if not replaced:
        return rows
    keys = spark.createDataFrame(
        [(COMPACTED, date.fromisoformat(day), batch) for day, batch in replaced if day[0] != "_"],
        f"batch string, dt date, {ORIGIN} string",
    )
    return rows.join(keys, ["batch", "dt", ORIGIN], "left_anti").select(schema.names)


#: Says of a batch without rows that it replaces those of a compacted one.
_GONE = "_gone"
_COMMITTED = "_COMMITTED"
#: Stands for the folder of a batch that has been compacted, but not yet removed.
_MERGED = "merged"


class Unit:
    """Batches of one or both tables that become visible together, or not at all.

    Rows are written below ``path`` as ``<table>/dt=.../batch=...`` by :func:`write_readings`. A unit
    that was stopped before its commit is written anew, one that was stopped after it is only moved
    to its place."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = f"{self.root}/_staged/{name}"
        self.marker = f"{self.path}/{_COMMITTED}"

    @property
    def committed(self) -> bool:
        return exists(self.spark, self.marker)

    def begin(self) -> None:
        """Drop what an attempt without a commit has left."""
        remove(self.spark, [self.path])

    def table(self, name: str) -> str:
        return f"{self.path}/{name}"

    def days(self, gone: Iterable[tuple[str, date | str, str]] = ()) -> dict[str, set[date]]:
        """The days that the unit changes, by table."""
        out = {}
        for table in TABLES:
            days = {day for day, _ in batch_folders(self.spark, self.table(table))}
            days |= {str(day) for t, day, _ in gone if t == table}
            out[table] = {date.fromisoformat(d) for d in days if d[0] != "_"}
        return out

    def gone(self) -> list[tuple[str, str, str]]:
        """Batches without rows of a committed unit."""
        return json.loads(_read_text(self.spark, self.marker))["gone"]

    def commit(
        self, gone: Iterable[tuple[str, date | str, str]] = (), merged: dict[str, list[str]] | None = None
    ) -> None:
        """Make the unit count. ``gone`` names (table, day, batch) that have no rows any more, and
        ``merged`` files by folder (below the root) whose rows are in the unit."""
        gone = [(table, str(day), batch) for table, day, batch in gone]
        for table in TABLES:
            days = {day for day, batch in self._folders(table) if batch != COMPACTED}
            days |= {day for t, day, _ in gone if t == table}
            for day in days & set(names_in(self.spark, f"{self.root}/_compacted/{table}", "dt=")):
                block(self.spark, f"{self.root}/_late/{table}/dt={day}")
        _write_text(self.spark, self.marker, json.dumps({"gone": gone, "merged": merged or {}}))
        self.publish()

    def _folders(self, table: str) -> list[tuple[str, str]]:
        return batch_folders(self.spark, self.table(table))

    def publish(self) -> None:
        """Move the folders of a committed unit to their places. May be repeated."""
        said = json.loads(_read_text(self.spark, self.marker))
        for folder, files in said["merged"].items():
            if set(names_in(self.spark, f"{self.root}/{folder}")) <= set(files):
                remove(self.spark, [f"{self.root}/{folder}"])
        for table, day, batch in said["gone"]:
            folder = f"{self.root}/{table}/dt={day}/batch={batch}"
            remove(self.spark, [folder])
            if exists(self.spark, f"{self.root}/_compacted/{table}/dt={day}"):
                block(self.spark, f"{folder}/{_GONE}")
        for table in TABLES:
            for day, batch in self._folders(table):
                target = f"{self.root}/{table}/dt={day}/batch={batch}"
                remove(self.spark, [target])
                move_folder(self.spark, f"{self.table(table)}/dt={day}/batch={batch}", target)
        remove(self.spark, [self.path])


def _pending(spark: SparkSession, root: str, table: str) -> dict[tuple[str, str], str | None]:
    """(day, batch) of units that count but are not in place yet: the folder above their days, None
    for batches without rows, and ``_MERGED`` for those that are part of a compacted one."""
    found: dict[tuple[str, str], str | None] = {}
    root = root.rstrip("/")
    for name in names_in(spark, f"{root}/_staged"):
        unit = Unit(spark, root, name)
        if not unit.committed:
            continue
        said = json.loads(_read_text(spark, unit.marker))
        for folder, files in said["merged"].items():
            where, day, batch = folder.split("/")
            if where == table and set(names_in(spark, f"{root}/{folder}")) <= set(files):
                found[day.removeprefix("dt="), batch.removeprefix("batch=")] = _MERGED
        found |= {(day, batch): None for where, day, batch in said["gone"] if where == table}
        found |= dict.fromkeys(unit._folders(table), unit.table(table))
    return found


def _late_days(spark: SparkSession, root: str, table: str) -> set[str]:
    """Compacted days to which batches were written since."""
    return set(names_in(spark, f"{root.rstrip('/')}/_late/{table}", "dt="))


def compact(spark: SparkSession, root: str, table: str, day: date) -> None:
    """Make one batch of all batches of a day. Streams may still write to the day: a batch that is
    written again takes the place of its rows. Readers see the day as it was or as it is then. A call
    that was stopped is taken up by the next call for that day."""
    root = root.rstrip("/")
    unit = Unit(spark, root, f"compact-{table}-{day}")
    if unit.committed:
        unit.publish()
    unit.begin()
    folder = f"{table}/dt={day}"
    merged = {
        f"{folder}/batch={batch}": names_in(spark, f"{root}/{folder}/batch={batch}")
        for batch in names_in(spark, f"{root}/{folder}", "batch=")
    }
    if not merged:
        return
    changed = {k: v for k, v in _pending(spark, root, table).items() if k[0] == str(day)}
    if changed:
        raise ValueError(f"{day} has batches that are being written; repeat these first")
    rows = _special_days(spark, root, table, [str(day)], {})
    rows = rows.select(*TABLES[table].names, F.coalesce(ORIGIN, "batch").alias(ORIGIN))
    rows.repartitionByRange("no_device", "timestamp").sortWithinPartitions(
        "no_device", "timestamp"
    ).write.mode("overwrite").parquet(f"{unit.table(table)}/dt={day}/batch={COMPACTED}")
    own = f"{folder}/batch={COMPACTED}"
    block(spark, f"{root}/_compacted/{table}/dt={day}")
    unit.commit(merged={name: files for name, files in merged.items() if name != own})
    if not [b for b in names_in(spark, f"{root}/{folder}", "batch=") if b != COMPACTED]:
        remove(spark, [f"{root}/_late/{table}/dt={day}"])


def write_readings(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Write rows as one batch, or without ``batch`` as those that a column of this name
    gives. Only the (dt, batch) folders present in ``df`` are replaced, so writing the same
    batch again does not duplicate rows. Within a file the rows are ordered by device and
    time, so that a device filter skips pages."""
    rows = df if batch is None else df.withColumn("batch", F.lit(batch))
    (
        rows.withColumn("dt", F.to_date("timestamp"))
        .sortWithinPartitions("dt", "batch", "no_device", "timestamp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt", "batch")
        .parquet(path)
    )


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the storage that it names."""
    return bool(_files(spark, path).exists(_path(spark, path)))


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders; those that do not exist are passed over."""
    for path in paths:
        _files(spark, path).delete(_path(spark, path), True)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    # Spark itself has no call to list, move or delete folders.
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """What a folder holds, by one listing: names with a prefix, without it."""
    if not exists(spark, folder):
        return []
    names = [s.getPath().getName() for s in _files(spark, folder).listStatus(_path(spark, folder))]
    return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix) and not n.endswith(".crc"))


def batch_folders(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(day, batch) of all folders of a table, by one listing."""
    found = _files(spark, path).globStatus(_path(spark, f"{path}/dt=*/batch=*"))
    folders = [s.getPath() for s in found or ()]
    return sorted(
        (f.getParent().getName().removeprefix("dt="), f.getName().removeprefix("batch="))
        for f in folders
    )


def block(spark: SparkSession, path: str) -> None:
    """An empty file."""
    _write_text(spark, path, "")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    part = f"{path}.part"
    stream = _files(spark, path).create(_path(spark, part), True)
    stream.write(bytearray(text.encode()))
    stream.close()
    move_folder(spark, part, path)


def _read_text(spark: SparkSession, path: str) -> str:
    stream = _files(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def move_folder(spark: SparkSession, path: str, target: str) -> None:
    files = _files(spark, path)
    files.mkdirs(_path(spark, target).getParent())
    remove(spark, [target])
    if not files.rename(_path(spark, path), _path(spark, target)):
        raise OSError(f"could not move {path}")


def create_tables(
    spark: SparkSession,
    root: str,
    days: Iterable[date] | None = None,
    database: str | None = None,
) -> None:
    """Register ``power_meter`` and ``temp_control`` over ``root`` (in the current database unless
    one is named) unless they exist, and pick up the partitions of the given days, for example
    those of a batch; without days those of the whole table, which lists it. SQL sees all folders
    that are in place, so days with batches behind a compaction are compacted again first."""
    days = None if days is None else list(days)
    for table, schema in TABLES.items():
        columns = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields + PARTITIONS.fields
        )
        path = table_path(root, table)
        name = table if database is None else f"{database}.{table}"
        for day in sorted(_late_days(spark, root, table)):
            if days is None or date.fromisoformat(day) in days:
                compact(spark, root, table, date.fromisoformat(day))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"PARTITIONED BY (dt, batch) LOCATION '{path}'"
        )
        if days is None:
            if exists(spark, path):
                spark.sql(f"MSCK REPAIR TABLE {name}")
            continue
        parts = [
            f"PARTITION (dt=DATE'{day}', batch='{batch}')"
            for day in days
            for batch in names_in(spark, f"{path}/dt={day}", "batch=")
        ]
        if parts:
            spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {' '.join(parts)}")


def json_rows(df: DataFrame) -> DataFrame:
    """The result rows as JSON objects in one ``json`` column; NULL values are kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
