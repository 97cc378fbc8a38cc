"""Helpers of the operators in this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.sources.scratch import scratch_dir

#: Rows in one Arrow batch; with long texts the default of 10,000 is too much for a worker.
ROWS_PER_BATCH = 1000


def free_name(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: lineage ends here, and a lost
    executor costs a read, not the work before."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Memo(dict):
    """Word -> what ``make`` gives for it, computed at first sight. At most ``limit`` words are
    remembered: when half of that is reached, words not seen since the last time are forgotten."""

    def __init__(self, make: Callable, limit: int = 200_000):
        super().__init__()
        self.make, self.limit, self.before = make, limit, {}

    def __missing__(self, word):
        value = self.before.pop(word, None)
        self[word] = value = self.make(word) if value is None else value
        return value

    def trim(self) -> None:
        """To be called now and then, as lookups alone do not forget."""
        if len(self) > self.limit // 2:
            self.before = dict(self)
            self.clear()

    def forget(self) -> None:
        self.before = {}
        self.clear()


def text_slices(column: pa.Array, most: int = 1_000_000) -> Iterator[list[str | None]]:
    """The texts in lists of about ``most`` bytes; one text is never split."""
    part, size = [], 0
    for scalar in column:
        text = scalar.as_py()
        part.append(text)
        size += len(text or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def hex_digest(column) -> F.Column:
    """Lowercase SHA-256 of a string column's UTF-8 bytes."""
    return F.sha2(column.cast("binary"), 256)


#: Rows of two longs that may be broadcast (their number is always counted first).
BROADCAST_ROWS = 1_000_000


def fit_to_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow, stored table for broadcasting if its counted rows are few enough;
    otherwise Spark joins it by shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
