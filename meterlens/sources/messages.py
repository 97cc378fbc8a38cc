"""Landed broker messages: ``(topic, payload, ts, seq)`` rows, read as batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.schema import MESSAGE_SCHEMA


def _options(fmt: str) -> dict[str, str]:
    # A landed JSON line that is itself damaged must not stop the stream.
    return {"mode": "PERMISSIVE"} if fmt == "json" else {}


def read_messages(
    spark: SparkSession, path: str, topic: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    messages = spark.read.schema(MESSAGE_SCHEMA).format(fmt).options(**_options(fmt)).load(path)
    return messages if topic is None else messages.where(F.col("topic") == topic)


def stream_messages(
    spark: SparkSession,
    path: str,
    topic: str | None = None,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: int | None = None,
    archive_dir: str | None = None,
) -> DataFrame:
    """New files of the landing folder. ``max_bytes_per_trigger``, or else ``max_files_per_trigger``,
    bounds a batch; at least one file is in it. Files that were read are moved below ``archive_dir``,
    which must not lie in the landing folder."""
    reader = spark.readStream.schema(MESSAGE_SCHEMA).format(fmt).options(**_options(fmt))
    if max_bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    elif max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if archive_dir is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    messages = reader.load(path)
    return messages if topic is None else messages.where(F.col("topic") == topic)
