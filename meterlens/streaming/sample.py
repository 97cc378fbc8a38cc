"""Down-sampling of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.schema import SAMPLE_INTERVAL


def sample_latest(
    messages: DataFrame, every: str = SAMPLE_INTERVAL, keys: tuple[str, ...] = ("topic",)
) -> DataFrame:
    """The latest message per key and interval, with the interval start as ``window_start``.

    ``keys`` are SQL expressions over the messages, for example the topic and a site. The
    latest row of each interval is found before the shuffle, so a key that carries most of
    the traffic sends on one row per interval and task.
    """
    named = [F.expr(k).alias(f"key{n}") for n, k in enumerate(keys)]
    latest = F.max_by(F.struct(*messages.columns), F.struct("ts", "seq"))
    return (
        messages.groupBy(*named, F.window("ts", every).alias("interval"))
        .agg(latest.alias("latest"))
        .select(F.col("interval.start").alias("window_start"), "latest.*")
    )
