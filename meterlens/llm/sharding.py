"""Weighted rendezvous hashing of stable record keys, and gapless slots in each shard.

Every shard draws a number from the key and its own name, and the shard with the highest score
gets the record. A new shard can only win records, never move them between older ones.

All expressions are Spark's own. Null keys are a key like any other and go to one shard; null
texts have no bytes. Repeated rows get the same shard and a slot each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlens.llm.common import free_name, stored

#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on the key and the shard only."""
    bits = F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(shard)), 11)
    return (bits + 0.5) * 2.0**-53


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """Higher wins; shards win in proportion to their weights."""
    return F.lit(-float(weight)) / F.ln(draw(key, shard))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key. Shards are numbered from 0; weights must be positive, and a shard
    keeps its number when others are added behind it."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    scores = F.array(*[score(key, n, w) for n, w in enumerate(weights)])
    return F.aggregate(
        F.array(scores), F.lit(0), lambda _, s: (F.array_position(s, F.array_max(s)) - 1).cast("int")
    )


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def assign(
    docs: DataFrame,
    weights: Sequence[float],
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: the key, size, text_crc32 (0 without a text), shard, grown_shard
    (with one more shard of the first one's weight) and slot (0, 1, ... in each shard).

    Slots need a count of what comes before a row in its shard. The narrow rows are written
    once; each then knows the task that wrote it, so counts per shard and task give the first
    slot of every such part, and rows are only numbered within their part. No task gets a
    whole shard."""
    placed = rendezvous(F.col(key), weights)
    grown = score(F.col(key), len(weights), weights[0])
    rows = docs.select(
        F.col(key).alias("doc_id"),
        record_size(F.col(text)).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        placed.alias("shard"),
        F.array_max(F.array(*[score(F.col(key), n, w) for n, w in enumerate(weights)])).alias("best"),
        grown.alias("new"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = stored(
        rows.withColumn(
            "grown_shard", F.when(F.col("new") > F.col("best"), len(weights)).otherwise(F.col("shard"))
        ).drop("best", "new"),
        "sharded",
    )
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = (
        rows.groupBy("shard", "part")
        .agg(F.count("*").alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    within = F.row_number().over(W.partitionBy("shard", "part").orderBy("place"))
    return (
        rows.withColumn("nth", within)
        .join(firsts, ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )


def with_shard(docs: DataFrame, weights: Sequence[float], key: str = "doc_id") -> DataFrame:
    """The documents with their shard in a column that is named ``shard`` or, if there is one,
    ``shard_``."""
    return docs.withColumn(free_name("shard", docs), rendezvous(F.col(key), weights))
