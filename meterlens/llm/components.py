"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (columns a, b): root is the smallest node that
    can be reached. Alternates large stars (each node's larger neighbours move to its smallest
    one) and small stars (smaller neighbours and the node itself do) until nothing changes. Only
    the smallest neighbour of a node is ever aggregated, so a hub needs no special treatment."""
    edges = stored(
        links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        .where("high <> low")
        .distinct(),
        "links",
    )
    mark = _mark(edges)
    while mark[0]:
        edges = stored(_small_star(_large_star(edges)), "stars")
        was, mark = mark, _mark(edges)
        if mark == was:
            break
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number of links and a sum over them that changes with them."""
    return tuple(
        edges.agg(
            F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)"))
        ).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("high", "low").unionByName(
        edges.select(F.col("low").alias("high"), F.col("high").alias("low"))
    )
    least = both.groupBy("high").agg(F.least(F.min("low"), F.col("high")).alias("least"))
    return (
        both.where("low > high")
        .join(least, "high")
        .select(F.col("low").alias("high"), F.col("least").alias("low"))
        .where("high <> low")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    moved = edges.join(least, "high").select(F.col("low").alias("high"), F.col("least").alias("low"))
    kept = least.select("high", F.col("least").alias("low"))
    return moved.where("high <> low").unionByName(kept).distinct()
