"""Connected components of an edge table, by large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, join_hot


def _to_least(rows: DataFrame, key: str, other: str, total: int) -> DataFrame:
    """``rows`` with m, the smallest of each key and its others; a key of very many rows does not gather them in a task."""
    least = rows.groupBy(key).agg(F.min(other).alias("m"), F.count("*").alias("__n")).withColumn("m", F.least(key, "m"))
    return join_hot(rows, least, key, "__n", total)


def components(edges: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: bigint); root is the component's smallest node.

    Each round links nodes to the smallest node next to them and ends when nothing changes, after about the logarithm of the
    longest path; there is no bound on the rounds. A round writes its edges. Neighbour lists are never gathered and hubs are
    not join keys, so a node may have any number of neighbours. No edges: no rows. Edges with a null end are left out. ``rows`` is a bound of the edges' number, where one is known.
    """
    edges = scratch.write(edges.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges", rows)
    mark, n = None, edges.count()
    while n:
        # Large star: every neighbour that is larger than u links to the smallest of u and its neighbours.
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        large = _to_least(both, "u", "v", 2 * n).where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        large = scratch.write(large, "large", 2 * n)
        # Small star: u and its smaller neighbours link to the smallest of them.
        small = _to_least(large, "hi", "lo", n).select("m", F.explode(F.array("lo", "hi")).alias("v")).where("m != v").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        edges = scratch.write(small, "edges", 2 * n)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.countDistinct("hi")).first()
        if now[0] == now[2] and now == mark:
            break
        mark, n = now, now[0]
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
