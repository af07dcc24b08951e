"""Connected components of a table of links, by alternating stars over Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage


def _state(edges: DataFrame) -> tuple[int, int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).first()
    return int(row[0]), int(row[1]), int(row[2])


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node, itself included) for all nodes of ``links`` (u long, v long).

    Each round hangs every node's larger neighbours on its smallest neighbour, then its smaller ones; the links become
    stars after a number of rounds that grows as the logarithm of the nodes. A node's neighbours only ever meet in a
    minimum, which is pre-aggregated, and in a join that may be split. Self-links, repeats and either direction are
    allowed; an empty table gives an empty result.
    """
    edges = stage(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        # every node with its larger neighbours goes to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), "large-star")
        # then with its smaller ones
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        following = stage(small.where("u <> v").distinct(), "small-star")
        drop_staged(large)
        after = _state(following)
        drop_staged(edges)
        edges = following
        if after == state:
            break
        state = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
