"""Connected components of a table of links, by alternating large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import written


FEW = 100_000  # rows of two longs, counted; at 16 bytes each a megabyte or two


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_033)).first())


def _held(table: DataFrame, few: bool) -> DataFrame:
    return table.coalesce(1) if few else table


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of links(a, b); nodes are longs, rows may repeat or link a node to itself.

    Each step reads and writes rows of two longs. A hub's rows are joined with one row on its key, between two written tables, so Spark
    can split them. Steps grow with the logarithm of the longest path. No step makes more rows than there are; FEW of them or less are held
    in one partition, so that a step is a few tasks instead of shuffles of next to nothing. An empty table gives an empty one.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        few = before[0] <= FEW
        edges = _held(edges, few)
        both = _held(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), few)
        least = _held(written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))), few)
        large = _held(written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()), few)
        least = _held(written(large.groupBy("u").agg(F.min("v").alias("m"))), few)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(_held(small.unionByName(least.select("u", F.col("m").alias("v"))), few).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
