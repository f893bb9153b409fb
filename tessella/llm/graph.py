"""Connected components of links by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, work: common.Scratch | None = None) -> DataFrame:
    """(node, root) for every node of links(u, v), where root is the least node of its component.

    Each pass is partially aggregated and joins on a node, so that a node with very many links is split by the skew join;
    the number of passes grows with the logarithm of the longest chain. Links of a node to itself are allowed.
    """
    work = work or common.Scratch(links.sparkSession)
    edges = work.write(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "graph-links")
    before, now = None, _state(edges)
    while now != before and now[0]:
        # large star: every neighbour above a node points to the node's least neighbour
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its lesser neighbours point to the least of them
        large = work.write(large, "graph-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        small = work.write(small, "graph-small")
        work.release(edges, large)
        edges, before = small, now
        now = _state(edges)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
