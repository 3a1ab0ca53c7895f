"""Connected components by alternating stars, on links that never leave the executors.

Links are pairs of numbers. Repeated links, links in both directions and links of a node with itself change nothing; a null end, or a
node without links, is in no row of the result. Ties can't arise, as a component's label is its smallest number. No links give no rows; columns
beside a and b are not read. Texts are not involved. A node with very many links is one key of a join here; its rows are two numbers each,
and adaptive execution splits them once they are a partition of note.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v) edges with u > v; v ends up as the smaller end."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u != v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = small.unionByName(least.select("u", F.col("m").alias("v")))
    return small.where("u != v").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): for every node of ``links`` (a, b), the smallest node it can reach. Number of rounds: the logarithm of the longest path."""
    nodes = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges, before = scratch.save(nodes), None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before, last = mark, edges
        edges = scratch.save(_stars(last))
        scratch.drop(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
