"""Connected components by alternating stars, with every round's edges in a staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwright.llm.common import drop, stage


#: Beyond so many edges (16 bytes each) the least neighbours are written before they are joined, so that
#: adaptive execution sees two shuffles and splits a hub's edges.
SPLIT_EDGES = 1_000_000


def _star(edges: DataFrame, large: bool, split: bool = False) -> DataFrame:
    """edges (u, v) with u > v. Large star: hang a node's larger neighbours on its smallest one; small
    star: hang a node and its smaller neighbours on the smallest of them."""
    write = (lambda df: stage(df, "stars")) if split else (lambda df: df)
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        edges = write(edges)
        least = write(edges.groupBy("u").agg(F.min("v").alias("m")))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node reachable.

    links (a, b): any direction, repeats allowed. Rounds grow with the logarithm of the longest path;
    nothing but two sums comes to the driver.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    while mark[0]:
        split = mark[0] > SPLIT_EDGES
        following = stage(_star(_star(edges, True, split), False, split), "edges")
        drop(edges)
        edges, last = following, mark
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
