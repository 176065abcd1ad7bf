"""Connected components by alternating star contractions.

Edges stay a distributed table throughout. Each round points every node at the
least node it knows of and never adds edges, so the work shrinks; the number of
rounds grows with the logarithm of the longest path. Only a count and a checksum
of the edges reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: neighbours above a node go to the least of its neighbourhood;
    otherwise the node and its neighbours below go there."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(least, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: two columns of one type, ends of an edge. Returns (node,
    component): for each node with an edge to another, the least node that it
    reaches. Null ends and loops are left out."""
    a, b = edges.columns
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).where(F.col(a) != F.col(b))
    now = stored(now.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    while True:
        sum_ = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sum_ == seen or not sum_[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = sum_
        now = stored(_star(_star(now, True), False), "edges")
