"""Connected components of a graph of links, as DataFrame operations.

Large-star and small-star steps in turn (Kiveris et al., "Connected Components
in MapReduce and Beyond", 2014) turn any graph into stars around the smallest
node of each component, in a number of rounds that grows with the logarithm of
its size.  A node with very many links is only ever reduced to a minimum and
joined back on a key that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Kept


def _star(edges: DataFrame, large: bool, keep: Kept) -> DataFrame:
    """edges: (a, b) with b < a, each once."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # Written first, so that the join deals both sides anew.
    least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "components-least")
    if large:
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = both.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of *edges* that isn't the smallest of its
    component; directions, repeats, loops and nulls don't matter.  An empty
    graph gives an empty result."""
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct()
    keep, was = Kept(), None
    edges = keep(edges, "components")
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == was or not now[0]:
            keep.leave(edges)
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        was = now
        halfway = keep(_star(edges, True, keep), "components")
        edges = keep(_star(halfway, False, keep), "components")
        keep.leave(edges)
