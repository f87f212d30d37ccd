"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of a link; component is its smallest node.

    ``links`` has two long columns ``a`` and ``b``.  Each step hooks nodes to
    the smallest neighbour, so a chain shortens geometrically; a node with
    very many links is met with partial aggregation and joins that Spark may
    split, never as one group.  Every step is a written table; the loop ends
    when a step changes nothing, which two sums over the links show.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter("a > b").distinct(), "links")
    before = None
    while True:
        # large star: larger neighbours move to the smallest of the neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself move to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = written(small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                        .union(least.select("a", "m")).filter("a <> b").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", F.col("b").alias("c")).distinct())
