"""Connected components of link tables that may be larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.frames import stored


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node that an edge (a, b) of long columns names.

    Rounds of large-star and small-star: every node links its larger neighbours, then its
    smaller ones, to the smallest it knows, until each is linked to its component's minimum
    only.  A hub's edges meet in a map-side combined minimum and in joins that can be split.
    """
    flipped = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = flipped.union(flipped.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        flipped = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        flipped = stored(flipped, "small-star")
        # stars: no node has two roots, no root hangs on another
        loose = flipped.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a").limit(1) \
            .union(flipped.join(flipped.select(F.col("a").alias("r")), F.col("b") == F.col("r"), "left_semi").select("a").limit(1))
        if not loose.take(1):
            break
    return flipped.select(F.col("a").alias("node"), F.col("b").alias("component")).union(flipped.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
