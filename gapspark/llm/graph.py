"""Connected components of a graph given by its links, as rounds of DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.llm.common import materialize


def connected_components(links: DataFrame, first: str = "u", second: str = "v") -> DataFrame:
    """(node, root) for every node that has a link; the root is the smallest node of its component.

    Alternates two steps until no link changes: every node links its larger neighbours to its
    smallest one, then links its smaller neighbours to its smallest one. The number of links never
    grows and the number of rounds is about the square of the logarithm of the longest path at most.
    Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    links = links.select(F.col(first).alias("u"), F.col(second).alias("v")).where("u <> v")
    links = materialize(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # here u > v in every link: v is a smaller neighbour of u
        down = large.where("u > v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = materialize(small.where("u <> v").distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
