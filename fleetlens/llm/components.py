"""Connected components of a graph given as a table of edges, with Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.anchors import stored


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) of every node that has an edge.

    Alternating star steps: every node hands its smallest neighbour to its
    larger neighbours, then its smaller neighbours to its smallest one, until
    each component is a star.  The smallest node then has a row per member; the
    join that reads them streams, and adaptive execution splits it.
    """
    current = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    )
    before = None
    for _ in range(rounds):
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
        current = stored(small.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        found = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if found == before:
            break
        before = found
    else:
        raise RuntimeError("the components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
