"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.shared import written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and root (the smallest node reachable) of every node of edges.

    Each half-round points the neighbours of a node to the smallest among them, the large star for larger
    neighbours, the small star for smaller ones, until every edge is a star's. Rounds grow with the logarithm of a
    component's diameter. Each round is a written table, so lineage stays short. An edge from a node to itself
    keeps the node alone; repeated edges count once.
    """
    held = written(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges")
    while True:
        both = held.select(F.col("u").alias("n"), F.col("v").alias("m")).union(held.select(F.col("v"), F.col("u")))
        least = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.join(least, "n").where(F.col("m") > F.col("n")).select(F.col("low").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where(F.col("n") > F.col("low")).select(F.col("low"), F.col("n"))).distinct()
        low = large.where("u < v").groupBy("v").agg(F.min("u").alias("low"))
        star = large.where("u < v").join(low, "v").select(F.col("low").alias("u0"), "u", "v", "low")
        small = star.select(F.col("low").alias("u"), F.col("v")).union(star.where("u <> low").select(F.col("low"), F.col("u"))).distinct()
        loops = held.where("u = v")
        new = written(small.union(loops), "edges")
        count = new.where("u < v").select(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        old = held.where("u < v").select(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        # Equal sums may be chance; that no edge is new is not.
        if count == old and new.where("u < v").exceptAll(held.where("u < v")).isEmpty():
            held = new
            break
        held = new
    pairs = held.select(F.col("v").alias("node"), F.col("u").alias("root")).union(held.select(F.col("u"), F.col("u")))
    return pairs.groupBy("node").agg(F.min("root").alias("root"))
