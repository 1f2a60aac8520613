"""Connected components of a graph given as a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabrichealth.llm.common import settle

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links(a, b)``; component is the smallest id reachable.

    Each round points an id's larger neighbours, then its smaller ones, to its smallest neighbour, with two
    grouped minima and no gathered neighbour lists; rounds are settled tables and grow with the logarithm
    of the longest chain. Links of an id to itself and repeated links are dropped.
    """
    links = settle(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    previous = None
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # large star: every larger neighbour of a goes to a's smallest
        large = links.select(F.col("b").alias("x"), F.col("a").alias("y")).join(low.withColumnRenamed("a", "x"), "x").select(F.col("y").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = settle(large, "links")
        # small star: a and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        links = settle(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError("components did not settle")
    roots = links.groupBy("a").agg(F.min("b").alias("component"))
    return roots.select(F.col("a").alias("id"), "component").unionByName(roots.select(F.col("component").alias("id"), "component").distinct())
