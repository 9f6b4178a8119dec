"""Connected components of a links table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import split_join, written


def connected_components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of links (a, b), two long columns.

    Each round keeps at most as many links as it was given and shortens paths, so the number of rounds grows with
    the logarithm of the largest component. A node's smallest neighbour comes from a partial aggregate and a join
    that splits frequent keys, so a node with very many links doesn't land in one task. Each round is a
    table in the shared folder.
    """
    ordered = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    now = written(ordered(links), "links")
    seen = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
        large = ordered(split_join(both, least, ["a"], "n", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = written(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = split_join(large, least, ["a"], "n", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = written(ordered(small), "links")
        after = mark(now)
        if after == seen:
            break
        seen = after
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
