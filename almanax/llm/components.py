"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanax.llm.scratch import drop, read, write


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in links, component being the smallest node reachable.

    Alternating large-star and small-star rounds: each replaces links by links to the smallest neighbour, until a round
    changes nothing. Links stay in tables; a round's are written before the next begins, and only their number, sum and hash
    come to the driver. No links give an empty table.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    first = links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    path = write(first, "links")
    edges, mark = read(links.sparkSession, path, first.schema), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before, path = path, write(small, "links")
        edges = read(links.sparkSession, path, first.schema)
        drop(before)  # of all rounds, one table is left
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    member = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
