"""Connected components of a link table, by alternating star contractions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.tables import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for (a, b) links: every linked node with the smallest node it can reach.

    Each round hangs a node's larger neighbours, then its smaller ones, on the
    smallest; links become stars in about log(nodes) rounds.  Rounds are written
    tables; only their row count and checksum reach the driver.
    """
    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        links = materialize(small)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
