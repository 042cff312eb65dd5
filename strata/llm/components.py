"""Connected components of links between ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import cut


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns id and root, the smallest id reachable, of every id that has a link to another one.

    The links live in tables, never on the driver; the number of rounds grows with the logarithm of the longest chain.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0]
        if now == seen or not now["n"]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut(large, "links")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(met.where("u != v").distinct(), "links")
