"""Connected components of a link table by alternating large-star / small-star rounds.

Each round replaces links by links to the smallest neighbour, using only grouped minima (partial
aggregation takes hot nodes) and equi-joins (skewed sides are split by AQE); no group is ever
collected. It ends when a round changes nothing, when every node links straight to the smallest
node of its component.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.session import settle


def _round(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = (both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
             .select("u", F.least("u", "m").alias("m")))
    large = e.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).distinct()
    low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    small = (large.join(low, F.col("a") == F.col("u")).where(F.col("b") != F.col("m"))
             .select(F.col("b").alias("a"), F.col("m").alias("b")))
    return small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked node that is not the smallest of its component.

    ``links`` holds pairs of non-null comparable ids in any order, repeats and self-links
    included; an empty table gives an empty table.
    """
    e = settle(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
               .where("a <> b").distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == state or now[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        e = settle(_round(e))
