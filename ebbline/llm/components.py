"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import new_folder, store


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each linked node the least node it reaches.

    Rounds of grouped minima and joins, each stored; none gathers a neighbourhood.  Their number grows
    with the logarithm of the longest chain.  Self links and nulls are left out.
    """
    spark, folder = links.sparkSession, new_folder(links.sparkSession, "components")
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = store(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), folder, "edges0")
    turn = 0
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = store(large, folder, f"large{turn}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = store(small.select("e.*").filter("u <> v").distinct(), folder, f"edges{turn + 1}")
        if _digest(small) == _digest(edges):
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(small.select("v", "v").distinct())
        edges, turn = small, turn + 1


def _digest(edges: DataFrame) -> tuple:
    wide = [F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(20,0)")) for seed in range(2)]
    return tuple(edges.agg(F.count("*"), *wide).first())
