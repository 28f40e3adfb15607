"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ambientspark.llm.common import staged


def _least(links: DataFrame, by: str) -> DataFrame:
    return links.groupBy(by).agg(F.min("v").alias("m"))


def connected(links: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) for every end of the links (a, b).

    Alternates two star steps on a stored link table: every node's larger neighbours move to the smallest neighbour, then
    its smaller ones do. The number of links never grows, and rounds grow with the logarithm of the longest path. The smallest
    neighbour of a node comes from an aggregate and is joined back, so a node with very many links is no
    single task's work.
    """
    now = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = both.join(_least(both, "u"), "u").where(F.col("v") > F.col("u"))
        now = larger.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        smaller = now.join(_least(now, "u"), "u")
        now = staged(smaller.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(smaller.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    # at the end every link leads from a node to its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
