"""Connected components of an edge table, by large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import written

#: Pieces that the neighbours of one node are dealt into: a hub's star is no single task's work.
SALTS = 8


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its greater neighbours to its least neighbour (or itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    greater = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return greater.join(least, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its lesser neighbours, and itself, to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for the nodes of edges (u, v); nodes without an edge are not in it.

    Rounds go on until the edges are stars, about log(n)^2 of them at worst. Each writes its edges, so a lost executor
    costs one round. Groups are met by aggregates and salted joins, never gathered.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now, mark, settled = written(tidy(edges), "edges"), None, False
    while not settled:
        now = written(tidy(_small_star(tidy(_large_star(now)))), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        mark, settled = seen, seen == mark
    centre = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centre)
