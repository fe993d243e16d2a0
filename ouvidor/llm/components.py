"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a group-by and a join on the node, so a node with very many neighbours is pre-aggregated on the
map side and its join partition can be split; each round is written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ouvidor.llm.common import drop_table, free_shuffles, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """(u, v), u > v -> every neighbour larger than u points to the smallest one around u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Of the edges to smaller nodes, all ends and u itself point to the smallest."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of any direction -> (node, root) for every node with a link, root the smallest node of its component.

    Null ends and loops are ignored, repeated edges count once, no edges give no rows.
    """
    spark = edges.sparkSession
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialise(now, "edges")
    sign = None
    while True:
        new = materialise(_small_star(_large_star(now)), "edges")
        drop_table(now)
        now = new
        at = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        if tuple(at) == sign:
            free_shuffles(spark)
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        sign = tuple(at)
