"""Connected components of links that stay in Spark, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatline.operators.scale import stored


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step, then one small-star step over (u, v) links."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    # A node with very many links is a skewed key of this join only, which is split.
    large = (
        both.join(least, "u")
        .filter("v > u AND v != m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    hooked = large.join(down, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.union(down.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node that some link touches; the root is the least node.

    Links of a node with itself and links with NULL say nothing. No links give an
    empty table.
    """
    edges = links.select(F.col(u).alias("u"), F.col(v).alias("v")).dropna().filter("u != v")
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = edges.agg(
            F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, v))")
        ).first()
        if state == seen or not state[0]:
            break
        seen = state
        edges = stored(_stars(edges))
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
