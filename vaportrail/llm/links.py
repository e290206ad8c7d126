"""Connected components of a table of links, without gathering a hub's links in one task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaportrail.session import stage, unstage


def _stars(edges: DataFrame) -> DataFrame:
    """One round of large-star and small-star over edges (u > v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u > v").distinct()
    root = large.groupBy("u").agg(F.min("v").alias("m"))
    hung = large.join(root, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(root.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node but the smallest of each component, which is the component's name.

    Minimum neighbours are found by partial aggregation, so a node with very many links is no hot spot; each round is
    written to the shared folder. Rounds grow with the logarithm of the longest path.
    """
    edges = stage(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        done, edges, before = edges, stage(_stars(edges), "links"), now
        unstage(done)
