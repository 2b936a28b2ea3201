"""Connected components of a graph given by its edges."""

from pyspark.sql import DataFrame, functions as F

from ..session import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Alternates two steps until the edges stay the same: each node hands its
    larger neighbours to its smallest neighbour, then its smaller ones. Every
    component ends as a star around its smallest node, after about log(n)
    rounds. Each round is written to the shared folder. Edges with a null end,
    loops and repeated edges change nothing; without edges there are no rows.
    """
    stars = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .where(F.col(a) != F.col(b)).distinct(), "edges")
    before = None
    while (now := _state(stars)) != before:
        before = now
        both = stars.select(F.explode(F.array(
            F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("least"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct())
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = (large.join(least, "u")
                 .select(F.explode(F.array(F.struct(F.col("u"), F.col("least").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e"))
                 .select("e.*").where("u <> v").distinct())
        stars = written(small, "small-star")
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(centres)


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum that changes with any of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
