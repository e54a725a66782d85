"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.llm.common import written


def _to_smallest(edges: DataFrame) -> DataFrame:
    """edges u, v with m, the least of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    return edges.join(written(least, "components-least"), "u")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) for every node of a table of edges u, v that is not such a root itself.

    Directions, repeats and loops of edges do not matter. Hubs are no
    problem: the least neighbour is pre-aggregated, and the join that hands it out can be split by Spark.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "components-edges")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_smallest(written(large, "components-large"))
        edges = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = written(edges, "components-edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("the components did not settle")
