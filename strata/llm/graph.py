"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.tables import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of edges reaches, for nodes with an edge to another.

    Alternates two star steps until nothing changes: every node's larger neighbours are linked to
    its smallest neighbour, then its smaller neighbours and itself are. Both keep components as they
    are; stars remain after a number of rounds that grows with the logarithm of their size.
    Minima are taken before a join, so a node with very many neighbours is combined map-side.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges")
        low_small = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low_small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(small.unionByName(low_small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        same = _digest(small) == _digest(edges)
        for done in (edges, low, large, low_small):
            discard(done)
        edges = small
        if same:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())
