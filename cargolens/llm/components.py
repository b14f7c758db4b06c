"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import stored


def _nearest(pairs: DataFrame) -> DataFrame:
    """Adds m, the smaller of u and its smallest neighbour; combined before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("m", "u"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        _nearest(both)
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    near = _nearest(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    )
    return (
        near.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(near.select("u", F.col("m").alias("v")))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    pair = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(pair)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node reachable.

    Rounds of large and small stars until nothing changes, a number that grows with the
    logarithm of the longest path.  Every round is written, so none depends on the last.
    """
    edges = stored(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "edges")
    before = None
    now = _state(edges)
    while now[0] and now != before:
        edges = stored(_small_star(_large_star(edges)), "stars")
        before, now = now, _state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
