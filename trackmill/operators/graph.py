"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.sources.tables import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (u, v) with u > v. The minimum of a node's neighbours is a
    partially aggregated groupBy and comes back by a join, so that a node with very
    many neighbours is never gathered in one task."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select("u", "v")
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(low, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node that has an edge to another node; component is
    the smallest node that is reachable. Rows with a null end and self loops are ignored.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    now, _ = materialise(now)
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = None
    for _ in range(max_rounds):
        now, _ = materialise(_star(_star(now, True), False))
        after = tuple(sign(now))
        if after == before or after[0] == 0:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    assert spark is now.sparkSession
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
