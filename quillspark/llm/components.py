"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import drop, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its larger (or its smaller) neighbours to its least one. Edges go from u down to v."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node, component`` (the least node) for all nodes of the links ``a, b``; loops are ignored.

    Every round halves distances or better; a round is written to the shared folder, so a lost executor
    costs one round at most. No link or label goes to the driver, only two numbers a round. With rounds, no
    more than that many are made: nodes of one label are connected, but not all that are have one label yet.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()
    before, done = None, 0
    while done != rounds:
        if rounds is None:
            now = mark(edges)
            if now == before or now["n"] == 0:
                break
            before = now
        after = materialize(_star(_star(edges, True), False))
        drop(edges)
        edges, done = after, done + 1
    if rounds is None:  # all edges are stars now
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
