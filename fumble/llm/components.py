"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumble.llm.shared import keep, release


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; the root is the least node of the component.

    Large star: each node's larger neighbours move to its least neighbour;
    small star: its smaller neighbours and itself do. The minima are partial
    aggregates and are written, so that in their join with the edges both sides
    come from a plain exchange, which AQE splits where a node has very many
    edges. A round's tables are removed when the next edges are written."""
    kind = edges.schema["a"].dataType
    now = keep(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = _least(both)
        large = keep(both.join(first, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "cc")
        second = _least(large)
        small = large.join(second, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        before, now = now, keep(small, "cc")
        for t in (before, first, large, second):
            release(t)
        if _stars(now):
            break
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    roots = now.select(F.col("v").cast(kind).alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of each node and its neighbours."""
    return keep(edges.groupBy("u").agg(F.min("v").alias("v0")).select("u", F.least("u", "v0").alias("m")), "cc")


def _stars(edges: DataFrame) -> bool:
    """Whether every edge leads to a root: one edge for each node, and no node that is a root too."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("root")))
    sums = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
    return sums.filter("out > 1 OR out = 1 AND root = 1").isEmpty()
