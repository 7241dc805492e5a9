"""Connected components as alternating star contractions over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _towards_least(edges: DataFrame, which: str) -> DataFrame:
    """One contraction: re-hang neighbours of each node on its least neighbour.

    ``edges`` holds (u, v) with u > v.  "large" re-hangs the larger neighbours,
    "small" the smaller ones and the node itself.
    """
    if which == "large":
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).unionAll(edges.select(F.col("v").alias("n"), F.col("u").alias("o")))
        least = both.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m"))
        hung = both.where("o > n").join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return hung.where("u > v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, most: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.

    Each round needs only joins and aggregates on a node, so no component ever
    has to fit in a task, and is written to shared storage, so a lost executor
    costs one round.  The number of rounds grows with the logarithm of the
    longest path.  Null ends and self loops are ignored.
    """
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = now.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = scratch.save(now, "edges")
    seen = None
    for _ in range(most):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        seen = state
        now = scratch.save(_towards_least(_towards_least(now, "large"), "small"), "edges")
    raise RuntimeError(f"components did not settle in {most} rounds")
