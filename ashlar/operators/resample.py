"""Minority oversampling by interpolation (Chawla et al. 2002), a side branch.

Neighbours are exact and found within the minority class, in blocks: rows are
dealt to blocks of bounded size and every pair of blocks is one task, so no
task holds the class.  All random choices are hashes of the seed and the row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash48
from .boundary import hash_order

BLOCK = 2048


def neighbours(df: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """(id, rank, other, distance): the k nearest other rows, ties to the smaller key."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    n = max(1, -(-rows.count() // BLOCK))
    own = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = own.withColumn("o", every).select(F.col("b").alias("x"), F.col("o").alias("y"), "id", "v")
    asked = own.withColumn("o", every).select(F.col("o").alias("x"), F.col("b").alias("y"), "id", "v")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        p, q, other = np.stack(a["v"]), np.stack(b["v"]), b["id"].to_numpy()
        who = a["id"].to_numpy()
        # a matrix product finds who can be among the k; their distances are computed again one by one
        squares = (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :]
        near = squares - 2 * (p @ q.T)
        near[who[:, None] == other[None, :]] = np.inf
        least = np.partition(near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
        i, j = np.nonzero((near <= least[:, None] + 1e-9 * squares.max()) & np.isfinite(near))
        d = np.sqrt(((q[j] - p[i]) ** 2).sum(axis=1))
        order = np.lexsort((other[j], d, i))
        i, j, d = i[order], j[order], d[order]
        some = np.arange(len(i)) - np.searchsorted(i, i) < k
        return pd.DataFrame({"id": who[i[some]], "other": other[j[some]], "distance": d[some]})

    met = asking.groupBy("x", "y").cogroup(asked.groupBy("x", "y")).applyInPandas(meet, "id long, other long, distance double")
    w = Window.partitionBy("id").orderBy("distance", "other")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "rank", "other", "distance")


def oversample(df: DataFrame, key: str, vector: str, target: str, minority, k: int = 5, seed: int = 42) -> DataFrame:
    """Original rows, then as many synthetic minority rows as the classes need to be even.

    Synthetic row i lies at a hashed place between a hashed minority row and
    one of its neighbours; vectors are doubles, never cut to whole numbers.
    Minority rows without a key or vector count in the class but give no rows.
    """
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull()
    small = df.where((F.col(target) == minority) & usable)
    n_small, n_all, n_rest = df.agg(F.count_if((F.col(target) == minority) & usable), F.count_if(F.col(target) == minority), F.count_if(F.col(target) != minority)).first()
    base = df.select(F.col(key).alias("source_id"), F.lit(None).cast("long").alias("neighbour_id"), F.col(vector).cast("array<double>").alias("v"), F.col(target).alias("target"), F.lit("original").alias("sample_origin"))
    wanted = n_rest - n_all
    if n_small < 2 or wanted <= 0:
        return base
    near = neighbours(small, key, vector, k)
    degree = near.groupBy("id").agg(F.count("*").alias("d"))
    rounds = F.sequence(F.lit(0), F.lit(-(-wanted // n_small) - 1))
    # every row is taken once a round; a last, partial round takes the rows of least hash
    extra = wanted - (wanted // n_small) * n_small
    ids = small.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    drawn = _marked(ids.join(degree, "id"), hash_order("id", seed), "id", extra).withColumn("round", F.explode(rounds))
    drawn = drawn.where((F.col("round") < wanted // n_small) | F.col("extra"))
    drawn = drawn.withColumn("rank", (F.pmod(hash48(F.lit(f"{seed}:rank"), F.col("id"), F.col("round")), F.col("d")) + 1).cast("int")).withColumn("u", hash48(F.lit(f"{seed}:place"), F.col("id"), F.col("round")) / float(1 << 48))
    out = drawn.join(near.select("id", "rank", "other"), ["id", "rank"]).join(ids.select(F.col("id").alias("other"), F.col("v").alias("w")), "other")
    made = F.transform(F.arrays_zip("v", "w"), lambda x: x["v"] + F.col("u") * (x["w"] - x["v"]))
    return base.unionByName(out.select(F.col("id").alias("source_id"), F.col("other").alias("neighbour_id"), made.alias("v"), F.lit(minority).alias("target"), F.lit("synthetic").alias("sample_origin")))


def _marked(df: DataFrame, h: Column, key: str, n: int) -> DataFrame:
    """``df`` plus extra: whether a row is among the n of least hash; only rows with the cut-off's hash prefix are ranked."""
    marked = df.withColumn("__h", h).withColumn("__p", F.substring("__h", 1, 4))
    counts = marked.groupBy("__p").agg(F.count("*").alias("c"))  # 65,536 prefixes at most
    before = F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumn("b", before).where((F.col("b") < n) & (F.col("b") + F.col("c") >= n)).first()
    if cut is None:
        return df.withColumn("extra", F.lit(n > 0))
    edge = F.col("__p") == cut["__p"]
    ranked = marked.where(edge).withColumn("extra", F.row_number().over(Window.partitionBy("__p").orderBy("__h", key)) <= n - cut["b"])
    return marked.where(~edge).withColumn("extra", F.col("__p") < cut["__p"]).unionByName(ranked).drop("__h", "__p")


def class_balance(df: DataFrame, target: str = "target") -> DataFrame:
    n = df.groupBy(target).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def interpolation_diagnostic(resampled: DataFrame) -> DataFrame:
    """Cells of synthetic vectors that are exactly 0 or 1, strictly between, outside, or no whole number."""
    x = resampled.where("sample_origin = 'synthetic'").select(F.explode("v").alias("x"))
    return x.agg(F.count("*").alias("total_cells"), F.count_if(F.col("x") == 0).alias("exactly_0_n"), F.count_if(F.col("x") == 1).alias("exactly_1_n"), F.count_if((F.col("x") > 0) & (F.col("x") < 1)).alias("strictly_between_0_1_n"), F.count_if((F.col("x") < 0) | (F.col("x") > 1)).alias("outside_0_1_n"), F.count_if(F.col("x") != F.rint("x")).alias("fractional_n"))
