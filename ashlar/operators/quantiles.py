"""Exact quantiles and distinct counts without a reducer that holds a column.

A quantile lies at one or two ranks.  All values are counted into equal bins
between their least and largest value; only the bins that hold a wanted rank
go on, each with the limits of the values it really holds, so outliers cost one
round.  Once few values are left they are counted one by one.  A round is one
pass that gives ``BINS`` counts for each open range, whatever the rows; all
columns share it.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite

BINS = 1024
#: values that are counted one by one in the last round
FEW = 100_000


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(c, x): the finite values of all columns, c being the column's number."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), (finite(F.col(n)) + 0.0).alias("x")) for i, n in enumerate(columns))))
    return df.select(cells.alias("v")).select("v.*").where("x IS NOT NULL")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """How many different finite values each column has: one unpivot, one shuffle of distinct values."""
    n = long_values(df, columns).distinct().groupBy("c").agg(F.count("*")).collect()
    return {name: 0 for name in columns} | {columns[c]: k for c, k in n}


def exact_quantiles(df: DataFrame, columns: Sequence[str], ps: Sequence[float]) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of each column (None for a column without finite values)."""
    spark, values = df.sparkSession, long_values(df, columns)
    whole = values.groupBy("c").agg(F.min("x"), F.max("x"), F.count("x")).collect()
    total = {c: n for c, _, _, n in whole}
    found: dict[tuple[int, int], float] = {}
    # open ranges: (column, least, largest, rows below it, rows in it) with their wanted ranks
    open_ = []
    for c, lo, hi, n in whole:
        ranks = sorted({r for p in ps for r in (floor(p * (n - 1)), ceil(p * (n - 1)))})
        open_.append((c, lo, hi, 0, n, ranks))
    while open_:
        for c, lo, hi, *_, ranks in open_:
            if lo == hi:
                found |= {(c, r): lo for r in ranks}
        open_ = [x for x in open_ if x[1] < x[2]]
        if not open_:
            break
        last = sum(x[4] for x in open_) <= FEW
        table = spark.createDataFrame([(i, c, lo, hi) for i, (c, lo, hi, *_) in enumerate(open_)], "i int, c int, lo double, hi double")
        own = values.join(F.broadcast(table), "c").where("x BETWEEN lo AND hi")
        # halved before subtracting, so that no width overflows
        share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        at = F.col("x") if last else F.least(F.floor(share * BINS), F.lit(BINS - 1))
        bins = own.groupBy("i", at.alias("at")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("i").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        wanted = spark.createDataFrame([(i, r - x[3]) for i, x in enumerate(open_) for r in x[5]], "i int, r long")
        held = bins.withColumn("before", before).join(F.broadcast(wanted), "i").where("r >= before AND r < before + n")
        nxt = {}
        for i, lo, hi, n, b, r in held.select("i", "lo", "hi", "n", "before", "r").collect():
            below = open_[i][3]
            nxt.setdefault((i, lo), (open_[i][0], lo, hi, below + b, n, []))[5].append(below + r)
        open_ = list(nxt.values())
    out = {}
    for c, name in enumerate(columns):
        out[name] = [_between(found, c, p * (total[c] - 1)) if total.get(c) else None for p in ps]
    return out


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once for several passes: checkpointed where the session names a folder for that, else cached.

    A checkpoint lies in storage that all machines share and cuts the lineage,
    so a lost executor costs nothing; Spark's cleaner removes it.
    """
    sc = df.sparkSession.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named and not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return df.checkpoint() if sc.getCheckpointDir() else df.persist()


def _between(found: dict, c: int, at: float) -> float:
    low, high = found[c, floor(at)], found[c, ceil(at)]
    return low if low == high else low + (high - low) * (at - floor(at))
