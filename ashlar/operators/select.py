"""Mutual information with a class label, ranking and roll-up.

Discrete features need only the counts of (feature, value, class).  Continuous
ones use the nearest-neighbour estimator of Ross (2014) in one dimension, where
neighbours are neighbours in sort order.  Everything is in nats.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import kept


def discrete_information(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, mi) by one unpivot and one aggregate; null is a value like others, rows without a class are left out."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("<NA>")).alias("v")) for c in features)))
    n = df.where(F.col(target).isNotNull()).select(F.col(target).alias("y"), cells.alias("x")).select("y", "x.*").groupBy("feature", "v", "y").agg(F.count("*").cast("double").alias("n"))
    w = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    n = n.withColumns({"nx": w("feature", "v"), "ny": w("feature", "y"), "all": w("feature")})
    return n.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny"))))).alias("mi"))


def _harmonic(n: Column) -> Column:
    """H(n), exact up to 40, else by its asymptotic series (error below 1e-12)."""
    d = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(40)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)
    series = F.ln(d) + F.lit(0.5772156649015329) + 1 / (2 * d) - 1 / (12 * d * d) + 1 / (120 * F.pow(d, F.lit(4.0)))
    return F.when(n <= 0, 0.0).when(n <= 40, small).otherwise(series)


def continuous_information(df: DataFrame, key: str, column: str, target: str, k: int = 3, seed: int = 42, rows_a_range: int = 20_000, most_ranges: int = 4096) -> DataFrame:
    """(feature, mi) of one continuous column by k nearest neighbours of the same class.

    Ties are settled as the estimator does it, by noise of 1e-10 of the mean
    size; here it is a hash of the seed and the key, so neither the order nor
    the size of keys matters.  Values are cut into ranges between approximate
    quantiles, and a range of a class is a task's unit: the k nearest values
    that lie in other ranges come from a table of each range's k first and last
    values.  Neighbours of all classes within the radius are counted by running
    sums over points and query bounds, in ranges too, so there is no range join
    and no window over a class.  Classes of one row are left out, k is at most
    the class size - 1.
    """
    spark = df.sparkSession
    seen = df.select(F.col(key).alias("id"), F.col(target).alias("y"), F.col(column).cast("double").alias("x")).where("x IS NOT NULL AND y IS NOT NULL")
    size, rows = seen.agg(F.avg(F.abs("x")), F.count("*")).first()
    empty = spark.createDataFrame([(column, 0.0)], "feature string, mi double")
    if not rows:
        return empty
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long") / float(1 << 47) - 1
    points = seen.withColumn("x", F.col("x") + F.lit(1e-10 * max(1.0, size)) * unit)
    n = max(1, min(most_ranges, rows // rows_a_range))
    cuts = sorted(set(points.agg(F.percentile_approx("x", [i / n for i in range(1, n)], 10 * n)).first()[0])) if n > 1 else []
    sizes = points.groupBy("y").agg(F.count("*").alias("ny")).where("ny > 1")
    points = points.join(F.broadcast(sizes), "y").withColumn("b", _range_of(cuts)("x"))
    cell = Window.partitionBy("y", "b")
    order = cell.orderBy("x", "id")
    placed = kept(points.withColumns({"first": F.row_number().over(order), "many": F.count("*").over(cell)} | {f"before{i}": F.col("x") - F.lag("x", i).over(order) for i in range(1, k + 1)} | {f"after{i}": F.lead("x", i).over(order) - F.col("x") for i in range(1, k + 1)}))
    # 2k rows of each range of a class: what lies beyond a range's edges
    edge = placed.where((F.col("first") <= k) | (F.col("first") > F.col("many") - k)).select("y", "b", "x").toPandas()
    halo = []
    for y, own in edge.groupby("y"):
        own = own.sort_values("x", kind="stable")
        xs, bs = own["x"].to_numpy(), own["b"].to_numpy()
        for b in np.unique(bs).tolist():
            lo, hi = np.searchsorted(bs, b, "left"), np.searchsorted(bs, b, "right")
            halo.append((y, int(b), [*xs[max(0, lo - k) : lo].tolist(), *xs[hi : hi + k].tolist()]))
    kind = placed.schema["y"].dataType.simpleString()
    halo = spark.createDataFrame([(y if kind == "string" else int(y), b, xs) for y, b, xs in halo], f"y {kind}, b int, halo array<double>")
    own = F.array(*(F.col(f"{side}{i}") for side in ("before", "after") for i in range(1, k + 1)))
    near = F.array_sort(F.filter(F.concat(own, F.transform("halo", lambda h: F.abs(h - F.col("x")))), lambda g: g.isNotNull()))
    kk = F.least(F.lit(k), F.col("ny") - 1)
    points = placed.join(F.broadcast(halo), ["y", "b"]).select("id", "ny", "x", kk.alias("k"), F.element_at(near, kk.cast("int")).alias("r"))
    # the radius ends before the k-th neighbour, whatever the rounding
    inward = F.lit(4e-16) * (F.abs("x") + F.col("r"))
    events = points.select(F.explode(F.array(
        F.struct(F.col("x").alias("v"), F.lit(1).alias("tag"), F.lit(0).alias("sign"), "id", "ny", "k"),
        F.struct((F.col("x") + F.col("r") - inward).alias("v"), F.lit(0).alias("tag"), F.lit(1).alias("sign"), "id", "ny", "k"),
        F.struct((F.col("x") - F.col("r") + inward).alias("v"), F.lit(2).alias("tag"), F.lit(-1).alias("sign"), "id", "ny", "k"),
    )).alias("e")).select("e.*")
    # rows before a range: its number of points is known, a table of the ranges
    count = dict(placed.groupBy("b").agg(F.count("*")).collect())
    before, total = [], 0
    for b in range(len(cuts) + 1):
        before.append((b, total))
        total += count.get(b, 0)
    run = F.sum((F.col("tag") == 1).cast("long")).over(Window.partitionBy("b").orderBy("v", "tag").rowsBetween(Window.unboundedPreceding, 0))
    events = events.withColumn("b", _range_of(cuts)("v")).withColumn("run", run).where("sign <> 0")
    events = events.join(F.broadcast(spark.createDataFrame(before, "b int, before long")), "b")
    m = events.groupBy("id", "ny", "k").agg(F.sum(F.col("sign") * (F.col("before") + F.col("run"))).alias("m"))
    means = m.agg(F.count("*").alias("n"), F.avg(_harmonic(F.col("k") - 1)).alias("hk"), F.avg(_harmonic(F.col("ny") - 1)).alias("hy"), F.avg(_harmonic(F.col("m") - 1)).alias("hm"))
    mi = _harmonic(F.col("n") - 1) + F.col("hk") - F.col("hy") - F.col("hm")
    return means.select(F.lit(column).alias("feature"), F.coalesce(F.greatest(F.lit(0.0), mi), F.lit(0.0)).alias("mi"))


def _range_of(cuts: Sequence[float]):
    """The number of cuts below a value, by binary search over Arrow batches."""
    ordered = np.array(cuts, float)

    @F.pandas_udf(T.IntegerType())
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ordered, x.to_numpy(), "left").astype("int32"))

    return place


def mixed_information(df: DataFrame, key: str, features: dict[str, bool], target: str, k: int = 3, seed: int = 42) -> DataFrame:
    """(feature, mi, discrete) of a mixed table; ``features`` says of each column whether it is discrete."""
    names = [c for c, discrete in features.items() if discrete]
    tables = [discrete_information(df, names, target).withColumn("discrete", F.lit(True))] if names else []
    tables += [continuous_information(df, key, c, target, k, seed).withColumn("discrete", F.lit(False)) for c in features if c not in names]
    return reduce(DataFrame.unionByName, tables)


def ranked(scores: DataFrame, top: int) -> DataFrame:
    """rank by mi, then name, and ``selected`` for the first ``top``.  A row for each feature."""
    r = F.row_number().over(Window.orderBy(F.desc("mi"), F.asc("feature")))
    return scores.withColumn("rank", r.cast("int")).withColumn("selected", r <= top)


def source_rollup(ranking: DataFrame, source: Column) -> DataFrame:
    """Of each source column: encoded columns, largest and summed mi, selected ones, the best and its rank."""
    return ranking.groupBy(source.alias("source_column")).agg(F.count("*").alias("encoded_columns_n"), F.max("mi").alias("max_mi"), F.sum("mi").alias("sum_mi"), F.count_if("selected").alias("selected_encoded_columns_n"), F.min_by("feature", "rank").alias("best_encoded_feature"), F.min("rank").alias("best_rank"))


def summary_by_kind(ranking: DataFrame) -> DataFrame:
    """Of discrete and continuous features: how many, how many selected, how many without information."""
    return ranking.groupBy("discrete").agg(F.count("*").alias("feature_n"), F.count_if("selected").alias("selected_n"), F.count_if(F.col("mi") <= 0).alias("zero_mi_n"), F.max("mi").alias("max_mi"))


def selection_summary(ranking: DataFrame) -> DataFrame:
    return ranking.agg(F.count("*").alias("input_feature_n"), F.count_if("selected").alias("selected_feature_n"), F.max("mi").alias("top_mi"), F.percentile("mi", 0.5).alias("median_mi"), F.min(F.when(F.col("selected"), F.col("mi"))).alias("selected_min_mi"), F.count_if(F.col("mi") <= 0).alias("zero_mi_total_n"))
