"""The train/test boundary: a deterministic stratified split and its diagnostics.

The split is a column, never two tables.  Allocation is by largest remainder;
inside a class rows are ranked by a seeded hash of their key, so any engine
gives the same rows to the test side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import null_ranking, pct


def allocation(df: DataFrame, target: str, share: float) -> DataFrame:
    """(target, n, test_n): the test rows of each class; a table of the classes."""
    n = df.groupBy(target).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # a row for each class
    exact = F.ceil(F.sum("n").over(whole) * F.lit(share)).cast("double") * F.col("n") / F.sum("n").over(whole)
    n = n.withColumn("exact", exact).withColumn("base", F.floor("exact").cast("long")).withColumn("rest", F.col("exact") - F.col("base"))
    missing = F.ceil(F.sum("n").over(whole) * F.lit(share)).cast("long") - F.sum("base").over(whole)
    rank = F.row_number().over(Window.orderBy(F.desc("rest"), F.asc(target)))
    return n.withColumn("missing", missing).withColumn("place", rank).select(target, "n", (F.col("base") + (F.col("place") <= F.col("missing")).cast("long")).alias("test_n"))


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified_split(df: DataFrame, key: str, target: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` plus partition ``train`` or ``test``.  Rows with a null target are left out.

    A class may hold most rows, so nothing ranks a whole class in one task: the
    class's cut-off hash is found on the sorted hash prefixes (65,536 a class),
    and only the rows that share the cut-off's prefix are ranked.
    """
    seen = df.where(F.col(target).isNotNull())
    h = hash_order(key, seed)
    marked = seen.withColumn("__h", h).withColumn("__p", F.substring("__h", 1, 4))
    counts = marked.groupBy(target, "__p").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(target).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    need = allocation(seen, target, share).select(F.col(target).alias("__t"), "test_n")
    bounds = counts.withColumn("before", before).join(F.broadcast(need), F.col(target) == F.col("__t")).where((F.col("before") < F.col("test_n")) & (F.col("before") + F.col("c") >= F.col("test_n")))
    bounds = bounds.select("__t", F.col("__p").alias("__cut"), (F.col("test_n") - F.col("before")).alias("__left"))
    out = marked.join(F.broadcast(bounds), F.col(target) == F.col("__t"), "left")
    edge = F.col("__p") == F.col("__cut")
    ranked = out.where(edge).withColumn("__r", F.row_number().over(Window.partitionBy(target, "__p").orderBy("__h", key)))
    sides = out.where(~F.coalesce(edge, F.lit(False))).withColumn("__r", F.lit(0)).unionByName(ranked)
    test = F.coalesce((F.col("__p") < F.col("__cut")) | (edge & (F.col("__r") <= F.col("__left"))), F.lit(False))
    return sides.withColumn("partition", F.when(test, "test").otherwise("train")).select(*df.columns, "partition")


def membership_digest(df: DataFrame, key: str, by: str = "partition") -> DataFrame:
    """(partition, n, digest): SHA-256 of the sorted keys' text, one a line.

    Keys of a partition are gathered for the digest; ``content_digest`` of
    ``lineage`` is the form without that bound.
    """
    keys = F.array_sort(F.collect_list(F.col(key).cast("string")))
    return df.groupBy(by).agg(F.count("*").alias("n"), F.sha2(F.concat_ws("\n", keys), 256).alias("digest"))


def partition_target(df: DataFrame, target: str, by: str = "partition") -> DataFrame:
    """Class shares of each partition and their difference from the whole, in percentage points."""
    n = df.groupBy(by, target).agg(F.count("*").alias("n"))
    total, all_, cls = F.sum("n").over(Window.partitionBy(by)), F.sum("n").over(Window.partitionBy()), F.sum("n").over(Window.partitionBy(target))
    return n.select(by, target, "n", pct(F.col("n"), total).alias("pct_partition"), (pct(F.col("n"), total) - pct(cls, all_)).alias("difference_pp_vs_global"))


def partition_nulls(df: DataFrame, columns: Sequence[str], by: str = "partition") -> DataFrame:
    """Nulls of each column in each partition and, as ``global``, in all."""
    return null_ranking(df, columns, [by]).unionByName(null_ranking(df, columns).withColumn(by, F.lit("global")))


def cluster_partitions(df: DataFrame, cluster: str, by: str = "partition") -> DataFrame:
    out = df.groupBy(cluster).agg(F.count_if(F.col(by) == "train").alias("train_n"), F.count_if(F.col(by) == "test").alias("test_n"), F.count("*").alias("total_n"))
    a, b = F.col("train_n") > 0, F.col("test_n") > 0
    return out.withColumn("partition_status", F.when(a & b, "shared").when(a, "train_only").otherwise("test_only"))
