"""Profiles of numeric and categorical columns.

Each function makes one aggregate for all its columns and turns the single wide
row into long form afterwards, so a table is read once whatever the number of
columns.  Quantiles are exact by default: of whole tables by ``quantiles``,
whose state is bounded, of groups by an aggregate; ``accuracy`` switches to a
sketch of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite
from .quantiles import distinct_values, exact_quantiles


def quantile(c: Column, p: float, accuracy: int | None = None) -> Column:
    """Linear-interpolation quantile, or the approximate one for a given accuracy."""
    return F.percentile_approx(c, p, accuracy).cast("double") if accuracy else F.percentile(c, p)


def skewness(c: Column) -> Column:
    """Bias-adjusted (G1) sample skewness; null for fewer than three values or no spread."""
    n = F.count(c).cast("double")
    return F.when((F.count(c) > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") * 100 / whole).otherwise(F.lit(0.0))


def _long(df: DataFrame, keys: Sequence[str], rows: list[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(F.array(*rows).alias("__rows")).select(*keys, F.inline("__rows"))


def quantiles_of(df: DataFrame, columns: Sequence[str], ps: Sequence[float], by: Sequence[str] = (), accuracy: int | None = None) -> dict[str, list[Column]]:
    """For each column the wanted quantiles as columns of an aggregate over ``by``.

    Without groups they are exact numbers found beforehand, else one aggregate
    gives all quantiles of a column in a group.
    """
    if accuracy is None and not by:
        return {c: [F.lit(v).cast("double") for v in found] for c, found in exact_quantiles(df, columns, ps).items()}
    many = F.array(*map(F.lit, ps))
    state = (lambda c: F.percentile_approx(c, many, accuracy).cast("array<double>")) if accuracy else (lambda c: F.percentile(c, many))
    return {c: [state(finite(F.col(c)))[i] for i in range(len(ps))] for c in columns}


def numeric_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """Count, nulls, moments, five numbers, distinct count and skewness of each column (NaN and infinities count as null)."""
    known = quantiles_of(df, columns, (0.25, 0.5, 0.75), by, accuracy)
    distinct = {} if by else distinct_values(df, columns)

    def row(name: str) -> Column:
        c = finite(F.col(name))
        q1, q2, q3 = known[name]
        return F.struct(
            F.lit(name).alias("column"), F.count(c).alias("observed_n"), F.count_if(c.isNull()).alias("missing_n"), pct(F.count_if(c.isNull()), F.count("*")).alias("missing_pct"),
            F.avg(c).alias("mean"), q2.alias("median"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"),
            F.max(c).alias("max"), (F.count_distinct(c) if by else F.lit(distinct[name]).cast("long")).alias("n_unique"), skewness(c).alias("skewness"),
        )

    return _long(df, by, [row(c) for c in columns])


def null_ranking(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(column, missing_n, missing_pct) of each column."""
    return _long(df, by, [F.struct(F.lit(c).alias("column"), F.count("*").alias("n_rows"), F.count_if(F.col(c).isNull()).alias("missing_n"), pct(F.count_if(F.col(c).isNull()), F.count("*")).alias("missing_pct")) for c in columns])


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column without and with null as a value."""
    rows = [F.struct(F.lit(c).alias("column"), F.count_distinct(F.col(c)).alias("n_distinct"), (F.count_distinct(F.col(c)) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))).alias("n_distinct_with_null")) for c in columns]
    return _long(df, (), rows)


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, and rows beyond the first of each key."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicate"))


def value_counts(df: DataFrame, columns: Sequence[str], keep_null: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """(column, value, n): value frequencies of several columns in one unpivot and one aggregate."""
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select(*by, "x.*")
    long = long if keep_null else long.where("value IS NOT NULL")
    return long.groupBy(*by, "column", "value").agg(F.count("*").alias("n"))


def categorical_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cardinality, nulls, mode (ties: smallest value), its share of observed rows, and all values by frequency as JSON."""
    counts = value_counts(df, columns, keep_null=True)
    seen = F.col("value").isNotNull()
    ranked = F.array_sort(F.collect_list(F.when(seen, F.struct((-F.col("n")).alias("o"), "value"))))
    out = counts.groupBy("column").agg(
        F.count_if(seen).alias("cardinality"), F.coalesce(F.sum(F.when(~seen, F.col("n"))), F.lit(0)).alias("missing_n"), F.sum("n").alias("n_rows"), ranked.alias("r"), F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("observed_n")
    )
    top = F.try_element_at("r", F.lit(1))
    return out.select(
        "column", "cardinality", "missing_n", pct(F.col("missing_n"), F.col("n_rows")).alias("missing_pct"), top["value"].alias("mode_category"), (-top["o"]).alias("mode_frequency"),
        pct(-top["o"], F.col("observed_n")).alias("mode_pct_observed"), F.to_json(F.transform("r", lambda x: x["value"])).alias("observed_values"),
    )


def category_target(df: DataFrame, column: str, target: str) -> DataFrame:
    """Rows of each (category, target) with their share of the category; the total comes from the small table of counts."""
    n = df.groupBy(F.col(column).alias("category"), F.col(target).alias("target")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("category"))
    return n.withColumns({"category_total": total, "target_pct_within_category": pct(F.col("n"), total)})


def target_pivot(df: DataFrame, column: str, target: str, values: Sequence[int] = (0, 1)) -> DataFrame:
    """Contingency table with fixed target columns, and its rows as proportions."""
    n = df.groupBy(F.col(column).alias("category")).agg(*(F.count_if(F.col(target) == v).alias(f"n_{v}") for v in values))
    total = sum((F.col(f"n_{v}") for v in values[1:]), F.col(f"n_{values[0]}"))
    return n.select("*", *(F.when(total > 0, F.col(f"n_{v}") / total).otherwise(0.0).alias(f"share_{v}") for v in values))


def cluster_profile(df: DataFrame, cluster: str, target: str) -> DataFrame:
    """Rows, classes and positive rate of each cluster."""
    return df.groupBy(cluster).agg(F.count("*").alias("n_rows"), F.count_if(F.col(target) == 0).alias("target_0_n"), F.count_if(F.col(target) == 1).alias("target_1_n"), F.avg(F.col(target).cast("double")).alias("positive_rate"))


def cluster_spread(profile: DataFrame) -> DataFrame:
    """Statistics over clusters: sizes, rates and how many hold one class only."""
    return profile.agg(
        F.count("*").alias("clusters"), F.min("n_rows").alias("min_size"), F.percentile("n_rows", 0.5).alias("median_size"), F.max("n_rows").alias("max_size"), F.min("positive_rate").alias("min_rate"), F.max("positive_rate").alias("max_rate"),
        F.count_if((F.col("target_0_n") == 0) | (F.col("target_1_n") == 0)).alias("one_class_n"),
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n, density) over equal bins from the least to the largest value; the last bin is closed."""
    c = finite(F.col(column))
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = df.select(c.alias("x")).where("x IS NOT NULL").join(F.broadcast(ends))
    at = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return placed.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.first(F.when(width > 0, F.col("total") * width)).alias("area")).select("bin", "n", (F.col("n") / F.col("area")).alias("density"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr, covar) of all column pairs a <= b, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return _long(df, (), [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr"), F.covar_samp(a, b).alias("covar")) for a, b in pairs])


def value_kinds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, finite, whole, binary): whether all values are finite (nulls aren't), whole numbers, or 0 and 1."""
    rows = []
    for c in columns:
        x = finite(F.col(c))
        every = lambda cond: F.coalesce(F.bool_and(cond), F.lit(True))
        rows.append(F.struct(F.lit(c).alias("column"), every(x.isNotNull()).alias("finite"), every(x == F.rint(x)).alias("whole"), every(x.isin(0.0, 1.0)).alias("binary")))
    return _long(df, (), rows)
