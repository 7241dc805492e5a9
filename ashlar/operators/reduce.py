"""Principal components of standardised columns.

One aggregate gives the means, one pass of matrix products the n - 1 covariance
(a generated aggregate of all pairs does not compile for many columns); the
eigenvectors of that small matrix (columns squared, whatever the rows) are found on the driver.
Signs are fixed by making each component's largest loading positive.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def vector_columns(df: DataFrame, vector: str, n: int, prefix: str = "x") -> DataFrame:
    return df.select(*(c for c in df.columns if c != vector), *(F.get(vector, F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(n)))


class Components:
    """names, means, scales, variances (descending) and loadings (component by feature)."""

    def __init__(self, names, means, scales, variances, loadings):
        self.names, self.means, self.scales, self.variances, self.loadings = list(names), means, scales, variances, loadings

    def variance_table(self, spark: SparkSession) -> DataFrame:
        share = self.variances / self.variances.sum()
        return spark.createDataFrame([(f"PC{i + 1}", i + 1, float(v), float(s), float(c)) for i, (v, s, c) in enumerate(zip(self.variances, share, np.cumsum(share), strict=True))], "component string, i int, explained_variance double, explained_variance_ratio double, cumulative_explained_variance double")

    def loading_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f"PC{i + 1}", i + 1, n, float(x)) for i, row in enumerate(self.loadings) for n, x in zip(self.names, row, strict=True)], "component string, i int, feature string, loading double")

    def scores(self, df: DataFrame, k: int) -> DataFrame:
        """``df`` without the features, plus PC1 ... PCk; a sum of products, so it stays in generated code."""
        out = []
        for i in range(k):
            terms = [(F.col(n) - F.lit(float(m))) * F.lit(float(w / s)) for n, m, s, w in zip(self.names, self.means, self.scales, self.loadings[i], strict=True)]
            out.append(sum(terms[1:], terms[0]).alias(f"PC{i + 1}"))
        return df.select(*(c for c in df.columns if c not in self.names), *out)


def _covariance(df: DataFrame, means: np.ndarray) -> np.ndarray:
    """The n - 1 covariance of all columns, each pair over the rows that have both; a partition gives three small matrices."""
    n = len(means)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, n, n))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) - means
            there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(float)
            x = np.where(there > 0, x, 0.0)
            total += x.T @ x, x.T @ there, there.T @ there
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    both, one, rows = sum(np.frombuffer(r["sums"]).reshape(3, n, n) for r in df.mapInArrow(sums, "sums binary").toLocalIterator())
    return (both - one * one.T / rows) / (rows - 1)


def fit(df: DataFrame, columns: Sequence[str]) -> Components:
    """All components of the rows given (the train side); columns of no variance scale by 1."""
    n = len(columns)
    df = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)))
    row = df.agg(*(F.avg(f"x{i}").alias(f"m{i}") for i in range(n)), *(F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(n))).first()
    means, scales = np.array([row[f"m{i}"] for i in range(n)]), np.array([row[f"s{i}"] or 1.0 for i in range(n)])
    cov = _covariance(df, means) / np.outer(scales, scales)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    loadings = vectors[:, order].T
    lead = loadings[np.arange(n), np.abs(loadings).argmax(axis=1)]
    return Components(columns, means, scales, np.maximum(values[order], 0), loadings * np.sign(lead)[:, None])


def reconstruction(c: Components, spark: SparkSession) -> DataFrame:
    """(a, b, covariance) for a <= b: the standardised covariance that variances and loadings give back; columns squared, whatever the rows."""
    whole = (c.loadings.T * c.variances) @ c.loadings
    return spark.createDataFrame([(c.names[i], c.names[j], float(whole[i, j])) for i in range(len(whole)) for j in range(i, len(whole))], "a string, b string, covariance double")


def component_checks(c: Components, scores: DataFrame, k: int, tolerance: float = 1e-8) -> DataFrame:
    """One row: loadings orthonormal, variances descending, and the means of the first k scores of the rows it learned from zero."""
    means = scores.agg(*(F.avg(f"PC{i + 1}") for i in range(k))).first()
    unit = float(np.abs(c.loadings @ c.loadings.T - np.eye(len(c.loadings))).max())
    centred = float(max(abs(m or 0.0) for m in means))
    return scores.sparkSession.createDataFrame([(unit <= tolerance, bool((np.diff(c.variances) <= 1e-12).all()), centred <= tolerance)], "orthonormal boolean, descending boolean, centred boolean")


def thresholds(variances: DataFrame, wanted: Sequence[float]) -> DataFrame:
    """(threshold, k, variance_at_k): the least number of components that reach each threshold."""
    rows = [F.struct(F.lit(float(t)).alias("threshold"), F.min(F.when(F.col("cumulative_explained_variance") >= t, F.col("i"))).alias("k"), F.min(F.when(F.col("cumulative_explained_variance") >= t, F.col("cumulative_explained_variance"))).alias("variance_at_k")) for t in wanted]
    return variances.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def contributors(loadings: DataFrame, top: int = 5, components: int = 10) -> DataFrame:
    """The features of largest absolute loading in each of the first components."""
    w = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), F.asc("feature"))
    return loadings.where(F.col("i") <= components).withColumn("rank_within_component", F.row_number().over(w)).where(F.col("rank_within_component") <= top).select("component", "rank_within_component", "feature", "loading", F.abs("loading").alias("abs_loading"))
