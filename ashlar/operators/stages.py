"""Fit/transform stages that learn from the train side only.

``fit`` functions take a table and read only the rows whose ``partition`` is
``train``; what they learn is a small table of parameters.  ``transform``
functions read nothing but those parameters, so no stage can leak.  Parameter
tables have a row for each column or vocabulary entry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import category_order, category_text, column_token, finite
from .profile import quantile, quantiles_of

MISSING = "sin_dato"
MISSING_CODE, UNSEEN_CODE, ESCAPE_CODE = -1, -2, -3


def train(df: DataFrame) -> DataFrame:
    return df.where(F.col("partition") == "train")


def fit_median(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    known = quantiles_of(train(df), columns, (0.5,), (), accuracy)
    rows = [F.struct(F.lit(c).alias("column"), F.count(finite(F.col(c))).alias("fit_observed_n"), F.count_if(finite(F.col(c)).isNull()).alias("fit_missing_n"), known[c][0].alias("learned_value")) for c in columns]
    return train(df).agg(F.array(*rows).alias("r")).select(F.inline("r"))


def impute(df: DataFrame, params: DataFrame) -> DataFrame:
    """Null, NaN and infinite values of the fitted columns become the learned ones."""
    known = {r["column"]: r["learned_value"] for r in params.collect()}
    return df.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(v)) for c, v in known.items()})


def joint_indicator(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """1 where the columns are null; raises if their null masks differ."""
    masks = [F.col(c).isNull() for c in columns]
    unlike = df.agg(F.count_if(sum((m.cast("int") for m in masks[1:]), masks[0].cast("int")).between(1, len(masks) - 1))).first()[0] if len(masks) > 1 else 0
    if unlike:
        raise ValueError(f"{', '.join(columns)} have different null masks in {unlike} rows")
    return df.withColumn(name, F.col(columns[0]).isNull().cast("tinyint"))


def same_masks(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.coalesce(F.bool_and(F.col(a).isNull() == F.col(b).isNull()), F.lit(True)).alias("same"), F.count_if(F.col(a).isNull() != F.col(b).isNull()).alias("mismatch_n"))


def fill_category(df: DataFrame, columns: Sequence[str], token: str = MISSING) -> DataFrame:
    return df.withColumns({c: F.coalesce(category_text(F.col(c)), F.lit(token)) for c in columns})


def unchanged(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(column, changed_n): observed values that differ after a stage; must be 0."""
    b = before.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    both = b.join(after.select(key, *columns), key)
    rows = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(f"__{c}").isNotNull() & ~F.col(f"__{c}").eqNullSafe(F.col(c))).alias("changed_n")) for c in columns]
    return both.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def null_stages(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null cells of each partition before and after."""

    def cells(df: DataFrame, stage: str) -> DataFrame:
        n = sum((F.count_if(F.col(c).isNull()) for c in columns[1:]), F.count_if(F.col(columns[0]).isNull()))
        return df.groupBy("partition").agg(F.lit(stage).alias("stage"), F.count("*").alias("n_rows"), (F.count("*") * len(columns)).alias("cell_n"), n.alias("missing_n"))

    return cells(before, "before").unionByName(cells(after, "after"))


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation; a deviation of 0 scales by 1."""
    rows = [F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean_train"), F.var_pop(c).alias("variance_train"), F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias("scale_train")) for c in columns]
    return train(df).agg(F.array(*rows).alias("r")).select(F.inline("r"))


def scale(df: DataFrame, params: DataFrame) -> DataFrame:
    known = {r["column"]: (r["mean_train"], r["scale_train"]) for r in params.collect()}
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in known.items()})


def scaling_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std_ddof0"), F.min(c).alias("min"), F.max(c).alias("max")) for c in columns]
    return df.groupBy("partition").agg(F.array(*rows).alias("r")).select("partition", F.inline("r"))


def scaling_before_after(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``scaling_summary`` of both, with the stage's name."""
    return scaling_summary(before, columns).withColumn("stage", F.lit("before")).unionByName(scaling_summary(after, columns).withColumn("stage", F.lit("after")))


#: categories of a column that may become columns or literals of a plan
MOST_CATEGORIES = 10_000


def _bounded(rows: DataFrame, what: str) -> list:
    """The rows of a small table; raises beyond ``MOST_CATEGORIES`` instead of flooding the driver."""
    out = rows.limit(MOST_CATEGORIES + 1).collect()
    if len(out) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} {what}; such columns are for a join, not for a plan")
    return out


def vocabulary(df: DataFrame, columns: Sequence[str], token: str = MISSING) -> DataFrame:
    """(column, category, position from 0) of the train categories: numbers, then texts, the missing token last."""
    long = train(df).select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(category_text(F.col(c)), F.lit(token)).alias("category")) for c in columns))).alias("x")).select("x.*").distinct()
    w = Window.partitionBy("column").orderBy(*category_order(F.col("category"), token))
    return long.withColumn("position", (F.row_number().over(w) - 1).cast("int"))


def ordinal_map(vocab: DataFrame, escapes: dict[str, Sequence[str]] | None = None, token: str = MISSING) -> DataFrame:
    """(column, category, kind, value): places among real categories; missing -1, escape answers -3."""
    lost = F.col("category") == token
    gone = F.lit(False)
    for c, values in (escapes or {}).items():
        gone = gone | ((F.col("column") == c) & F.col("category").isin(list(values)))
    kind = F.when(lost, "missing").when(gone, "escape").otherwise("ordinal")
    w = Window.partitionBy("column", "kind").orderBy("position")
    return vocab.withColumn("kind", kind).withColumn("value", F.when(lost, MISSING_CODE).when(gone, ESCAPE_CODE).otherwise(F.row_number().over(w) - 1).cast("smallint")).drop("position")


def encode_ordinal(df: DataFrame, mapping: DataFrame, columns: Sequence[str], token: str = MISSING) -> DataFrame:
    """Codes of the mapping, -2 for a category it lacks."""
    rows = _bounded(mapping.where(F.col("column").isin(list(columns))), "categories")
    out = {}
    for c in columns:
        own = [x for r in rows if r["column"] == c for x in (F.lit(r["category"]), F.lit(int(r["value"])))]
        v = F.coalesce(category_text(F.col(c)), F.lit(token))
        out[f"{c}_ord"] = F.coalesce(F.try_element_at(F.create_map(*own), v) if own else F.lit(None), F.lit(UNSEEN_CODE)).cast("smallint")
    return df.withColumns(out)


def onehot_names(vocab: DataFrame) -> DataFrame:
    """``vocab`` plus output_column; raises if two categories of a column share a name."""
    named = vocab.withColumn("output_column", F.concat("column", F.lit("__"), column_token(F.col("category"))))
    clash = named.groupBy("output_column").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"two categories give the column {clash[0]['output_column']}")
    return named


def encode_onehot(df: DataFrame, vocab: DataFrame, token: str = MISSING) -> DataFrame:
    """A 0/1 column for every train category; a category unseen in train gives zeros everywhere."""
    out = {}
    for r in sorted(_bounded(onehot_names(vocab), "categories"), key=lambda r: (r["column"], r["position"])):
        out[r["output_column"]] = (F.coalesce(category_text(F.col(r["column"])), F.lit(token)) == F.lit(r["category"])).cast("tinyint")
    return df.withColumns(out)


def unseen(df: DataFrame, vocab: DataFrame, columns: Sequence[str], token: str = MISSING, policy: str = "all_zero") -> DataFrame:
    """(column, category, test_n, policy) of test categories that train lacks; policy says how they are encoded."""
    test = df.where(F.col("partition") == "test").select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(category_text(F.col(c)), F.lit(token)).alias("category")) for c in columns))).alias("x")).select("x.*")
    return test.groupBy("column", "category").agg(F.count("*").alias("test_n")).join(vocab.select("column", "category"), ["column", "category"], "left_anti").withColumn("policy", F.lit(policy))


def missing_conservation(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls before the fill against codes -1 after the ordinal encoding, by column."""
    rows = lambda f: [F.struct(F.lit(c).alias("column"), f(c).alias("n")) for c in columns]
    b = before.agg(F.array(*rows(lambda c: F.count_if(F.col(c).isNull()))).alias("r")).select(F.inline("r")).withColumnRenamed("n", "missing_before_n")
    a = after.agg(F.array(*rows(lambda c: F.count_if(F.col(f"{c}_ord") == MISSING_CODE))).alias("r")).select(F.inline("r")).withColumnRenamed("n", "encoded_n")
    return b.join(a, "column").withColumn("conserved", F.col("missing_before_n") == F.col("encoded_n"))


def describe(df: DataFrame, value: Column, keys: Sequence[str]) -> DataFrame:
    """Five numbers, mean and population deviation of a value by group."""
    v = finite(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), quantile(v, 0.25).alias("q1"), quantile(v, 0.5).alias("median"), quantile(v, 0.75).alias("q3"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_ddof0"))
