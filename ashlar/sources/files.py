"""Readers and writers of tables and artifacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import digits15, finite
from ..operators.catalog import schema_of


class SourceError(RuntimeError):
    pass


def locate(spark: SparkSession, root: str, name: str) -> str:
    """The one file called ``name`` anywhere below ``root``."""
    found = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path").take(2)]
    if len(found) != 1:
        raise SourceError(f"{len(found) or 'no'} file{'s' * (len(found) != 1)} called {name} below {root}")
    return found[0]


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names without a byte-order mark."""
    names = spark.read.option("header", True).option("sep", sep).csv(path).columns
    return [n.removeprefix("﻿") for n in names]


def read_survey(spark: SparkSession, path: str, sep: str = ",", continuous: tuple[str, ...] = ("q4", "q5")) -> DataFrame:
    """A survey file with the schema its column names tell (``catalog.schema_of``); malformed rows raise."""
    schema = schema_of(header(spark, path, sep), continuous)
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "FAILFAST").option("enforceSchema", True).csv(path)


def read_artifact(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A CSV artifact, with or without a byte-order mark."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.toDF(*(c.removeprefix("﻿") for c in df.columns))


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_csv(df: DataFrame, path: str, single: bool = False, fifteen_digits: bool = False) -> None:
    """CSV with a header; ``single`` makes one file of a small table."""
    if fifteen_digits:
        df = df.withColumns({f.name: digits15(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.DoubleType)})
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_snapshot(df: DataFrame, path: str, by: str = "partition") -> None:
    """One table for both sides of the boundary; a reader of one side opens only its files."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def read_snapshot(spark: SparkSession, path: str, side: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("partition") == side) if side else df


def without_nan(df: DataFrame) -> DataFrame:
    """Null for NaN and infinities in all double and float columns."""
    return df.withColumns({f.name: finite(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)})
