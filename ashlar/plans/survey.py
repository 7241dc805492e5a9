"""The survey stand-in: a coded questionnaire with nulls, built on the order tables.

Its columns are plain SQL expressions that Spark and DuckDB read alike, so both
sides of a comparison see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CODES = [
    ("record", "k"),
    ("psu", "CAST(nk AS BIGINT)"),
    ("stratum", "CAST(rk AS BIGINT)"),
    ("weight", "1 + CAST(k % 5 AS DOUBLE) / 4"),
    ("sitio", "'S1'"),
    ("q49", "CASE WHEN k % 40 = 0 THEN NULL ELSE 1 + (k * 7 + nk) % 8 END"),
    ("q4", "CASE WHEN k % 11 < 4 THEN NULL ELSE CAST(1.2 AS DOUBLE) + CAST((k * 37 + ck) % 84 AS DOUBLE) / 100 END"),
    ("q5", "CASE WHEN k % 11 < 4 THEN NULL ELSE 27 + CAST((k * 53 + ck * 3) % 1600 AS DOUBLE) / 10 END"),
    ("q6", "CASE WHEN k % 13 = 0 THEN NULL ELSE 1 + (k + ck) % 5 END"),
    ("q2", "CASE WHEN ck % 113 = 0 THEN NULL ELSE 1 + ck % 2 END"),
    ("q28", "CASE WHEN ck % 3 = 0 THEN 1 ELSE 2 + ck % 7 END"),
    ("qn28", "CASE WHEN ck % 3 = 0 OR k % 97 = 0 THEN NULL ELSE 1 + k % 2 END"),
]
_LABELS = [
    ("texto_q49", "CASE WHEN q49 IS NULL THEN 'Dato perdido' WHEN q49 = 2 THEN '1 día' ELSE concat(CAST(q49 - 1 AS STRING), ' días') END"),
    ("qnpa5g", "CAST(CASE WHEN q49 IS NULL THEN NULL WHEN q49 >= 6 THEN 1 ELSE 2 END AS BIGINT)"),
    ("texto_qnpa5g", "CASE WHEN q49 IS NULL THEN 'Dato perdido' WHEN q49 >= 6 THEN 'Sí' ELSE 'No' END"),
    ("texto_q6", "CASE q6 WHEN 1 THEN 'Nunca' WHEN 2 THEN 'Rara vez' WHEN 3 THEN 'Algunas veces' WHEN 4 THEN 'Casi siempre' WHEN 5 THEN 'Siempre' ELSE 'Dato perdido' END"),
    ("texto_q2", "CASE q2 WHEN 1 THEN 'Hombre' WHEN 2 THEN 'Mujer' ELSE 'Dato perdido' END"),
    ("texto_q28", "CASE WHEN q28 = 1 THEN 'Nunca probé cigarrillos' ELSE concat(CAST(q28 + 5 AS STRING), ' años') END"),
    ("target", "CAST(CASE WHEN q49 IS NULL THEN NULL WHEN q49 - 1 >= 5 THEN 1 ELSE 0 END AS BIGINT)"),
]
COLUMNS = [n for n, _ in _CODES + _LABELS]
_BASE = "SELECT o_orderkey AS k, o_custkey AS ck, c_nationkey AS nk, n_regionkey AS rk FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"

#: the view for DuckDB, to stand in a WITH clause
SQL = (
    f"survey AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _LABELS)} FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in _CODES)} FROM ({_BASE})))"
)


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order; joins are left to the planner, which broadcasts the small side if it is small."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("ck"))
    customer = read("customer").select("c_custkey", F.col("c_nationkey").alias("nk"))
    nation = read("nation").select("n_nationkey", F.col("n_regionkey").alias("rk"))
    base = orders.join(customer, orders.ck == customer.c_custkey).join(nation, customer.nk == nation.n_nationkey)
    codes = base.selectExpr(*(f"{e} AS {n}" for n, e in _CODES))
    return codes.selectExpr("*", *(f"{e} AS {n}" for n, e in _LABELS))


def supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey(spark, sf_dir).where("target IS NOT NULL")
