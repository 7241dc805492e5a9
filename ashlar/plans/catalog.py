"""Registry of the named queries and their SQL oracles.

Every query is a thin application of operators to the standard tables.  Doubles
are rounded to six digits on both sides, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..operators import boundary, catalog, checks, lineage, profile, quality, reduce, resample, select, stages
from ..operators.quantiles import kept
from . import survey as survey_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "standard_scale"

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CODED = {"q49": "texto_q49", "qnpa5g": "texto_qnpa5g", "q6": "texto_q6", "q2": "texto_q2", "q28": "texto_q28"}
NULLABLE = ["q2", "q28", "q4", "q49", "q5", "q6", "qn28"]


def query(sql: str | None = None, survey: bool = False):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: _rounded(f(spark, sf_dir))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            body = sql.strip()
            if survey:
                body = body.replace("WITH ", f"WITH {survey_view.SQL}, ", 1) if body.startswith("WITH ") else f"WITH {survey_view.SQL} {body}"
            ORACLES[f.__name__] = body
        return f

    return register


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, counts to bigint."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, T.DoubleType):
            out[f.name] = F.round(F.col(f.name) + 1e-10, 6)  # settles means that end in a 5
        elif isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType):
            out[f.name] = F.col(f.name).cast("long")
    return df.withColumns(out) if out else df


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _survey(spark, sf_dir):
    return survey_view.survey(spark, sf_dir)


def _split(spark, sf_dir):
    """The split, computed once for the passes that fit and transform on it."""
    return kept(boundary.stratified_split(_survey(spark, sf_dir), "record", "target"))


#: the split in SQL: largest-remainder allocation, then hash order inside a class
_SPLIT = """
alloc AS (SELECT target, n, base + CASE WHEN row_number() OVER (ORDER BY exact - base DESC, target) <= ceil(total * 0.2) - sum(base) OVER () THEN 1 ELSE 0 END AS test_n
  FROM (SELECT target, n, total, ceil(total * 0.2) * n / total AS exact, floor(ceil(total * 0.2) * n / total) AS base
        FROM (SELECT target, CAST(count(*) AS DOUBLE) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS total FROM survey WHERE target IS NOT NULL GROUP BY target))),
split AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.target ORDER BY md5('42:' || CAST(record AS VARCHAR)), record) <= test_n THEN 'test' ELSE 'train' END AS partition
  FROM survey s JOIN alloc a ON s.target = a.target)"""

_STATS = """count({c}) AS observed_n, count(*) - count({c}) AS missing_n, round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct, round(avg({c}) + 1e-10, 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median,
 round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.75), 6) AS q3, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr,
 round(max({c}), 6) AS max, count(DISTINCT {c}) AS n_unique, round(skewness({c}), 6) AS skewness"""


def _each(template: str, columns, table: str, tail: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {template.replace('{c}', c)} FROM {table} {tail}" for c in columns)


# -- profiles ------------------------------------------------------------------


@query(_each("'{c}' AS \"column\", " + _STATS, LINE_NUMBERS, "lineitem"))
def num_profile(spark, sf_dir):
    return profile.numeric_summary(_table(spark, sf_dir, "lineitem"), LINE_NUMBERS)


@query(_each("target, '{c}' AS \"column\", " + _STATS, ["q4", "q5"], "survey", "WHERE target IS NOT NULL GROUP BY target"), survey=True)
def num_profile_by_target(spark, sf_dir):
    return profile.numeric_summary(survey_view.supervised(spark, sf_dir), ["q4", "q5"], ["target"])


_CAT = """WITH long AS ({long}), n AS (SELECT "column", value, count(*) AS n FROM long GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value IS NULL, n DESC, value) AS r FROM n)
SELECT "column", count(value) AS cardinality, CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS missing_n, round(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) * 100.0 / sum(n), 6) AS missing_pct,
 max(value) FILTER (WHERE r = 1) AS mode_category, max(n) FILTER (WHERE r = 1 AND value IS NOT NULL) AS mode_frequency, round(max(n) FILTER (WHERE r = 1 AND value IS NOT NULL) * 100.0 / sum(n) FILTER (WHERE value IS NOT NULL), 6) AS mode_pct_observed,
 '[' || string_agg('"' || value || '"', ',' ORDER BY r) FILTER (WHERE value IS NOT NULL) || ']' AS observed_values FROM r GROUP BY "column" """


@query(_CAT.replace("{long}", _each("'{c}' AS \"column\", CAST({c} AS VARCHAR) AS value", ["o_orderstatus", "o_orderpriority"], "orders")))
def cat_profile(spark, sf_dir):
    return profile.categorical_summary(_table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(_CAT.replace("{long}", _each("'{c}' AS \"column\", CAST({c} AS VARCHAR) AS value", ["q2", "q6", "q28"], "survey")), survey=True)
def cat_profile_survey(spark, sf_dir):
    return profile.categorical_summary(_survey(spark, sf_dir), ["q2", "q6", "q28"])


_NULLS = "'{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS missing_n, round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct"


@query(_each(_NULLS, NULLABLE, "survey"), survey=True)
def null_ranking(spark, sf_dir):
    return profile.null_ranking(_survey(spark, sf_dir), NULLABLE)


_DICTIONARY = """SELECT "column", CASE WHEN layer IS NULL THEN 'q_response' ELSE layer END AS layer, statistical_type, n_unique, missing_n, domain, true AS model_candidate FROM (
 SELECT 'q2' AS "column", NULL AS layer, 'binary_categorical' AS statistical_type, count(DISTINCT q2) AS n_unique, count(*) - count(q2) AS missing_n, '["Hombre","Mujer"]' AS domain FROM survey
 UNION ALL SELECT 'q6', NULL, 'ordinal_categorical', count(DISTINCT q6), count(*) - count(q6), '["Algunas veces","Casi siempre","Nunca","Rara vez","Siempre"]' FROM survey
 UNION ALL SELECT 'q28', NULL, 'unknown_categorical', count(DISTINCT q28), count(*) - count(q28), '[' || (SELECT string_agg('"' || t || '"', ',' ORDER BY t) FROM (SELECT DISTINCT texto_q28 AS t FROM survey WHERE q28 IS NOT NULL)) || ']' FROM survey
 UNION ALL SELECT 'q49', NULL, 'ordinal_categorical', count(DISTINCT q49), count(*) - count(q49), '[' || (SELECT string_agg('"' || t || '"', ',' ORDER BY t) FROM (SELECT DISTINCT texto_q49 AS t FROM survey WHERE q49 IS NOT NULL)) || ']' FROM survey
 UNION ALL SELECT 'qnpa5g', 'qn_derived', 'binary_categorical', count(DISTINCT qnpa5g), count(*) - count(qnpa5g), '["No","Sí"]' FROM survey
 UNION ALL SELECT 'q4', NULL, 'continuous', count(DISTINCT q4), count(*) - count(q4), format('{:.2f}..{:.2f}', min(q4), max(q4)) FROM survey
 UNION ALL SELECT 'q5', NULL, 'continuous', count(DISTINCT q5), count(*) - count(q5), format('{:.2f}..{:.2f}', min(q5), max(q5)) FROM survey)"""


@query(_DICTIONARY, survey=True)
def data_dictionary(spark, sf_dir):
    return catalog.dictionary(_survey(spark, sf_dir), CODED, ["q4", "q5"])


@query(_each("'{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_distinct_with_null", ["q2", "q6", "q49"], "survey"), survey=True)
def distinct_values(spark, sf_dir):
    return profile.distinct_counts(_survey(spark, sf_dir), ["q2", "q6", "q49"])


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS n_duplicate FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)")
def distinct_duplicates(spark, sf_dir):
    return profile.duplicate_rows(_table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""SELECT c AS category, t AS target, n, CAST(sum(n) OVER (PARTITION BY c) AS BIGINT) AS category_total, round(n * 100.0 / sum(n) OVER (PARTITION BY c), 6) AS target_pct_within_category
 FROM (SELECT q6 AS c, target AS t, count(*) AS n FROM survey WHERE target IS NOT NULL GROUP BY ALL)""", survey=True)
def category_target_pct(spark, sf_dir):
    return profile.category_target(survey_view.supervised(spark, sf_dir), "q6", "target")


@query("""SELECT q28 AS category, count(*) FILTER (WHERE target = 0) AS n_0, count(*) FILTER (WHERE target = 1) AS n_1, round(count(*) FILTER (WHERE target = 0) * 1.0 / count(*), 6) AS share_0, round(count(*) FILTER (WHERE target = 1) * 1.0 / count(*), 6) AS share_1
 FROM survey WHERE target IS NOT NULL GROUP BY q28""", survey=True)
def target_pivot_norm(spark, sf_dir):
    return profile.target_pivot(survey_view.supervised(spark, sf_dir), "q28", "target")


_CLUSTERS = "SELECT psu, count(*) AS n_rows, count(*) FILTER (WHERE target = 0) AS target_0_n, count(*) FILTER (WHERE target = 1) AS target_1_n, avg(target) AS positive_rate FROM survey WHERE target IS NOT NULL GROUP BY psu"


@query(f"SELECT * REPLACE (round(positive_rate, 6) AS positive_rate) FROM ({_CLUSTERS})", survey=True)
def cluster_profile(spark, sf_dir):
    return profile.cluster_profile(survey_view.supervised(spark, sf_dir), "psu", "target")


@query(f"SELECT count(*) AS clusters, min(n_rows) AS min_size, round(median(n_rows), 6) AS median_size, max(n_rows) AS max_size, round(min(positive_rate), 6) AS min_rate, round(max(positive_rate), 6) AS max_rate, count(*) FILTER (WHERE target_0_n = 0 OR target_1_n = 0) AS one_class_n FROM ({_CLUSTERS})", survey=True)
def cluster_spread(spark, sf_dir):
    return profile.cluster_spread(profile.cluster_profile(survey_view.supervised(spark, sf_dir), "psu", "target"))


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS t FROM lineitem)
SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin, count(*) AS n, round(count(*) / (max(t) * max((hi - lo) / 30)), 6) AS density FROM lineitem, e GROUP BY 1""")
def histogram(spark, sf_dir):
    return profile.histogram(_table(spark, sf_dir, "lineitem"), "l_extendedprice", 30)


@query(_each("l_returnflag, '{c}' AS \"column\", " + _STATS, ["l_quantity"], "lineitem", "GROUP BY l_returnflag"))
def boxplot_stats(spark, sf_dir):
    return profile.numeric_summary(_table(spark, sf_dir, "lineitem"), ["l_quantity"], ["l_returnflag"])


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr, round(covar_samp({a}, {b}), 6) AS covar FROM lineitem" for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i:]))
def corr_matrix(spark, sf_dir):
    return profile.correlation_matrix(_table(spark, sf_dir, "lineitem"), LINE_NUMBERS)


# -- targets and leakage ---------------------------------------------------------


@query("""SELECT record, CASE WHEN q49 IS NULL THEN NULL WHEN CAST(regexp_extract(strip_accents(lower(texto_q49)), '^(\\d+)\\s+dias?$', 1) AS INT) >= 5 THEN CAST(1 AS BIGINT) ELSE 0 END AS target FROM survey""", survey=True)
def label_target(spark, sf_dir):
    s = _survey(spark, sf_dir).drop("target")
    return quality.with_threshold_target(s, quality.day_map(s, "q49", "texto_q49"), "q49", 5).select("record", "target")


@query("""WITH m AS (SELECT q49 AS code, min(texto_q49) AS label, count(DISTINCT texto_q49) AS labels, CAST(nullif(regexp_extract(strip_accents(lower(min(texto_q49))), '^(\\d+)\\s+dias?$', 1), '') AS BIGINT) AS days FROM survey WHERE q49 IS NOT NULL GROUP BY q49)
SELECT code, label, days, (SELECT max(labels) = 1 AND count(days) = count(*) AND count(DISTINCT days) = count(*) AND list_sort(list(days)) = [0, 1, 2, 3, 4, 5, 6, 7] FROM m) AS valid FROM m""", survey=True)
def label_day_map(spark, sf_dir):
    return quality.day_map(_survey(spark, sf_dir), "q49", "texto_q49")


@query("""WITH p AS (SELECT target AS a, CASE WHEN qnpa5g IS NULL THEN NULL WHEN strip_accents(lower(texto_qnpa5g)) = 'si' THEN 1 WHEN lower(texto_qnpa5g) = 'no' THEN 0 END AS b FROM survey)
SELECT count(*) FILTER (WHERE a = 0 AND b = 0) AS n_00, count(*) FILTER (WHERE a = 0 AND b = 1) AS n_01, count(*) FILTER (WHERE a = 1 AND b = 0) AS n_10, count(*) FILTER (WHERE a = 1 AND b = 1) AS n_11,
 count(*) FILTER (WHERE a = b) AS matches, count(*) FILTER (WHERE a <> b) AS discrepancies, round(count(*) FILTER (WHERE a = b) * 100.0 / count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL), 6) AS match_pct,
 count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS both_observed, count(*) FILTER (WHERE a IS NOT NULL AND b IS NULL) AS only_a, count(*) FILTER (WHERE a IS NULL AND b IS NOT NULL) AS only_b, count(*) FILTER (WHERE a IS NULL AND b IS NULL) AS neither FROM p""", survey=True)
def yes_no_agreement(spark, sf_dir):
    s = _survey(spark, sf_dir).withColumn("proxy", F.when(F.col("qnpa5g").isNotNull(), quality.yes_no(F.col("texto_qnpa5g"))))
    return quality.agreement(s, "target", "proxy")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS candidate, bool_and((q49 IS NULL) = ({c} IS NULL)) AS same_null_mask, (SELECT max(d) FROM (SELECT count(DISTINCT {c}) AS d FROM survey WHERE q49 IS NOT NULL GROUP BY q49)) AS max_values,
 count(DISTINCT {c}) AS n_values, bool_and((q49 IS NULL) = ({c} IS NULL)) AND (SELECT max(d) FROM (SELECT count(DISTINCT {c}) AS d FROM survey WHERE q49 IS NOT NULL GROUP BY q49)) <= 1 AND count(DISTINCT {c}) > 1 AS is_derivative FROM survey""" for c in ("qnpa5g", "q6", "q2", "target")), survey=True)
def functional_dependency(spark, sf_dir):
    return quality.functional_dependents(_survey(spark, sf_dir), "q49", ["qnpa5g", "q6", "q2", "target"])


@query("""WITH p AS (SELECT DISTINCT coalesce(CAST(q6 AS VARCHAR), '<NA>') AS a, texto_q6 AS b FROM survey) SELECT count(*) AS pairs_n, count(DISTINCT a) AS a_n, count(DISTINCT b) AS b_n, count(*) = count(DISTINCT a) AND count(*) = count(DISTINCT b) AS is_bijection FROM p""", survey=True)
def bijection_test(spark, sf_dir):
    return quality.bijection(_survey(spark, sf_dir), "q6", "texto_q6")


@query("""SELECT q28 AS code, min(texto_q28) AS label, count(DISTINCT texto_q28) AS labels_n FROM survey WHERE q28 IS NOT NULL GROUP BY q28""", survey=True)
def label_maps(spark, sf_dir):
    return quality.label_map(_survey(spark, sf_dir), "q28", "texto_q28")


# -- missingness -----------------------------------------------------------------

_RATE = "SELECT {g} AS category, count(*) AS n, count(*) FILTER (WHERE q4 IS NULL AND q5 IS NULL) AS missing_n, count(*) FILTER (WHERE NOT (q4 IS NULL AND q5 IS NULL)) AS observed_n, count(*) FILTER (WHERE q4 IS NULL AND q5 IS NULL) * 100.0 / count(*) AS missing_pct FROM survey GROUP BY {g}"
_EVIDENCE = " UNION ALL ".join(f"SELECT '{g}' AS evidence_source, count(*) AS groups, min(missing_pct) AS min_missing_pct, max(missing_pct) AS max_missing_pct, max(missing_pct) - min(missing_pct) AS absolute_range_pp FROM ({_RATE.replace('{g}', g)})" for g in ("target", "psu", "stratum", "q2"))


def _joint():
    return F.col("q4").isNull() & F.col("q5").isNull()


def _evidence(spark, sf_dir):
    s = _survey(spark, sf_dir)
    return quality.rate_evidence({g: quality.missing_by_group(s, _joint(), g) for g in ("target", "psu", "stratum", "q2")})


@query(f"SELECT * REPLACE (round(missing_pct, 6) AS missing_pct) FROM ({_RATE.replace('{g}', 'q2')})", survey=True)
def null_rate_by_group(spark, sf_dir):
    return quality.missing_by_group(_survey(spark, sf_dir), _joint(), "q2")


@query(f"SELECT evidence_source, groups, round(min_missing_pct, 6) AS min_missing_pct, round(max_missing_pct, 6) AS max_missing_pct, round(absolute_range_pp, 6) AS absolute_range_pp FROM ({_EVIDENCE})", survey=True)
def null_rate_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir)


@query(f"SELECT count(*) FILTER (WHERE absolute_range_pp >= 5) AS sources_n, CASE WHEN count(*) FILTER (WHERE absolute_range_pp >= 5) >= 2 THEN 'MAR_HIPOTESIS_RESPALDADA' WHEN count(*) FILTER (WHERE absolute_range_pp >= 5) = 1 THEN 'MAR_HIPOTESIS_DEBIL' ELSE 'NO_IDENTIFICABLE' END AS mechanism FROM ({_EVIDENCE})", survey=True)
def null_mechanism(spark, sf_dir):
    return quality.mechanism(_evidence(spark, sf_dir))


@query("""WITH b AS (SELECT qn28 IS NULL AS m, starts_with(strip_accents(lower(texto_q28)), 'nunca ') AS s FROM survey)
SELECT 'qn28' AS dependent_col, 'texto_q28' AS filter_col, count(*) FILTER (WHERE s) AS n_filter_non_applicable, count(*) FILTER (WHERE m) AS n_missing_dependent, count(*) FILTER (WHERE s <> m) AS mismatch_n, count(*) FILTER (WHERE s AND NOT m) AS observed_though_skipped_n,
 count(*) FILTER (WHERE s <> m) = 0 AS exact_mask_match, CASE WHEN count(*) FILTER (WHERE s <> m) = 0 THEN 'ESTRUCTURAL_DEMOSTRADO' WHEN count(*) FILTER (WHERE s AND NOT m) = 0 THEN 'ESTRUCTURAL_POSIBLE_BRANCHING' ELSE 'NO_IDENTIFICABLE' END AS classification FROM b""", survey=True)
def branching_test(spark, sf_dir):
    return quality.branching(_survey(spark, sf_dir), "qn28", "texto_q28")


@query("""WITH p AS (""" + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) FILTER (WHERE {a} IS NULL) AS missing_a, count(*) FILTER (WHERE {b} IS NULL) AS missing_b, count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) AS both_missing FROM survey" for i, a in enumerate(NULLABLE) for b in NULLABLE[i + 1 :]) + """),
s AS (SELECT *, CASE WHEN missing_a > 0 THEN both_missing * 100.0 / missing_a ELSE 0 END AS x, CASE WHEN missing_b > 0 THEN both_missing * 100.0 / missing_b ELSE 0 END AS y, CASE WHEN missing_a + missing_b - both_missing > 0 THEN both_missing * 1.0 / (missing_a + missing_b - both_missing) ELSE 0 END AS j FROM p)
SELECT column_a, column_b, missing_a, missing_b, both_missing, round(x, 6) AS missing_a_shared_pct, round(y, 6) AS missing_b_shared_pct, round(j, 6) AS jaccard_missing, round(least(x, y), 6) AS min_shared_pct FROM s WHERE least(x, y) >= 80 OR (column_a = 'q4' AND column_b = 'q5') ORDER BY least(x, y) DESC, both_missing DESC, column_a, column_b LIMIT 50""", survey=True)
def null_cooccurrence(spark, sf_dir):
    return quality.null_cooccurrence(_survey(spark, sf_dir), NULLABLE, least_pct=80.0, top=50, always=[("q4", "q5")])


_BRANCH = """SELECT 'qn28' AS dependent_col, 'texto_q28' AS filter_col, count(*) FILTER (WHERE s) AS n_filter_non_applicable, count(*) FILTER (WHERE m) AS n_missing_dependent, count(*) FILTER (WHERE s <> m) AS mismatch_n, count(*) FILTER (WHERE s AND NOT m) AS observed_though_skipped_n, count(*) FILTER (WHERE s <> m) = 0 AS exact_mask_match,
 CASE WHEN count(*) FILTER (WHERE s) = 0 THEN 'NO_IDENTIFICABLE' WHEN count(*) FILTER (WHERE s <> m) = 0 THEN 'ESTRUCTURAL_DEMOSTRADO' WHEN count(*) FILTER (WHERE s AND NOT m) = 0 THEN 'ESTRUCTURAL_POSIBLE_BRANCHING' ELSE 'NO_IDENTIFICABLE' END AS classification FROM (SELECT qn28 IS NULL AS m, starts_with(strip_accents(lower(texto_q28)), 'nunca ') AS s FROM survey)"""
_MECHANISM = f"SELECT CASE WHEN count(*) FILTER (WHERE absolute_range_pp >= 5) >= 2 THEN 'MAR_HIPOTESIS_RESPALDADA' WHEN count(*) FILTER (WHERE absolute_range_pp >= 5) = 1 THEN 'MAR_HIPOTESIS_DEBIL' END FROM ({_EVIDENCE})"


@query(_BRANCH, survey=True)
def branching_found(spark, sf_dir):
    """The dependents whose filter question is found by name."""
    return quality.branching_table(_survey(spark, sf_dir), NULLABLE)


@query(f"""SELECT *, CASE WHEN missing_n = 0 THEN 'SIN_FALTANTES' WHEN missing_n = n_rows THEN 'VACIA' WHEN "column" = 'qn28' AND (SELECT classification LIKE 'ESTRUCTURAL%' FROM ({_BRANCH})) THEN (SELECT classification FROM ({_BRANCH})) WHEN "column" IN ('q4', 'q5') AND ({_MECHANISM}) IS NOT NULL THEN ({_MECHANISM}) WHEN missing_pct >= 40 THEN 'ALTA_SIN_EXPLICACION' ELSE 'NO_IDENTIFICABLE' END AS diagnosis FROM ({_each(_NULLS, NULLABLE, 'survey')})""", survey=True)
def null_diagnosis(spark, sf_dir):
    return quality.diagnosis_from_data(_survey(spark, sf_dir), NULLABLE, ["q4", "q5"], ["target", "psu", "stratum", "q2"])


@query("""SELECT round(a, 6) AS rate_a_pct, round(b, 6) AS rate_b_pct, round(abs(b - a), 6) AS absolute_difference_pp, round(CASE WHEN a > 0 THEN b / a END, 6) AS rate_ratio FROM (SELECT count(*) FILTER (WHERE q4 IS NULL AND q5 IS NULL AND target = 0) * 100.0 / count(*) FILTER (WHERE target = 0) AS a, count(*) FILTER (WHERE q4 IS NULL AND q5 IS NULL AND target = 1) * 100.0 / count(*) FILTER (WHERE target = 1) AS b FROM survey)""", survey=True)
def rate_contrast(spark, sf_dir):
    return quality.rate_contrast(_survey(spark, sf_dir), _joint(), "target", 0, 1)


@query(_each("'{c}' AS \"column\", count({c}) AS observed_n, count(*) FILTER (WHERE {c} IS NOT NULL AND try_cast(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL) AS invalid_n", ["q4", "q6", "texto_q28"], "survey"), survey=True)
def invalid_numbers(spark, sf_dir):
    return quality.invalid_numbers(_survey(spark, sf_dir), ["q4", "q6", "texto_q28"])


@query("SELECT record, q2, q28, q49, q6 FROM survey", survey=True)
def dense_columns(spark, sf_dir):
    """Columns that are null in more than 20 percent of the rows go."""
    return quality.without_null_columns(_survey(spark, sf_dir).select("record", *NULLABLE), NULLABLE, 20.0)


@query(_each("'{c}' AS \"column\", bool_and({c} IS NOT NULL) AS finite, coalesce(bool_and({c} = round({c})), true) AS whole, coalesce(bool_and({c} IN (0, 1)), true) AS binary", ["target", "q6", "q4", "record"], "survey"), survey=True)
def value_kinds(spark, sf_dir):
    return profile.value_kinds(_survey(spark, sf_dir), ["target", "q6", "q4", "record"])


@query(f"SELECT count(*) FILTER (WHERE missing_pct = 0) AS none_n, count(*) FILTER (WHERE missing_pct = 100) AS all_n, count(*) FILTER (WHERE missing_pct > 0 AND missing_pct < 100) AS between_n FROM ({_RATE.replace('{g}', 'psu')})", survey=True)
def cluster_null_bands(spark, sf_dir):
    return quality.rate_bands(quality.missing_by_group(_survey(spark, sf_dir), _joint(), "psu"))


# -- outliers --------------------------------------------------------------------

OUTLIER_COLUMNS = ["l_extendedprice", "l_quantity"]
RULES = {"l_extendedprice": [(">", 90000.0), ("<", 1000.0)], "l_quantity": [(">=", 50.0)]}
SURVEY_RULES = {"q4": [("<", 1.25), (">", 2.0)], "q5": [(">", 180.0)]}
_LIMITS = {
    "iqr": ("quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))", "quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"),
    "z3": ("avg({c}) - 3 * stddev_samp({c})", "avg({c}) + 3 * stddev_samp({c})"),
}


def _count_sql(method: str) -> str:
    lo, hi = _LIMITS[method]
    one = f"SELECT '{{c}}' AS variable, count({{c}}) AS observed_n, round(max(lo), 6) AS lower, round(max(hi), 6) AS upper, count(*) FILTER (WHERE {{c}} < lo) AS below_n, count(*) FILTER (WHERE {{c}} > hi) AS above_n, count(*) FILTER (WHERE {{c}} < lo OR {{c}} > hi) AS flagged_n, round(count(*) FILTER (WHERE {{c}} < lo OR {{c}} > hi) * 100.0 / count({{c}}), 6) AS flagged_pct_observed FROM lineitem, (SELECT {lo} AS lo, {hi} AS hi FROM lineitem)"
    return " UNION ALL ".join(one.replace("{c}", c) for c in OUTLIER_COLUMNS)


def _flags_sql(table: str, columns: list[str], rules: dict) -> str:
    """A CTE ``flags``: the table with the three flags of each column."""
    lim = ", ".join(f"{lo.replace('{c}', c)} AS {c}_{m}_lo, {hi.replace('{c}', c)} AS {c}_{m}_hi" for c in columns for m, (lo, hi) in _LIMITS.items())
    own = ", ".join(f"coalesce({c} < {c}_{m}_lo OR {c} > {c}_{m}_hi, false) AS {c}_{m}" for c in columns for m in _LIMITS)
    dom = ", ".join(f"coalesce({' OR '.join(f'{c} {op} {t}' for op, t in rules[c])}, false) AS {c}_domain" for c in columns)
    return f"flags AS (SELECT t.*, {own}, {dom} FROM {table} t, (SELECT {lim} FROM {table}) l)"


@query(_count_sql("iqr"))
def iqr_outliers(spark, sf_dir):
    return quality.method_counts(_table(spark, sf_dir, "lineitem"), OUTLIER_COLUMNS, "iqr")


@query(_count_sql("z3"))
def z3_outliers(spark, sf_dir):
    return quality.method_counts(_table(spark, sf_dir, "lineitem"), OUTLIER_COLUMNS, "z3")


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, '{n}' AS rule, count({c}) AS observed_n, count(*) FILTER (WHERE {w}) AS flagged_n, round(count(*) FILTER (WHERE {w}) * 100.0 / count({c}), 6) AS flagged_pct_observed FROM lineitem" for c, own in RULES.items() for n, w in [(f"{op}{t:g}", f"{c} {op} {t}") for op, t in own] + [("ANY", " OR ".join(f"{c} {op} {t}" for op, t in own))]))
def domain_flags(spark, sf_dir):
    return quality.domain_counts(_table(spark, sf_dir, "lineitem"), RULES)


@query("WITH " + _flags_sql("lineitem", OUTLIER_COLUMNS, RULES) + " " + " UNION ALL ".join("SELECT '{c}' AS variable, count(*) FILTER (WHERE {c}_iqr) AS iqr_n, count(*) FILTER (WHERE {c}_z3) AS z3_n, count(*) FILTER (WHERE {c}_domain) AS domain_flag_n, count(*) FILTER (WHERE {c}_iqr AND NOT {c}_z3) AS iqr_only_n, count(*) FILTER (WHERE {c}_z3 AND NOT {c}_iqr) AS z3_only_n, count(*) FILTER (WHERE {c}_iqr AND {c}_z3) AS iqr_and_z3_n, count(*) FILTER (WHERE {c}_domain AND NOT {c}_iqr AND NOT {c}_z3) AS domain_only_n, count(*) FILTER (WHERE {c}_iqr AND {c}_domain) AS iqr_and_domain_n, count(*) FILTER (WHERE {c}_z3 AND {c}_domain) AS z3_and_domain_n, count(*) FILTER (WHERE {c}_iqr AND {c}_z3 AND {c}_domain) AS all_three_n FROM flags".replace("{c}", c) for c in OUTLIER_COLUMNS))
def outlier_overlap(spark, sf_dir):
    return quality.method_overlap(quality.flagged(_table(spark, sf_dir, "lineitem"), OUTLIER_COLUMNS, RULES), OUTLIER_COLUMNS)


@query("WITH " + _flags_sql("survey", ["q4", "q5"], SURVEY_RULES) + " SELECT target, count(*) AS n_total, " + ", ".join(f"count({c}) AS {c}_observed_n, count(*) FILTER (WHERE {c}_iqr) AS {c}_iqr_n, round(count(*) FILTER (WHERE {c}_iqr) * 100.0 / count(*), 6) AS {c}_iqr_pct_total, round(count(*) FILTER (WHERE {c}_iqr) * 100.0 / count({c}), 6) AS {c}_iqr_pct_observed" for c in ("q4", "q5")) + ", count(*) FILTER (WHERE q4_domain OR q5_domain) AS any_domain_n FROM flags GROUP BY target", survey=True)
def outlier_by_target(spark, sf_dir):
    return quality.flags_by_target(quality.flagged(_survey(spark, sf_dir), ["q4", "q5"], SURVEY_RULES), ["q4", "q5"], "target")


@query("WITH " + _flags_sql("survey", ["q4", "q5"], SURVEY_RULES) + """, n AS (SELECT *, q4_iqr::INT + q4_z3::INT + q4_domain::INT + q5_iqr::INT + q5_z3::INT + q5_domain::INT AS k FROM flags)
SELECT record, round(q4, 6) AS q4, round(q5, 6) AS q5, CAST(k AS BIGINT) AS flag_count, CASE WHEN (q4_domain OR q5_domain) AND k > 1 THEN 'DOMAIN_AND_STATISTICAL' WHEN q4_domain OR q5_domain THEN 'DOMAIN' WHEN k > 1 THEN 'STATISTICAL_MULTIPLE' ELSE 'STATISTICAL_SINGLE' END AS review_class,
 concat_ws(';', CASE WHEN q4_iqr THEN 'q4_iqr' END, CASE WHEN q4_z3 THEN 'q4_z3' END, CASE WHEN q4_domain THEN 'q4_domain' END, CASE WHEN q5_iqr THEN 'q5_iqr' END, CASE WHEN q5_z3 THEN 'q5_z3' END, CASE WHEN q5_domain THEN 'q5_domain' END) AS evidence FROM n WHERE k > 0""", survey=True)
def outlier_cases(spark, sf_dir):
    return quality.case_review(quality.flagged(_survey(spark, sf_dir), ["q4", "q5"], SURVEY_RULES), "record", ["q4", "q5"])


_COHERENCE = {
    "height_not_numeric": "q4 IS NOT NULL AND try_cast(CAST(q4 AS VARCHAR) AS DOUBLE) IS NULL", "weight_not_numeric": "q5 IS NOT NULL AND try_cast(CAST(q5 AS VARCHAR) AS DOUBLE) IS NULL",
    "height_without_weight": "q4 IS NOT NULL AND q5 IS NULL", "weight_without_height": "q4 IS NULL AND q5 IS NOT NULL", "both_missing": "q4 IS NULL AND q5 IS NULL", "height_not_positive": "q4 <= 0", "weight_not_positive": "q5 <= 0",
    "height_out_of_range": "q4 < 1.2 OR q4 > 2.05", "weight_out_of_range": "q5 < 27 OR q5 > 180", "ratio_above": "q5 / (q4 * q4) > 60",
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) FILTER (WHERE {w}) AS affected_n, CASE WHEN count(*) FILTER (WHERE {w}) > 0 THEN 'REVISAR' ELSE 'OK' END AS classification, count(*) FILTER (WHERE {w}) || ' of ' || count(*) || ' rows (' || printf('%.3f', count(*) FILTER (WHERE {w}) * 100.0 / count(*)) || '%)' AS evidence FROM survey" for n, w in _COHERENCE.items()), survey=True)
def coherence_checks(spark, sf_dir):
    s = _survey(spark, sf_dir)
    return quality.with_evidence(quality.coherence(s, quality.body_checks("q4", "q5", "q4", "q5")), s.count())


@query("SELECT record, round(q5 / (q4 * q4), 6) AS imc FROM survey WHERE q4 IS NOT NULL", survey=True)
def derived_ratio(spark, sf_dir):
    return _survey(spark, sf_dir).select("record", quality.body_ratio(F.col("q4"), F.col("q5")).alias("imc")).where("imc IS NOT NULL")


# -- the boundary ----------------------------------------------------------------


@query("WITH " + _SPLIT.strip() + " SELECT record, target, partition FROM split", survey=True)
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("record", "target", "partition")


@query("WITH " + _SPLIT.strip() + " SELECT partition, count(*) AS n, sha256(string_agg(CAST(record AS VARCHAR), chr(10) ORDER BY CAST(record AS VARCHAR))) AS digest FROM split GROUP BY partition", survey=True)
def membership_digest(spark, sf_dir):
    return boundary.membership_digest(_split(spark, sf_dir), "record")


@query("WITH " + _SPLIT.strip() + ", n AS (SELECT partition, target, count(*) AS n FROM split GROUP BY ALL) SELECT partition, target, n, round(n * 100.0 / sum(n) OVER (PARTITION BY partition), 6) AS pct_partition, round(n * 100.0 / sum(n) OVER (PARTITION BY partition) - sum(n) OVER (PARTITION BY target) * 100.0 / sum(n) OVER (), 6) AS difference_pp_vs_global FROM n", survey=True)
def partition_target_dist(spark, sf_dir):
    return boundary.partition_target(_split(spark, sf_dir), "target")


@query("WITH " + _SPLIT.strip() + " " + _each("partition, " + _NULLS, ["q4", "q6"], "split", "GROUP BY partition") + " UNION ALL " + _each("'global' AS partition, " + _NULLS, ["q4", "q6"], "split"), survey=True)
def partition_null_summary(spark, sf_dir):
    return boundary.partition_nulls(_split(spark, sf_dir), ["q4", "q6"])


@query("WITH " + _SPLIT.strip() + " SELECT psu, count(*) FILTER (WHERE partition = 'train') AS train_n, count(*) FILTER (WHERE partition = 'test') AS test_n, count(*) AS total_n, CASE WHEN bool_or(partition = 'train') AND bool_or(partition = 'test') THEN 'shared' WHEN bool_or(partition = 'train') THEN 'train_only' ELSE 'test_only' END AS partition_status FROM split GROUP BY psu", survey=True)
def cluster_partition_status(spark, sf_dir):
    return boundary.cluster_partitions(_split(spark, sf_dir), "psu")


#: in SQL: which columns are functions of the target's source
_DERIVED = "derived AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, bool_and((q49 IS NULL) = ({c} IS NULL)) AND (SELECT max(d) FROM (SELECT count(DISTINCT {c}) AS d FROM survey WHERE q49 IS NOT NULL GROUP BY q49)) <= 1 AND count(DISTINCT {c}) > 1 AS is_derived FROM survey" for c in ("qnpa5g", "q6", "q2", "q28")) + ")"
_LEAKS = f"""{_DERIVED}, leaks AS (SELECT row_number() OVER (ORDER BY o, t) AS position, c AS "column", reason, action FROM (SELECT 0 AS o, 0 AS t, 'q49' AS c, 'TARGET_SOURCE' AS reason, 'exclude' AS action UNION ALL SELECT 0, 1, 'texto_q49', 'TARGET_SOURCE_LABEL', 'exclude'
 UNION ALL SELECT list_position(['qnpa5g', 'q6', 'q2', 'q28'], c), 0, c, 'HARD_LEAKAGE', 'exclude' FROM derived WHERE is_derived UNION ALL SELECT list_position(['qnpa5g', 'q6', 'q2', 'q28'], c), 1, 'texto_' || c, 'HARD_LEAKAGE_LABEL', 'exclude' FROM derived WHERE is_derived
 UNION ALL SELECT 10, i, c, 'SAMPLE_DESIGN', 'review' FROM (VALUES (1, 'weight'), (2, 'stratum'), (3, 'psu'), (4, 'sitio'), (5, 'record')) v(i, c)))"""


def _leaks(df):
    return catalog.leakage(df, "q49", ["qnpa5g", "q6", "q2", "q28"])


@query(f"WITH {_LEAKS} SELECT * FROM leaks", survey=True)
def leakage_list(spark, sf_dir):
    return _leaks(_survey(spark, sf_dir))


@query(f"""WITH {_LEAKS} SELECT d."column", statistical_type, coalesce(reason, 'INCLUDED') AS exclusion_reason, reason IS NULL AS included FROM ({_DICTIONARY}) d LEFT JOIN leaks l ON l."column" = d."column" AND l.action = 'exclude'""", survey=True)
def feature_contract(spark, sf_dir):
    s = _survey(spark, sf_dir)
    reasons = {r["column"]: r["reason"] for r in _leaks(s).where("action = 'exclude'").collect()}
    return catalog.contract(catalog.dictionary(s, CODED, ["q4", "q5"]), reasons)


@query(f"""WITH {_LEAKS}, n AS (SELECT count(*) AS n FROM survey), d AS (SELECT d.*, l.reason, CASE WHEN reason = 'TARGET_SOURCE' THEN 'target_source' WHEN action = 'exclude' THEN 'leakage' WHEN layer = 'metadata' THEN 'design' ELSE 'feature' END AS role FROM ({_DICTIONARY}) d LEFT JOIN leaks l ON l."column" = d."column")
SELECT "column", layer, role, statistical_type, CASE WHEN statistical_type IN ('binary_categorical', 'continuous') THEN 'high' WHEN statistical_type = 'unknown_categorical' THEN 'low' ELSE 'medium' END AS confidence,
 CASE statistical_type WHEN 'continuous' THEN 'declared continuous' WHEN 'binary_categorical' THEN 'two codes with two labels' WHEN 'ordinal_categorical' THEN 'labels form a known scale' WHEN 'nominal_categorical' THEN 'labels form no known scale' ELSE 'labels are missing or only partly on a scale' END AS basis,
 n_unique, missing_n, round(missing_n * 100.0 / n, 6) AS missing_pct, domain, concat_ws('; ', CASE WHEN missing_n * 100 >= 40 * n THEN 'high missingness' END, CASE WHEN statistical_type = 'unknown_categorical' THEN 'type needs review' END, CASE WHEN role IN ('target_source', 'leakage') THEN 'not a feature' END) AS notes, role = 'feature' AS model_candidate FROM d, n""", survey=True)
def full_dictionary(spark, sf_dir):
    s = _survey(spark, sf_dir)
    return catalog.full_dictionary(s, CODED, ["q4", "q5"], _leaks(s))


@query(f"""SELECT "column", CASE action WHEN 'ordinal' THEN 'ordered' WHEN 'scale' THEN 'numeric' ELSE 'unordered' END AS structure, action, CASE "column" WHEN 'q6' THEN 'keep' WHEN 'q28' THEN 'change' ELSE 'pending' END AS decision, CASE "column" WHEN 'q6' THEN 'a frequency scale' WHEN 'q28' THEN 'ages have an order' ELSE 'not reviewed' END AS reason
FROM (SELECT "column", CASE statistical_type WHEN 'continuous' THEN 'scale' WHEN 'ordinal_categorical' THEN 'ordinal' ELSE 'onehot' END AS action FROM ({_DICTIONARY}))""", survey=True)
def semantic_review(spark, sf_dir):
    plan = catalog.encoding_plan(catalog.dictionary(_survey(spark, sf_dir), CODED, ["q4", "q5"]))
    return catalog.semantic_review(plan, {"q6": ("keep", "a frequency scale"), "q28": ("change", "ages have an order")})


@query("WITH " + _SPLIT.strip() + " SELECT record, target, partition, row_number() OVER (ORDER BY record) - 1 AS position FROM split", survey=True)
def split_positions(spark, sf_dir):
    return checks.with_position(_split(spark, sf_dir).select("record", "target", "partition"), "record")


@query("WITH " + _SPLIT.strip() + """, p AS (SELECT record, partition, row_number() OVER (ORDER BY record) - 1 AS position FROM split)
SELECT 'column_order' AS "check", true AS passed, 'record,target,partition,position' AS detail UNION ALL SELECT 'unique_key', count(*) = count(DISTINCT record), CAST(count(DISTINCT record) AS VARCHAR) FROM p UNION ALL SELECT 'contiguous_position', max(position) - min(position) + 1 = count(*), CAST(count(DISTINCT position) AS VARCHAR) FROM p UNION ALL SELECT 'known_sides', count(*) FILTER (WHERE partition NOT IN ('train', 'test')) = 0, CAST(count(*) FILTER (WHERE partition NOT IN ('train', 'test')) AS VARCHAR) FROM p""", survey=True)
def assignment_checks(spark, sf_dir):
    return checks.valid_assignment(split_positions(spark, sf_dir)).table(spark)


@query("WITH " + _SPLIT.strip() + " SELECT psu, count(*) FILTER (WHERE partition = 'train') AS train_n, count(*) FILTER (WHERE partition = 'test') AS test_n FROM split GROUP BY psu", survey=True)
def side_counts(spark, sf_dir):
    df = _split(spark, sf_dir)
    side = lambda name: df.where(F.col("partition") == name).groupBy("psu").agg(F.count("*").alias(f"{name}_n"))
    return checks.join_counts(side("train"), side("test"), "psu")


@query("SELECT record, q6, row_number() OVER (ORDER BY record DESC) AS position FROM survey WHERE q6 = 5", survey=True)
def keyed_gather(spark, sf_dir):
    s = _survey(spark, sf_dir)
    wanted = checks.with_position(s.where("q6 = 5").select("record", (-F.col("record")).alias("o")), "o").select("record", (F.col("position") + 1).alias("position"))
    return checks.gathered(s.select("record", "q6"), "record", wanted)


@query("SELECT count(*) AS n, count(*) FILTER (WHERE d < 0) AS decreasing_n FROM (SELECT n - lag(n) OVER (ORDER BY psu) AS d FROM (SELECT psu, count(*) AS n FROM survey GROUP BY psu))", survey=True)
def monotone_steps(spark, sf_dir):
    return checks.monotone(_survey(spark, sf_dir).groupBy("psu").agg(F.count("*").alias("n")), "psu", "n")


@query("SELECT DISTINCT texto_q28 AS label, trim(regexp_replace(strip_accents(lower(texto_q28)), '\\s+', ' ', 'g')) AS normal, strip_accents(lower(texto_q28)) AS bare FROM survey UNION SELECT DISTINCT texto_q49, trim(regexp_replace(strip_accents(lower(texto_q49)), '\\s+', ' ', 'g')), strip_accents(lower(texto_q49)) FROM survey", survey=True)
def normal_labels(spark, sf_dir):
    s = _survey(spark, sf_dir)
    labels = s.select(F.col("texto_q28").alias("label")).union(s.select("texto_q49")).distinct()
    return labels.select("label", scalar.normal_label_any("label").alias("normal"), scalar.normal_text_any("label").alias("bare"))


@query("SELECT record, texto_q28 ILIKE '%NUNCA%' AS skipped, coalesce(CAST(q6 AS VARCHAR), 'NA') AS q6_code, row_number() OVER (ORDER BY q4 ASC NULLS LAST, record) AS place FROM survey", survey=True)
def text_and_order(spark, sf_dir):
    """Case-blind contains, codes as text, and places in an order that puts nulls at infinity."""
    s = _survey(spark, sf_dir).withColumn("o", scalar.null_last(F.col("q4")))
    out = checks.with_position(s, "o", "record")
    return out.select("record", scalar.contains_any_case(F.col("texto_q28"), "NUNCA").alias("skipped"), scalar.code_text(F.col("q6")).alias("q6_code"), (F.col("position") + 1).alias("place"))


@query("""SELECT "column", statistical_type, action, 'train' AS fit_partition FROM (VALUES ('q49', 'ordinal_categorical', 'ordinal'), ('qnpa5g', 'binary_categorical', 'onehot'), ('q6', 'ordinal_categorical', 'ordinal'), ('q2', 'binary_categorical', 'onehot'), ('q28', 'unknown_categorical', 'onehot'), ('q4', 'continuous', 'scale'), ('q5', 'continuous', 'scale')) t("column", statistical_type, action)""")
def encoding_plan(spark, sf_dir):
    return catalog.encoding_plan(catalog.dictionary(_survey(spark, sf_dir), CODED, ["q4", "q5"]))


# -- fit on train, transform both ------------------------------------------------

_MEDIANS = "med AS (SELECT median(q4) AS m4, median(q5) AS m5 FROM split WHERE partition = 'train')"
_IMPUTED = f"{_SPLIT.strip()}, {_MEDIANS}, imputed AS (SELECT s.* REPLACE (coalesce(q4, m4) AS q4, coalesce(q5, m5) AS q5), q4 IS NULL AS was_null FROM split s, med)"


def _imputed(spark, sf_dir):
    df = stages.joint_indicator(_split(spark, sf_dir), ["q4", "q5"], "q4q5_missing")
    return stages.impute(df, stages.fit_median(df, ["q4", "q5"]))


@query(f"WITH {_IMPUTED} SELECT record, partition, round(q4, 6) AS q4, round(q5, 6) AS q5, CAST(was_null AS BIGINT) AS q4q5_missing FROM imputed", survey=True)
def median_impute(spark, sf_dir):
    return _imputed(spark, sf_dir).select("record", "partition", "q4", "q5", "q4q5_missing")


@query(f"WITH {_SPLIT.strip()} " + _each("'{c}' AS \"column\", count({c}) AS fit_observed_n, count(*) - count({c}) AS fit_missing_n, round(median({c}), 6) AS learned_value", ["q4", "q5"], "split", "WHERE partition = 'train'"), survey=True)
def median_params(spark, sf_dir):
    return stages.fit_median(_split(spark, sf_dir), ["q4", "q5"])


@query("SELECT bool_and((q4 IS NULL) = (q5 IS NULL)) AS same, count(*) FILTER (WHERE (q4 IS NULL) <> (q5 IS NULL)) AS mismatch_n FROM survey", survey=True)
def joint_masks(spark, sf_dir):
    return stages.same_masks(_survey(spark, sf_dir), "q4", "q5")


@query(f"WITH {_IMPUTED} SELECT 'q4' AS \"column\", count(*) FILTER (WHERE s.q4 IS NOT NULL AND s.q4 IS DISTINCT FROM i.q4) AS changed_n FROM split s JOIN imputed i USING (record) UNION ALL SELECT 'q5', count(*) FILTER (WHERE s.q5 IS NOT NULL AND s.q5 IS DISTINCT FROM i.q5) FROM split s JOIN imputed i USING (record)", survey=True)
def observed_unchanged(spark, sf_dir):
    return stages.unchanged(_split(spark, sf_dir), _imputed(spark, sf_dir), "record", ["q4", "q5"])


@query(f"WITH {_SPLIT.strip()} SELECT partition, 'before' AS stage, count(*) AS n_rows, count(*) * 4 AS cell_n, CAST(sum((q4 IS NULL)::INT + (q5 IS NULL)::INT + (q6 IS NULL)::INT + (q2 IS NULL)::INT) AS BIGINT) AS missing_n FROM split GROUP BY partition UNION ALL SELECT partition, 'after', count(*), count(*) * 4, 0 FROM split GROUP BY partition", survey=True)
def null_before_after(spark, sf_dir):
    return stages.null_stages(_split(spark, sf_dir), stages.fill_category(_imputed(spark, sf_dir), ["q6", "q2"]), ["q4", "q5", "q6", "q2"])


@query(f"WITH {_IMPUTED}, p AS (SELECT avg(q4) AS a4, stddev_pop(q4) AS s4, avg(q5) AS a5, stddev_pop(q5) AS s5 FROM imputed WHERE partition = 'train'), z AS (SELECT partition, (q4 - a4) / s4 AS q4, (q5 - a5) / s5 AS q5 FROM imputed, p) " + _each("partition, '{c}' AS \"column\", round(avg({c}), 6) + 0.0 AS mean, round(stddev_pop({c}), 6) AS std_ddof0, round(min({c}), 6) AS min, round(max({c}), 6) AS max", ["q4", "q5"], "z", "GROUP BY partition"), survey=True)
def standard_scale(spark, sf_dir):
    """The leak-safe chain: target, split, train medians, train scaler, summary by side."""
    df = _imputed(spark, sf_dir)
    return stages.scaling_summary(stages.scale(df, stages.fit_scaler(df, ["q4", "q5"])), ["q4", "q5"])


_SCALED = f"{_IMPUTED}, p AS (SELECT avg(q4) AS a4, stddev_pop(q4) AS s4, avg(q5) AS a5, stddev_pop(q5) AS s5 FROM imputed WHERE partition = 'train'), z AS (SELECT partition, (q4 - a4) / s4 AS q4, (q5 - a5) / s5 AS q5 FROM imputed, p)"
_SPREAD = "partition, '{c}' AS \"column\", round(avg({c}) + 1e-10, 6) + 0.0 AS mean, round(stddev_pop({c}) + 1e-10, 6) AS std_ddof0, round(min({c}) + 1e-10, 6) AS min, round(max({c}) + 1e-10, 6) AS max"


@query(f"WITH {_SCALED} " + _each(_SPREAD + ", 'before' AS stage", ["q4", "q5"], "imputed", "GROUP BY partition") + " UNION ALL " + _each(_SPREAD + ", 'after' AS stage", ["q4", "q5"], "z", "GROUP BY partition"), survey=True)
def scaling_before_after(spark, sf_dir):
    df = _imputed(spark, sf_dir)
    return stages.scaling_before_after(df, stages.scale(df, stages.fit_scaler(df, ["q4", "q5"])), ["q4", "q5"])


@query(f"WITH {_IMPUTED} " + _each("'{c}' AS \"column\", round(avg({c}), 6) AS mean_train, round(var_pop({c}), 6) AS variance_train, round(stddev_pop({c}), 6) AS scale_train", ["q4", "q5"], "imputed", "WHERE partition = 'train'"), survey=True)
def scaler_params(spark, sf_dir):
    return stages.fit_scaler(_imputed(spark, sf_dir), ["q4", "q5"])


_VOCAB = f"{_SPLIT.strip()}, v AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS \"column\", coalesce(CAST({c} AS VARCHAR), 'sin_dato') AS category FROM split WHERE partition = 'train'" for c in ("q28", "q6")) + "), vocab AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY category = 'sin_dato', try_cast(category AS DOUBLE)) - 1 AS position FROM v)"
_ORDINAL = f"{_VOCAB}, kinds AS (SELECT *, CASE WHEN category = 'sin_dato' THEN 'missing' WHEN \"column\" = 'q28' AND category = '1' THEN 'escape' ELSE 'ordinal' END AS kind FROM vocab), mapping AS (SELECT \"column\", category, kind, CASE kind WHEN 'missing' THEN -1 WHEN 'escape' THEN -3 ELSE row_number() OVER (PARTITION BY \"column\", kind ORDER BY position) - 1 END AS value FROM kinds)"


def _mapping(df):
    return stages.ordinal_map(stages.vocabulary(df, ["q28", "q6"]), {"q28": ["1"]})


@query(f"WITH {_VOCAB} SELECT \"column\", category, position FROM vocab", survey=True)
def train_vocabulary(spark, sf_dir):
    return stages.vocabulary(_split(spark, sf_dir), ["q28", "q6"])


@query(f"WITH {_ORDINAL} SELECT \"column\", category, kind, value FROM mapping", survey=True)
def ordinal_values(spark, sf_dir):
    return _mapping(_split(spark, sf_dir))


@query(f"WITH {_ORDINAL} SELECT record, partition, coalesce(a.value, -2) AS q28_ord, coalesce(b.value, -2) AS q6_ord FROM split LEFT JOIN mapping a ON a.\"column\" = 'q28' AND a.category = coalesce(CAST(q28 AS VARCHAR), 'sin_dato') LEFT JOIN mapping b ON b.\"column\" = 'q6' AND b.category = coalesce(CAST(q6 AS VARCHAR), 'sin_dato')", survey=True)
def ordinal_encode(spark, sf_dir):
    df = _split(spark, sf_dir)
    return stages.encode_ordinal(df, _mapping(df), ["q28", "q6"]).select("record", "partition", "q28_ord", "q6_ord")


@query(f"WITH {_SPLIT.strip()} SELECT record, " + ", ".join(f"CAST(coalesce(q6 = {v}, false) AS BIGINT) AS q6__{v}" for v in range(1, 6)) + ", CAST(q6 IS NULL AS BIGINT) AS q6__sin_dato FROM split", survey=True)
def onehot_encode(spark, sf_dir):
    df = _split(spark, sf_dir)
    out = stages.encode_onehot(df, stages.vocabulary(df, ["q6"]))
    return out.select("record", *(c for c in out.columns if c.startswith("q6__")))


@query("""WITH o AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS partition FROM orders), t AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS c FROM o WHERE partition = 'train')
SELECT 'o_custkey' AS "column", CAST(o_custkey AS VARCHAR) AS category, count(*) AS test_n, 'all_zero' AS policy FROM o WHERE partition = 'test' AND CAST(o_custkey AS VARCHAR) NOT IN (SELECT c FROM t) GROUP BY 2""")
def unseen_audit(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").withColumn("partition", F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train"))
    return stages.unseen(df, stages.vocabulary(df, ["o_custkey"]), ["o_custkey"])


@query(f"WITH {_ORDINAL}, n AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing_before_n, count(*) FILTER (WHERE coalesce(m.value, -2) = -1) AS encoded_n FROM split LEFT JOIN mapping m ON m.\"column\" = '{c}' AND m.category = coalesce(CAST({c} AS VARCHAR), 'sin_dato')" for c in ("q6", "q28")) + ") SELECT *, missing_before_n = encoded_n AS conserved FROM n", survey=True)
def missing_conservation(spark, sf_dir):
    df = _split(spark, sf_dir)
    return stages.missing_conservation(df, stages.encode_ordinal(df, _mapping(df), ["q28", "q6"]), ["q28", "q6"])


@query(f"WITH {_SPLIT.strip()} SELECT DISTINCT 'q2__' || coalesce(CAST(q2 AS VARCHAR), 'sin_dato') AS output_column, 'q2' AS source_column, coalesce(CAST(q2 AS VARCHAR), 'sin_dato') AS category FROM split WHERE partition = 'train' UNION ALL VALUES ('q6_ord', 'q6', NULL), ('q4', 'q4', NULL), ('q5', 'q5', NULL)", survey=True)
def feature_lineage(spark, sf_dir):
    return catalog.lineage(stages.vocabulary(_split(spark, sf_dir), ["q2", "q6"]), ["q6"], ["q4", "q5"])


@query(f"WITH {_IMPUTED}, r AS (SELECT partition, CAST(was_null AS BIGINT) AS q4q5_missing, q5 / (q4 * q4) AS v FROM imputed) SELECT partition, q4q5_missing, count(v) AS n, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q1, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std_ddof0 FROM r GROUP BY ALL", survey=True)
def ratio_feature(spark, sf_dir):
    return stages.describe(_imputed(spark, sf_dir), quality.body_ratio(F.col("q4"), F.col("q5")), ["partition", "q4q5_missing"])


# -- selection, reduction, resampling ----------------------------------------------

_MI = "mi AS (SELECT feature, greatest(0, sum(n / t * ln(n * t / (nx * ny)))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY feature, v) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM (SELECT feature, v, y, CAST(count(*) AS DOUBLE) AS n FROM cells GROUP BY ALL)) GROUP BY feature)"
MI_FEATURES = ["q2", "q28", "q6", "qn28", "stratum", "psu"]
_CELLS = "cells AS (" + _each("'{c}' AS feature, coalesce(CAST({c} AS VARCHAR), '<NA>') AS v, target AS y", MI_FEATURES, "survey", "WHERE target IS NOT NULL") + ")"
_RANKED = f"{_CELLS}, {_MI}, ranked AS (SELECT feature, mi, row_number() OVER (ORDER BY round(mi, 12) DESC, feature) AS rank, row_number() OVER (ORDER BY round(mi, 12) DESC, feature) <= 3 AS selected FROM mi)"


def _ranking(spark, sf_dir):
    mi = select.discrete_information(survey_view.supervised(spark, sf_dir), MI_FEATURES, "target")
    return select.ranked(mi.withColumn("mi", F.round("mi", 12)), 3)


@query("WITH cells AS (" + _each("'{c}' AS feature, CAST({c} AS VARCHAR) AS v, l_linestatus AS y", ["l_returnflag", "l_linenumber"], "lineitem") + f"), {_MI} SELECT feature, round(mi, 6) AS mi FROM mi")
def mi_discrete(spark, sf_dir):
    return select.discrete_information(_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], "l_linestatus")


@query("""WITH s AS (SELECT 1e-10 * greatest(1, avg(abs(o_totalprice))) AS size FROM orders),
p AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_totalprice + size * (CAST('0x' || substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 12) AS BIGINT) / 140737488355328.0 - 1) AS x FROM orders, s),
q AS (SELECT *, count(*) OVER (PARTITION BY y) AS ny, lag(x, 1) OVER w AS a1, lag(x, 2) OVER w AS a2, lag(x, 3) OVER w AS a3, lead(x, 1) OVER w AS b1, lead(x, 2) OVER w AS b2, lead(x, 3) OVER w AS b3 FROM p WINDOW w AS (PARTITION BY y ORDER BY x, id)),
r AS (SELECT id, ny, x, list_sort(list_filter([x - a1, x - a2, x - a3, b1 - x, b2 - x, b3 - x], lambda g: g IS NOT NULL))[3] AS r FROM q),
e AS (SELECT x AS v, 1 AS tag, 0 AS s, id, ny FROM r UNION ALL SELECT x + r - 4e-16 * (abs(x) + r), 0, 1, id, ny FROM r UNION ALL SELECT x - r + 4e-16 * (abs(x) + r), 2, -1, id, ny FROM r),
c AS (SELECT *, sum(CASE WHEN tag = 1 THEN 1 ELSE 0 END) OVER (ORDER BY v, tag ROWS UNBOUNDED PRECEDING) AS run FROM e),
m AS (SELECT id, ny, CAST(sum(s * run) AS BIGINT) AS m FROM c WHERE s <> 0 GROUP BY id, ny),
h AS (SELECT i, sum(1.0 / greatest(i, 1)) FILTER (WHERE i > 0) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS h FROM range((SELECT count(*) FROM p)) t(i))
SELECT 'o_totalprice' AS feature, round(greatest(0, (SELECT h FROM h WHERE i = (SELECT count(*) - 1 FROM m)) + 1.5 - avg(a.h) - avg(coalesce(b.h, 0))), 6) AS mi FROM m JOIN h a ON a.i = ny - 1 JOIN h b ON b.i = m - 1""")
def mi_continuous(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").withColumn("y", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return select.continuous_information(df, "o_orderkey", "o_totalprice", "y")


_MIXED = {"o_orderpriority": True, "o_totalprice": False}


def _mixed(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").withColumn("y", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return select.mixed_information(df, "o_orderkey", _MIXED, "y")


_MIXED_SQL = "WITH cells AS (SELECT 'o_orderpriority' AS feature, o_orderpriority AS v, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders), " + f"{_MI}, scores AS (SELECT feature, mi, true AS discrete FROM mi UNION ALL SELECT feature, mi, false FROM ({ORACLES['mi_continuous']}))"


@query(f"{_MIXED_SQL} SELECT feature, round(mi, 6) AS mi, discrete FROM scores")
def mi_mixed(spark, sf_dir):
    return _mixed(spark, sf_dir)


@query(f"{_MIXED_SQL} SELECT discrete, count(*) AS feature_n, count(*) FILTER (WHERE round(mi, 6) > 0.5) AS selected_n, count(*) FILTER (WHERE mi <= 0) AS zero_mi_n, round(max(mi), 6) AS max_mi FROM scores GROUP BY discrete")
def mi_by_kind(spark, sf_dir):
    return select.summary_by_kind(_mixed(spark, sf_dir).withColumn("selected", F.col("mi") > 0.5))


@query(f"WITH {_RANKED} SELECT feature, round(mi, 6) AS mi, rank, selected FROM ranked", survey=True)
def mi_rank_topk(spark, sf_dir):
    return _ranking(spark, sf_dir)


@query(f"WITH {_RANKED} SELECT CASE WHEN feature LIKE 'q%' THEN 'answers' ELSE 'design' END AS source_column, count(*) AS encoded_columns_n, round(max(mi), 6) AS max_mi, round(sum(mi), 6) AS sum_mi, count(*) FILTER (WHERE selected) AS selected_encoded_columns_n, arg_min(feature, rank) AS best_encoded_feature, min(rank) AS best_rank FROM ranked GROUP BY 1", survey=True)
def mi_source_rollup(spark, sf_dir):
    return select.source_rollup(_ranking(spark, sf_dir), F.when(F.col("feature").startswith("q"), "answers").otherwise("design"))


@query(f"WITH {_RANKED} SELECT count(*) AS input_feature_n, count(*) FILTER (WHERE selected) AS selected_feature_n, round(max(mi), 6) AS top_mi, round(median(mi), 6) AS median_mi, round(min(mi) FILTER (WHERE selected), 6) AS selected_min_mi, count(*) FILTER (WHERE round(mi, 12) <= 0) AS zero_mi_total_n FROM ranked", survey=True)
def selection_summary(spark, sf_dir):
    return select.selection_summary(_ranking(spark, sf_dir))


def _components(spark, sf_dir):
    """All components of the vectors, learned on the train side of the split."""
    vectors = _table(spark, sf_dir, "embeddings")
    n = vectors.agg(F.max(F.size("embedding"))).first()[0]
    train = boundary.stratified_split(vectors, "vec_id", "label").where("partition = 'train'")
    return reduce.vector_columns(vectors, "embedding", n), reduce.fit(reduce.vector_columns(train, "embedding", n), [f"x{i}" for i in range(n)])


@query("""WITH alloc AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY exact - base DESC, label) <= ceil(total * 0.2) - sum(base) OVER () THEN 1 ELSE 0 END AS test_n FROM (SELECT label, total, ceil(total * 0.2) * n / total AS exact, floor(ceil(total * 0.2) * n / total) AS base FROM (SELECT label, CAST(count(*) AS DOUBLE) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS total FROM embeddings WHERE label IS NOT NULL GROUP BY label))),
t AS (SELECT vec_id, embedding FROM (SELECT e.*, test_n, row_number() OVER (PARTITION BY e.label ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) AS r FROM embeddings e JOIN alloc a ON e.label = a.label) WHERE r > test_n),
x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM t)
SELECT 'x' || a.i AS a, 'x' || b.i AS b, round(covar_samp(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) + 1e-10, 6) AS covariance FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i""")
def pca_reconstruction(spark, sf_dir):
    """Variances and loadings together give back the covariance of the train side, which SQL can compute."""
    return reduce.reconstruction(_components(spark, sf_dir)[1], spark)


@query()
def pca_checks(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    n = vectors.agg(F.max(F.size("embedding"))).first()[0]
    train = reduce.vector_columns(boundary.stratified_split(vectors, "vec_id", "label").where("partition = 'train'"), "embedding", n)
    c = reduce.fit(train, [f"x{i}" for i in range(n)])
    return reduce.component_checks(c, c.scores(train, 5), 5)


@query()
def pca_variance(spark, sf_dir):
    return _components(spark, sf_dir)[1].variance_table(spark)


@query()
def pca_thresholds(spark, sf_dir):
    return reduce.thresholds(_components(spark, sf_dir)[1].variance_table(spark), [0.8, 0.9, 0.95])


@query()
def pca_loadings(spark, sf_dir):
    return _components(spark, sf_dir)[1].loading_table(spark)


@query()
def pca_contributors(spark, sf_dir):
    return reduce.contributors(_components(spark, sf_dir)[1].loading_table(spark))


@query()
def pca_scores(spark, sf_dir):
    df, c = _components(spark, sf_dir)
    return c.scores(df, 5)


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 0), d AS (SELECT a.id, b.id AS other, list_distance(a.v, b.v) AS distance FROM e a JOIN e b ON a.id <> b.id)
SELECT * FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank, other, round(distance, 6) AS distance FROM d) WHERE rank <= 5""")
def knn_minority(spark, sf_dir):
    return resample.neighbours(_table(spark, sf_dir, "embeddings").where("label = 0"), "vec_id", "embedding", 5)


def _resampled(spark, sf_dir):
    df = _table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") == 0).cast("int"))
    return resample.oversample(df, "vec_id", "embedding", "y", 1)


_SMOTE = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM embeddings), s AS (SELECT id, v FROM e WHERE y = 1), c AS (SELECT (SELECT count(*) FROM s) AS ns, (SELECT count(*) FROM e WHERE y = 0) - (SELECT count(*) FROM s) AS wanted),
d AS (SELECT a.id, b.id AS other, list_distance(a.v, b.v) AS distance FROM s a JOIN s b ON a.id <> b.id), nn AS (SELECT * FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM d) WHERE rank <= 5),
pl AS (SELECT s.id, v, k, row_number() OVER (ORDER BY md5('42:' || s.id), s.id) AS place FROM s JOIN (SELECT id, count(*) AS k FROM nn GROUP BY id) g ON s.id = g.id),
dr AS (SELECT id, v, k, r AS round FROM pl, c, range((SELECT CAST(ceil(wanted * 1.0 / ns) AS BIGINT) FROM c)) t(r) WHERE r < wanted // ns OR place <= wanted - (wanted // ns) * ns),
pk AS (SELECT id, v, CAST('0x' || substr(md5('42:rank:' || id || ':' || round), 1, 12) AS BIGINT) % k + 1 AS rank, CAST('0x' || substr(md5('42:place:' || id || ':' || round), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM dr),
made AS (SELECT row_number() OVER () AS m, pk.id, nn.other, pk.v, o.v AS w, u FROM pk JOIN nn ON pk.id = nn.id AND pk.rank = nn.rank JOIN s o ON o.id = nn.other)"""


@query(_SMOTE + " SELECT id AS source_id, CAST(NULL AS BIGINT) AS neighbour_id, CAST(y AS BIGINT) AS target, 'original' AS sample_origin, round(list_sum(v) + 1e-10, 6) AS v_sum FROM e UNION ALL SELECT id, other, 1, 'synthetic', round(list_sum(v) + u * (list_sum(w) - list_sum(v)) + 1e-10, 6) FROM made")
def smote_rows(spark, sf_dir):
    return _resampled(spark, sf_dir).select("source_id", "neighbour_id", "target", "sample_origin", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("v_sum"))


@query(_SMOTE + ", n AS (SELECT target, count(*) AS n FROM (SELECT y AS target FROM e UNION ALL SELECT 1 FROM made) GROUP BY target) SELECT CAST(target AS BIGINT) AS target, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct FROM n")
def smote_balance(spark, sf_dir):
    return resample.class_balance(_resampled(spark, sf_dir))


@query(_SMOTE + ", x AS (SELECT a + u * (b - a) AS x FROM (SELECT unnest(v) AS a, unnest(w) AS b, u FROM made)) SELECT count(*) AS total_cells, count(*) FILTER (WHERE x = 0) AS exactly_0_n, count(*) FILTER (WHERE x = 1) AS exactly_1_n, count(*) FILTER (WHERE x > 0 AND x < 1) AS strictly_between_0_1_n, count(*) FILTER (WHERE x < 0 OR x > 1) AS outside_0_1_n, count(*) FILTER (WHERE x <> round(x)) AS fractional_n FROM x")
def interpolation_diag(spark, sf_dir):
    return resample.interpolation_diagnostic(_resampled(spark, sf_dir))


# -- sets, order, lineage ------------------------------------------------------------


@query("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders), j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k)
SELECT count(x) AS a_n, count(y) AS b_n, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS common_n, count(*) FILTER (WHERE y IS NULL) AS only_a_n, count(*) FILTER (WHERE x IS NULL) AS only_b_n, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) = 0 AS disjoint, count(*) FILTER (WHERE x IS NULL OR y IS NULL) = 0 AS equal, count(*) FILTER (WHERE y IS NULL) = 0 AS a_in_b FROM j""")
def set_checks(spark, sf_dir):
    a, b = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return checks.key_sets(a, b, "k")


@query("(SELECT 'bottom' AS side, psu, round(positive_rate, 6) AS positive_rate FROM (" + _CLUSTERS + ") ORDER BY round(positive_rate, 9), psu LIMIT 3) UNION ALL (SELECT 'top', psu, round(positive_rate, 6) FROM (" + _CLUSTERS + ") ORDER BY round(positive_rate, 9) DESC, psu LIMIT 3)", survey=True)
def top_bottom_n(spark, sf_dir):
    p = profile.cluster_profile(survey_view.supervised(spark, sf_dir), "psu", "target").withColumn("o", F.round("positive_rate", 9))
    low = p.orderBy("o", "psu").limit(3).select(F.lit("bottom").alias("side"), "psu", "positive_rate")
    return low.unionByName(p.orderBy(F.desc("o"), "psu").limit(3).select(F.lit("top").alias("side"), "psu", "positive_rate"))


@query("""WITH h AS (SELECT md5(CAST(json_object('o_custkey', o_custkey, 'o_orderkey', o_orderkey, 'o_orderpriority', o_orderpriority, 'o_orderstatus', o_orderstatus) AS VARCHAR)) AS h FROM orders)
SELECT count(*) AS rows, sha256(count(*) || ':' || CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR)) AS digest FROM h""")
def content_digest(spark, sf_dir):
    return lineage.content_digest(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
