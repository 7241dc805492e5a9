"""The column catalog: layer, role and statistical type of every column.

Columns are told apart by their names and, for coded ones, by the label texts
seen in the data.  The facts about all columns come from one aggregate; the
catalog is a small table that drives what later stages generate.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import normal_label

# fixed values: the names and label scales of the survey domain
METADATA = ("weight", "stratum", "psu", "sitio", "record")
FREQUENCY_SCALE = ("nunca", "rara vez", "algunas veces", "casi siempre", "siempre", "la mayoria del tiempo", "casi todos los dias", "todos los dias")
LIKELIHOOD_SCALE = ("definitivamente no", "probablemente no", "probablemente si", "definitivamente si")
QUANTITY = r"^(?:\d+|los \d+|menos de (?:un|una|\d+)|mas de (?:un|una|\d+))"
NO_QUANTITY = ("ninguna", "ninguno")
ZERO_QUANTITY = ("no tome alcohol", "no comi ", "no tome gaseosas")
ZERO_OF_PERSONS = "nunca tuve relaciones sexuales"
PERSON = "persona"
EDUCATION = ("primaria", "secundario", "terciario", "universitario")


def layer(name: str) -> str:
    if name in METADATA:
        return "metadata"
    if re.fullmatch(r"q\d+", name):
        return "q_response"
    if re.fullmatch(r"texto_q\d+", name):
        return "response_text"
    if name.startswith("texto_qn"):
        return "derived_text"
    return "derived" if not name.startswith("qn") else "qn_derived"


def label_column(name: str, columns: Sequence[str]) -> str | None:
    return f"texto_{name}" if f"texto_{name}" in columns else None


def schema_of(columns: Sequence[str], continuous: Sequence[str] = ("q4", "q5")) -> T.StructType:
    """The types that column names stand for, so files need no inference."""
    kinds = {"weight": T.DoubleType(), "record": T.LongType(), "psu": T.LongType(), "stratum": T.IntegerType()}

    def kind(c: str) -> T.DataType:
        if c in kinds:
            return kinds[c]
        if c in continuous:
            return T.DoubleType()
        return T.IntegerType() if layer(c) in ("q_response", "qn_derived") else T.StringType()

    return T.StructType([T.StructField(c, kind(c)) for c in columns])


def label_facts(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """(column, n_unique, labels): distinct codes and the distinct labels of coded rows, for all pairs in one unpivot."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("code"), F.col(t).alias("label")) for c, t in pairs.items())))
    seen = df.select(cells.alias("x")).select("x.*").where("code IS NOT NULL").distinct()
    return seen.groupBy("column").agg(F.count_distinct("code").alias("n_unique"), F.array_sort(F.collect_set("label")).alias("labels"))


def statistical_type(n_unique: Column, labels: Column) -> Column:
    """binary, ordinal, nominal or unknown from the label texts; the first rule that speaks decides."""
    bare = F.transform(labels, normal_label)
    some = lambda p: F.exists(bare, p)
    every = lambda p: F.forall(bare, p)
    decide = lambda p: F.when(every(p), "ordinal_categorical").otherwise("unknown_categorical")
    frequent = lambda x: x.isin(*FREQUENCY_SCALE)
    counted = lambda x: x.rlike(QUANTITY)
    zero = lambda x: x.rlike("^(" + "|".join(ZERO_QUANTITY) + ")") | (x.startswith(ZERO_OF_PERSONS) & some(lambda y: y.contains(PERSON)))
    school = lambda x: x.rlike("|".join(EDUCATION))
    likely = F.array_sort(F.array_distinct(bare)) == F.array(*map(F.lit, sorted(LIKELIHOOD_SCALE)))
    return (
        F.when((n_unique == 2) & (F.size(labels) == 2), "binary_categorical")
        .when(F.size(labels) == 0, "unknown_categorical")
        .when(some(frequent), decide(frequent))
        .when(likely, "ordinal_categorical")
        .when(some(counted), decide(lambda x: counted(x) | x.isin(*NO_QUANTITY) | zero(x)))
        .when(some(school), decide(school))
        .otherwise("nominal_categorical")
    )


def dictionary(df: DataFrame, pairs: dict[str, str], continuous: Sequence[str] = (), most_values: int = 20) -> DataFrame:
    """(column, layer, statistical_type, n_unique, missing_n, domain, model_candidate) of coded and continuous columns.

    domain is the labels as JSON, or least and largest value of a continuous column.
    """
    facts = label_facts(df, pairs)
    columns = [*pairs, *continuous]
    nulls = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing_n"), F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi"), F.count_distinct(c).alias("distinct_n")) for c in columns)).alias("r")).select(F.inline("r"))
    out = nulls.join(facts, "column", "left")
    is_continuous = F.col("column").isin(list(continuous)) if continuous else F.lit(False)
    kind = F.when(F.col("distinct_n") <= 1, "constant").when(is_continuous, "continuous").otherwise(statistical_type(F.col("n_unique"), F.col("labels")))
    place = F.create_map(*(x for c in columns for x in (F.lit(c), F.lit(layer(c)))))
    domain = F.when(is_continuous, F.format_string("%.2f..%.2f", "lo", "hi")).when(F.size("labels") <= most_values, F.to_json("labels")).otherwise("HIGH_CARDINALITY")
    return out.select("column", place[F.col("column")].alias("layer"), kind.alias("statistical_type"), F.col("distinct_n").alias("n_unique"), "missing_n", domain.alias("domain"), (kind != "constant").alias("model_candidate"))


def unique_names(names: Sequence[str]) -> list[str]:
    """Names once each, in the order of their first places."""
    return list(dict.fromkeys(names))


def columns_by_rule(ranking: DataFrame, always: Sequence[str], prefix: str, least_pct: float) -> list[str]:
    """The priority columns, then those that start with ``prefix`` and are null in ``least_pct`` percent or more; a row for each column."""
    more = ranking.where(F.col("column").startswith(prefix) & (F.col("missing_pct") >= least_pct)).orderBy("column").collect()
    return unique_names([*always, *(r["column"] for r in more)])


def leakage(df: DataFrame, source: str, candidates: Sequence[str], metadata: Sequence[str] = METADATA) -> DataFrame:
    """(position, column, reason, action): the target's source, columns that are functions of it, and their label columns.

    The list is ordered and holds a column once; columns of the sample design
    follow for review.  A row for each such column.
    """
    from .quality import functional_dependents

    found = {r["candidate"] for r in functional_dependents(df, source, candidates).where("is_derivative").collect()}
    proxies = [c for c in candidates if c in found]
    twin = lambda c: [t for t in [label_column(c, df.columns)] if t]
    rows = [(source, "TARGET_SOURCE", "exclude")] + [(t, "TARGET_SOURCE_LABEL", "exclude") for t in twin(source)]
    rows += [x for c in proxies for x in [(c, "HARD_LEAKAGE", "exclude"), *((t, "HARD_LEAKAGE_LABEL", "exclude") for t in twin(c))]]
    rows += [(c, "SAMPLE_DESIGN", "review") for c in metadata if c in df.columns]
    first = {c: (why, what) for c, why, what in reversed(rows)}
    return df.sparkSession.createDataFrame([(i + 1, c, *first[c]) for i, c in enumerate(unique_names([x[0] for x in rows]))], "position int, column string, reason string, action string")


def full_dictionary(df: DataFrame, pairs: dict[str, str], continuous: Sequence[str], leaks: DataFrame) -> DataFrame:
    """``dictionary`` plus role, confidence and basis of the type, null share and notes."""
    d = dictionary(df, pairs, continuous).join(leaks.select("column", "reason", "action"), "column", "left")
    t, n = F.col("statistical_type"), df.count()
    role = F.when(F.col("reason") == "TARGET_SOURCE", "target_source").when(F.col("action") == "exclude", "leakage").when(F.col("layer") == "metadata", "design").otherwise("feature")
    sure = t.isin("binary_categorical", "continuous", "constant")
    basis = F.when(t == "constant", "one value").when(t == "continuous", "declared continuous").when(t == "binary_categorical", "two codes with two labels").when(t == "ordinal_categorical", "labels form a known scale").when(t == "nominal_categorical", "labels form no known scale").otherwise("labels are missing or only partly on a scale")
    note = F.concat_ws("; ", F.when(F.col("missing_n") * 100 >= 40 * n, F.lit("high missingness")), F.when(t == "unknown_categorical", F.lit("type needs review")), F.when(F.col("action") == "exclude", F.lit("not a feature")))
    return d.select("column", "layer", role.alias("role"), "statistical_type", F.when(sure, "high").when(t == "unknown_categorical", "low").otherwise("medium").alias("confidence"), basis.alias("basis"), "n_unique", "missing_n", F.when(F.lit(n) > 0, F.col("missing_n") * 100.0 / n).otherwise(0.0).alias("missing_pct"), "domain", note.alias("notes"), (F.col("model_candidate") & (role == "feature")).alias("model_candidate"))


def semantic_review(plan: DataFrame, decisions: dict[str, tuple[str, str]]) -> DataFrame:
    """(column, structure, action, decision, reason): an encoding plan with what a reviewer decided; ``pending`` where nobody did."""
    pick = lambda i, other: F.coalesce(*(F.when(F.col("column") == c, F.lit(x[i])) for c, x in decisions.items()), F.lit(other))
    structure = F.when(F.col("action") == "ordinal", "ordered").when(F.col("action") == "scale", "numeric").otherwise("unordered")
    return plan.select("column", structure.alias("structure"), "action", pick(0, "pending").alias("decision"), pick(1, "not reviewed").alias("reason"))


def contract(catalog: DataFrame, excluded: dict[str, str]) -> DataFrame:
    """``catalog`` plus exclusion_reason and included: candidates without a reason against them (``leakage`` gives these)."""
    reason = F.coalesce(*(F.when(F.col("column") == c, F.lit(r)) for c, r in excluded.items()), F.when(~F.col("model_candidate"), "NOT_A_CANDIDATE"), F.lit("INCLUDED"))
    return catalog.select("column", "statistical_type", reason.alias("exclusion_reason"), (reason == "INCLUDED").alias("included"))


def encoding_plan(catalog: DataFrame) -> DataFrame:
    """How each included column is encoded: ordinal codes, one-hot columns, or scaling."""
    t = F.col("statistical_type")
    return catalog.select("column", "statistical_type", F.when(t == "continuous", "scale").when(t == "ordinal_categorical", "ordinal").otherwise("onehot").alias("action"), F.lit("train").alias("fit_partition"))


def lineage(vocab: DataFrame, ordinal: Sequence[str], continuous: Sequence[str]) -> DataFrame:
    """(output_column, source_column, category): where every encoded column comes from."""
    from .stages import onehot_names

    names = onehot_names(vocab.where(~F.col("column").isin(list(ordinal)))).select("output_column", F.col("column").alias("source_column"), "category")
    plain = [F.struct(F.lit(f"{c}_ord").alias("output_column"), F.lit(c).alias("source_column"), F.lit(None).cast("string").alias("category")) for c in ordinal]
    plain += [F.struct(F.lit(c).alias("output_column"), F.lit(c).alias("source_column"), F.lit(None).cast("string").alias("category")) for c in continuous]
    rest = vocab.groupBy().agg(F.array(*plain).alias("r")).select(F.inline("r"))
    return names.unionByName(rest)
