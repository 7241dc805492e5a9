"""Data-quality tests: label-derived targets, dependencies, missingness and outliers.  Nothing here changes data."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import days_of_label, finite, fold, normal_label, ratio
from .profile import null_ranking, pct, quantiles_of, skewness

FLAG_ONLY = "FLAG_RETAIN"


# -- targets and leakage -----------------------------------------------------


def label_map(df: DataFrame, code: str, label: str) -> DataFrame:
    """Distinct (code, label) of rows with a code, with the number of labels of each code."""
    pairs = df.where(F.col(code).isNotNull()).select(F.col(code).alias("code"), F.col(label).alias("label")).distinct()
    return pairs.groupBy("code").agg(F.count("*").alias("labels_n"), F.min("label").alias("label"))


def day_map(df: DataFrame, code: str, label: str, days: Sequence[int] = range(8)) -> DataFrame:
    """Code to days by label text, with ``valid``: one label a code, one code a day, and all of ``days``."""
    m = label_map(df, code, label).withColumn("days", days_of_label(F.col("label")))
    ok = m.agg(((F.max("labels_n") == 1) & (F.count("days") == F.count("*")) & (F.count_distinct("days") == F.count("*")) & (F.array_sort(F.collect_set("days")) == F.array(*map(F.lit, days)))).alias("valid"))
    return m.join(F.broadcast(ok)).select("code", "label", "days", "valid")


def with_threshold_target(df: DataFrame, codes: DataFrame, code: str, least: int, name: str = "target") -> DataFrame:
    """``name`` = 1 if the code's days reach ``least``, else 0; null stays null.  ``codes`` has a row for each code; Spark broadcasts it if it is small."""
    m = codes.select(F.col("code").alias("__code"), F.col("days").alias("__days"))
    out = df.join(m, df[code] == F.col("__code"), "left")
    return out.withColumn(name, F.when(F.col("__days").isNotNull(), (F.col("__days") >= least).cast("tinyint"))).drop("__code", "__days")


def yes_no(label: Column) -> Column:
    n = normal_label(label)
    return F.when(n == "si", 1).when(n == "no", 0)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """2 x 2 counts, matches, and the four null patterns of two 0/1 columns."""
    x, y = F.col(a), F.col(b)
    both = x.isNotNull() & y.isNotNull()
    cells = [F.count_if((x == i) & (y == j)).alias(f"n_{i}{j}") for i in (0, 1) for j in (0, 1)]
    return df.agg(
        *cells, F.count_if(both & (x == y)).alias("matches"), F.count_if(both & (x != y)).alias("discrepancies"), pct(F.count_if(both & (x == y)), F.count_if(both)).alias("match_pct"),
        F.count_if(both).alias("both_observed"), F.count_if(x.isNotNull() & y.isNull()).alias("only_a"), F.count_if(x.isNull() & y.isNotNull()).alias("only_b"), F.count_if(x.isNull() & y.isNull()).alias("neither"),
    )


def functional_dependents(df: DataFrame, source: str, candidates: Sequence[str]) -> DataFrame:
    """Which candidates are functions of ``source``: same null mask, one value a source value, more than one value in all.

    All candidates go through one unpivot; each (candidate, source value, value)
    is counted once before the test, so nothing is collected by value.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("candidate"), F.col(c).cast("string").alias("v")) for c in candidates)))
    long = df.select(F.col(source).cast("string").alias("s"), cells.alias("x")).select("s", "x.*").groupBy("candidate", "s", "v").agg(F.count("*").alias("n"))
    each = long.groupBy("candidate", "s").agg(F.count("v").alias("values"), F.count_if(F.col("v").isNull()).alias("nulls"))
    masks = each.groupBy("candidate").agg(F.bool_and((F.col("s").isNull() & (F.col("values") == 0)) | (F.col("s").isNotNull() & (F.col("nulls") == 0))).alias("same_null_mask"), F.max(F.when(F.col("s").isNotNull(), F.col("values")).otherwise(0)).alias("max_values"))
    number = long.where("v IS NOT NULL").select("candidate", "v").distinct().groupBy("candidate").agg(F.count("*").alias("n_values"))
    out = masks.join(number, "candidate", "left").withColumn("n_values", F.coalesce("n_values", F.lit(0)))
    return out.withColumn("is_derivative", F.col("same_null_mask") & (F.col("max_values") <= 1) & (F.col("n_values") > 1))


def bijection(df: DataFrame, a: str, b: str) -> DataFrame:
    """Whether two columns are renamings of each other, null being a value like others."""
    token = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("<NA>"))
    pairs = df.select(token(a).alias("a"), token(b).alias("b")).distinct()
    return pairs.agg(F.count("*").alias("pairs_n"), F.count_distinct("a").alias("a_n"), F.count_distinct("b").alias("b_n")).withColumn("is_bijection", (F.col("pairs_n") == F.col("a_n")) & (F.col("pairs_n") == F.col("b_n")))


# -- missingness -------------------------------------------------------------


def missing_by_group(df: DataFrame, mask: Column, group: str) -> DataFrame:
    """Rate of ``mask`` in each group; the null group is a group."""
    m = F.coalesce(mask, F.lit(False))
    return df.groupBy(F.col(group).alias("category")).agg(F.count("*").alias("n"), F.count_if(m).alias("missing_n"), F.count_if(~m).alias("observed_n"), pct(F.count_if(m), F.count("*")).alias("missing_pct"))


def rate_evidence(tables: dict[str, DataFrame], keep_null: bool = True) -> DataFrame:
    """A row for each source: groups, least and largest rate, range in percentage points."""
    out = [(t if keep_null else t.where("category IS NOT NULL")).agg(F.lit(name).alias("evidence_source"), F.count("*").alias("groups"), F.min("missing_pct").alias("min_missing_pct"), F.max("missing_pct").alias("max_missing_pct"), (F.max("missing_pct") - F.min("missing_pct")).alias("absolute_range_pp")) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, out)


def mechanism(evidence: DataFrame, least_pp: float = 5.0) -> DataFrame:
    """The missingness hypothesis: supported by two sources with a range of ``least_pp`` or more, weak by one."""
    n = F.count_if(F.col("absolute_range_pp") >= least_pp)
    return evidence.agg(n.alias("sources_n"), F.when(n >= 2, "MAR_HIPOTESIS_RESPALDADA").when(n == 1, "MAR_HIPOTESIS_DEBIL").otherwise("NO_IDENTIFICABLE").alias("mechanism"))


#: fixed values: beginnings of labels that mean a question didn't apply
NOT_APPLICABLE = ("nunca ", "no tuve ", "no sufri ", "no intente ", "no tome ", "no fume ", "no probe ", "no maneje ", "no viaje ", "yo no tomo ")


def not_applicable(label: Column, prefixes: Sequence[str] = NOT_APPLICABLE) -> Column:
    t = F.trim(fold(label))
    return reduce(lambda a, b: a | b, (t.startswith(p) for p in prefixes))


def branching(df: DataFrame, dependent: str, filter_label: str, prefixes: Sequence[str] = NOT_APPLICABLE) -> DataFrame:
    """Skip-logic test: is ``dependent`` null where the filter question's label says it doesn't apply?"""
    skipped = F.coalesce(not_applicable(F.col(filter_label), prefixes), F.lit(False))
    null = F.col(dependent).isNull()
    out = df.agg(F.count_if(skipped).alias("n_filter_non_applicable"), F.count_if(null).alias("n_missing_dependent"), F.count_if(skipped != null).alias("mismatch_n"), F.count_if(skipped & ~null).alias("observed_though_skipped_n"))
    kind = F.when((F.col("mismatch_n") == 0) & (F.col("n_filter_non_applicable") > 0), "ESTRUCTURAL_DEMOSTRADO").when((F.col("observed_though_skipped_n") == 0) & (F.col("n_filter_non_applicable") > 0), "ESTRUCTURAL_POSIBLE_BRANCHING").otherwise("NO_IDENTIFICABLE")
    return out.select(F.lit(dependent).alias("dependent_col"), F.lit(filter_label).alias("filter_col"), "*", (F.col("mismatch_n") == 0).alias("exact_mask_match"), kind.alias("classification"))


def null_cooccurrence(df: DataFrame, columns: Sequence[str], least_pct: float = 0.0, top: int | None = None, always: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Shared nulls of all column pairs by one aggregate of pairwise sums; quadratic in columns, never in rows.

    Given back are the pairs that share ``least_pct`` at least, and those of ``always``.
    """
    pairs = list(combinations(columns, 2))
    null = {c: F.col(c).isNull() for c in columns}
    rows = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.count_if(null[a]).alias("missing_a"), F.count_if(null[b]).alias("missing_b"), F.count_if(null[a] & null[b]).alias("both_missing")) for a, b in pairs]
    out = df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    a, b, both = (F.col(c).cast("double") for c in ("missing_a", "missing_b", "both_missing"))
    out = out.withColumns({"missing_a_shared_pct": 100 * ratio(both, a), "missing_b_shared_pct": 100 * ratio(both, b), "jaccard_missing": ratio(both, a + b - both)})
    out = out.withColumn("min_shared_pct", F.least("missing_a_shared_pct", "missing_b_shared_pct"))
    asked = [(F.col("column_a") == x) & (F.col("column_b") == y) for x, y in always]
    out = out.where(reduce(lambda a, b: a | b, asked, F.col("min_shared_pct") >= least_pct))
    return out.orderBy(F.desc("min_shared_pct"), F.desc("both_missing"), "column_a", "column_b").limit(top) if top else out


def null_diagnosis(ranking: DataFrame, structural: dict[str, str], hypotheses: dict[str, str], least_pct: float = 40.0) -> DataFrame:
    """The mechanism of each column: complete, structural, hypothesised, high without explanation, or unidentified."""
    known = F.coalesce(*(F.when(F.col("column") == c, F.lit(v)) for c, v in {**structural, **hypotheses}.items()), F.lit(None).cast("string")) if structural or hypotheses else F.lit(None).cast("string")
    return ranking.withColumn("diagnosis", F.when(F.col("missing_n") == 0, "SIN_FALTANTES").when(F.col("missing_n") == F.col("n_rows"), "VACIA").when(known.isNotNull(), known).when(F.col("missing_pct") >= least_pct, "ALTA_SIN_EXPLICACION").otherwise("NO_IDENTIFICABLE"))


def rate_contrast(df: DataFrame, mask: Column, group: str, a, b) -> DataFrame:
    """The rates of ``mask`` in groups ``a`` and ``b``, their absolute difference in points, and b's rate over a's (null for a rate of 0)."""
    m, g = F.coalesce(mask, F.lit(False)), F.col(group)
    rate = lambda v: pct(F.count_if(m & (g == v)), F.count_if(g == v))
    out = df.agg(rate(a).alias("rate_a_pct"), rate(b).alias("rate_b_pct"))
    return out.withColumns({"absolute_difference_pp": F.abs(F.col("rate_b_pct") - F.col("rate_a_pct")), "rate_ratio": F.when(F.col("rate_a_pct") > 0, F.col("rate_b_pct") / F.col("rate_a_pct"))})


def filter_question(dependent: str, columns: Sequence[str]) -> str | None:
    """The label column of the question that a derived column depends on: ``qn28`` and ``qnc28g`` ask about ``texto_q28``."""
    m = re.fullmatch(r"qn[a-z]*(\d+)[a-z]*", dependent)
    name = f"texto_q{m[1]}" if m else None
    return name if name in columns else None


def branching_table(df: DataFrame, dependents: Sequence[str]) -> DataFrame | None:
    """``branching`` of all dependents whose filter question is found by name; None if there is none."""
    pairs = [(d, f) for d in dependents if (f := filter_question(d, df.columns))]
    return reduce(DataFrame.unionByName, (branching(df, d, f) for d, f in pairs)) if pairs else None


def diagnosis_from_data(df: DataFrame, columns: Sequence[str], joint: Sequence[str], groups: Sequence[str], least_pct: float = 40.0) -> DataFrame:
    """``null_diagnosis`` with its reasons taken from the data.

    Structural columns come from ``branching_table``, the hypothesis of the
    ``joint`` columns from the rates of their common nulls in ``groups``.
    """
    shared = reduce(lambda a, b: a & b, (F.col(c).isNull() for c in joint))
    kind = mechanism(rate_evidence({g: missing_by_group(df, shared, g) for g in groups})).first()["mechanism"]
    table = branching_table(df, [c for c in columns if c not in joint])
    found = {r["dependent_col"]: r["classification"] for r in table.collect()} if table is not None else {}
    structural = {c: k for c, k in found.items() if k.startswith("ESTRUCTURAL")}
    return null_diagnosis(null_ranking(df, columns), structural, {c: kind for c in joint if kind != "NO_IDENTIFICABLE"}, least_pct)


def rate_bands(table: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Groups with a rate of 0 %, 100 % and in between."""
    p = F.col("missing_pct")
    none, all_ = F.abs(p) <= tolerance, F.abs(p - 100) <= tolerance
    return table.agg(F.count_if(none).alias("none_n"), F.count_if(all_).alias("all_n"), F.count_if(~none & ~all_).alias("between_n"))


# -- outliers ----------------------------------------------------------------


def limits(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """(variable, observed_n, q1, q3, mean, std, skewness and both pairs of limits) of each column."""
    known = quantiles_of(df, columns, (0.25, 0.75), (), accuracy)

    def row(name: str) -> Column:
        c = finite(F.col(name))
        return F.struct(F.lit(name).alias("variable"), F.count(c).alias("observed_n"), known[name][0].alias("q1"), known[name][1].alias("q3"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), skewness(c).alias("skewness"))

    out = df.agg(F.array(*map(row, columns)).alias("r")).select(F.inline("r"))
    iqr = F.col("q3") - F.col("q1")
    return out.withColumns({"iqr_lower": F.col("q1") - 1.5 * iqr, "iqr_upper": F.col("q3") + 1.5 * iqr, "z3_lower": F.col("mean") - 3 * F.col("std"), "z3_upper": F.col("mean") + 3 * F.col("std")})


def flagged(df: DataFrame, columns: Sequence[str], rules: dict[str, list[tuple[str, float]]] | None = None, accuracy: int | None = None) -> DataFrame:
    """``df`` plus <column>_iqr, _z3 and _domain flags; a value on a limit isn't flagged, null is False.

    The limits are one row, so its broadcast has a fixed size.  ``rules`` gives
    (comparison, threshold) pairs for a column.
    """
    row = limits(df, columns, accuracy).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("variable", F.struct("iqr_lower", "iqr_upper", "z3_lower", "z3_upper")))).alias("__limits"))
    out = df.join(F.broadcast(row))
    flags = {}
    for c in columns:
        x, lim = finite(F.col(c)), F.col("__limits")[c]
        for m in ("iqr", "z3"):
            flags[f"{c}_{m}"] = F.coalesce((x < lim[f"{m}_lower"]) | (x > lim[f"{m}_upper"]), F.lit(False))
        flags[f"{c}_domain"] = any_rule(x, (rules or {}).get(c, []))
    return out.withColumns(flags).drop("__limits")


def rule(x: Column, comparison: str, threshold: float) -> Column:
    t = F.lit(float(threshold))
    return F.coalesce({"<": x < t, "<=": x <= t, ">": x > t, ">=": x >= t}[comparison], F.lit(False))


def any_rule(x: Column, rules: Sequence[tuple[str, float]]) -> Column:
    return reduce(lambda a, b: a | b, (rule(x, *r) for r in rules), F.lit(False))


def method_counts(df: DataFrame, columns: Sequence[str], method: str, accuracy: int | None = None) -> DataFrame:
    """Below, above and flagged counts of ``iqr`` or ``z3`` for each column: one pass for the limits, one to count."""
    lim = limits(df, columns, accuracy).select("variable", "observed_n", F.col(f"{method}_lower").alias("lower"), F.col(f"{method}_upper").alias("upper"))
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), finite(F.col(c)).alias("x")) for c in columns))).alias("s")).select("s.*")
    long = long.where("x IS NOT NULL").join(F.broadcast(lim), "variable")
    out = long.groupBy("variable", "observed_n", "lower", "upper").agg(F.count_if(F.col("x") < F.col("lower")).alias("below_n"), F.count_if(F.col("x") > F.col("upper")).alias("above_n"))
    return out.withColumn("flagged_n", F.col("below_n") + F.col("above_n")).withColumn("flagged_pct_observed", pct(F.col("flagged_n"), F.col("observed_n")))


def domain_counts(df: DataFrame, rules: dict[str, list[tuple[str, float]]]) -> DataFrame:
    """Observed and flagged rows of each rule, and of any rule of a column."""
    rows = []
    for c, own in rules.items():
        x = finite(F.col(c))
        named = [(f"{op}{t:g}", rule(x, op, t)) for op, t in own] + [("ANY", any_rule(x, own))]
        rows += [F.struct(F.lit(c).alias("variable"), F.lit(n).alias("rule"), F.count(x).alias("observed_n"), F.count_if(f).alias("flagged_n"), pct(F.count_if(f), F.count(x)).alias("flagged_pct_observed")) for n, f in named]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def method_overlap(flags: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How the three methods' flags meet, for each column."""

    def row(c: str) -> Column:
        i, z, d = (F.col(f"{c}_{m}") for m in ("iqr", "z3", "domain"))
        n = F.count_if
        return F.struct(F.lit(c).alias("variable"), n(i).alias("iqr_n"), n(z).alias("z3_n"), n(d).alias("domain_flag_n"), n(i & ~z).alias("iqr_only_n"), n(z & ~i).alias("z3_only_n"), n(i & z).alias("iqr_and_z3_n"), n(d & ~i & ~z).alias("domain_only_n"), n(i & d).alias("iqr_and_domain_n"), n(z & d).alias("z3_and_domain_n"), n(i & z & d).alias("all_three_n"))

    return flags.agg(F.array(*map(row, columns)).alias("r")).select(F.inline("r"))


def flags_by_target(flags: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    aggs = [F.count("*").alias("n_total")]
    for c in columns:
        x, f = finite(F.col(c)), F.col(f"{c}_iqr")
        aggs += [F.count(x).alias(f"{c}_observed_n"), F.count_if(f).alias(f"{c}_iqr_n"), pct(F.count_if(f), F.count("*")).alias(f"{c}_iqr_pct_total"), pct(F.count_if(f), F.count(x)).alias(f"{c}_iqr_pct_observed")]
    aggs.append(F.count_if(reduce(lambda a, b: a | b, (F.col(f"{c}_domain") for c in columns))).alias("any_domain_n"))
    return flags.groupBy(target).agg(*aggs)


def case_review(flags: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Flagged rows with their flag count, class and evidence: most flags first, then largest values (nulls last), then the key."""
    every = [f"{c}_{m}" for c in columns for m in ("iqr", "z3", "domain")]
    n = reduce(lambda a, b: a + b, (F.col(f).cast("int") for f in every))
    domain = reduce(lambda a, b: a | b, (F.col(f"{c}_domain") for c in columns))
    named = F.concat_ws(";", *(F.when(F.col(f), F.lit(f)) for f in every))
    out = flags.select(key, *columns, n.alias("flag_count"), F.when(domain & (n > 1), "DOMAIN_AND_STATISTICAL").when(domain, "DOMAIN").when(n > 1, "STATISTICAL_MULTIPLE").otherwise("STATISTICAL_SINGLE").alias("review_class"), named.alias("evidence"))
    return out.where("flag_count > 0").orderBy(F.desc("flag_count"), *(F.desc_nulls_last(c) for c in columns), F.asc(key))


def coherence(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, affected_n, classification): how many rows each named condition hits."""
    rows = [F.struct(F.lit(n).alias("check"), F.count_if(F.coalesce(c, F.lit(False))).alias("affected_n")) for n, c in checks.items()]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r")).withColumn("classification", F.when(F.col("affected_n") > 0, "REVISAR").otherwise("OK"))


def body_checks(height: str, weight: str, height_text: str | None = None, weight_text: str | None = None, tall: tuple[float, float] = (1.2, 2.05), heavy: tuple[float, float] = (27.0, 180.0), most_ratio: float = 60.0) -> dict[str, Column]:
    """The ten named conditions of a height and a weight column; the text columns, if given, are the unparsed values."""
    h, w = finite(F.col(height)), finite(F.col(weight))
    no_number = lambda t, x: (F.col(t).isNotNull() & x.isNull()) if t else F.lit(False)
    return {
        "height_not_numeric": no_number(height_text, h), "weight_not_numeric": no_number(weight_text, w),
        "height_without_weight": h.isNotNull() & w.isNull(), "weight_without_height": h.isNull() & w.isNotNull(), "both_missing": h.isNull() & w.isNull(),
        "height_not_positive": h <= 0, "weight_not_positive": w <= 0, "height_out_of_range": (h < tall[0]) | (h > tall[1]), "weight_out_of_range": (w < heavy[0]) | (w > heavy[1]),
        "ratio_above": body_ratio(F.col(height), F.col(weight)) > most_ratio,
    }


def with_evidence(checks: DataFrame, total: int) -> DataFrame:
    """``coherence`` rows with a sentence that gives the count and its share of ``total`` rows."""
    return checks.withColumn("evidence", F.concat("affected_n", F.lit(f" of {total} rows ("), F.format_string("%.3f", pct(F.col("affected_n"), F.lit(total))), F.lit("%)")))


def parsed_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` as doubles; a text that is no number becomes null."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns})


def invalid_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, observed_n, invalid_n): values that are there but are no number."""
    rows = [F.struct(F.lit(c).alias("column"), F.count(c).alias("observed_n"), F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull()).alias("invalid_n")) for c in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def without_null_columns(df: DataFrame, columns: Sequence[str], most_pct: float) -> DataFrame:
    """``df`` without those of ``columns`` that are null in more than ``most_pct`` percent of the rows."""
    gone = null_ranking(df, columns).where(F.col("missing_pct") > most_pct).select("column").collect()
    return df.drop(*(r["column"] for r in gone))


def body_ratio(height: Column, weight: Column) -> Column:
    """weight / height**2 for complete, finite, positive pairs, else null."""
    h, w = finite(height), finite(weight)
    return F.when((h > 0) & (w > 0), w / (h * h))
