"""URL rules by hashed host-suffix and path-prefix expressions.

A rule (host, path) fits its host and all subdomains of it, if the URL's path
starts with the rule's path.  Every URL is expanded into the expressions
``host suffix + path prefix`` that a rule could have, which are joined with the
rules on the first 32 bits of their SHA-256; the full digests then confirm the
match, and among a URL's rules the longest decides.

Only DataFrame functions are used.  Suffixes are taken for the label counts
and prefixes for the lengths that occur among the rules, so a URL of any
length gives at most ``label counts * lengths`` expressions.  Each distinct
URL is expanded once, and a URL that very many pages share meets its verdict
by broadcast, so hot URLs weigh no more than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hot, scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "host string, path string, verdict string"


def with_host_and_path(df: DataFrame, url_col: str) -> DataFrame:
    """``df`` plus host and path.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased.  Path: from there up to ``?``, ``#`` or the end.
    """
    url = F.col(url_col)
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    cut = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(cut, "/", 1)
    return df.withColumns({"host": F.translate(host, _UPPER, _LOWER), "path": F.substring(cut, F.length(host) + 1, F.length(cut))})


def url_verdicts(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` plus host, path, rule (``host + path`` of the deciding rule or null) and verdict.

    ``rules`` has host, path and verdict; rows with a null in any of them are
    left out.  The longest rule wins, by host first, then by path; of equal
    rules with different verdicts ``block`` wins.  URLs that no rule fits get
    ``default``.  Repeated pages come back as often as given; columns named
    like an output are replaced.
    """
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host is not null and r_path is not null and r_verdict is not null")
    rules = rules.groupBy("r_host", "r_path").agg(F.max(F.struct((F.col("r_verdict") == "block").alias("first"), "r_verdict")).alias("v")).select("r_host", "r_path", F.col("v.r_verdict").alias("r_verdict"))
    # a few integers: label counts and path lengths that occur among the rules
    shape = rules.agg(F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")).first()
    labels, lengths = sorted(shape["labels"]), sorted(shape["lengths"])

    pages = pages.drop("host", "path", "rule", "verdict")
    urls = pages.groupBy(F.col(url_col).alias("url")).agg(F.count("*").alias("n")).where("url is not null")
    urls = with_host_and_path(urls, "url")
    parts = F.split("host", r"\.")
    suffix = F.filter(F.transform(F.array(*map(F.lit, labels)), lambda n: F.when(F.size(parts) >= n, F.struct(n.alias("n"), F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".").alias("s")))), lambda x: x.isNotNull())
    prefix = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: F.length("path") >= n), lambda n: F.substring(F.col("path"), F.lit(1), n))
    none = F.array().cast("array<string>")
    wide = urls.select("url", "n", F.explode(F.transform(suffix, lambda x: x["s"]) if labels else none).alias("suffix"), prefix.alias("prefixes") if lengths else none.alias("prefixes"))
    wide = wide.select("url", "n", "suffix", F.explode("prefixes").alias("prefix"))
    digest = F.sha2(F.concat("suffix", "prefix"), 256)
    wide = wide.select("url", "n", digest.alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    known = rules.withColumn("r_digest", F.sha2(F.concat("r_host", "r_path"), 256)).withColumn("short", F.substring("r_digest", 1, 8))
    fits = wide.join(known, "short").where(F.col("digest") == F.col("r_digest"))
    best = fits.groupBy("url").agg(F.max("n").alias("n"), F.max(F.struct(F.length("r_host").alias("h"), F.length("r_path").alias("p"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
    out = with_host_and_path(pages, url_col)
    key = scratch.fresh("fits", out)
    best = scratch.save(best.select(F.col("url").alias(key), "n", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")), "verdicts")
    out = hot.join(out.withColumn(key, F.col(url_col)), best, [key], "n", "left").drop(key)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path, verdict)."""
    return spark.createDataFrame(rules, RULE_SCHEMA)
