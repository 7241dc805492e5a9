"""Scalar expressions shared by the operators."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: Spanish letters with marks and their bare forms
_MARKED = "áéíóúüñ"
_BARE = "aeiouun"


def finite(c: Column) -> Column:
    """Null for NaN and infinities; other types pass unchanged in value, as double."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def fold(c: Column) -> Column:
    """Lower case without the marks of Spanish letters."""
    return F.translate(F.lower(c), _MARKED, _BARE)


def normal_label(c: Column) -> Column:
    """``fold``, trimmed, with runs of white space made one space."""
    return F.regexp_replace(F.trim(fold(c)), r"\s+", " ")


@F.pandas_udf(T.StringType())
def normal_label_any(texts: pd.Series) -> pd.Series:
    """``normal_label`` for any script: NFKD, marks dropped, case folded."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        bare = "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))
        return " ".join(bare.casefold().split())

    return texts.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def normal_text_any(texts: pd.Series) -> pd.Series:
    """NFKD, marks dropped, case folded; spaces stay."""
    return texts.map(lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)).casefold(), na_action="ignore")


def contains_any_case(c: Column, part: str) -> Column:
    """Whether a text holds ``part`` in any case; null is False."""
    return F.coalesce(F.contains(F.lower(c), F.lit(part.lower())), F.lit(False))


def code_text(c: Column) -> Column:
    """A code as text: whole numbers without a fraction, ``NA`` for null."""
    return F.coalesce(category_text(c), F.lit("NA"))


def null_last(c: Column) -> Column:
    """A sort key in which null stands for infinity."""
    return F.coalesce(c.cast("double"), F.lit(float("inf")))


def hash48(*parts: Column) -> Column:
    """48 bits of the MD5 of the parts' texts joined by colons; any engine with MD5 gives the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 12), 16, 10).cast("long")


def category_text(c: Column) -> Column:
    """Canonical category: whole numbers without a fraction, anything else as it is."""
    d = c.cast("string").try_cast("double")
    return F.when(d.isNotNull() & (d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("long").cast("string")).otherwise(c.cast("string"))


def column_token(c: Column) -> Column:
    """A category as part of a column name: other than letters, digits and ``_`` become ``_``, none at the ends."""
    t = F.regexp_replace(F.regexp_replace(c, "[^0-9A-Za-z_]+", "_"), "^_+|_+$", "")
    return F.when(t == "", F.lit("empty")).otherwise(t)


def category_order(c: Column, missing: str) -> list[Column]:
    """Sort keys: numbers by value, then other texts, the missing category last."""
    d = c.try_cast("double")
    return [F.when(d.isNotNull(), 0).when(c == missing, 2).otherwise(1), d, c]


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def days_of_label(c: Column) -> Column:
    """The number of a label like ``3 días`` or ``1 día``; null if it isn't one."""
    return F.nullif(F.regexp_extract(normal_label(c), r"^(\d+)\s+dias?$", 1), F.lit("")).cast("int")


def digits15(c: Column) -> Column:
    """A double with 15 significant digits, for text sinks."""
    return F.format_string("%.15g", c)
