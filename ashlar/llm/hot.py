"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: keys at most that can be hot; what is broadcast has a row for each
MOST = 10_000
LEAST = 1_000


def join(big: DataFrame, small: DataFrame, on: Sequence[str], rows: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has one row for each key and the key's number of rows in column ``rows``.

    Keys with a ``MOST``-th of all rows at least meet a broadcast: there are
    ``MOST`` of them at most, whatever the size of the tables.  All others are
    shuffled, and none has more rows than that.  ``how`` is inner or left; the
    count is dropped.  ``small`` is read three times, so it should be saved.
    """
    on = list(on)
    total = small.agg(F.sum(rows)).first()[0] or 0
    bound = max(LEAST, -(-total // MOST))
    hot, cold = small.where(F.col(rows) >= bound).drop(rows), small.where(F.col(rows) < bound).drop(rows)
    if total < bound or hot.isEmpty():
        return big.join(cold, on, how)
    hot = F.broadcast(hot)
    return big.join(hot, on).unionByName(big.join(hot.select(*on), on, "left_anti").join(cold, on, how))
