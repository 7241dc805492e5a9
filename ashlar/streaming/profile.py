"""Profiles of unbounded tables by event-time window.

An extension: the batch operators have no streaming counterpart to match.  The
aggregates are the mergeable ones of the batch profile (counts, mean,
deviation, extremes), so state is one row for each open window and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite


def windowed_profile(events: DataFrame, time_col: str, column: str, window: str = "1 hour", late: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """Count, nulls, mean, sample deviation, least and largest value of ``column`` in each window.

    Rows later than ``late`` are dropped by the watermark.  Works on batch
    tables too, where there is no lateness.
    """
    x = finite(F.col(column))
    out = events.withWatermark(time_col, late).groupBy(F.window(time_col, window), *by)
    out = out.agg(F.count(x).alias("observed_n"), F.count_if(x.isNull()).alias("missing_n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return out.select(F.col("window.start").alias("window_start"), *by, "observed_n", "missing_n", "mean", "std", "min", "max")
