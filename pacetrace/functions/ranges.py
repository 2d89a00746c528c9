"""Range joins as equi joins.

Each interval is listed under every distance bucket it touches, so points and intervals meet on
(keys, bucket) and the exact range test is a residual filter.  Without a cross join the optimiser is free to
broadcast the interval side when it is small and to shuffle, with skew splitting, when it is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    x: str,
    lo: str,
    hi: str,
    *,
    include_hi: bool = True,
    bucket_m: float = 100.0,
    how: str = "inner",
) -> DataFrame:
    """Pair each point with the intervals [lo, hi] (or [lo, hi)) of the same keys that hold ``x``."""
    cut = lambda c: F.floor(c / F.lit(bucket_m)).cast("long")
    payload = [c for c in intervals.columns if c not in points.columns]
    # The interval side gets names of its own, so both sides may come from the same table.
    right = intervals.filter(F.col(hi) >= F.col(lo)).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col(lo).alias("__lo"), F.col(hi).alias("__hi"),
        *[F.col(c).alias(f"__r_{c}") for c in payload],
        F.explode(F.sequence(cut(F.col(lo)), cut(F.col(hi)))).alias("__rb"),
    )
    left = points.withColumn("__b", cut(F.col(x)))
    on = (F.col("__b") == F.col("__rb")) & (F.col(x) >= F.col("__lo"))
    on = on & ((F.col(x) <= F.col("__hi")) if include_hi else (F.col(x) < F.col("__hi")))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__k_{k}"))
    return left.join(right, on, how).select(*points.columns, *[F.col(f"__r_{c}").alias(c) for c in payload])
