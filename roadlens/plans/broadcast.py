"""Broadcast only what has a proven size bound.

Two ways a small side gets broadcast here:

* a *static* bound - the caller knows the row count cannot grow with the data
  (a parameter grid, a 5-line list, a road map of 31 intervals, the queries of a
  retrieval batch capped by the caller). Then ``bound_rows * row_bytes`` is checked
  against ``spark.sql.autoBroadcastJoinThreshold`` and the hint is given;
* a *runtime* bound - no hint; the small side is an aggregate behind an exchange,
  so AQE sees its real size after the map stage and switches the sort-merge join to
  a broadcast hash join only when it is under the same threshold.

Nothing is broadcast on faith: past the bound the plan stays a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_THRESHOLD = 10 * 1024 * 1024


def broadcast_limit(spark) -> int:
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", str(DEFAULT_THRESHOLD))
    raw = raw.strip().lower()
    mult = 1
    for suffix, m in (("kb", 1024), ("mb", 1024**2), ("gb", 1024**3), ("b", 1)):
        if raw.endswith(suffix):
            raw, mult = raw[: -len(suffix)], m
            break
    try:
        value = int(float(raw) * mult)
    except ValueError:
        value = DEFAULT_THRESHOLD
    return value if value > 0 else 0


def fits_broadcast(spark, bound_rows: int | None, row_bytes: int = 64) -> bool:
    if bound_rows is None:
        return False
    return bound_rows * row_bytes <= broadcast_limit(spark)


def maybe_broadcast(small: DataFrame, bound_rows: int | None, row_bytes: int = 64) -> DataFrame:
    """Hint a broadcast only when the static bound fits the threshold."""
    if fits_broadcast(small.sparkSession, bound_rows, row_bytes):
        return F.broadcast(small)
    return small


def join_small(
    big: DataFrame,
    small: DataFrame,
    on,
    how: str = "inner",
    bound_rows: int | None = None,
    row_bytes: int = 64,
) -> DataFrame:
    """Join ``big`` with a side expected to be small.

    With a static bound that fits, the small side is broadcast; otherwise the join is
    left to AQE's runtime size check.
    """
    return big.join(maybe_broadcast(small, bound_rows, row_bytes), on=on, how=how)
