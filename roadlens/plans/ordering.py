"""Dense per-group positions without sending a whole group to one task.

``row_number() over (partition by key order by t)`` puts every row of a key into one
task. A drive (or a user, or an event type) may hold a third of all rows, so the
position is built in two levels:

1. a coarse, monotone ``bucket`` of the order (e.g. the hour of the timestamp) splits
   each key into many windows ``(key, bucket)``, each numbered locally;
2. a count table per ``(key, bucket)`` - far smaller than the data - gets running
   totals over the buckets of each key, and joining it back turns the local number
   into the global position.

Everything is a pure function of the data (no partition ids), so a recomputed task
after an executor loss gives the same numbers. The count table join is left to AQE's
runtime size check (``plans.broadcast``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def time_bucket(ts: str, unit: str = "hour") -> Column:
    """Monotone coarse bucket of a timestamp (``date_trunc``; no time-zone shift, so
    it stays monotone for TIMESTAMP_NTZ under any session zone)."""
    return F.date_trunc(unit, F.col(ts))


def value_bucket(x: str, width: float) -> Column:
    """Monotone coarse bucket of a numeric order column."""
    return F.floor(F.col(x) / F.lit(width)).cast("long")


def dense_position(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    bucket: Column | None = None,
    name: str = "seq",
    prefix_sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Add ``name`` = 0-based position of each row inside its ``keys`` group by ``order``.

    ``bucket`` must be non-decreasing in ``order`` inside a key. Without it the plain
    per-key window is used (only right when no key can be large). ``order`` must be a
    total order inside a group (append a unique id).
    """
    order_cols = _cols(order)
    sums = prefix_sums or {}
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order_cols)
        x = df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
        ex = w.rowsBetween(Window.unboundedPreceding, -1)
        return x.withColumns({k: F.coalesce(F.sum(v).over(ex), F.lit(0)) for k, v in sums.items()})
    x = df.withColumn("_bk", bucket).withColumns({f"_v_{k}": v for k, v in sums.items()})
    w = Window.partitionBy(*keys, "_bk").orderBy(*order_cols)
    x = x.withColumn("_loc", (F.row_number().over(w) - 1).cast("long"))
    # exclusive prefix sums ride on the same window and the same count table
    ex = w.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({f"_l_{k}": F.coalesce(F.sum(f"_v_{k}").over(ex), F.lit(0)) for k in sums})
    counts = (df.withColumn("_bk", bucket).withColumns({f"_v_{k}": v for k, v in sums.items()})
              .groupBy(*keys, "_bk").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums]))
    wb = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bk", F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_before"),
                            *[F.coalesce(F.sum(f"_t_{k}").over(wb), F.lit(0)).alias(f"_c_{k}") for k in sums])
    out = x.join(offsets, on=[*keys, "_bk"], how="inner")
    out = out.withColumn(name, F.col("_before") + F.col("_loc"))
    out = out.withColumns({k: F.col(f"_c_{k}") + F.col(f"_l_{k}") for k in sums})
    drop = ["_bk", "_loc", "_before"] + [f"_{p}_{k}" for k in sums for p in ("v", "l", "c")]
    return out.drop(*drop)
