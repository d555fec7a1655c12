"""Window frames over series that may be longer than one task can hold.

A drive, a vehicle log or an event-type series is ordered by a dense 0-based
position ``seq`` (see ``plans.ordering``). Windows partitioned by the series key alone
would put a hot series into one task. Here the series is cut into blocks of
``block`` rows and every window is partitioned by ``(key, block)``:

* bounded frames (``lag``/``lead``/moving sums up to ``before`` rows back and
  ``after`` rows ahead): each row is also copied into the neighbouring block whose
  halo it falls in, the window runs on the widened block, and only the block's own
  rows are kept. Exact for any frame inside the halo; the copy overhead is
  ``(before + after) / block``;
* running frames (``unbounded preceding``): a local running value per block plus a
  carry from the block totals of earlier blocks (one row per block, small);
* carry-forward of the last non-null value: local ``last(ignoreNulls)`` plus the last
  non-null value of earlier blocks.

``seq`` must be dense (0..n-1 without holes) for row frames to equal seq ranges.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 20


def block_size(spark) -> int:
    return int(spark.conf.get("roadlens.block.rows", str(BLOCK_ROWS)))


def _blk(seq: str, block: int) -> Column:
    return F.floor(F.col(seq) / F.lit(block)).cast("long")


def with_halo(df: DataFrame, seq: str, before: int, after: int, block: int) -> DataFrame:
    """Add ``_blk``/``_own``; rows within ``before`` of the next block or ``after`` of
    the previous one are duplicated into it with ``_own = false``."""
    if before >= block or after >= block:
        raise ValueError("halo must be smaller than the block")
    b = _blk(seq, block)
    s = F.col(seq)
    items = [F.struct(b.alias("_blk"), F.lit(True).alias("_own"))]
    if before > 0:
        items.append(F.when(s >= (b + 1) * block - before, F.struct((b + 1).alias("_blk"), F.lit(False).alias("_own"))))
    if after > 0:
        items.append(F.when((b > 0) & (s < b * block + after), F.struct((b - 1).alias("_blk"), F.lit(False).alias("_own"))))
    if len(items) == 1:
        return df.withColumn("_blk", b).withColumn("_own", F.lit(True))
    arr = F.filter(F.array(*items), lambda x: x.isNotNull())
    return df.withColumn("_h", F.explode(arr)).select("*", "_h._blk", "_h._own").drop("_h")


def over_blocks(
    df: DataFrame,
    keys: list[str],
    seq: str,
    before: int,
    after: int,
    build: Callable[[Window], dict[str, Column]],
    block: int | None = None,
) -> DataFrame:
    """Compute bounded-frame window columns ``build(w)`` over ``w`` = (keys, block) by seq.

    ``build`` receives the window spec and returns ``{name: column}``; every frame it
    uses must stay within ``before`` rows back and ``after`` rows ahead.
    """
    block = block or block_size(df.sparkSession)
    wide = with_halo(df, seq, before, after, block)
    w = Window.partitionBy(*keys, "_blk").orderBy(seq)
    cols = build(w)
    return wide.withColumns(cols).filter(F.col("_own")).drop("_blk", "_own")


def running_sum(
    df: DataFrame,
    keys: list[str],
    seq: str,
    values: dict[str, Column],
    exclusive: bool = False,
    block: int | None = None,
) -> DataFrame:
    """Running sums per key by seq; ``exclusive`` = frame ends one row before (empty -> 0)."""
    block = block or block_size(df.sparkSession)
    tmp = {f"_v_{k}": v for k, v in values.items()}
    base = df.withColumns(tmp).withColumn("_blk", _blk(seq, block))
    end = -1 if exclusive else Window.currentRow
    w_local = Window.partitionBy(*keys, "_blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, end)
    local = base.withColumns({f"_l_{k}": F.sum(f"_v_{k}").over(w_local) for k in values})
    totals = base.groupBy(*keys, "_blk").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    w_blk = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_blk", *[F.coalesce(F.sum(f"_t_{k}").over(w_blk), F.lit(0.0)).alias(f"_c_{k}") for k in values]
    )
    out = local.join(carry, on=[*keys, "_blk"], how="inner")
    out = out.withColumns(
        {k: F.col(f"_c_{k}") + F.coalesce(F.col(f"_l_{k}"), F.lit(0.0)) for k in values}
    )
    drop = ["_blk"] + [f"_{p}_{k}" for k in values for p in ("v", "l", "c")]
    return out.drop(*drop)


def carry_forward(
    df: DataFrame,
    keys: list[str],
    seq: str,
    values: dict[str, Column],
    block: int | None = None,
) -> DataFrame:
    """``last(value, ignoreNulls)`` over (unbounded preceding, current row) per key by seq."""
    block = block or block_size(df.sparkSession)
    tmp = {f"_v_{k}": v for k, v in values.items()}
    base = df.withColumns(tmp).withColumn("_blk", _blk(seq, block))
    w_local = Window.partitionBy(*keys, "_blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns({f"_l_{k}": F.last(f"_v_{k}", ignorenulls=True).over(w_local) for k in values})
    lasts = base.groupBy(*keys, "_blk").agg(
        *[F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), F.col(seq))).alias(f"_t_{k}") for k in values]
    )
    w_blk = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(
        *keys, "_blk", *[F.last(f"_t_{k}", ignorenulls=True).over(w_blk).alias(f"_c_{k}") for k in values]
    )
    out = local.join(carry, on=[*keys, "_blk"], how="inner")
    out = out.withColumns({k: F.coalesce(F.col(f"_l_{k}"), F.col(f"_c_{k}")) for k in values})
    drop = ["_blk"] + [f"_{p}_{k}" for k in values for p in ("v", "l", "c")]
    return out.drop(*drop)
