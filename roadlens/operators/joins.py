"""Join shapes the domain needs beyond a plain equi-join.

* as-of (J1): both sides united, the last right row carried forward inside and across time cells,
  never an inequality join (``rt <= t`` alone plans as a nested-loop join);
* point-in-segment (J2): the segment starts of a road are a bounded list (one row per
  road, array of starts); a row finds its segment by counting starts <= position;
* interval payload (J3/J12): bounded dimension (road map, knot list) broadcast behind
  its static bound, otherwise a shuffled range join on a bucketed key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.broadcast import join_small, maybe_broadcast


#: rows of both sides that a time cell of the as-of join holds on average, and the most cells (two levels of a search)
ASOF_CELL_ROWS = 100_000
ASOF_CELLS = 4096


def _time_cells(rows: DataFrame, t: str, cells: int) -> Column:
    """Number of the cell of ``t``: cells hold about equally many ``rows``, wherever the times are. Their bounds are
    quantiles read once (``cells`` numbers); a row finds its own by a search in two short arrays."""
    if cells <= 1:
        return F.lit(0)
    at = [k / cells for k in range(1, cells)]
    bounds = sorted(set(rows.agg(F.percentile_approx(t, at, 10 * cells)).first()[0] or []))
    width = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[k:k + width] for k in range(0, len(bounds), width)]
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    block = F.greatest(F.size(F.filter(numbers([x[0] for x in blocks]), lambda x: x <= F.col(t))) - 1, F.lit(0))
    inner = F.element_at(F.array(*[numbers(x) for x in blocks]), block + 1)
    return block * width + F.size(F.filter(inner, lambda x: x <= F.col(t)))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_t: str,
    right_t: str,
    payload: list[str],
    clamp_first: bool = True,
    cell_rows: int | None = None,
) -> DataFrame:
    """For each left row, the right row with the largest ``right_t <= left_t`` per key
    (``bisect_right - 1``); before the first right row, the first one when ``clamp_first``
    (the source's ``max(i, 0)``), else NULL. Of right rows with equal times one is taken. A null
    time or key on the left has no match; on the right it is left out.

    Both sides are united and carry the last right row forward: inside (keys, time cell) by a window, across
    cells by a table of one row per key and cell in use. Cells are quantiles of all times, so a burst of times
    or a hot key is many cells of about ``cell_rows`` rows, and no left row ever meets more than its one
    match (an equi-join on cells pairs all rows of a full cell).
    """
    match = right_t + "_match"
    kinds = {f.name: f.dataType for f in right.schema.fields}
    own = [F.col(right_t).alias(match), *[F.col(c) for c in payload]]
    r = right.select(*keys, F.col(right_t).cast("double").alias("_t"), F.struct(*own).alias("_row")).filter("_t is not null").dropna(subset=keys or None)
    r = r.dropDuplicates([*keys, "_t"]).select(*keys, "_t", F.lit(0).alias("_o"), "_row")
    x = left.select(*keys, F.col(left_t).cast("double").alias("_t"), F.lit(1).alias("_o"), F.struct(*left.columns).alias("_left"))
    rows = x.unionByName(r, allowMissingColumns=True)
    n = rows.count()
    cells = min(ASOF_CELLS, -(-n // (cell_rows or ASOF_CELL_ROWS)))
    rows = rows.withColumn("_cell", _time_cells(rows, "_t", cells))
    before = Window.partitionBy(*keys, "_cell").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_in", F.last("_row", ignorenulls=True).over(before)).filter("_o = 1 and _t is not null")
    dated = F.when(F.col("_row").isNotNull(), F.col("_t"))
    table = rows.groupBy(*keys, "_cell").agg(F.max_by("_row", dated).alias("_last"), F.min_by("_row", dated).alias("_lead"))
    over = Window.partitionBy(*keys).orderBy("_cell")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = table.select(*keys, "_cell", F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
                         F.first("_lead", ignorenulls=True).over(whole).alias("_head"))
    found = inside.select(*keys, "_cell", "_left", "_in").join(table, [*keys, "_cell"], "left")
    row = F.coalesce("_in", "_carry", *(["_head"] if clamp_first else []))
    cols = [*[F.col(f"_left.`{c}`").alias(c) for c in left.columns]]
    out = found.withColumn("_row", row).select(*cols, *[F.col(f"_row.`{c}`").alias(c) for c in (match, *payload)])
    none = [F.lit(None).cast(kinds[right_t]).alias(match), *[F.lit(None).cast(kinds[c]).alias(c) for c in payload]]
    return out.unionByName(left.filter(F.col(left_t).isNull()).select(*left.columns, *none))


def segment_index(df: DataFrame, pos: str, starts: DataFrame, start_col: str, keys: list[str] | None = None,
                  bound_segments: int = 10_000, name: str = "seg_idx") -> DataFrame:
    """``bisect_right(starts, pos) - 1`` (-1 before the first start).

    ``starts`` is collapsed to one sorted array per road key; that table has one row
    per key and at most ``bound_segments`` elements per row, so it is broadcast under
    that bound and shuffled past it.
    """
    keys = keys or []
    arrs = starts.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(start_col))).alias("_starts"))
    n_roads = None if keys else 1
    arrs = maybe_broadcast(arrs, n_roads, row_bytes=8 * bound_segments) if n_roads else arrs
    x = df.join(arrs, on=keys, how="left") if keys else df.crossJoin(arrs)
    return x.withColumn(name, F.size(F.filter("_starts", lambda s: s <= F.col(pos))) - 1)


def interval_lookup(df: DataFrame, x: Column, intervals: DataFrame, lo: str, hi: str, bound_rows: int,
                    inclusive_hi: bool = True) -> DataFrame:
    """Attach the interval row with ``lo <= x <= hi`` (first interval on ties).

    ``intervals`` is a bounded dimension (road map): broadcast when ``bound_rows`` fits.
    """
    iv = maybe_broadcast(intervals, bound_rows, row_bytes=64)
    cond = (x >= F.col(lo)) & ((x <= F.col(hi)) if inclusive_hi else (x < F.col(hi)))
    return df.join(iv, cond, "left")


def interpolate(df: DataFrame, x: str, knots: DataFrame, kx: str, ky: str, keys: list[str], bound_knots: int,
                name: str = "interp") -> DataFrame:
    """``np.interp`` - piecewise-linear through sorted knots, clamped at both ends.

    Knots are grouped into one sorted array per key (bounded by ``bound_knots``), and each
    row reads its bracketing pair from the array.
    """
    k = knots.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(kx).alias("x"), F.col(ky).alias("y")))).alias("_k"))
    x_df = df.join(k, on=keys, how="left") if keys else df.crossJoin(maybe_broadcast(k, 1, 16 * bound_knots))
    xc = F.col(x)
    i = F.size(F.filter("_k", lambda s: s["x"] <= xc))  # knots at or left of x
    n = F.size("_k")
    lo = F.element_at("_k", F.greatest(i, F.lit(1)))
    hi = F.element_at("_k", F.least(i + 1, n))
    first = F.element_at("_k", 1)
    last = F.element_at("_k", -1)
    val = (
        F.when(xc <= first["x"], first["y"])
        .when(xc >= last["x"], last["y"])
        .otherwise(lo["y"] + (hi["y"] - lo["y"]) * (xc - lo["x"]) / (hi["x"] - lo["x"]))
    )
    return x_df.withColumn(name, val).drop("_k")


def semi_by_times(df: DataFrame, times: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose (run, time) is in ``times``."""
    return df.join(times.select(*on).distinct(), on=on, how="left_semi")


def crossing_ids(df: DataFrame, keys: list[str], id_col: str, pos: str, line: Column | float) -> DataFrame:
    """Ids seen both before (pos < line) and after (pos > line), as one conditional
    aggregate per id instead of intersecting two id sets."""
    ln = line if isinstance(line, Column) else F.lit(line)
    return (
        df.groupBy(*keys, id_col)
        .agg(F.min(pos).alias("_mn"), F.max(pos).alias("_mx"))
        .filter((F.col("_mn") < ln) & (F.col("_mx") > ln))
        .select(*keys, id_col)
    )


def tail_aligned(a: DataFrame, b: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Align two series on their last rows (trim the longer one's head)."""
    def rev(d, p):
        n = d.groupBy(*keys).agg(F.max(order).alias("_mx"))
        d = d.join(n, on=keys, how="inner")
        return d.select(*keys, (F.col("_mx") - F.col(order)).alias("_r"), *[F.col(c).alias(p + c) for c in cols])

    return rev(a, "a_").join(rev(b, "b_"), on=[*keys, "_r"], how="inner")
