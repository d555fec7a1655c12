"""Series operators over ordered rows (W*): one row per (key, seq), seq dense from 0.

Bounded frames go through ``plans.blocks.over_blocks`` and running frames through
``running_sum`` / ``carry_forward``, so no series - however long - lands in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics as ph
from ..functions.numeric import rnd
from ..plans.blocks import carry_forward, over_blocks, running_sum
from ..plans.ordering import dense_position


def positions_from_speeds(df, keys, seq="seq", speed="speed", dt=ph.DT, name="position") -> DataFrame:
    """pos_0 = 0; pos_i = pos_{i-1} + dt * v_{i-1}."""
    return running_sum(df, keys, seq, {name: F.col(speed) * dt}, exclusive=True)


def gps_distance(df, keys, seq="seq", lat="lat", lon="lon", name="distance_gps") -> DataFrame:
    """Cumulative haversine distance along the series (0 at the first row)."""
    x = over_blocks(
        df, keys, seq, 1, 0,
        lambda w: {"_step_m": ph.haversine_m(F.lag(lat, 1).over(w), F.lag(lon, 1).over(w), F.col(lat), F.col(lon))},
    )
    return running_sum(x, keys, seq, {name: F.coalesce(F.col("_step_m"), F.lit(0.0))}).drop("_step_m")


def bearing_next(df, keys, seq="seq", lat="lat", lon="lon", name="bearing") -> DataFrame:
    """Bearing (from radians of lat/lon) to the next point; last row 0; plus direction (F8)."""
    x = over_blocks(
        df, keys, seq, 0, 1,
        lambda w: {
            name: F.coalesce(
                ph.bearing_deg(
                    F.radians(F.col(lat)), F.radians(F.col(lon)),
                    F.radians(F.lead(lat, 1).over(w)), F.radians(F.lead(lon, 1).over(w)),
                ),
                F.lit(0.0),
            )
        },
    )
    return x.withColumn("driving_dir", ph.driving_direction(name))


def gap_fill(df, keys, seq="seq", time="time", values=(), dt=ph.DT) -> DataFrame:
    """Rows at every missing dt step between two rows, values linearly blended.

    ``missing = round(gap / dt)``; inserted row k of a gap takes
    ``prev + (next - prev) * k / missing`` (ruling Q8: every missing step, exact).
    Output keeps (keys, time, values) and a fresh dense ``seq``.
    """
    cols = [time, *values]
    x = over_blocks(df, keys, seq, 0, 1, lambda w: {f"_n_{c}": F.lead(c, 1).over(w) for c in cols})
    gap = F.col(f"_n_{time}") - F.col(time)
    missing = F.when(F.abs(gap - dt) > 1e-3, F.round(gap / dt, 3).cast("int")).otherwise(F.lit(1))
    x = x.withColumn("_k", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(missing, F.lit(1)) - 1, F.lit(0)))))
    x = x.withColumn("_m", missing)
    blend = {
        c: F.when(F.col("_k") == 0, F.col(c)).otherwise(F.col(c) + (F.col(f"_n_{c}") - F.col(c)) * F.col("_k") / F.col("_m"))
        for c in cols
    }
    blend[time] = F.round(blend[time], 3)
    out = x.withColumns(blend).select(*keys, *cols, F.col(seq).alias("_src"), "_k")
    block = 1 << 20
    out = dense_position(out, keys, ["_src", "_k"], bucket=F.floor(F.col("_src") / block).cast("long"))
    return out.drop("_src", "_k")


def smoothing_kernel(passes: int = 50, mu: float = 0.9) -> np.ndarray:
    """``passes`` applications of [mu/2, 1-mu, mu/2] as one symmetric kernel."""
    k = np.array([1.0])
    base = np.array([mu / 2, 1 - mu, mu / 2])
    for _ in range(passes):
        k = np.convolve(k, base)
    return k


def smooth(df, keys, seq="seq", value="value", passes=50, mu=0.9, name="smoothed") -> DataFrame:
    """``passes`` rounds of 3-tap smoothing with replicated edges, as one kernel.

    Replicated-edge iteration equals one (2*passes+1)-tap kernel over the
    half-sample-mirrored series, so each row is copied to the mirrored positions it
    occupies within ``passes`` of an end (any length: the fold is periodic with period
    2n); blocks of the extended series with their halos are then correlated with the
    kernel in numpy. One shuffle instead of ``passes`` windows.
    """
    kern = smoothing_kernel(passes, mu)
    r = passes
    n_tab = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    x = df.select(*keys, seq, value).join(n_tab, on=keys, how="inner")
    # extended positions j in [-r, n+r) with fold(j) == seq
    n = F.col("_n")
    s = F.col(seq)
    reps = F.floor(F.lit(r) / (2 * n)).cast("int") + 1
    ks = F.sequence(-reps, reps)
    cands = F.flatten(F.transform(ks, lambda k: F.array(s + 2 * n * k, 2 * n - 1 - s + 2 * n * k)))
    cands = F.array_distinct(F.filter(cands, lambda j: (j >= -r) & (j < n + r)))
    x = x.withColumn("_j", F.explode(cands)).withColumn("_e", F.col("_j") + r)

    # rows of each (key, block) plus the r-row halos on both sides go to one pandas call;
    # the 101-tap kernel is one numpy correlation there (the halo makes every own row's
    # neighbourhood complete, so blocks never see each other)
    from pyspark.sql import types as T

    from ..plans.blocks import block_size, with_halo

    block = block_size(df.sparkSession)
    wide = with_halo(x.select(*keys, "_j", "_e", "_n", value), "_e", r, r, block)
    key_fields = [df.schema[k] for k in keys]
    out_schema = T.StructType(key_fields + [T.StructField(seq, T.LongType()), T.StructField(value, T.DoubleType()),
                                            T.StructField(name, T.DoubleType())])
    kern_list = [float(v) for v in kern]

    def per_block(pdf):
        import numpy as np

        pdf = pdf.sort_values("_e")
        v = pdf[value].to_numpy(dtype=float)
        own = pdf["_own"].to_numpy() & (pdf["_j"].to_numpy() >= 0) & (pdf["_j"].to_numpy() < pdf["_n"].to_numpy())
        pos = np.nonzero(own)[0]
        valid = np.correlate(v, np.asarray(kern_list), mode="valid") if len(v) > 2 * r else np.zeros(0)
        sm = valid[pos - r] if len(pos) else np.zeros(0)  # centre p <-> valid index p - r
        sel = pdf.iloc[pos]
        res = sel[keys].copy()
        res[seq] = sel["_j"].to_numpy(dtype=np.int64)
        res[value] = sel[value].to_numpy(dtype=float)
        res[name] = sm
        return res

    return wide.groupBy(*keys, "_blk").applyInPandas(per_block, out_schema)


def moving_sum(df, keys, seq, value, n: int, name="moving_sum", average=False) -> DataFrame:
    """Sum (or mean) over the last n rows, only where a full window exists."""
    def build(w):
        frame = w.rowsBetween(-(n - 1), 0)
        agg = F.sum(value).over(frame)
        return {name: agg / n if average else agg}

    x = over_blocks(df, keys, seq, n - 1, 0, build)
    return x.filter(F.col(seq) >= n - 1)


def trailing_avg(df, keys, seq, value, w_rows: int, name="trailing_avg", denoise: int | None = None) -> DataFrame:
    """Average of up to the last w rows (warm-up averages what exists).

    ``denoise``: round the frame sum to that many decimals before dividing, so the
    result does not depend on the summation order of the engine."""
    def build(w):
        f = w.rowsBetween(-(w_rows - 1), 0)
        if denoise is None:
            return {name: F.avg(value).over(f)}
        return {name: rnd(F.sum(value).over(f), denoise) / F.count(value).over(f)}

    return over_blocks(df, keys, seq, w_rows - 1, 0, build)


def rolling_ratio(df, keys, seq, num, den, n: int, name="rolling_ratio") -> DataFrame:
    """(sum num / sum den) + 1e-6 over the last n rows (source precedence), full windows."""
    def build(w):
        f = w.rowsBetween(-(n - 1), 0)
        return {"_rn": F.sum(num).over(f), "_rd": F.sum(den).over(f)}

    x = over_blocks(df, keys, seq, n - 1, 0, build).filter(F.col(seq) >= n - 1)
    return x.withColumn(name, F.try_divide(F.col("_rn"), F.col("_rd")) + 1e-6).drop("_rn", "_rd")


def next_point(df, keys, seq, cols, prefix="next_") -> DataFrame:
    """Next row's values per key; the last row (no next) is dropped."""
    x = over_blocks(df, keys, seq, 0, 1, lambda w: {prefix + c: F.lead(c, 1).over(w) for c in cols})
    return x.filter(F.col(prefix + cols[0]).isNotNull())


def sharp_events(df, keys, seq, time, velocity_kmh, delta=50, brake=-1.5, accel=1.0) -> DataFrame:
    """Average accel over ``delta`` rows ahead (km/h -> m/s); counts below / above."""
    x = over_blocks(
        df, keys, seq, 0, delta,
        lambda w: {"_v2": F.lead(velocity_kmh, delta).over(w), "_t2": F.lead(time, delta).over(w)},
    )
    acc = F.try_divide(F.col("_v2") - F.col(velocity_kmh), F.col("_t2") - F.col(time)) / 3.6
    x = x.withColumn("avg_accel", acc)
    return x.groupBy(*keys).agg(
        F.count_if(F.col("avg_accel") < brake).cast("long").alias("sharp_braking"),
        F.count_if(F.col("avg_accel") > accel).cast("long").alias("sharp_accel"),
        F.count("avg_accel").alias("n_windows"),
    )


def lag_features(df, keys, seq, value, k: int, prefix=None, fill=0.0) -> DataFrame:
    """``value`` at 1..k rows back, 0-padded."""
    prefix = prefix or f"{value}_lag"
    return over_blocks(df, keys, seq, k, 0,
                       lambda w: {f"{prefix}{i}": F.coalesce(F.lag(value, i).over(w), F.lit(fill)) for i in range(1, k + 1)})


def steps_since_seen(df, keys, seq, present: Column, cap: int, name="steps_since_seen", never=999999) -> DataFrame:
    """Steps since ``present`` was last true, capped; never seen -> ``never`` then capped."""
    x = carry_forward(df, keys, seq, {"_last": F.when(present, F.col(seq))})
    gap = F.when(F.col("_last").isNull(), F.lit(never)).otherwise(F.col(seq) - F.col("_last"))
    return x.withColumn(name, F.least(gap, F.lit(cap))).drop("_last")


def last_row(df, keys, order, cols) -> DataFrame:
    """Last row per key by ``order`` (max_by of a struct; partial aggregation)."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r")).select(*keys, "_r.*")


def switch_pairs(df, keys, seq, flag: Column, direction: Column, keep: str = "West") -> DataFrame:
    """Switch points ``flag[i] <> flag[i+1]``, paired (1st,2nd), (3rd,4th), ...;
    rows ``[start, end)``; pairs whose start direction is West numbered k = 0, 1, ..
    (unpaired last switch ignored, ruling Q9)."""
    x = df.withColumn("_f", flag).withColumn("_dir", direction)
    x = over_blocks(x, keys, seq, 0, 1, lambda w: {"_fn": F.lead("_f", 1).over(w)})
    sw = x.filter(F.col("_fn").isNotNull() & (F.col("_f") != F.col("_fn"))).select(*keys, seq, "_dir")
    block = 1 << 20
    sw = dense_position(sw, keys, [seq], bucket=F.floor(F.col(seq) / block).cast("long"), name="_sw")
    starts = sw.filter(F.col("_sw") % 2 == 0).select(*keys, F.col("_sw"), F.col(seq).alias("start_row"), F.col("_dir"))
    ends = sw.filter(F.col("_sw") % 2 == 1).select(*keys, (F.col("_sw") - 1).alias("_sw"), F.col(seq).alias("end_row"))
    pairs = starts.join(ends, on=[*keys, "_sw"], how="inner").filter(F.col("_dir") == keep)
    pairs = dense_position(pairs, keys, ["_sw"], bucket=F.floor(F.col("_sw") / block).cast("long"), name="k")
    return pairs.select(*keys, "k", "start_row", "end_row", (F.col("end_row") - F.col("start_row")).alias("n_rows"))


#: positions that one block of a drive has where rows meet the pairs of ``switch_pairs``
PAIR_BLOCK = 1024


def rows_inside(df, pairs, keys, seq, start="start_row", end="end_row") -> DataFrame:
    """Rows of ``df`` with each of the ``pairs`` of their key whose ``[start, end)`` holds them. Both sides meet by key and block of
    positions, so a row is compared with the few pairs that touch its block, not with all of a drive, and a long drive is many tasks."""
    block = lambda c: F.floor(c / PAIR_BLOCK).cast("long")
    p = pairs.filter(F.col(start) < F.col(end)).withColumn("_b", F.explode(F.sequence(block(F.col(start)), block(F.col(end) - 1))))
    x = df.withColumn("_b", block(F.col(seq))).join(p, [*keys, "_b"])
    return x.filter((F.col(seq) >= F.col(start)) & (F.col(seq) < F.col(end))).drop("_b")


def relative_speed_from_gap(df, keys, seq, time, velocity_kmh, gap, delta=10, acc_lo=-20.0, acc_hi=10.0,
                            v_lo=0.0, v_hi=140.0, name="relative_velocity") -> DataFrame:
    """W13 (dormant in the source): central difference of the gap over +/-delta rows,
    blanked when the implied leader accel leaves [acc_lo, acc_hi] (checked only when the
    previous row survived) or the implied leader speed leaves [v_lo, v_hi].

    The row-to-row dependency is a 2-state automaton: a row with a bad speed is NaN; with
    a good accel it is kept; with a bad accel it is kept iff the previous row was NaN. So
    kept[i] = value of the last 'constant' row XOR the parity of 'flip' rows since - one
    carry-forward and one running count over blocks, no per-drive fold.
    """
    v, t, g = F.col(velocity_kmh), F.col(time), F.col(gap)
    x = over_blocks(df, keys, seq, delta + 1, delta, lambda w: {
        "_g2": F.lead(gap, delta).over(w), "_g0": F.lag(gap, delta).over(w),
        "_t2": F.lead(time, delta).over(w), "_t0": F.lag(time, delta).over(w),
        "_g2p": F.lead(gap, delta - 1).over(w), "_g0p": F.lag(gap, delta + 1).over(w),
        "_t2p": F.lead(time, delta - 1).over(w), "_t0p": F.lag(time, delta + 1).over(w),
        "_vp": F.lag(velocity_kmh, 1).over(w), "_tp": F.lag(time, 1).over(w)})
    raw = (F.col("_g2") - F.col("_g0")) / (F.col("_t2") - F.col("_t0"))
    rawp = (F.col("_g2p") - F.col("_g0p")) / (F.col("_t2p") - F.col("_t0p"))
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    x = x.join(n, keys).withColumn("_raw", raw).withColumn("_rawp", rawp)
    inside = (F.col(seq) >= delta) & (F.col(seq) < F.col("_n") - delta)
    prev_inside = (F.col(seq) - 1 >= delta)
    acc = (v + F.col("_raw") - F.col("_vp") - F.col("_rawp")) / (t - F.col("_tp")) / 3.6
    acc_bad = prev_inside & ((acc < acc_lo) | (acc > acc_hi))
    spd = v + F.col("_raw")
    spd_bad = (spd < v_lo) | (spd > v_hi)
    # function kind per row: 0 = const False, 1 = const True, 2 = NOT
    kind = F.when(~inside | spd_bad, 0).when(~acc_bad, 1).otherwise(2)
    x = x.withColumn("_kind", kind)
    x = carry_forward(x, keys, seq, {"_cseq": F.when(F.col("_kind") < 2, F.col(seq)),
                                     "_cval": F.when(F.col("_kind") < 2, F.col("_kind") == 1)})
    x = running_sum(x, keys, seq, {"_flips": F.when(F.col("_kind") == 2, 1).otherwise(0)})
    flips_at_c = running_sum(x.select(*keys, seq, "_kind"), keys, seq,
                             {"_fc": F.when(F.col("_kind") == 2, 1).otherwise(0)}).select(*keys, F.col(seq).alias("_cseq"), "_fc")
    x = x.join(flips_at_c, on=[*keys, "_cseq"], how="left")
    parity = (F.col("_flips") - F.coalesce(F.col("_fc"), F.lit(0))) % 2 == 1
    # before any constant row the state is the initial NaN (False)
    ok = F.when(F.col("_cval").isNull(), parity).otherwise(F.col("_cval") != parity)
    x = x.withColumn(name, F.when(inside & ok, F.col("_raw")))
    return x.drop("_g2", "_g0", "_t2", "_t0", "_g2p", "_g0p", "_t2p", "_t0p", "_vp", "_tp", "_n", "_raw", "_rawp",
                  "_kind", "_cseq", "_cval", "_flips", "_fc")


def lane_change_flags(df, keys, seq, headway="headway", accel="accel", speed="speed", leader_speed="leader_speed",
                      lc_thresh=3.5, dt=0.1, th_safe=2.0, ttc_safe=4.5, name="lane_change") -> DataFrame:
    """-1 cut-in (gap drops by >= 3.5 m), +1 cut-out (gap grows by >= 3.5 m), when the
    accel changed by more than 0.9 * dt and the time headway / TTC is safe; else 0."""
    x = over_blocks(df, keys, seq, 1, 0, lambda w: {"_ph": F.lag(headway, 1).over(w), "_pa": F.lag(accel, 1).over(w)})
    h, v, vl = F.col(headway), F.col(speed), F.col(leader_speed)
    rv = vl - v
    da = F.abs(F.col(accel) - F.col("_pa"))
    th = F.when(v > 0, h / v).otherwise(F.lit(60.0))
    ttc = F.when(rv < 0, -h / rv).otherwise(F.lit(60.0))
    safe = ((rv > 0) & (th > th_safe)) | ((rv < 0) & (ttc > ttc_safe))
    diff = h - F.col("_ph")
    flag = (F.when((diff <= -lc_thresh) & (da > 0.9 * dt) & safe, -1)
            .when((diff >= lc_thresh) & (da > 0.9 * dt) & safe, 1).otherwise(0))
    return x.withColumn(name, F.coalesce(flag, F.lit(0))).drop("_ph", "_pa")


def memory_features(df, keys, seq, values: dict[str, int], long_values: dict[str, int], lags: dict[str, int], per: int = 10) -> DataFrame:
    """The stacked state of a row, zero where the log does not reach back.

    ``values``: column -> n: ``{c}_past_{i}``, i = 1..n, the value of this row (1), the row before (2), ... ``lags``: column
    -> n: ``{c}_{i}``, the value i rows before. ``long_values``: column -> n: ``{c}_second_{j}``, j = 0..n-1, memory that
    takes the current value at every ``per``-th row (``seq % per = 0``) and pushes the older ones on. One bounded frame."""
    n_long = max(long_values.values(), default=0)
    reach = max([n - 1 for n in values.values()] + list(lags.values()) + [per * n_long], default=0)

    def build(w):
        cols = {f"{c}_past_{i}": F.coalesce(F.lag(c, i - 1).over(w), F.lit(0.0)) for c, n in values.items() for i in range(1, n + 1)}
        cols |= {f"{c}_{i}": F.coalesce(F.lag(c, i).over(w), F.lit(0.0)) for c, n in lags.items() for i in range(1, n + 1)}
        for c, n in long_values.items():
            full = F.when(F.col(seq) % per == 0, F.col(c))
            for j in range(n):  # exactly one full second among these rows
                cols[f"{c}_second_{j}"] = F.coalesce(F.last(full, ignorenulls=True).over(w.rowsBetween(-per * (j + 1) + 1, -per * j)), F.lit(0.0))
        return cols

    return over_blocks(df, keys, seq, reach, 0, build)
