"""Speed planners behind one interface.

A planner is a function ``planner(x_av, x_seg, v_seg, **extra) -> targets``: target speeds at the positions ``x_av`` of
vehicles on a road whose traffic state is ``v_seg`` at ``x_seg``. ``plan_targets`` brings vehicles and the profile of their road
together by a co-grouped map. A road's vehicles are cut into blocks of about ``BLOCK`` rows, each with a
copy of the road's one profile row, so a road that holds a third of all vehicles is many tasks.

Two planners, each equal to its DataFrame form: the smoothed profile (D7) and the speed-limit profile (D8).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import traffic as tf

BLOCK = 100_000
BROADCAST_ROADS = 100_000


def smoothed_grid(x_seg, v_seg, lo: int = tf.RESAMPLE_LO, hi: int = tf.RESAMPLE_HI, dx: int = tf.RESAMPLE_DX, sigma: float = tf.KERNEL_SIGMA):
    """(grid positions, profile resampled there and smoothed by a normalised Gaussian kernel)."""
    grid = np.arange(lo, hi, dx, dtype=float)
    raw = np.interp(grid, x_seg, v_seg)
    lags = np.arange(-min(len(grid) - 1, math.ceil(8 * sigma / dx)), min(len(grid) - 1, math.ceil(8 * sigma / dx)) + 1)
    weights = np.exp(-((lags * dx) ** 2) / (2 * sigma**2))
    half = len(weights) // 2
    inside = lambda values: np.convolve(values, weights)[half:half + len(grid)]
    return grid, inside(raw) / inside(np.ones(len(grid)))


def at_position(x_av, grid, values, shift: float = tf.TIME_OFFSET * tf.PROP_SPEED):
    """Linear between grid points moved back by ``shift``, on along the last two past the ends."""
    q = np.asarray(x_av, float) + shift
    i = np.clip(np.floor((q - grid[0]) / (grid[1] - grid[0])), 0, len(grid) - 2).astype(int)
    return values[i] + (values[i + 1] - values[i]) * (q - grid[i]) / (grid[i + 1] - grid[i])


def smoothed_planner(x_av, x_seg, v_seg, shift: float = tf.TIME_OFFSET * tf.PROP_SPEED, **_):
    """Drive at the smoothed speed of traffic."""
    return at_position(x_av, *smoothed_grid(x_seg, v_seg), shift)


def _bound(grid, raw, loc: float, standing: bool, v_q: float, k_c: float, decel: float):
    """The speed that one bottleneck allows at each grid point (inf where it sets none); None if it has no speed."""
    dx = grid[1] - grid[0]
    before = (grid < loc) & (raw < v_q)
    if standing:
        if not before.any():
            return None
        v = tf.BUFFER_SPEED_RATIO * raw[before].min()
        ratio = raw[before] / tf.FLOW_V0
        buffer = float((dx / ((tf.FLOW_S0 + tf.FLOW_T * raw[before]) / np.sqrt(1 - ratio**4) + tf.VEHICLE_LENGTH)).sum()) / k_c
    else:
        cell = np.flatnonzero(grid == math.copysign(math.floor(abs(loc) / dx) * dx, loc))
        if not len(cell):
            return None
        v, buffer = raw[cell[0]], 0.0
    gain = v * v - v_q * v_q
    brake = gain / (2 * decel)
    begin, end, rate = loc - buffer - brake, loc - buffer, -decel
    if begin <= 0:  # too little road: the buffer, then the braking rate gives way
        fits = standing and loc > brake
        begin, end = 0.0, brake if fits else loc
        rate = -decel if fits or loc == 0 else -gain / (2 * loc)
    held = standing & (grid > end) & (grid <= loc)
    cap = np.where(held, np.minimum(raw, v), raw)
    out = np.full(len(grid), np.inf)
    stretch = (begin <= end) & (grid >= begin) & (grid - dx <= end)
    energy = np.where(stretch, cap * cap + 2 * rate * grid, np.inf)
    ahead = np.minimum.accumulate(energy[::-1])[::-1]
    braking = (grid >= begin) & (grid <= end)
    with np.errstate(invalid="ignore"):
        out[braking] = np.sqrt(ahead - 2 * rate * grid)[braking]
    out[held & ~braking] = cap[held & ~braking]
    return out


def limited_grid(x_seg, v_seg, stand=(), move=(), v_q: float = tf.V_QUEUE, k_c: float = tf.K_CRIT, decel: float = tf.DECEL,
                 aggressiveness: float = tf.AGGRESSIVENESS):
    """(grid positions, least of the smoothed speed and what the bottlenecks allow, no less than its share of the former)."""
    grid, raw = smoothed_grid(x_seg, v_seg)
    target = raw.copy()
    spots = [(float(p), True) for p in list(stand)[:1]] + [(float(p), False) for p in dict.fromkeys(move)]
    for loc, standing in spots:
        bound = _bound(grid, raw, loc, standing, v_q, k_c, decel)
        if bound is not None:
            target = np.fmin(target, bound)
    return grid, np.maximum(target, raw * (1 - aggressiveness))


def speed_limit_planner(x_av, x_seg, v_seg, stand=(), move=(), shift: float = tf.TIME_OFFSET * tf.PROP_SPEED, **_):
    """Slow down early for the bottlenecks ahead (positions ``stand``, of which the first counts, and ``move``)."""
    return at_position(x_av, *limited_grid(x_seg, v_seg, stand, move), shift)


def plan_targets(vehicles: DataFrame, pos: str, profiles: DataFrame, keys: list[str], planner: Callable, x_seg: str = "xs", v_seg: str = "zs",
                 extra: tuple[str, ...] = (), name: str = "target_speed", block: int | None = None) -> DataFrame:
    """``vehicles`` with ``name``: the planner's target at ``pos``. ``profiles`` has one row a road (``keys``) with the arrays
    ``x_seg``, ``v_seg`` and those of ``extra``, which the planner gets by name (null: empty).

    Roads without a profile, null keys and null positions give a null target. Columns of ``vehicles`` pass through
    (``name``, ``_block`` and ``_n`` must not be among them)."""
    block = block or BLOCK
    taken = {name, "_block", "_n"} & set(vehicles.columns)
    if taken:
        raise ValueError(f"columns of vehicles that plan_targets writes itself: {sorted(taken)}")
    # roads of more than one block: no more than rows / block of them, so their list is small, and counted before it is broadcast
    many = vehicles.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n")).filter("_n > 1")
    many = F.broadcast(many) if many.count() <= BROADCAST_ROADS else many
    v = vehicles.join(many, keys, "left").withColumn("_block", F.pmod(F.xxhash64(*[F.col(c) for c in vehicles.columns]), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    p = profiles.select(*keys, F.col(x_seg).alias("_x"), F.col(v_seg).alias("_v"), *[F.col(c) for c in extra])
    p = p.join(many, keys, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    v = v.select(*vehicles.columns, "_block")
    schema = vehicles.select("*", F.lit(None).cast("double").alias(name)).schema
    out_cols = [*vehicles.columns, name]

    def run(rows, profile):
        rows[name] = np.nan
        if len(rows) and len(profile):
            one = profile.iloc[0]
            known = rows[pos].notna().to_numpy()
            if one["_x"] is not None and len(one["_x"]):
                more = {c: () if one[c] is None else np.asarray(one[c], float) for c in extra}
                rows.loc[known, name] = planner(rows.loc[known, pos].to_numpy(float), np.asarray(one["_x"], float), np.asarray(one["_v"], float), **more)
        return rows[out_cols]

    on = [*keys, "_block"]
    out = v.groupBy(*on).cogroup(p.groupBy(*on)).applyInPandas(run, schema)
    return out.withColumn(name, F.when(~F.isnan(name), F.col(name)))
