"""Vehicle physics as Column expressions (whole-stage codegen, no Python per row).

Every builder takes Columns (or names) and returns a Column. Powers are written as
products so both engines compute the same IEEE values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the studied code base) -------------------------
# Fuel model of a 2019 mid-size SUV, polynomial fit; gasoline.
FUEL_COEFFS = {
    "beta0": 0.013111753095302022,
    "vc": 5.98,
    "p1": 0.047436831067050676,
    "C0": 0.14631964767035743,
    "C1": 0.012179045946260292,
    "C2": 0.0,
    "C3": 2.7432588728174234e-05,
    "p0": 0.04553801347643801,
    "p2": 0.0018022443124799303,
    "q0": 0.0,
    "q1": 0.02609037187916979,
    "b1": 7.1780386096154185,
    "b2": 0.053537268955100234,
    "b3": 0.27965662935753677,
    "z0": 1.4940081773441736,
    "z1": 1.2718495543500672,
}
GAL_PER_HOUR_PER_GRAM_PER_SEC = 1.268  # gasoline
JOULES_PER_GRAM = 42360.0  # gasoline
METERS_PER_MILE = 1609.34  # metrics
METERS_PER_MILE_ROAD = 1609.344  # road maps
MPH = 0.44704  # m/s
VEHICLE_LENGTH = 5.0
DT = 0.1
# IDM defaults
IDM = {"v0": 45.0, "T": 1.0, "a": 1.3, "b": 2.0, "delta": 4, "s0": 2.0}
# Follower-stopper bands
FS = {"h": (0.4, 0.6, 0.8), "dx0": (4.5, 5.25, 6.0), "d": (1.5, 1.0, 0.5), "v_des": 15.0,
      "max_accel": 1.5, "max_decel": 3.0}
EARTH_RADIUS_M = 6371e3
# ------------------------------------------------------------------------------


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def _inf() -> Column:
    return F.lit(float("inf"))


def fuel_rate(speed, accel, grade=0.0, c: dict = FUEL_COEFFS) -> Column:
    """instantaneous fuel consumption in gal/h."""
    v, a, g = _c(speed), _c(accel), _c(grade)
    ap = F.greatest(a, F.lit(0.0))
    fc = (
        F.lit(c["C0"]) + F.lit(c["C1"]) * v + F.lit(c["C2"]) * v * v + F.lit(c["C3"]) * v * v * v
        + F.lit(c["p0"]) * a + F.lit(c["p1"]) * a * v + F.lit(c["p2"]) * a * v * v
        + F.lit(c["q0"]) * ap * ap + F.lit(c["q1"]) * ap * ap * v
        + F.lit(c["z0"]) * g + F.lit(c["z1"]) * g * v
    )
    floor_ = F.when(v <= F.lit(c["vc"]), F.lit(c["beta0"])).otherwise(F.lit(0.0))
    return F.greatest(fc, floor_) * GAL_PER_HOUR_PER_GRAM_PER_SEC


def infeasible_accel(speed, accel, c: dict = FUEL_COEFFS) -> Column:
    """accel above the feasible envelope b1*exp(-b2 v)+b3."""
    return _c(accel) > F.lit(c["b1"]) * F.exp(-F.lit(c["b2"]) * _c(speed)) + F.lit(c["b3"])


def power_watts(speed, accel, grade=0.0) -> Column:
    """power = fuel rate x joules per gram / gal-per-hour factor."""
    return fuel_rate(speed, accel, grade) * (JOULES_PER_GRAM / GAL_PER_HOUR_PER_GRAM_PER_SEC)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """great-circle distance in metres."""
    la1, lo1, la2, lo2 = map(_c, (lat1, lon1, lat2, lon2))
    dlat = F.radians(la2 - la1)
    dlon = F.radians(lo2 - lo1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(la1)) * F.cos(F.radians(la2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(EARTH_RADIUS_M) * (2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """F8: bearing in [0, 360); inputs used as given (the source passes degrees to sin/cos)."""
    la1, lo1, la2, lo2 = map(_c, (lat1, lon1, lat2, lon2))
    dlon = lo2 - lo1
    x = F.cos(la2) * F.sin(dlon)
    y = F.cos(la1) * F.sin(la2) - F.sin(la1) * F.cos(la2) * F.cos(dlon)
    b = F.degrees(F.atan2(x, y))
    return F.when(b < 0, b + 360).otherwise(b)


def driving_direction(bearing) -> Column:
    """F8: West (270,360), East (90,190), else NULL."""
    b = _c(bearing)
    return F.when((b > 270) & (b < 360), "West").when((b > 90) & (b < 190), "East")


def in_geofence(lat, lon) -> Column:
    """Four strict bounds."""
    la, lo = _c(lat), _c(lon)
    return (lo < -86.58) & (lo > -86.685) & (la > 35.98) & (la < 36.07)


def headway(leader_pos, pos, length=VEHICLE_LENGTH) -> Column:
    """bumper gap; NULL without leader."""
    return _c(leader_pos) - _c(pos) - F.lit(length)


def time_gap(hw, speed) -> Column:
    """headway / speed, +inf at speed 0, NULL without leader."""
    return F.when(_c(hw).isNull(), F.lit(None).cast("double")).when(_c(speed) == 0, _inf()).otherwise(
        F.try_divide(_c(hw), _c(speed))
    )


def time_to_collision(hw, speed, leader_speed) -> Column:
    """headway / (v - v_leader) when closing, else +inf; NULL without leader."""
    dv = _c(speed) - _c(leader_speed)
    return F.when(_c(hw).isNull() | dv.isNull(), F.lit(None).cast("double")).when(dv <= 0, _inf()).otherwise(
        F.try_divide(_c(hw), dv)
    )


def idm_accel(speed, leader_speed, hw, p: dict = IDM) -> Column:
    """IDM acceleration without noise (no leader -> free road term only)."""
    v, vl = _c(speed), _c(leader_speed)
    h = F.when(F.abs(_c(hw)) < 1e-3, F.lit(1e-3)).otherwise(_c(hw))
    s_star = F.when(vl.isNull(), F.lit(0.0)).otherwise(
        F.lit(p["s0"]) + F.greatest(F.lit(0.0), v * p["T"] + v * (v - vl) / (2 * math.sqrt(p["a"] * p["b"])))
    )
    ratio = v / p["v0"]
    free = ratio * ratio * ratio * ratio if p["delta"] == 4 else F.pow(ratio, p["delta"])
    inter = F.when(vl.isNull(), F.lit(0.0)).otherwise((s_star / h) * (s_star / h))
    return p["a"] * (1 - free - inter)


def brake_distance(speed, max_decel=FS["max_decel"], dt=DT) -> Column:
    """distance to stop braking as hard as possible after one step of delay."""
    v = _c(speed)
    r = max_decel * dt
    n = F.floor(v / r)  # int() on a non-negative speed
    return dt * (n * v - r * n * (n + 1) / 2) + v * dt


def safe_stop_speed(dist, max_decel=FS["max_decel"], dt=DT) -> Column:
    """largest speed that can stop within ``dist`` when each step of ``dt`` takes
    ``r = max_decel dt`` off the speed.

    ``k`` whole steps of braking from ``k r`` cover ``r dt k (k + 1) / 2``; the largest such
    ``k`` that fits solves a quadratic, and what is left of the distance is spread over the
    ``k + 1`` steps."""
    unit = max_decel * dt * dt
    steps = _c(dist) / unit
    k = F.floor((F.sqrt(1 + 8 * steps) - 1) / 2)
    rest = steps - k * (k + 1) / 2
    return F.when(_c(dist) <= 0, F.lit(0.0)).otherwise(max_decel * dt * (k + rest / (k + 1)))


def safe_velocity(speed, leader_speed, hw, max_decel=FS["max_decel"], dt=DT, min_gap=2.5) -> Column:
    """safe velocity against a leader that may stop at once."""
    return safe_stop_speed(_c(hw) + brake_distance(leader_speed, max_decel, dt) - min_gap, max_decel, dt)


def safe_ttc_velocity(speed, leader_speed, hw, max_decel=FS["max_decel"], dt=DT) -> Column:
    """TTC-based safe velocity (slow down when the scaled TTC < 6 s)."""
    v = _c(speed)
    dv = (v + 1 + v * 4 / 30) - _c(leader_speed)
    ttc = F.when(dv <= 0, _inf()).otherwise(F.try_divide(_c(hw), dv))
    return F.when(ttc < 6, v - dt * max_decel).otherwise(v + dt * max_decel)


def failsafe_threshold(speed, leader_speed) -> Column:
    """6 * ((v + 1 + 4v/30) - v_lead)."""
    v = _c(speed)
    return 6 * ((v + 1 + v * 4 / 30) - _c(leader_speed))


def gap_closing_threshold(speed, max_headway=120.0, time_headway=6.0) -> Column:
    """max(h, th * v)."""
    return F.greatest(F.lit(max_headway), F.lit(time_headway) * _c(speed))


def follower_stopper_accel(speed, leader_speed, hw, p: dict = FS, dt=DT) -> Column:
    """F16: follower-stopper velocity command turned into a clipped acceleration,
    replaced by the safe-velocity acceleration when the command would exceed it."""
    v, vl, dx = _c(speed), _c(leader_speed), _c(hw)
    dvm = F.least(vl - v, F.lit(0.0))
    bands = [
        1 / (2 * d) * dvm * dvm + F.greatest(F.lit(x0), h * v)
        for h, x0, d in zip(p["h"], p["dx0"], p["d"])
    ]
    vv = F.least(F.greatest(vl, F.lit(0.0)), F.lit(p["v_des"]))
    v_cmd = (
        F.when(dx <= bands[0], F.lit(0.0))
        .when(dx <= bands[1], vv * (dx - bands[0]) / (bands[1] - bands[0]))
        .when(dx <= bands[2], vv + (p["v_des"] - vv) * (dx - bands[1]) / (bands[2] - bands[1]))
        .otherwise(F.lit(p["v_des"]))
    )

    def clip(x):
        return F.least(F.greatest(x, F.lit(-abs(p["max_decel"]))), F.lit(p["max_accel"]))

    v_safe = safe_velocity(v, vl, dx, p["max_decel"], dt)
    desired = clip((v_cmd - v) / dt)
    return F.when(desired * dt + v > v_safe, clip((v_safe - v) / dt)).otherwise(desired)


def miles_per_step(speed, dt=DT) -> Column:
    """m/s over one step -> miles."""
    return _c(speed) / METERS_PER_MILE * dt


def gallons_per_step(rate_gph, dt=DT) -> Column:
    """gal/h over one step -> gallons."""
    return _c(rate_gph) / 3600.0 * dt


# ---- fixed values: second (simplified) fuel model, reward weights, ACC law ------
SIMPLE_FUEL = {"p0": 0.014702037699570, "p1": 0.051202817419139, "p2": 0.001873784068826, "q0": 0.0,
               "q1": 0.018538661491842, "C0": 0.245104874164936, "C1": 0.003891740295745, "C2": 0.0,
               "C3": 3.300502213720286e-05, "beta0": 0.194462963040005}
REWARD = {"crash": -50.0, "energy_penalty": 0.1, "accel_penalty": 0.2, "intervention_penalty": 0.0,
          "headway_penalty": 0.0, "min_headway_penalty_gap": 10.0, "min_headway_penalty_speed": 1.0,
          "speed_diff_weight": 0.0, "accel_delta_weight": 0.0, "max_headway": 120.0, "max_time_headway": 0.0,
          "scale": 10.0}
ACC = {"p3": 0.824, "p4": -0.827, "p20": 0.45657109, "p21": -0.2367410149228702,
       "p22": 0.32107542, "p23": -0.20247014575942673, "switch": 0.6}
IDM_EQ = {"v0": 35.0, "T": 1.24, "delta": 4, "s0": 2.0, "veh_len": 4.0}
LINEAR_FD = {"k_max": 0.147, "v_max": 31.2}
# policy post-processing: bounds, logistic weights of a small TTC and of a large gap, acceleration at a large gap
POSTPROCESS = {"low": -3.0, "high": 1.5, "min_closing": 0.1, "ttc_rate": 1.5, "ttc": 6.5, "gap_rate": 0.1, "gap": 120.0, "gap_accel": 0.75}
# cut-in probability per step (slow and fast leader: polynomial of the gap, divisor), cut-out (polynomial of the leader's speed)
CUT_SPEED = 25.0
CUT_IN_SLOW, CUT_IN_SLOW_BY = (1.9e-2, -8.975e-4, 1.002e-4), 100.0
CUT_IN_FAST, CUT_IN_FAST_BY = (-5.068e-3, 1.347e-3, 8.912e-6), 500.0
CUT_OUT, CUT_OUT_BY = (-8.98e-3, 8.763e-3, -2.1e-4), 500.0
# ------------------------------------------------------------------------------


def simple_fuel(speed, accel, c: dict = SIMPLE_FUEL) -> Column:
    """simplified fuel model, speed floored at 0, result floored at beta0."""
    v = F.greatest(_c(speed), F.lit(0.0))
    a = _c(accel)
    ap = F.greatest(a, F.lit(0.0))
    fc = (F.lit(c["C0"]) + F.lit(c["C1"]) * v + F.lit(c["C2"]) * v * v + F.lit(c["C3"]) * v * v * v
          + F.lit(c["p0"]) * a + F.lit(c["p1"]) * a * v + F.lit(c["p2"]) * a * v * v
          + F.lit(c["q0"]) * ap * ap + F.lit(c["q1"]) * ap * ap * v)
    return F.greatest(fc, F.lit(c["beta0"]))


def reward_components(hw, speed, leader_speed, accel, fuel, prev_accel=None, target_speed=None, w: dict = REWARD) -> dict:
    """per-step reward terms of an AV row; total is divided by ``scale``."""
    h, v, a = _c(hw), _c(speed), _c(accel)
    crash = F.when(h < 0, F.lit(w["crash"])).otherwise(F.lit(0.0))
    energy = -w["energy_penalty"] * F.greatest(_c(fuel), F.lit(0.0))
    accel_r = -w["accel_penalty"] * (a * a)
    gap_closing = h > gap_closing_threshold(v, w["max_headway"], w["max_time_headway"])
    failsafe = h < failsafe_threshold(v, leader_speed)
    interv = F.when(gap_closing | failsafe, F.lit(-w["accel_penalty"] * w["intervention_penalty"])).otherwise(F.lit(0.0))
    head = F.when((h > w["min_headway_penalty_gap"]) & (v > w["min_headway_penalty_speed"]),
                  -w["headway_penalty"] * time_gap(h, v)).otherwise(F.lit(0.0))
    sdiff = F.lit(0.0) if target_speed is None else -w["speed_diff_weight"] * (_c(target_speed) - v) * (_c(target_speed) - v)
    adelta = F.lit(0.0) if prev_accel is None else -w["accel_delta_weight"] * (_c(prev_accel) - a) * (_c(prev_accel) - a)
    total = (crash + energy + accel_r + interv + head + sdiff + adelta) / w["scale"]
    return {"reward": total, "energy_reward": energy, "accel_reward": accel_r, "intervention_reward": interv,
            "headway_reward": head, "speed_diff_reward": sdiff, "accel_delta_reward": adelta}


def acc_settings(speed, leader_speed, target_speed=None, max_headway=True) -> dict:
    """ACC speed setting (snapped to whole mph, at least 20 mph; Python round is
    half-to-even, hence bround) and gap setting 1..3."""
    v, vl = _c(speed), _c(leader_speed)
    if target_speed is None:
        slow = vl < 20 * MPH
        speed_set = F.when(slow, vl).when(v > vl + 2, vl).otherwise((v + vl) / 2.0)
        gap = (F.when(slow & (F.abs(v - vl) < 2.0), 2).when(slow & (v > vl), 1).when(slow, 3)
               .when(v > vl + 2, 1).otherwise(3))
    else:
        ts = _c(target_speed)
        speed_set = F.when(ts < vl, ts * 0.6 + vl * 0.4).otherwise(ts)
        gap = F.lit(1 if max_headway else 3)
    snapped = F.bround(speed_set / MPH, 0) * MPH
    return {"speed_setting": F.greatest(snapped, F.lit(MPH * 20)), "gap_setting": gap.cast("int")}


def acc_residual(speed_setting, speed, accel, p: dict = ACC) -> Column:
    """F32: two-branch speed-control law of the speed error, clipped, minus the logged accel."""
    err = _c(speed_setting) - _c(speed)
    ctl = F.when(err > p["switch"], F.least(F.lit(p["p3"]), p["p20"] * err + p["p21"])).otherwise(
        F.greatest(F.lit(p["p4"]), p["p22"] * err + p["p23"]))
    return ctl - _c(accel)


def density_idm(speed, p: dict = IDM_EQ) -> Column:
    """IDM-equilibrium density of a speed (NULL at or above v0)."""
    v = _c(speed)
    r = v / p["v0"]
    s = (p["s0"] + p["T"] * v) / F.sqrt(1 - r * r * r * r)
    return F.when(v < p["v0"], 1 / (s + p["veh_len"]))


def density_linear(speed, p: dict = LINEAR_FD) -> Column:
    """linear fundamental diagram k(v)."""
    return p["k_max"] * (1 - _c(speed) / p["v_max"])


def speed_linear(density, p: dict = LINEAR_FD) -> Column:
    """linear fundamental diagram v(k)."""
    return p["v_max"] * (1 - _c(density) / p["k_max"])


def policy_postprocess(raw_accel, speed, leader_speed, hw) -> Column:
    """logged raw policy accel bounded, blended towards 0.75 above a 120 m gap and
    towards -3 at small TTC (logistic weights), bounded again."""
    p = POSTPROCESS

    def clamp(x):
        return F.least(F.greatest(x, F.lit(p["low"])), F.lit(p["high"]))

    rl = clamp(_c(raw_accel))
    sd = F.greatest(F.lit(p["min_closing"]), _c(speed) - _c(leader_speed))
    ttc = _c(hw) / sd
    small = 1 / (1.0 + F.exp(-p["ttc_rate"] * (p["ttc"] - ttc)))
    large = 1 / (1.0 + F.exp(-p["gap_rate"] * (_c(hw) - p["gap"])))
    mod = rl * (1 - large) + p["gap_accel"] * large
    mod = (1 - small) * mod + small * p["low"]
    return clamp(mod)


def cut_probabilities(space_gap, leader_speed) -> dict:
    """per-step cut-in and cut-out probabilities (base rates, before the
    vehicle-count multiplier)."""
    g, vl = _c(space_gap), _c(leader_speed)
    square = lambda k, x: k[0] + k[1] * x + k[2] * x * x
    cin = F.when(vl <= CUT_SPEED, square(CUT_IN_SLOW, g) / CUT_IN_SLOW_BY).otherwise(square(CUT_IN_FAST, g) / CUT_IN_FAST_BY)
    return {"cutin_proba": cin, "cutout_proba": square(CUT_OUT, vl) / CUT_OUT_BY}
