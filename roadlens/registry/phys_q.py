"""Per-row physics expressions over the enriched vehicle log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics as ph
from ..functions.numeric import rnd
from ..operators import emissions as em
from ..sources import tables as tb
from .core import register
from .logs_q import fuel_log
from .sqlfrag import LEAD_CTES, LOG_CTES, lit

R_ = ph.FS["max_decel"] * ph.DT  # speed reduction per step, as the source computes it


def lead_log(spark, d, runs=None):
    """fuel_log (of ``runs`` where given: a leader is of its follower's run) + leader columns (J4) + headway / speed difference."""
    x = em.attach_leader(em.platoon_leader(fuel_log(spark, d, runs)))
    return x.withColumns({"headway": ph.headway("leader_position", "position"),
                          "speed_difference": F.col("leader_speed") - F.col("speed")})


def with_leader(spark, d, runs=None):
    return lead_log(spark, d, runs).filter(F.col("leader_speed").isNotNull())


K = ["run_id", "id_num", "step"]
SF = ph.SIMPLE_FUEL


def simple_fuel_sql(v, a):
    vv = f"greatest({v}, 0e0)"
    ap = f"greatest({a}, 0e0)"
    return (f"greatest({lit(SF['C0'])} + {lit(SF['C1'])} * {vv} + {lit(SF['C2'])} * {vv} * {vv} + {lit(SF['C3'])} * {vv} * {vv} * {vv}"
            f" + {lit(SF['p0'])} * {a} + {lit(SF['p1'])} * {a} * {vv} + {lit(SF['p2'])} * {a} * {vv} * {vv}"
            f" + {lit(SF['q0'])} * {ap} * {ap} + {lit(SF['q1'])} * {ap} * {ap} * {vv}, {lit(SF['beta0'])})")


C = ph.FUEL_COEFFS


@register(
    "f10_f11_fuel_power_infeasible", "F9,F10,F11,F20",
    sql=f"""SELECT run_id, id_num, step, round(fuel, 9) AS fuel, round({simple_fuel_sql('speed', 'accel')}, 9) AS fuel_simple,
                   round(fuel * {lit(ph.JOULES_PER_GRAM / ph.GAL_PER_HOUR_PER_GRAM_PER_SEC)}, 6) AS power,
                   accel > {lit(C['b1'])} * exp(-{lit(C['b2'])} * speed) + {lit(C['b3'])} AS infeasible
            FROM fuel_log""",
    views=["veh_log"], ctes=LOG_CTES,
)
def f10(spark, d):
    x = fuel_log(spark, d)
    return x.select(*K, rnd("fuel", 9).alias("fuel"), rnd(ph.simple_fuel("speed", "accel"), 9).alias("fuel_simple"),
                    rnd(F.col("fuel") * (ph.JOULES_PER_GRAM / ph.GAL_PER_HOUR_PER_GRAM_PER_SEC), 6).alias("power"),
                    ph.infeasible_accel("speed", "accel").alias("infeasible"))


@register(
    "f12_gap_metrics", "F12,J4,D19",
    sql="""SELECT run_id, id_num, step, round(headway, 6) AS headway, round(speed_difference, 6) AS speed_difference,
                  CASE WHEN speed = 0 THEN 'inf'::DOUBLE ELSE round(headway / speed, 6) END AS time_gap,
                  CASE WHEN speed - leader_speed <= 0 THEN 'inf'::DOUBLE ELSE round(headway / (speed - leader_speed), 6) END AS time_to_collision
           FROM lead_log WHERE leader_speed IS NOT NULL""",
    views=["veh_log"], ctes=LEAD_CTES,
)
def f12(spark, d):
    x = with_leader(spark, d)
    tg = ph.time_gap("headway", "speed")
    ttc = ph.time_to_collision("headway", "speed", "leader_speed")
    return x.select(*K, rnd("headway", 6).alias("headway"), rnd("speed_difference", 6).alias("speed_difference"),
                    F.when(tg == float("inf"), tg).otherwise(rnd(tg, 6)).alias("time_gap"),
                    F.when(ttc == float("inf"), ttc).otherwise(rnd(ttc, 6)).alias("time_to_collision"))


def _brake_sql(v):
    r = lit(R_)
    n = f"floor({v} / {r})"
    return f"(1e-1 * ({n} * {v} - {r} * {n} * ({n} + 1) / 2) + {v} * 1e-1)"


def _safe_stop_sql(g):
    """k whole braking steps fit where unit k (k + 1) / 2 <= g; the rest is spread over k + 1 steps."""
    steps = f"(({g}) / ({lit(R_)} * 1e-1))"
    k = f"floor((sqrt(1 + 8 * {steps}) - 1) / 2)"
    return f"(CASE WHEN ({g}) <= 0 THEN 0e0 ELSE {lit(R_)} * ({k} + ({steps} - {k} * ({k} + 1) / 2) / ({k} + 1)) END)"


@register(
    "f13_safe_velocities", "F13",
    sql=f"""SELECT run_id, id_num, step, round({_brake_sql('leader_speed')}, 9) AS brake_distance,
                   round({_safe_stop_sql(f"(headway + {_brake_sql('leader_speed')} - 2.5e0)")}, 9) AS safe_velocity,
                   round(CASE WHEN (speed + 1 + speed * 4 / 30) - leader_speed > 0
                               AND headway / ((speed + 1 + speed * 4 / 30) - leader_speed) < 6
                              THEN speed - 1e-1 * 3e0 ELSE speed + 1e-1 * 3e0 END, 9) AS safe_ttc_velocity
            FROM lead_log WHERE leader_speed IS NOT NULL""",
    views=["veh_log"], ctes=LEAD_CTES,
)
def f13(spark, d):
    x = with_leader(spark, d)
    return x.select(*K, rnd(ph.brake_distance("leader_speed"), 9).alias("brake_distance"),
                    rnd(ph.safe_velocity("speed", "leader_speed", "headway"), 9).alias("safe_velocity"),
                    rnd(ph.safe_ttc_velocity("speed", "leader_speed", "headway"), 9).alias("safe_ttc_velocity"))


def _fs_sql():
    b = [f"(1 / (2 * {d_!r}e0) * least(leader_speed - speed, 0e0) * least(leader_speed - speed, 0e0) + greatest({x0!r}e0, {h!r}e0 * speed))"
         for h, x0, d_ in zip(ph.FS["h"], ph.FS["dx0"], ph.FS["d"])]
    vv = "least(greatest(leader_speed, 0e0), 1.5e1)"
    vcmd = (f"(CASE WHEN headway <= {b[0]} THEN 0e0 WHEN headway <= {b[1]} THEN {vv} * (headway - {b[0]}) / ({b[1]} - {b[0]})"
            f" WHEN headway <= {b[2]} THEN {vv} + (1.5e1 - {vv}) * (headway - {b[1]}) / ({b[2]} - {b[1]}) ELSE 1.5e1 END)")
    vsafe = _safe_stop_sql(f"(headway + {_brake_sql('leader_speed')} - 2.5e0)")

    def clip(e):
        return f"least(greatest({e}, -3e0), 1.5e0)"

    des = clip(f"({vcmd} - speed) / 1e-1")
    return f"(CASE WHEN {des} * 1e-1 + speed > {vsafe} THEN {clip(f'({vsafe} - speed) / 1e-1')} ELSE {des} END)"


@register(
    "f15_f16_controller_accels", "F15,F16",
    sql=f"""SELECT run_id, id_num, step,
                   round(1.3e0 * (1 - (speed / 4.5e1) * (speed / 4.5e1) * (speed / 4.5e1) * (speed / 4.5e1)
                         - ((2e0 + greatest(0e0, speed * 1e0 + speed * (speed - leader_speed) / {lit(2 * (1.3 * 2.0) ** 0.5)})) / h)
                         * ((2e0 + greatest(0e0, speed * 1e0 + speed * (speed - leader_speed) / {lit(2 * (1.3 * 2.0) ** 0.5)})) / h)), 6) AS idm_accel,
                   round({_fs_sql()}, 6) AS fs_accel
            FROM (SELECT *, CASE WHEN abs(headway) < 1e-3 THEN 1e-3 ELSE headway END AS h FROM lead_log WHERE leader_speed IS NOT NULL)""",
    views=["veh_log"], ctes=LEAD_CTES,
)
def f15(spark, d):
    x = with_leader(spark, d)
    return x.select(*K, rnd(ph.idm_accel("speed", "leader_speed", "headway"), 6).alias("idm_accel"),
                    rnd(ph.follower_stopper_accel("speed", "leader_speed", "headway"), 6).alias("fs_accel"))


@register(
    "f17_a22_reward_sums", "F17,A22",
    sql="""SELECT run_id, round(sum(reward), 6) AS reward, round(sum(energy), 6) AS energy_reward,
                  round(sum(accel_r), 6) AS accel_reward, count(*) AS n_steps, CAST(count(CASE WHEN headway < 0 THEN 1 END) AS BIGINT) AS n_crash
           FROM (SELECT run_id, headway, -1e-1 * greatest(fuel, 0e0) AS energy, -2e-1 * (accel * accel) AS accel_r,
                        ((CASE WHEN headway < 0 THEN -5e1 ELSE 0e0 END) + -1e-1 * greatest(fuel, 0e0) + -2e-1 * (accel * accel)
                         + 0e0 + 0e0 + 0e0 + 0e0) / 1e1 AS reward
                 FROM lead_log WHERE id LIKE '%av%' AND leader_speed IS NOT NULL)
           GROUP BY run_id""",
    views=["veh_log"], ctes=LEAD_CTES,
    note="default weights: energy 0.1, accel 0.2, intervention 0, headway 0, speed-diff 0, accel-delta 0",
)
def f17(spark, d):
    x = with_leader(spark, d).filter(F.col("id").contains("av"))
    r = ph.reward_components("headway", "speed", "leader_speed", "accel", "fuel")
    x = x.select("run_id", "headway", *[v.alias(k) for k, v in r.items()])
    return x.groupBy("run_id").agg(
        rnd(F.sum("reward"), 6).alias("reward"), rnd(F.sum("energy_reward"), 6).alias("energy_reward"),
        rnd(F.sum("accel_reward"), 6).alias("accel_reward"), F.count(F.lit(1)).alias("n_steps"),
        F.count_if(F.col("headway") < 0).cast("long").alias("n_crash"),
    )


MPH_SQL = lit(ph.MPH)


@register(
    "f18_f32_acc_settings_residual", "F18,F32",
    sql=f"""WITH s AS (SELECT run_id, id_num, step, speed, accel, leader_speed,
                          CASE WHEN leader_speed < 2e1 * {MPH_SQL} THEN leader_speed WHEN speed > leader_speed + 2 THEN leader_speed
                               ELSE (speed + leader_speed) / 2e0 END AS raw_set,
                          CAST(CASE WHEN leader_speed < 2e1 * {MPH_SQL} AND abs(speed - leader_speed) < 2e0 THEN 2
                                    WHEN leader_speed < 2e1 * {MPH_SQL} AND speed > leader_speed THEN 1
                                    WHEN leader_speed < 2e1 * {MPH_SQL} THEN 3
                                    WHEN speed > leader_speed + 2 THEN 1 ELSE 3 END AS INT) AS gap_setting
                   FROM lead_log WHERE leader_speed IS NOT NULL),
                 t AS (SELECT *, greatest(round_even(raw_set / {MPH_SQL}, 0) * {MPH_SQL}, {MPH_SQL} * 20) AS speed_setting FROM s)
            SELECT run_id, id_num, step, round(speed_setting, 9) AS speed_setting, gap_setting,
                   round(CASE WHEN speed_setting - speed > 6e-1
                              THEN least({lit(ph.ACC['p3'])}, {lit(ph.ACC['p20'])} * (speed_setting - speed) + {lit(ph.ACC['p21'])})
                              ELSE greatest({lit(ph.ACC['p4'])}, {lit(ph.ACC['p22'])} * (speed_setting - speed) + {lit(ph.ACC['p23'])}) END - accel, 6) AS accel_residual
            FROM t""",
    views=["veh_log"], ctes=LEAD_CTES,
)
def f18(spark, d):
    x = with_leader(spark, d)
    a = ph.acc_settings("speed", "leader_speed")
    x = x.withColumns({"speed_setting": a["speed_setting"], "gap_setting": a["gap_setting"]})
    return x.select(*K, rnd("speed_setting", 9).alias("speed_setting"), "gap_setting",
                    rnd(ph.acc_residual("speed_setting", "speed", "accel"), 6).alias("accel_residual"))


@register(
    "f19_densities", "F19",
    sql=f"""SELECT t, seg_idx, round(CASE WHEN avg_speed < 3.5e1 THEN 1 / ((2e0 + 1.24e0 * avg_speed)
                   / sqrt(1 - (avg_speed / 3.5e1) * (avg_speed / 3.5e1) * (avg_speed / 3.5e1) * (avg_speed / 3.5e1)) + 4e0) END, 9) AS k_idm,
                   round(1.47e-1 * (1 - avg_speed / 3.12e1), 9) AS k_linear,
                   round(3.12e1 * (1 - (1.47e-1 * (1 - avg_speed / 3.12e1)) / 1.47e-1), 6) AS v_of_k
            FROM tse""",
    views=["tse"],
)
def f19(spark, d):
    x = tb.tse(spark, d)
    k = ph.density_linear("avg_speed")
    return x.select("t", "seg_idx", rnd(ph.density_idm("avg_speed"), 9).alias("k_idm"), rnd(k, 9).alias("k_linear"),
                    rnd(ph.speed_linear(k), 6).alias("v_of_k"))


@register(
    "f21_policy_postprocess", "F21",
    sql="""WITH b AS (SELECT run_id, id_num, step, headway, least(greatest(accel, -3e0), 1.5e0) AS rl,
                             headway / greatest(1e-1, speed - leader_speed) AS ttc FROM lead_log WHERE leader_speed IS NOT NULL),
                c AS (SELECT *, 1 / (1e0 + exp(-1.5e0 * (6.5e0 - ttc))) AS small, 1 / (1e0 + exp(-1e-1 * (headway - 1.2e2))) AS large FROM b)
           SELECT run_id, id_num, step,
                  round(least(greatest((1 - small) * (rl * (1 - large) + 7.5e-1 * large) + small * -3e0, -3e0), 1.5e0), 6) AS modified_accel
           FROM c""",
    views=["veh_log"], ctes=LEAD_CTES,
)
def f21(spark, d):
    x = with_leader(spark, d)
    return x.select(*K, rnd(ph.policy_postprocess("accel", "speed", "leader_speed", "headway"), 6).alias("modified_accel"))


@register(
    "f30_cut_probabilities", "F30",
    sql="""SELECT run_id, id_num, step,
                  round(CASE WHEN leader_speed <= 2.5e1 THEN (1.9e-2 + -8.975e-4 * headway + 1.002e-4 * headway * headway) / 1e2
                             ELSE (-5.068e-3 + 1.347e-3 * headway + 8.912e-6 * headway * headway) / 5e2 END, 12) AS cutin_proba,
                  round((-8.98e-3 + 8.763e-3 * leader_speed - 2.1e-4 * leader_speed * leader_speed) / 5e2, 12) AS cutout_proba
           FROM lead_log WHERE leader_speed IS NOT NULL""",
    views=["veh_log"], ctes=LEAD_CTES,
)
def f30(spark, d):
    x = with_leader(spark, d)
    p = ph.cut_probabilities("headway", "leader_speed")
    return x.select(*K, rnd(p["cutin_proba"], 12).alias("cutin_proba"), rnd(p["cutout_proba"], 12).alias("cutout_proba"))
