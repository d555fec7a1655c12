"""Join queries (J1-J13) over the vehicle log and traffic-profile adapters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import physics as ph
from ..functions.numeric import rnd
from ..operators import emissions as em
from ..operators import joins as jn
from ..operators import metrics as mt
from ..plans.broadcast import maybe_broadcast
from ..sources import tables as tb
from ..sources.road_map import ELEVATION_FIT, GRADE_FIT, elevation_table, grade_table
from .core import register
from .logs_q import fuel_log, mpg_sql
from .sqlfrag import LEAD_CTES, LOG_CTES

PROBE_SCALE = 0.35  # log step -> profile clock (scaled parameter: steps 0..86 cover profile days 1..30)


def profiles(spark, d):
    # mean as denoised sum / count: the sum of 9-decimal values is rounded first, so both
    # engines divide the same double
    return tb.tse(spark, d).groupBy("t").agg((rnd(F.sum("avg_speed"), 9) / F.count(F.lit(1))).alias("profile_mean"))


@register(
    "j1_asof_profile", "J1",
    sql="""WITH prof AS (SELECT t, round(sum(avg_speed), 9) / count(*) AS profile_mean FROM tse GROUP BY t),
                first_prof AS (SELECT arg_min(t, t) AS t0, arg_min(profile_mean, t) AS m0 FROM prof),
                probe AS (SELECT run_id, id_num, step, step * 3.5e-1 AS probe_t FROM veh_log)
           SELECT p.run_id, p.id_num, p.step, coalesce(a.t, f.t0) AS t_match, round(coalesce(a.profile_mean, f.m0), 6) AS profile_mean
           FROM probe p ASOF LEFT JOIN prof a ON p.probe_t >= a.t CROSS JOIN first_prof f""",
    views=["veh_log", "tse"],
)
def j1(spark, d):
    v = tb.veh_log(spark, d, keep=False).select("run_id", "id_num", "step", (F.col("step") * PROBE_SCALE).alias("probe_t"))
    x = jn.asof_join(v, profiles(spark, d), [], "probe_t", "t", ["profile_mean"])
    return x.select("run_id", "id_num", "step", F.col("t_match"), rnd("profile_mean", 6).alias("profile_mean"))


@register(
    "j2_segment_index", "J2",
    sql="""WITH s AS (SELECT list(DISTINCT seg_start ORDER BY seg_start) AS starts FROM tse)
           SELECT run_id, id_num, step, CAST(len(list_filter(starts, lambda x: x <= position)) - 1 AS INT) AS seg_idx
           FROM veh_log CROSS JOIN s""",
    views=["veh_log", "tse"],
)
def j2(spark, d):
    v = tb.veh_log(spark, d, keep=False).select("run_id", "id_num", "step", "position")
    x = jn.segment_index(v, "position", tb.tse(spark, d), "seg_start")
    return x.select("run_id", "id_num", "step", F.col("seg_idx").cast("int"))


def _values_sql(rows):
    return ", ".join("(" + ", ".join(f"{v!r}e0" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


END_MI = GRADE_FIT[-1][2]

ROAD_CTES = f"""g(interval_number, interval_start, interval_end, slope, intercept) AS (VALUES {_values_sql(GRADE_FIT)}),
                 e(interval_number, interval_start, interval_end, quadratic_term, linear_term, intercept) AS (VALUES {_values_sql(ELEVATION_FIT)}),
                 at_mile AS (SELECT run_id, id_num, step, position, {END_MI!r}e0 - position / 1609.344e0 AS x_mi FROM veh_log),
                 road AS (SELECT x.run_id, x.id_num, x.step, coalesce((g.slope * x.x_mi + g.intercept) * pi() / 180, 0e0) AS road_grade,
                   (e.quadratic_term * x.x_mi * x.x_mi + e.linear_term * x.x_mi + e.intercept) / 3.2808e0 AS altitude
            FROM at_mile x
            LEFT JOIN g ON x.position >= 0 AND x.position <= {END_MI!r}e0 * 1609.344e0 AND x.x_mi >= g.interval_start
                 AND (x.x_mi < g.interval_end OR (g.interval_number = {len(GRADE_FIT)} AND x.x_mi <= g.interval_end))
            LEFT JOIN e ON x.position >= 0 AND x.position <= {END_MI!r}e0 * 1609.344e0 AND x.x_mi >= e.interval_start
                 AND (x.x_mi < e.interval_end OR (e.interval_number = {len(ELEVATION_FIT)} AND x.x_mi <= e.interval_end)))"""


@register(
    "j3_road_grade_altitude", "J3,D16",
    sql=f"""WITH {ROAD_CTES} SELECT run_id, id_num, step, round(road_grade, 9) AS road_grade, round(altitude, 6) AS altitude FROM road""",
    views=["veh_log"],
    note="road map: all intervals of the eastbound fits; positions outside the map give grade 0 / altitude NULL",
)
def j3(spark, d):
    v = tb.veh_log(spark, d, keep=False).select("run_id", "id_num", "step", "position")
    return with_road(spark, v).select("run_id", "id_num", "step", rnd("road_grade", 9).alias("road_grade"), rnd("altitude", 6).alias("altitude"))


def with_road(spark, v):
    """Adds road_grade (radians, 0 outside the map) and altitude (metres, null outside) at ``position``."""
    cols = v.columns
    end_m = END_MI * ph.METERS_PER_MILE_ROAD
    v = v.withColumn("x_mi", F.lit(END_MI) - F.col("position") / ph.METERS_PER_MILE_ROAD)
    inside = (F.col("position") >= 0) & (F.col("position") <= end_m)

    def cond(p):
        return inside & (F.col("x_mi") >= F.col(f"{p}_start")) & (
            (F.col("x_mi") < F.col(f"{p}_end")) | ((F.col(f"{p}_num") == len(GRADE_FIT)) & (F.col("x_mi") <= F.col(f"{p}_end"))))

    g = grade_table(spark).select(F.col("interval_number").alias("g_num"), F.col("interval_start").alias("g_start"),
                                  F.col("interval_end").alias("g_end"), "slope", F.col("intercept").alias("g_icpt"))
    e = elevation_table(spark).select(F.col("interval_number").alias("e_num"), F.col("interval_start").alias("e_start"),
                                      F.col("interval_end").alias("e_end"), "quadratic_term", "linear_term", F.col("intercept").alias("e_icpt"))
    x = v.join(maybe_broadcast(g, len(GRADE_FIT)), cond("g"), "left").join(maybe_broadcast(e, len(ELEVATION_FIT)), cond("e"), "left")
    xm = F.col("x_mi")
    grade = F.coalesce((F.col("slope") * xm + F.col("g_icpt")) * math.pi / 180, F.lit(0.0))
    alt = (F.col("quadratic_term") * xm * xm + F.col("linear_term") * xm + F.col("e_icpt")) / 3.2808
    return x.select(*cols, grade.alias("road_grade"), alt.alias("altitude"))


@register(
    "j5_a8_low_high_speed_mpg", "J5,A8",
    sql=f"""WITH lt AS (SELECT DISTINCT run_id, step, speed < 20 AS low FROM fuel_log WHERE id LIKE '%trajectory%')
            SELECT f.run_id,
                   {mpg_sql("CASE WHEN lt.low THEN speed END", "CASE WHEN lt.low THEN fuel END")} AS low_system_mpg,
                   {mpg_sql("CASE WHEN lt.low THEN speed END", "CASE WHEN lt.low THEN fuel END", where="id LIKE '%av%'")} AS low_av_mpg,
                   {mpg_sql("CASE WHEN NOT lt.low THEN speed END", "CASE WHEN NOT lt.low THEN fuel END")} AS high_system_mpg,
                   {mpg_sql("CASE WHEN NOT lt.low THEN speed END", "CASE WHEN NOT lt.low THEN fuel END", where="id LIKE '%av%'")} AS high_av_mpg
            FROM fuel_log f SEMI JOIN lt ON f.run_id = lt.run_id AND f.step = lt.step
            JOIN lt ON f.run_id = lt.run_id AND f.step = lt.step
            GROUP BY f.run_id""",
    views=["veh_log"], ctes=LOG_CTES,
)
def j5(spark, d):
    f = fuel_log(spark, d)
    leader = f.filter(F.col("id").contains("trajectory"))
    out = None
    for tag, cond in (("low", F.col("speed") < 20), ("high", F.col("speed") >= 20)):
        times = leader.filter(cond).select("run_id", "step")
        m = mt.mpg_metrics(jn.semi_by_times(f, times, ["run_id", "step"]), ["run_id"])
        m = m.select("run_id", F.col("system_mpg").alias(f"{tag}_system_mpg"), F.col("av_mpg").alias(f"{tag}_av_mpg"))
        out = m if out is None else out.join(m, on="run_id", how="full")
    return out


@register(
    "j6_crossing_vehicles", "J6,U2",
    sql="""SELECT run_id, id_num FROM veh_log GROUP BY run_id, id_num HAVING min(position) < 1e2 AND max(position) > 1e2""",
    views=["veh_log"],
)
def j6(spark, d):
    return jn.crossing_ids(tb.veh_log(spark, d), ["run_id"], "id_num", "position", 100.0)


@register(
    "j13_never_crossing_vehicles", "J13",
    sql="""SELECT DISTINCT run_id, id_num FROM veh_log v WHERE NOT EXISTS (
             SELECT 1 FROM (SELECT run_id, id_num FROM veh_log GROUP BY run_id, id_num
                            HAVING min(position) < 1e2 AND max(position) > 1e2) c
             WHERE c.run_id = v.run_id AND c.id_num = v.id_num)""",
    views=["veh_log"],
)
def j13(spark, d):
    v = tb.veh_log(spark, d)
    ids = v.select("run_id", "id_num").distinct()
    return ids.join(jn.crossing_ids(v, ["run_id"], "id_num", "position", 100.0), on=["run_id", "id_num"], how="left_anti")


@register(
    "j7_controller_vs_baseline", "J7,A17",
    sql=f"""WITH m AS (SELECT run_id, split_part(id, '_', 2) AS controller, {mpg_sql()} AS mpg FROM fuel_log GROUP BY 1, 2)
            SELECT m.run_id, m.controller, m.mpg, b.mpg AS baseline_mpg, round((m.mpg / b.mpg - 1) * 100, 6) AS pct_improvement
            FROM m JOIN m b ON b.run_id = m.run_id AND b.controller = 'idm' WHERE m.controller <> 'idm'""",
    views=["veh_log"], ctes=LOG_CTES,
)
def j7(spark, d):
    f = fuel_log(spark, d).withColumn("controller", F.split("id", "_").getItem(1))
    m = f.groupBy("run_id", "controller").agg(rnd(mt.mpg_from_sums(F.sum("speed"), F.sum("fuel")), 6).alias("mpg"))
    b = m.filter(F.col("controller") == "idm").select("run_id", F.col("mpg").alias("baseline_mpg"))
    x = m.filter(F.col("controller") != "idm").join(b, on="run_id", how="inner")
    return x.withColumn("pct_improvement", rnd((F.try_divide(F.col("mpg"), F.col("baseline_mpg")) - 1) * 100, 6))


@register(
    "j8_paired_run_diff", "J8",
    sql="""SELECT a.run_id AS run_a, a.id_num, a.step, round(100 * (a.speed - b.speed), 6) AS speed_diff,
                  round(100 * (a.accel - b.accel), 6) AS accel_diff
           FROM acc a JOIN acc b ON b.run_id = a.run_id + 1 AND b.id_num = a.id_num AND b.step = a.step
           WHERE a.run_id % 2 = 0""",
    views=["veh_log"], ctes=LOG_CTES[:1],
)
def j8(spark, d):
    x = em.realized_accel(tb.veh_log(spark, d)).select("run_id", "id_num", "step", "speed", "accel")
    a = x.filter(F.col("run_id") % 2 == 0).withColumnRenamed("run_id", "run_a")
    b = x.select((F.col("run_id") - 1).alias("run_a"), "id_num", "step", F.col("speed").alias("b_speed"), F.col("accel").alias("b_accel"))
    j = a.join(b, on=["run_a", "id_num", "step"], how="inner")
    return j.select("run_a", "id_num", "step", rnd(100 * (F.col("speed") - F.col("b_speed")), 6).alias("speed_diff"),
                    rnd(100 * (F.col("accel") - F.col("b_accel")), 6).alias("accel_diff"))


@register(
    "j9_a19_tail_aligned_rmse", "J9,A19",
    sql="""WITH a AS (SELECT run_id, max(step) OVER (PARTITION BY run_id, id_num) - step AS r, speed FROM veh_log WHERE id_num = 1),
                b AS (SELECT run_id, max(step) OVER (PARTITION BY run_id, id_num) - step AS r, speed FROM veh_log WHERE id_num = 2)
           SELECT a.run_id, count(*) AS n_aligned, round(sqrt(avg((a.speed - b.speed) * (a.speed - b.speed))), 6) AS rmse
           FROM a JOIN b ON a.run_id = b.run_id AND a.r = b.r GROUP BY a.run_id""",
    views=["veh_log"],
)
def j9(spark, d):
    v = tb.veh_log(spark, d, keep=False)
    x = jn.tail_aligned(v.filter("id_num = 1"), v.filter("id_num = 2"), ["run_id"], "step", ["speed"])
    return x.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_aligned"),
        rnd(F.sqrt(F.avg((F.col("a_speed") - F.col("b_speed")) * (F.col("a_speed") - F.col("b_speed")))), 6).alias("rmse"),
    )


# IDM sweep grid (fixed values of the studied sweep): a = 0.5..2.3, b = 1.3..2.9 by 0.1; v0=35, T=1, s0=7, delta=4
SWEEP = {"v0": 35.0, "T": 1.0, "s0": 7.0, "delta": 4}


#: steps of a run that one task sweeps
SWEEP_STEPS = 4096


def idm_grid(spark):
    a = spark.range(5, 24).select((F.col("id") / 10.0).alias("a"))
    b = spark.range(13, 30).select((F.col("id") / 10.0).alias("b"))
    return a.crossJoin(b)


@register(
    "j10_d13_idm_calibration_sweep", "J10,D13,T3,F15",
    sql="""WITH grid AS (SELECT a.i / 1e1 AS a, b.i / 1e1 AS b FROM range(5, 24) a(i), range(13, 30) b(i)),
                rows AS (SELECT run_id, speed AS v, leader_speed AS vl,
                                CASE WHEN abs(headway) < 1e-3 THEN 1e-3 ELSE headway END AS h, accel
                         FROM lead_log WHERE leader_speed IS NOT NULL),
                err AS (SELECT run_id, g.a, g.b,
                               sqrt(avg(power(g.a * (1 - (v / 3.5e1) * (v / 3.5e1) * (v / 3.5e1) * (v / 3.5e1)
                                   - ((7e0 + greatest(0e0, v * 1e0 + v * (v - vl) / (2 * sqrt(g.a * g.b)))) / h)
                                   * ((7e0 + greatest(0e0, v * 1e0 + v * (v - vl) / (2 * sqrt(g.a * g.b)))) / h)) - accel, 2))) AS rmse
                        FROM rows CROSS JOIN grid g GROUP BY run_id, g.a, g.b)
           SELECT run_id, arg_min(a, struct_pack(r := rmse, a := a, b := b)) AS best_a,
                  arg_min(b, struct_pack(r := rmse, a := a, b := b)) AS best_b, round(min(rmse), 6) AS best_rmse
           FROM err GROUP BY run_id""",
    views=["veh_log"], ctes=LEAD_CTES,
)
def j10(spark, d):
    x = em.attach_leader(em.platoon_leader(fuel_log(spark, d)))
    x = x.filter(F.col("leader_speed").isNotNull()).withColumn("headway", ph.headway("leader_position", "position"))
    grid = maybe_broadcast(idm_grid(spark), 19 * 17)
    # rows of a run's block come together before the grid multiplies them, so one sum a block and grid point is exchanged
    block = F.floor(F.col("step") / SWEEP_STEPS)
    x = x.select("run_id", block.alias("_b"), "speed", "leader_speed", "headway", "accel").repartition("run_id", "_b").crossJoin(grid)
    pred = _idm_grid_accel(F.col("speed"), F.col("leader_speed"), F.col("headway"), F.col("a"), F.col("b"))
    part = x.withColumn("_e", F.pow(pred - F.col("accel"), 2)).groupBy("run_id", "_b", "a", "b").agg(F.sum("_e").alias("_s"), F.count("_e").alias("_n"))
    err = part.groupBy("run_id", "a", "b").agg(F.sqrt(F.try_divide(F.sum("_s"), F.sum("_n"))).alias("rmse"))
    best = err.groupBy("run_id").agg(F.min_by(F.struct("a", "b"), F.struct("rmse", "a", "b")).alias("_b"), F.min("rmse").alias("r"))
    return best.select("run_id", F.col("_b.a").alias("best_a"), F.col("_b.b").alias("best_b"), rnd("r", 6).alias("best_rmse"))


def _idm_grid_accel(v, vl, hw, a, b):
    h = F.when(F.abs(hw) < 1e-3, F.lit(1e-3)).otherwise(hw)
    s_star = SWEEP["s0"] + F.greatest(F.lit(0.0), v * SWEEP["T"] + v * (v - vl) / (2 * F.sqrt(a * b)))
    r = v / SWEEP["v0"]
    return a * (1 - r * r * r * r - (s_star / h) * (s_star / h))


@register(
    "j12_interpolate_profile_at_position", "J12",
    sql="""WITH prof AS (SELECT DISTINCT t FROM tse),
                first_prof AS (SELECT min(t) AS t0 FROM prof),
                probe AS (SELECT run_id, id_num, step, position, step * 3.5e-1 AS probe_t FROM veh_log),
                m AS (SELECT p.run_id, p.id_num, p.step, p.position, coalesce(a.t, f.t0) AS t
                      FROM probe p ASOF LEFT JOIN prof a ON p.probe_t >= a.t CROSS JOIN first_prof f),
                k AS (SELECT t, list(struct_pack(x := seg_start, y := avg_speed) ORDER BY seg_start) AS kn FROM tse GROUP BY t),
                j AS (SELECT m.*, kn, len(list_filter(kn, lambda s: s.x <= m.position)) AS i, len(kn) AS n FROM m JOIN k ON k.t = m.t)
           SELECT run_id, id_num, step, t AS t_match, round(CASE WHEN position <= kn[1].x THEN kn[1].y
                    WHEN position >= kn[n].x THEN kn[n].y
                    ELSE kn[i].y + (kn[i + 1].y - kn[i].y) * (position - kn[i].x) / (kn[i + 1].x - kn[i].x) END, 6) AS interp_speed
           FROM j""",
    views=["veh_log", "tse"],
)
def j12(spark, d):
    v = tb.veh_log(spark, d, keep=False).select("run_id", "id_num", "step", "position", (F.col("step") * PROBE_SCALE).alias("probe_t"))
    times = tb.tse(spark, d).select("t").distinct()
    m = jn.asof_join(v, times, [], "probe_t", "t", [])
    m = m.withColumnRenamed("t_match", "t")
    x = jn.interpolate(m, "position", tb.tse(spark, d), "seg_start", "avg_speed", ["t"], bound_knots=1000, name="interp_speed")
    return x.select("run_id", "id_num", "step", F.col("t").alias("t_match"), rnd("interp_speed", 6).alias("interp_speed"))
