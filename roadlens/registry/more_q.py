"""More composites: W13, W17, D3, D14, D15, D20, D21, K4, P3, R6, L12."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import physics as ph
from ..functions import text as tx
from ..functions import vectors as vx
from ..functions.numeric import rnd
from ..operators import joins as jn
from ..operators import retrieval as rt
from ..operators import series as sr
from ..operators import sinks as sk
from ..operators import traffic as tf
from ..plans.broadcast import maybe_broadcast
from ..session import ensure_checkpoint_dir, materialize
from ..sources import tables as tb
from .core import register
from .joins_q import PROBE_SCALE
from .logs_q import fuel_log
from .metrics_q import CUM_CTES, cum_log
from .phys_q import _fs_sql, lead_log
from .sqlfrag import LEAD_CTES, LOG_CTES, fuel_sql, tag_sql


@register(
    "w13_relative_speed_from_gap", "W13",
    sql="""WITH RECURSIVE r AS (
             SELECT traj_id, seq, time, velocity_kmh AS v,
                    (lead(round((lat - 3.597e1) * 1000), 10) OVER w - lag(round((lat - 3.597e1) * 1000), 10) OVER w)
                    / (lead(time, 10) OVER w - lag(time, 10) OVER w) AS slope
             FROM raw_drive WINDOW w AS (PARTITION BY traj_id ORDER BY seq)),
           walk AS (SELECT traj_id, seq, time, v, CAST(NULL AS DOUBLE) AS rel FROM r WHERE seq = 0
             UNION ALL
             SELECT r.traj_id, r.seq, r.time, r.v,
                    CASE WHEN r.v + r.slope < 0 OR r.v + r.slope > 140 THEN NULL
                         WHEN (r.v + r.slope - walk.v - walk.rel) / (r.time - walk.time) / 3.6e0 NOT BETWEEN -2e1 AND 1e1 THEN NULL ELSE r.slope END
             FROM walk JOIN r ON r.traj_id = walk.traj_id AND r.seq = walk.seq + 1)
           SELECT traj_id, seq, round(rel, 6) AS relative_velocity FROM walk""",
    views=["raw_drive"],
    note="dormant in the source; the oracle goes row by row",
)
def w13(spark, d):
    x = tb.raw_drive(spark, d).withColumn("gap", F.round((F.col("lat") - 35.97) * 1000))
    y = sr.relative_speed_from_gap(x, ["traj_id"], "seq", "time", "velocity_kmh", "gap")
    return y.select("traj_id", "seq", rnd("relative_velocity", 6).alias("relative_velocity"))


@register(
    "w17_lane_change_events", "W17,A15",
    sql="""WITH x AS (SELECT run_id, id_num, step, headway, speed, leader_speed, accel,
                             lag(headway) OVER w AS ph, lag(accel) OVER w AS pa
                      FROM lead_log WHERE leader_speed IS NOT NULL WINDOW w AS (PARTITION BY run_id, id_num ORDER BY step)),
                f AS (SELECT *, CASE WHEN (leader_speed - speed > 0 AND (CASE WHEN speed > 0 THEN headway / speed ELSE 6e1 END) > 2e0)
                                       OR (leader_speed - speed < 0 AND (CASE WHEN leader_speed - speed < 0 THEN -headway / (leader_speed - speed) ELSE 6e1 END) > 4.5e0)
                                     THEN true ELSE false END AS safe, abs(accel - pa) > 9e-1 * 1e-1 AS jerk FROM x)
           SELECT run_id, CAST(count(CASE WHEN headway - ph <= -3.5e0 AND jerk AND safe THEN 1 END) AS BIGINT) AS n_cut_in,
                  CAST(count(CASE WHEN headway - ph >= 3.5e0 AND jerk AND safe THEN 1 END) AS BIGINT) AS n_cut_out
           FROM f GROUP BY run_id""",
    views=["veh_log"], ctes=LEAD_CTES,
)
def w17(spark, d):
    x = lead_log(spark, d).filter(F.col("leader_speed").isNotNull())
    f = sr.lane_change_flags(x, ["run_id", "id_num"], "step")
    return f.groupBy("run_id").agg(F.count_if(F.col("lane_change") == -1).cast("long").alias("n_cut_in"),
                                   F.count_if(F.col("lane_change") == 1).cast("long").alias("n_cut_out"))


@register(
    "d3_neighbor_segment_features", "D3,J1,J2",
    sql="""WITH prof AS (SELECT DISTINCT t FROM tse),
                first_prof AS (SELECT min(t) AS t0 FROM prof),
                probe AS (SELECT run_id, id_num, step, position, step * 3.5e-1 AS probe_t FROM veh_log),
                m AS (SELECT p.run_id, p.id_num, p.step, p.position, coalesce(a.t, f.t0) AS t
                      FROM probe p ASOF LEFT JOIN prof a ON p.probe_t >= a.t CROSS JOIN first_prof f),
                k AS (SELECT t, list(seg_start ORDER BY seg_idx) AS xs, list(avg_speed ORDER BY seg_idx) AS zs FROM tse GROUP BY t),
                j AS (SELECT m.*, xs, zs, len(list_filter(xs, lambda s: s <= m.position)) - 1 AS i, len(xs) AS n FROM m JOIN k ON k.t = m.t)
           SELECT run_id, id_num, step, CAST(i AS INT) AS seg_idx,
                  round(xs[i + 2] - position, 6) AS next_dist,
                  round(CASE WHEN len(list_slice(zs, greatest(i, 0) + 1, least(i + 3, n))) > 0 THEN round(list_reduce(list_prepend(0e0, list_slice(zs, greatest(i, 0) + 1, least(i + 3, n))), lambda u, w: u + w), 9) / len(list_slice(zs, greatest(i, 0) + 1, least(i + 3, n))) END, 6) AS down_mean,
                  round(CASE WHEN len(list_slice(zs, greatest(i - 3, 0) + 1, least(i, n))) > 0 THEN round(list_reduce(list_prepend(0e0, list_slice(zs, greatest(i - 3, 0) + 1, least(i, n))), lambda u, w: u + w), 9) / len(list_slice(zs, greatest(i - 3, 0) + 1, least(i, n))) END, 6) AS up_mean,
                  round(CASE WHEN len(list_slice(zs, greatest(i - 3, 0) + 1, least(i + 3, n))) > 0 THEN round(list_reduce(list_prepend(0e0, list_slice(zs, greatest(i - 3, 0) + 1, least(i + 3, n))), lambda u, w: u + w), 9) / len(list_slice(zs, greatest(i - 3, 0) + 1, least(i + 3, n))) END, 6) AS local_mean
           FROM j""",
    views=["veh_log", "tse"],
    note="k = 3 segments; slices as in the source (down [i, i+k), up [i-k, i), local [i-k, i+k))",
)
def d3(spark, d):
    v = tb.veh_log(spark, d, keep=False).select("run_id", "id_num", "step", "position", (F.col("step") * PROBE_SCALE).alias("probe_t"))
    m = jn.asof_join(v, tb.tse(spark, d).select("t").distinct(), [], "probe_t", "t", []).withColumnRenamed("t_match", "t")
    arr = tf.profile_arrays(tb.tse(spark, d), ["t"], "seg_start", "avg_speed")
    x = m.join(maybe_broadcast(arr, 10_000, 1024), "t")
    i = F.size(F.filter("xs", lambda s: s <= F.col("position"))) - 1
    n = F.size("xs")
    x = x.withColumn("i", i)

    def mean_slice(lo, hi):  # python slice [lo, hi) -> mean, NULL when empty
        sl = F.slice("zs", lo + 1, F.greatest(hi - lo, F.lit(0)))
        return F.when(F.size(sl) > 0, rnd(F.aggregate(sl, F.lit(0.0), lambda a, b: a + b), 9) / F.size(sl))

    k = 3
    ic = F.col("i")
    return x.select(
        "run_id", "id_num", "step", ic.cast("int").alias("seg_idx"),
        rnd(F.try_element_at("xs", ic + 2) - F.col("position"), 6).alias("next_dist"),
        rnd(mean_slice(F.greatest(ic, F.lit(0)), F.least(ic + k, n)), 6).alias("down_mean"),
        rnd(mean_slice(F.greatest(ic - k, F.lit(0)), F.least(ic, n)), 6).alias("up_mean"),
        rnd(mean_slice(F.greatest(ic - k, F.lit(0)), F.least(ic + k, n)), 6).alias("local_mean"))


def lookup_table(spark):
    """Controller table over ego 0..30 / leader 0..30 (step 0.5) x gap 0..100 (step 1),
    filled with the follower-stopper law (375,821 rows)."""
    ego = spark.range(0, 61).select(F.col("id").alias("ei"), (F.col("id") * 0.5).alias("ego_speed"))
    lead = spark.range(0, 61).select(F.col("id").alias("li"), (F.col("id") * 0.5).alias("leader_speed"))
    gap = spark.range(0, 101).select(F.col("id").alias("gi"), F.col("id").cast("double").alias("space_gap"))
    t = ego.crossJoin(lead).crossJoin(gap)
    return t.withColumn("accel", ph.follower_stopper_accel("ego_speed", "leader_speed", "space_gap"))


@register(
    "d14_lookup_table_controller", "D14,J10,F16",
    sql=f"""WITH c AS (SELECT run_id, floor(speed / 5e-1) AS ei, floor(leader_speed / 5e-1) AS li, floor(headway) AS gi FROM lead_log WHERE leader_speed IS NOT NULL),
                 k AS (SELECT run_id, ei * 5e-1 AS speed, li * 5e-1 AS leader_speed, gi * 1e0 AS headway FROM c
                       WHERE ei BETWEEN 0 AND 60 AND li BETWEEN 0 AND 60 AND gi BETWEEN 0 AND 100)
            SELECT run_id, count(*) AS n_in_grid, round(avg({_fs_sql()}), 6) AS mean_table_accel FROM k GROUP BY run_id""",
    views=["veh_log"], ctes=LEAD_CTES,
    note="grid lookup of logged (speed, leader speed, gap) cells",
)
def d14(spark, d):
    x = lead_log(spark, d).filter(F.col("leader_speed").isNotNull())
    x = x.select("run_id", F.floor(F.col("speed") / 0.5).alias("ei"), F.floor(F.col("leader_speed") / 0.5).alias("li"),
                 F.floor(F.col("headway")).alias("gi"))
    x = x.filter(F.col("ei").between(0, 60) & F.col("li").between(0, 60) & F.col("gi").between(0, 100))
    t = lookup_table(spark).select("ei", "li", "gi", "accel")
    j = x.join(t, ["ei", "li", "gi"], "inner")
    return j.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_in_grid"), rnd(F.avg("accel"), 6).alias("mean_table_accel"))


@register(
    "d15_fuel_surface_cells", "D15,F9",
    sql=f"""SELECT vi, ai, count(*) AS n_rows, round({fuel_sql('(vi * 1e-1)', '(-3e0 + ai * 5e-2)')}, 9) AS fuel_rate
            FROM (SELECT CAST(floor(speed / 1e-1) AS BIGINT) AS vi, CAST(floor((accel + 3) / 5e-2) AS BIGINT) AS ai FROM fuel_log)
            WHERE vi BETWEEN 0 AND 299 AND ai BETWEEN 0 AND 89 GROUP BY vi, ai""",
    views=["veh_log"], ctes=LOG_CTES,
    note="the plotted surface (speed 0..30 by 0.1, accel -3..1.5 by 0.05) evaluated at the cells the log visits",
)
def d15(spark, d):
    f = fuel_log(spark, d).select(F.floor(F.col("speed") / 0.1).alias("vi"), F.floor((F.col("accel") + 3) / 0.05).alias("ai"))
    f = f.filter(F.col("vi").between(0, 299) & F.col("ai").between(0, 89))
    c = f.groupBy("vi", "ai").agg(F.count(F.lit(1)).alias("n_rows"))
    return c.withColumn("fuel_rate", rnd(ph.fuel_rate(F.col("vi") * 0.1, -3.0 + F.col("ai") * 0.05, 0.0), 9))


@register(
    "d20_rollout_metric_readouts", "D20",
    sql="""WITH l AS (SELECT run_id, CASE WHEN id LIKE '%av%' THEN 'av' ELSE 'system' END AS grp, step, avg(speed) AS speed,
                             avg(avg_mpg) AS avg_mpg FROM cum GROUP BY 1, 2, 3),
                u AS (UNPIVOT l ON speed, avg_mpg INTO NAME metric VALUE value)
           SELECT run_id, grp, metric, round(arg_max(value, step), 6) AS last_value, round(min(value), 6) AS min_value,
                  round(max(value), 6) AS max_value, round(avg(value), 6) AS mean_value FROM u GROUP BY 1, 2, 3""",
    views=["veh_log"], ctes=CUM_CTES,
)
def d20(spark, d):
    c = cum_log(spark, d).withColumn("grp", F.when(F.col("id").contains("av"), "av").otherwise("system"))
    lg = c.groupBy("run_id", "grp", "step").agg(F.avg("speed").alias("speed"), F.avg("avg_mpg").alias("avg_mpg"))
    u = lg.unpivot(["run_id", "grp", "step"], ["speed", "avg_mpg"], "metric", "value")
    return u.groupBy("run_id", "grp", "metric").agg(
        rnd(F.max_by("value", "step"), 6).alias("last_value"), rnd(F.min("value"), 6).alias("min_value"),
        rnd(F.max("value"), 6).alias("max_value"), rnd(F.avg("value"), 6).alias("mean_value"))


@register(
    "d21_parameter_grid", "D21,J10",
    sql="""WITH b AS (SELECT DISTINCT p_brand FROM part), s AS (SELECT DISTINCT p_size FROM part)
           SELECT 'brand=' || b.p_brand || '_size=' || CAST(s.p_size AS VARCHAR) AS gs_str,
                  (SELECT count(*) FROM part p WHERE p.p_brand = b.p_brand AND p.p_size = s.p_size) AS n_parts
           FROM b CROSS JOIN s""",
    note="list-valued options from the part table (brands x sizes); label k=v_k=v",
)
def d21(spark, d):
    p = tb.table(spark, d, "part")
    brands = p.select("p_brand").distinct()
    sizes = p.select("p_size").distinct()
    grid = brands.crossJoin(sizes)  # the grid itself is the result
    cnt = p.groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n_parts"))
    g = grid.join(cnt, ["p_brand", "p_size"], "left")
    return g.select(F.concat_ws("_", F.concat(F.lit("brand="), F.col("p_brand")), F.concat(F.lit("size="), F.col("p_size").cast("string"))).alias("gs_str"),
                    F.coalesce(F.col("n_parts"), F.lit(0)).alias("n_parts"))


@register(
    "k4_json_records_sink", "K4",
    sql=f"""SELECT window_id, {tag_sql('response', 'reasoning')} AS reasoning FROM answer""",
    views=["answer"],
    note="records written as JSON lines and read back",
)
def k4(spark, d):
    a = tb.answer(spark, d).select("window_id", tx.extract_tag("response", "reasoning").alias("reasoning"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sinks/records-{uuid.uuid4().hex[:10]}"
    sk.write_json_records(a, path)
    return spark.read.schema(a.schema).json(path)


@register(
    "p3_vehicle_filter_projection", "P3,P2",
    sql="SELECT step, speed, position AS pos FROM veh_log WHERE id_num = 8",
    views=["veh_log"],
)
def p3(spark, d):
    v = tb.veh_log(spark, d, keep=False).filter(F.col("id_num") == 8).select("step", "speed", "position")
    return v.withColumnsRenamed({"position": "pos"})


@register(
    "r6_logic_scenario_score", "R6",
    sql="""WITH j AS (SELECT window_id, TRY_CAST(regexp_extract(judge_response, '<coherence_score>(.*?)</coherence_score>', 1) AS INT) AS sc
                      FROM judge),
                e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, lead(CAST(embedding AS DOUBLE[])) OVER (ORDER BY vec_id) AS nv,
                             lag(CAST(embedding AS DOUBLE[])) OVER (ORDER BY vec_id) AS pv FROM embeddings)
           SELECT vec_id, round(logic, 6) AS logic_score FROM (
             SELECT vec_id, (CASE WHEN nv IS NULL THEN NULL ELSE list_cosine_similarity(v, nv) END
                             + CASE WHEN pv IS NULL THEN NULL ELSE list_cosine_similarity(v, pv) END) / 2 AS logic FROM e)""",
    note="logic score = mean of the two similarities (observation: next item, deduction: previous item)",
)
def r6(spark, d):
    from ..plans.ordering import dense_position

    e = tb.table(spark, d, "embeddings").select("vec_id", vx.as_double("embedding").alias("v"))
    # neighbours by an equi-join on the dense position (no global single-task window)
    e = dense_position(e.withColumn("_all", F.lit(0)), ["_all"], ["vec_id"],
                       bucket=F.floor(F.col("vec_id") / 100000).cast("long"), name="pos").drop("_all")
    nxt = e.select((F.col("pos") - 1).alias("pos"), F.col("v").alias("nv"))
    prv = e.select((F.col("pos") + 1).alias("pos"), F.col("v").alias("pv"))
    e = e.join(nxt, "pos", "left").join(prv, "pos", "left")
    logic = (vx.cosine("v", "nv") + vx.cosine("v", "pv")) / 2
    return e.select("vec_id", rnd(F.when(F.col("nv").isNotNull() & F.col("pv").isNotNull(), logic), 6).alias("logic_score"))


# 410-point grid; every point meets the whole grid (the survey's full kernel)
D7_CTES = """k AS (SELECT t, list(seg_start ORDER BY seg_idx) AS xs, list(avg_speed ORDER BY seg_idx) AS zs FROM tse GROUP BY t),
  g AS (SELECT t, CAST(i AS INT) AS grid_idx, -2e4 + i * 1e2 AS x, xs, zs, len(list_filter(xs, lambda v: v <= -2e4 + i * 1e2)) AS kk, len(xs) AS n
        FROM k, unnest(range(0, 410)) AS u(i)),
  r AS (SELECT t, grid_idx, x, CASE WHEN x <= xs[1] THEN zs[1] WHEN x >= xs[n] THEN zs[n]
                                     ELSE zs[kk] + (zs[kk + 1] - zs[kk]) * (x - xs[kk]) / (xs[kk + 1] - xs[kk]) END AS resampled FROM g),
  sm AS (SELECT a.t, a.grid_idx, any_value(a.x) AS x, any_value(a.resampled) AS resampled,
                sum(exp(-((b.x - a.x) * (b.x - a.x)) / 1.25e5) * b.resampled) / sum(exp(-((b.x - a.x) * (b.x - a.x)) / 1.25e5)) AS smoothed
         FROM r a JOIN r b ON a.t = b.t GROUP BY a.t, a.grid_idx)"""


@register(
    "d7_gaussian_profile", "D7",
    sql=f"WITH {D7_CTES} SELECT t, grid_idx, round(resampled, 9) AS resampled, round(smoothed, 9) AS smoothed FROM sm",
    views=["tse"],
    note="410-point resample and normalised Gaussian kernel per profile",
)
def d7(spark, d):
    arr = tf.profile_arrays(tb.tse(spark, d), ["t"], "seg_start", "avg_speed")
    return tf.gaussian_profile(arr, ["t"]).select(
        "t", F.col("grid_idx").cast("int").alias("grid_idx"), rnd("resampled", 9).alias("resampled"), rnd("smoothed", 9).alias("smoothed"))


def _profiles(spark, d):
    """Profiles with the positions of their standing and moving bottlenecks. At the fixture's
    30 profiles of 8 segments no flag of one segment repeats five times, so every second
    bottleneck of a profile counts as standing here: both branches of D8 occur."""
    prof = tb.tse(spark, d)
    flags = tf.bottleneck_flags(prof, ["t"], "seg_idx", "avg_speed").filter("bottleneck")
    at = lambda even: F.array_sort(F.collect_list(F.when((F.col("seg_idx") % 2 == 0) == even, F.col("seg_start"))))
    bn = flags.groupBy("t").agg(at(True).alias("stand"), at(False).alias("move"))
    return tf.profile_arrays(prof, ["t"], "seg_start", "avg_speed").join(bn, "t", "left")


# the recursion of the survey, point by point from the road's end
D8_CTES = D7_CTES + """,
  fl AS (SELECT t, seg_idx, seg_start, coalesce(lead(avg_speed) OVER w <= 6e1 AND lead(avg_speed) OVER w - avg_speed > 4e0, false) AS raw,
                row_number() OVER w AS rn, lead(seg_idx) OVER w IS NULL AS is_last FROM tse WINDOW w AS (PARTITION BY t ORDER BY seg_idx)),
  bo AS (SELECT t, seg_idx, seg_start FROM (SELECT *, raw AND NOT coalesce(lag(raw) OVER (PARTITION BY t ORDER BY seg_idx), false) AND rn > 1 AND NOT is_last AS b FROM fl) WHERE b),
  bn AS (SELECT t, min(seg_start) AS loc, true AS standing FROM bo WHERE seg_idx % 2 = 0 GROUP BY t
         UNION ALL SELECT t, seg_start, false FROM bo WHERE seg_idx % 2 = 1),
  par AS (SELECT bn.t, loc, standing,
                 CASE WHEN standing THEN 1.2e0 * min(CASE WHEN x < loc AND smoothed < 2.7e1 THEN smoothed END)
                      ELSE max(CASE WHEN x = trunc(loc / 1e2) * 1e2 THEN smoothed END) END AS v,
                 CASE WHEN standing THEN sum(CASE WHEN x < loc AND smoothed < 2.7e1 THEN
                      1e2 / ((2e0 + 1.24e0 * smoothed) / sqrt(1 - pow(smoothed / 3.5e1, 4)) + 4e0) END) / 4.8e-2 ELSE 0e0 END AS buf
          FROM bn JOIN sm ON sm.t = bn.t GROUP BY bn.t, loc, standing),
  pb AS (SELECT *, (v * v - 7.29e2) / (2 * -1e-1) AS brake FROM par WHERE v IS NOT NULL),
  pc AS (SELECT t, loc, standing, v,
                CASE WHEN loc - buf - brake > 0 THEN loc - buf - brake ELSE 0e0 END AS beg,
                CASE WHEN loc - buf - brake > 0 THEN loc - buf WHEN standing AND loc > brake THEN brake ELSE loc END AS fin,
                CASE WHEN loc - buf - brake > 0 OR (standing AND loc > brake) OR loc = 0 THEN -1e-1 ELSE (v * v - 7.29e2) / (2 * loc) END AS dec FROM pb),
  walk AS (SELECT pc.t, loc, standing, v, beg, fin, dec, 409 AS i, smoothed AS s FROM pc JOIN sm ON sm.t = pc.t AND sm.grid_idx = 409
           UNION ALL
           SELECT w.t, w.loc, w.standing, w.v, w.beg, w.fin, w.dec, w.i - 1,
                  CASE WHEN m.x >= w.beg AND m.x <= w.fin THEN least(m.smoothed, sqrt(w.s * w.s - 2e2 * w.dec))
                       WHEN w.standing AND m.x > w.fin AND m.x <= w.loc THEN least(m.smoothed, w.v) ELSE m.smoothed END
           FROM walk w JOIN sm m ON m.t = w.t AND m.grid_idx = w.i - 1),
  fixed AS (SELECT t, 409 AS i, smoothed AS s FROM sm WHERE grid_idx = 409
            UNION ALL SELECT f.t, f.i - 1, least(m.smoothed, sqrt(f.s * f.s + 2e1)) FROM fixed f JOIN sm m ON m.t = f.t AND m.grid_idx = f.i - 1),
  lim AS (SELECT t, i, min(s) AS s FROM walk GROUP BY t, i),
  tgt AS (SELECT sm.t, sm.grid_idx, sm.x, smoothed AS raw, greatest(least(smoothed, coalesce(lim.s, smoothed)), smoothed * (1 - 2e-1)) AS target,
                 fixed.s AS fixed_decel FROM sm LEFT JOIN lim ON lim.t = sm.t AND lim.i = sm.grid_idx JOIN fixed ON fixed.t = sm.t AND fixed.i = sm.grid_idx)"""


@register(
    "d8_d9_speed_limit_profiles", "D8,D9",
    sql=f"""WITH RECURSIVE {D8_CTES},
            bl AS (SELECT t, coalesce(min(CASE WHEN raw < 2.5e1 THEN x END), 1e0) AS bn_loc FROM tgt GROUP BY t)
            SELECT tgt.t, grid_idx, round(raw, 6) AS raw, round(target, 6) AS target_speed, raw - target > 1e-9 AS max_headway,
                   round(fixed_decel, 6) AS fixed_decel, bn_loc AS fixed_bn_loc,
                   round(CASE WHEN x <= 0 OR x >= 1.5e4 THEN 3.3e1 WHEN x <= bn_loc THEN 3.3e1 - 8e0 * x / bn_loc
                              ELSE 2.5e1 + 8e0 * (x - bn_loc) / (1.5e4 - bn_loc) END, 6) AS fixed_start_speed
            FROM tgt JOIN bl ON bl.t = tgt.t""",
    views=["tse"],
    note="every second bottleneck is taken as standing (see _profiles); the flag tolerates 1e-9 of rounding between engines",
)
def d8(spark, d):
    out = tf.speed_limit_profiles(_profiles(spark, d), ["t"])
    return out.select("t", F.col("grid_idx").cast("int").alias("grid_idx"), rnd("raw", 6).alias("raw"), rnd("target_speed", 6).alias("target_speed"),
                      (F.col("raw") - F.col("target_speed") > 1e-9).alias("max_headway"), rnd("fixed_decel", 6).alias("fixed_decel"), "fixed_bn_loc",
                      rnd(tf.fixed_start_speed(F.col("x"), F.col("fixed_bn_loc")), 6).alias("fixed_start_speed"))


@register(
    "d10_target_by_position", "D10,D7,D8,J1,J12",
    sql=f"""WITH RECURSIVE {D8_CTES},
            prof AS (SELECT DISTINCT t FROM tse),
            probe AS (SELECT run_id, id_num, step, position, step * 3.5e-1 AS probe_t, position + 7.56e2 AS q FROM veh_log),
            m AS (SELECT p.*, coalesce(a.t, (SELECT min(t) FROM prof)) AS t FROM probe p ASOF LEFT JOIN prof a ON p.probe_t >= a.t),
            i AS (SELECT *, least(greatest(floor((q + 2e4) / 1e2), 0), 408) AS lo, least(greatest(floor((q + 2e4) / 1e2), 0), 409) AS at FROM m)
            SELECT run_id, id_num, step, round(a.target + (b.target - a.target) * (q - a.x) / (b.x - a.x), 6) AS target_speed,
                   f.raw - f.target > 1e-9 AS max_headway
            FROM i JOIN tgt a ON a.t = i.t AND a.grid_idx = i.lo JOIN tgt b ON b.t = i.t AND b.grid_idx = i.lo + 1
            JOIN tgt f ON f.t = i.t AND f.grid_idx = i.at""",
    views=["veh_log", "tse"],
    note="as-of profile; target moved back 180 s x 4.2 m/s: linear at the position, the flag from the point before",
)
def d10(spark, d):
    v = tb.veh_log(spark, d, keep=False).select("run_id", "id_num", "step", "position", (F.col("step") * PROBE_SCALE).alias("probe_t"))
    m = jn.asof_join(v, tb.tse(spark, d).select("t").distinct(), [], "probe_t", "t", []).withColumnRenamed("t_match", "t")
    g = materialize(tf.speed_limit_profiles(_profiles(spark, d), ["t"]).select(
        "t", "grid_idx", "x", F.col("target_speed").alias("smoothed"), (F.col("raw") - F.col("target_speed") > 1e-9).alias("max_headway")))
    x = tf.flag_at_position(tf.target_at_position(m, "position", g, ["t"]), "position", g, "max_headway", ["t"])
    return x.select("run_id", "id_num", "step", rnd("target_speed", 6).alias("target_speed"), "max_headway")
