"""Aggregation, top-k, set-operation and predicate queries (A*, T*, U*, P*, S4)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import physics as ph
from ..functions.numeric import rnd
from ..operators import emissions as em
from ..operators import metrics as mt
from ..operators import series as sr
from ..plans.broadcast import maybe_broadcast
from ..session import materialize
from ..sources import tables as tb
from .core import register
from .logs_q import fuel_log
from .sqlfrag import LOG_CTES

# enriched log (W9 columns) in SQL
CUM_CTE = (
    "cum",
    """SELECT *, te / 3600e0 * 1e-1 AS total_gallons, dist / 1609.34e0 AS total_miles,
              (dist / 1609.34e0) / (te / 3600e0 * 1e-1 + 1e-6) AS avg_mpg
       FROM (SELECT *, sum(fuel) OVER (PARTITION BY run_id, id_num ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS te,
                    position - first_value(position) OVER (PARTITION BY run_id, id_num ORDER BY step) AS dist
             FROM fuel_log)""",
)
CUM_CTES = LOG_CTES + [CUM_CTE]


def cum_log(spark, d):
    return materialize(em.cumulative_fuel(fuel_log(spark, d)))


@register(
    "a1_trajectory_summary", "A1",
    sql="""SELECT traj_id, round(max(CASE WHEN seq = 1 THEN seq * 1e-1 END) - max(CASE WHEN seq = 0 THEN seq * 1e-1 END), 3) AS timestep,
                  round(max(seq * 1e-1) - min(seq * 1e-1), 3) AS duration, count(*) AS size
           FROM drive_user GROUP BY traj_id""",
    views=["drive_user"],
)
def a1(spark, d):
    x = tb.drive_user(spark, d).withColumn("time", F.col("seq") * 0.1)
    return mt.trajectory_summary(x, ["traj_id"], "seq", "time")


@register(
    "a3_mean_vehicle_mpg_eps", "A3",
    sql="""SELECT run_id, round(avg(mpg), 6) AS mean_mpg FROM (
             SELECT run_id, id, (sum(speed) / 1609.34e0) / (sum(fuel) / 3600e0 + 1e-6) AS mpg
             FROM fuel_log GROUP BY run_id, id) WHERE id NOT LIKE '%trajectory%' GROUP BY run_id""",
    views=["veh_log"], ctes=LOG_CTES,
)
def a3(spark, d):
    return mt.mean_vehicle_mpg_eps(fuel_log(spark, d), ["run_id"])


@register(
    "a4_a5_system_totals", "A4,A5,P5",
    sql="""WITH c AS (SELECT * FROM cum WHERE position >= 0 AND position <= 14000),
                v AS (SELECT run_id, id, max(total_gallons) - min(total_gallons) AS g, max(total_miles) - min(total_miles) AS m,
                             count(*) * 1e-1 AS s FROM c GROUP BY run_id, id),
                t AS (SELECT run_id, sum(g) AS tg, sum(m) AS tm, sum(s) AS ts,
                             sum(CASE WHEN id LIKE '%av%' THEN g END) AS ag, sum(CASE WHEN id LIKE '%av%' THEN m END) AS am,
                             sum(CASE WHEN id LIKE '%av%' THEN s END) AS a_s FROM v GROUP BY run_id),
                sd AS (SELECT run_id, stddev_samp(speed) AS speed_std, stddev_samp(CASE WHEN id LIKE '%av%' THEN speed END) AS av_speed_std
                       FROM c GROUP BY run_id)
           SELECT t.run_id, round(tm / tg, 6) AS system_mpg, round(tg, 9) AS total_gallons, round(tm, 9) AS total_miles,
                  round(tm / ts * 3600, 6) AS system_speed, round(speed_std, 6) AS speed_std,
                  round(am / ag, 6) AS av_mpg, round(am / a_s * 3600, 6) AS av_speed, round(av_speed_std, 6) AS av_speed_std
           FROM t JOIN sd ON t.run_id = sd.run_id""",
    views=["veh_log"], ctes=CUM_CTES,
)
def a4(spark, d):
    c = cum_log(spark, d).filter(F.col("position").between(0, 14000))
    return mt.system_totals(c, ["run_id"])


LINES = (0.0, 100.0, 200.0, 300.0, 400.0)


@register(
    "a6_throughput_total", "A6,J6",
    sql="""WITH lines(line) AS (VALUES (0e0), (1e2), (2e2), (3e2), (4e2)),
                per_id AS (SELECT run_id, line, id_num,
                                  min(CASE WHEN position > line THEN t END) AS first_after,
                                  max(CASE WHEN position < line THEN t END) AS last_before
                           FROM veh_log CROSS JOIN lines GROUP BY run_id, line, id_num)
           SELECT run_id, line, count(*) AS n_crossing,
                  round(CASE WHEN max(last_before) - min(first_after) <> 0
                             THEN count(*) / (max(last_before) - min(first_after)) * 3600 END, 6) AS throughput
           FROM per_id WHERE first_after IS NOT NULL AND last_before IS NOT NULL GROUP BY run_id, line""",
    views=["veh_log"],
    note="lines scaled to the fixture route (0..400 m)",
)
def a6(spark, d):
    return mt.throughput_total(tb.veh_log(spark, d), ["run_id"], "id_num", "position", "t", LINES)


@register(
    "a7_throughput_series", "A7",
    sql="""WITH lines(line) AS (VALUES (0e0), (1e2), (2e2), (3e2), (4e2)),
                ends AS (SELECT run_id, CAST(floor(max(t) / 1e0) AS BIGINT) AS t_end FROM veh_log GROUP BY run_id),
                grid AS (SELECT run_id, line, CAST(m AS DOUBLE) AS t_mid FROM ends CROSS JOIN lines,
                         unnest(generate_series(0, t_end - 1)) AS g(m)),
                per_id AS (SELECT run_id, line, id_num, min(CASE WHEN position > line THEN t END) AS first_after,
                                  max(CASE WHEN position < line THEN t END) AS last_before
                           FROM veh_log CROSS JOIN lines GROUP BY run_id, line, id_num),
                win AS (SELECT g.run_id, g.line, g.t_mid, v.id_num
                        FROM grid g JOIN veh_log v ON v.run_id = g.run_id AND v.t BETWEEN g.t_mid - 3e0 AND g.t_mid + 3e0
                        GROUP BY g.run_id, g.line, g.t_mid, v.id_num
                        HAVING min(v.position) < g.line AND max(v.position) > g.line),
                agg AS (SELECT w.run_id, w.line, w.t_mid, count(*) AS n, max(p.last_before) - min(p.first_after) AS span
                        FROM win w JOIN per_id p ON p.run_id = w.run_id AND p.line = w.line AND p.id_num = w.id_num
                        GROUP BY w.run_id, w.line, w.t_mid)
           SELECT g.run_id, g.line, g.t_mid, coalesce(a.n, 0) AS n_crossing,
                  round(CASE WHEN a.n IS NULL THEN 0e0 WHEN a.span <> 0 THEN a.n / a.span * 3600 END, 6) AS throughput
           FROM grid g LEFT JOIN agg a ON a.run_id = g.run_id AND a.line = g.line AND a.t_mid = g.t_mid""",
    views=["veh_log"],
    note="lines 0..400 m, one point per 1 s, +/-3 s window (fixture scale of 60 s / 180 s)",
)
def a7(spark, d):
    return mt.throughput_series(tb.veh_log(spark, d), ["run_id"], "id_num", "position", "t", LINES,
                                period=1.0, half_width=3.0)


@register(
    "a9_mpg_by_leader_speed_bucket", "A9",
    sql="""WITH lead_b AS (SELECT run_id, step, CAST(ceil(speed / 1e1) AS INT) * 10 AS bucket_max
                           FROM fuel_log WHERE list_contains(string_split(id, '_'), 'leader') AND speed > 0 AND speed <= 40),
                cnt AS (SELECT run_id, bucket_max, count(*) AS n_steps FROM lead_b GROUP BY 1, 2),
                veh AS (SELECT f.run_id, b.bucket_max, f.id, (sum(f.speed) / 1609.34e0) / (sum(f.fuel) / 3600e0 + 1e-6) AS mpg
                        FROM fuel_log f JOIN lead_b b ON b.run_id = f.run_id AND b.step = f.step
                        WHERE list_contains(string_split(f.id, '_'), 'av') OR list_contains(string_split(f.id, '_'), 'human') GROUP BY 1, 2, 3)
           SELECT c.run_id, c.bucket_max, c.n_steps,
                  round(CASE WHEN c.n_steps > 10 THEN (SELECT avg(mpg) FROM veh v WHERE v.run_id = c.run_id AND v.bucket_max = c.bucket_max)
                        ELSE 0e0 END, 6) AS mean_mpg
           FROM cnt c""",
    views=["veh_log"], ctes=LOG_CTES,
    note="bucket kept when it has more than 10 leader steps (fixture scale of 1000)",
)
def a9(spark, d):
    return mt.mpg_by_leader_bucket(fuel_log(spark, d), ["run_id"], min_steps=10)


@register(
    "a10_trajectory_ranges", "A10,P4",
    sql="""WITH x AS (SELECT *, list_contains(string_split(id, '_'), 'leader') AS is_leader,
                             list_contains(string_split(id, '_'), 'av') AS is_av,
                             list_contains(string_split(id, '_'), 'human') AS is_human,
                             l.leader_position - c.position - 5e0 AS headway
                      FROM cum c LEFT JOIN (SELECT run_id AS lr, step AS ls, id_num AS ln, position AS leader_position FROM cum) l
                        ON l.lr = c.run_id AND l.ls = c.step AND l.ln = c.id_num - 1),
                last_mpg AS (SELECT run_id, id, arg_max(avg_mpg, step) AS final_mpg, bool_or(is_av) AS is_av, bool_or(is_human) AS is_human
                             FROM x GROUP BY run_id, id)
           SELECT x.run_id,
                  round(arg_max(CASE WHEN is_leader THEN dist END, CASE WHEN is_leader THEN step END), 6) AS traj_length,
                  round(max(CASE WHEN is_leader THEN t END), 6) AS traj_duration,
                  min(CASE WHEN is_leader THEN speed END) AS leader_speed_min, max(CASE WHEN is_leader THEN speed END) AS leader_speed_max,
                  round(min(CASE WHEN is_av THEN headway END), 6) AS av_headway_min, round(max(CASE WHEN is_av THEN headway END), 6) AS av_headway_max,
                  round(min(CASE WHEN is_av THEN accel END), 6) AS av_accel_min, round(max(CASE WHEN is_av THEN accel END), 6) AS av_accel_max,
                  round(any_value(m.mpg_avs), 6) AS mpg_avs, round(any_value(m.mpg_humans), 6) AS mpg_humans,
                  round(any_value(m.mpg_all), 6) AS mpg_avs_humans
           FROM x JOIN (SELECT run_id, avg(CASE WHEN is_av THEN final_mpg END) AS mpg_avs, avg(CASE WHEN is_human THEN final_mpg END) AS mpg_humans,
                               avg(CASE WHEN is_av OR is_human THEN final_mpg END) AS mpg_all FROM last_mpg GROUP BY run_id) m
             ON m.run_id = x.run_id
           GROUP BY x.run_id""",
    views=["veh_log"], ctes=CUM_CTES,
)
def a10(spark, d):
    c = cum_log(spark, d)
    c = em.attach_leader(em.platoon_leader(c), cols=("position",))
    c = c.withColumn("headway", ph.headway("leader_position", "position"))
    return mt.trajectory_ranges(c, ["run_id"])


@register(
    "a11_w21_platoon_mpg", "A11,W20,W21",
    sql="""WITH last AS (SELECT run_id, id_num, id, arg_max(total_miles, step) AS miles, arg_max(total_gallons, step) AS gallons
                         FROM cum GROUP BY run_id, id_num, id),
                avs AS (SELECT run_id, id_num FROM last WHERE id LIKE '%av%'),
                local AS (SELECT l.* FROM last l WHERE id LIKE '%av%' OR id LIKE '%sensor%'
                          OR EXISTS (SELECT 1 FROM last a WHERE a.run_id = l.run_id AND (a.id LIKE '%av%' OR a.id LIKE '%sensor%') AND a.id_num = l.id_num + 1)),
                p AS (SELECT l.run_id, 1 + (SELECT count(*) FROM avs a WHERE a.run_id = l.run_id AND a.id_num <= l.id_num) AS platoon_id,
                             sum(miles) AS miles, sum(gallons) AS gallons
                      FROM local l WHERE l.id_num < 100 GROUP BY 1, 2),
                m AS (SELECT run_id, platoon_id, miles / gallons AS mpg FROM p)
           SELECT run_id, CAST(platoon_id AS BIGINT) AS platoon_id, round(mpg, 6) AS mpg,
                  round(100 * (1 - (lag(mpg) OVER (PARTITION BY run_id ORDER BY platoon_id) / mpg)), 6) AS improvement_rel,
                  round(100 * (1 - (first_value(mpg) OVER (PARTITION BY run_id ORDER BY platoon_id) / mpg)), 6) AS improvement_abs
           FROM m""",
    views=["veh_log"], ctes=CUM_CTES,
)
def a11(spark, d):
    return mt.platoon_mpg(cum_log(spark, d), ["run_id"])


@register(
    "a13_system_step_state", "A13",
    sql="""SELECT run_id, step, round(sum(total_miles) / sum(total_gallons), 6) AS system_mpg, round(avg(speed), 6) AS mean_speed
           FROM cum GROUP BY run_id, step""",
    views=["veh_log"], ctes=CUM_CTES,
)
def a13(spark, d):
    c = cum_log(spark, d)
    return c.groupBy("run_id", "step").agg(
        rnd(F.try_divide(F.sum("total_miles"), F.sum("total_gallons")), 6).alias("system_mpg"),
        rnd(F.avg("speed"), 6).alias("mean_speed"),
    )


@register(
    "a14_metric_summary_pop", "A14,G4",
    sql="""SELECT cp_path, round(avg(system_mpg), 6) AS system_mpg_mean, round(stddev_pop(system_mpg), 6) AS system_mpg_std,
                  min(system_mpg) AS system_mpg_min, max(system_mpg) AS system_mpg_max,
                  round(avg(headway_max), 6) AS headway_max_mean, round(stddev_pop(headway_max), 6) AS headway_max_std,
                  min(headway_max) AS headway_max_min, max(headway_max) AS headway_max_max
           FROM policy_run GROUP BY cp_path""",
    views=["policy_run"],
)
def a14(spark, d):
    return mt.stat_summary(tb.policy_run(spark, d), ["cp_path"], ["system_mpg", "headway_max"], std="pop")


@register(
    "a16_t2_policy_selection", "A16,T2",
    sql="""WITH m AS (SELECT cp_path, avg(headway_max) AS hm, avg(headway_min) AS hn, avg(crash) AS c, avg(system_mpg) AS s
                      FROM policy_run GROUP BY cp_path),
                good AS (SELECT cp_path FROM m WHERE hm < 5.4e4 AND hn > 2.5e1 AND c < 3.5e-1 ORDER BY s DESC, cp_path LIMIT 3)
           SELECT cp_path, round(avg(system_mpg), 6) AS system_mpg_mean, round(coalesce(stddev_samp(system_mpg), 0), 6) AS system_mpg_std,
                  min(system_mpg) AS system_mpg_min, max(system_mpg) AS system_mpg_max, count(*) AS n_runs
           FROM policy_run WHERE cp_path IN (SELECT cp_path FROM good) GROUP BY cp_path""",
    views=["policy_run"],
    note="thresholds scaled to the fixture: mean headway max < 54000, min > 25, crash mean < 0.35; top 3",
)
def a16(spark, d):
    return mt.select_policies(tb.policy_run(spark, d), max_headway=5.4e4, min_headway=25.0, max_crash=0.35, n=3)


@register(
    "a21_distinct_vehicles_keys", "A21",
    sql="""SELECT run_id, count(DISTINCT id) AS n_vehicles, count(DISTINCT split_part(id, '_', 2)) AS n_controllers
           FROM veh_log GROUP BY run_id""",
    views=["veh_log"],
)
def a21(spark, d):
    v = tb.veh_log(spark, d)
    return v.groupBy("run_id").agg(
        F.countDistinct("id").alias("n_vehicles"),
        F.countDistinct(F.split("id", "_").getItem(1)).alias("n_controllers"),
    )


@register(
    "a23_system_mpg_two_ways", "A23",
    sql="""SELECT run_id, round(avg(avg_mpg), 6) AS mean_of_mpg, round(sum(total_miles) / sum(total_gallons), 6) AS ratio_of_totals
           FROM cum GROUP BY run_id""",
    views=["veh_log"], ctes=CUM_CTES,
)
def a23(spark, d):
    c = cum_log(spark, d)
    return c.groupBy("run_id").agg(
        rnd(F.avg("avg_mpg"), 6).alias("mean_of_mpg"),
        rnd(F.try_divide(F.sum("total_miles"), F.sum("total_gallons")), 6).alias("ratio_of_totals"),
    )


@register(
    "a24_chunk_speed_class", "A24",
    sql="""WITH v AS (SELECT run_id, id, (sum(speed) / 1609.34e0) / (sum(fuel) / 3600e0 + 1e-6) AS mpg FROM fuel_log GROUP BY 1, 2),
                cls AS (SELECT run_id, CASE WHEN avg(speed) > 18 THEN 'high' ELSE 'low' END AS speed_class
                        FROM fuel_log WHERE id LIKE '%trajectory%' GROUP BY run_id)
           SELECT speed_class, round(avg(mpg), 6) AS mean_mpg, count(*) AS n_vehicles
           FROM v JOIN cls ON cls.run_id = v.run_id WHERE v.id NOT LIKE '%trajectory%' GROUP BY speed_class""",
    views=["veh_log"], ctes=LOG_CTES,
)
def a24(spark, d):
    return mt.chunk_speed_class(fuel_log(spark, d), "run_id", threshold=18.0)


@register(
    "t4_latest_checkpoint", "T4",
    sql="""SELECT p_brand AS experiment, arg_max(p_brand || '/checkpoints/' || CAST(p_size AS VARCHAR), p_size) AS latest_path,
                  max(p_size) AS latest_n FROM part GROUP BY p_brand""",
)
def t4(spark, d):
    p = tb.table(spark, d, "part").select(F.col("p_brand").alias("experiment"), F.col("p_size").cast("string").alias("n_text"))
    p = p.withColumn("path", F.concat(F.col("experiment"), F.lit("/checkpoints/"), F.col("n_text")))
    return mt.latest_checkpoint(p, "experiment", "path", "n_text")


@register(
    "t5_head_tail_preview", "T5",
    sql="""SELECT traj_id, seq, speed FROM (
             SELECT traj_id, seq, speed, row_number() OVER (PARTITION BY traj_id ORDER BY seq) AS a,
                    row_number() OVER (PARTITION BY traj_id ORDER BY seq DESC) AS b FROM drive_user)
           WHERE a <= 5 OR b <= 5""",
    views=["drive_user"],
)
def t5(spark, d):
    return mt.head_tail(tb.drive_user(spark, d), ["traj_id"], "seq", 10).select("traj_id", "seq", "speed")


@register(
    "t7_leaderboard_sorted", "T7,K2",
    sql=f"""SELECT run_id, system_mpg, CAST(rank() OVER (ORDER BY system_mpg DESC NULLS LAST, run_id) AS BIGINT) AS place
            FROM (SELECT run_id, round(CASE WHEN sum(fuel) / 3600e0 * 1e-1 > 0 THEN (sum(speed) / 1609.34e0 * 1e-1) / (sum(fuel) / 3600e0 * 1e-1) END, 6) AS system_mpg
                  FROM fuel_log GROUP BY run_id)""",
    views=["veh_log"], ctes=LOG_CTES,
)
def t7(spark, d):
    m = mt.mpg_metrics(fuel_log(spark, d), ["run_id"]).select("run_id", "system_mpg")
    # places over all runs without a single-task global window: bucketed dense position
    # on (-mpg, run_id); NULL mpg sorts last (run_id breaks ties, so rank = row number)
    from ..plans.ordering import dense_position

    key = F.coalesce(-F.col("system_mpg"), F.lit(float("inf")))
    m = m.withColumn("_one", F.lit(0)).withColumn("_k", key)
    bucket = F.when(F.col("system_mpg").isNull(), F.lit(1 << 62)).otherwise(F.floor(-F.col("system_mpg") / 10.0))
    m = dense_position(m, ["_one"], ["_k", "run_id"], bucket=bucket.cast("long"), name="_p")
    return m.select("run_id", "system_mpg", (F.col("_p") + 1).alias("place")).orderBy("place")


@register(
    "t8_limit_timestep_rows", "T8,S5,P1",
    sql="""SELECT step, speed, position FROM veh_log WHERE run_id = 0 AND id_num = 1 ORDER BY step LIMIT 25""",
    views=["veh_log"],
    note="get_timestep_data(limit) of one vehicle: the limit is the operator",
)
def t8(spark, d):
    v = tb.veh_log(spark, d, keep=False).filter((F.col("run_id") == 0) & (F.col("id_num") == 1))
    return v.select("step", "speed", "position").orderBy("step").limit(25)


@register(
    "u1_union_sources", "U1",
    sql="""SELECT 'user' AS source, CAST(traj_id AS VARCHAR) AS traj_id, count(*) AS n_rows, round(avg(speed), 6) AS mean_speed,
                  CAST(NULL AS DOUBLE) AS mean_velocity_kmh FROM drive_user GROUP BY traj_id
           UNION ALL
           SELECT 'type', traj_id, count(*), NULL, round(avg(velocity_kmh), 6) FROM drive_type GROUP BY traj_id""",
    views=["drive_user", "drive_type"],
)
def u1(spark, d):
    a = tb.drive_user(spark, d).withColumn("source", F.lit("user")).withColumn("traj_id", F.col("traj_id").cast("string"))
    b = tb.drive_type(spark, d).withColumn("source", F.lit("type"))
    u = a.select("source", "traj_id", "seq", "speed").unionByName(b.select("source", "traj_id", "seq", "velocity_kmh"),
                                                                  allowMissingColumns=True)
    return u.groupBy("source", "traj_id").agg(
        F.count(F.lit(1)).alias("n_rows"), rnd(F.avg("speed"), 6).alias("mean_speed"),
        rnd(F.avg("velocity_kmh"), 6).alias("mean_velocity_kmh"),
    )


@register(
    "u2_intersect_ids", "U2",
    sql="""SELECT run_id, id_num FROM veh_log WHERE position < 1e2 INTERSECT SELECT run_id, id_num FROM veh_log WHERE position > 1e2""",
    views=["veh_log"],
)
def u2(spark, d):
    v = tb.veh_log(spark, d)
    return v.filter("position < 100").select("run_id", "id_num").intersect(v.filter("position > 100").select("run_id", "id_num"))


@register(
    "u4_except_removed_documents", "U4,R4",
    sql="""SELECT doc_id, source FROM documents EXCEPT ALL
           SELECT d.doc_id, d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1""",
)
def u4(spark, d):
    docs = tb.table(spark, d, "documents").select("doc_id", "source")
    bad = tb.table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    return docs.exceptAll(docs.join(bad, on="doc_id", how="left_semi"))


@register(
    "p4_kind_predicates", "P4",
    sql="""SELECT run_id, count(CASE WHEN id LIKE '%av%' THEN 1 END) AS n_substring,
                  count(CASE WHEN list_contains(string_split(id, '_'), 'av') THEN 1 END) AS n_token
           FROM (SELECT run_id, id || CASE WHEN id_num = 5 THEN '#avoid' ELSE '' END AS id FROM veh_log) GROUP BY run_id""",
    views=["veh_log"],
    note="vehicle 5 gets a tag containing 'av' so the two predicates differ",
)
def p4(spark, d):
    v = tb.veh_log(spark, d).withColumn("id", F.concat("id", F.when(F.col("id_num") == 5, "#avoid").otherwise("")))
    return v.groupBy("run_id").agg(
        F.count(F.when(mt.is_av_substring("id"), 1)).alias("n_substring"),
        F.count(F.when(mt.is_av_token("id"), 1)).alias("n_token"),
    )


@register(
    "p7_skip_sparse_drives", "P7,S4",
    sql="""WITH r AS (SELECT user_id, CASE WHEN event_id % 9 = 0 OR value > 4.5e2 THEN NULL ELSE value END AS rel FROM events)
           SELECT user_id, count(*) AS n_rows, count(rel) AS n_valid FROM r GROUP BY user_id
           HAVING avg(CASE WHEN rel IS NULL THEN 1e0 ELSE 0e0 END) <= 5e-1""",
    note="null rule: the S4 null token (every ninth event) plus values above 450",
)
def p7(spark, d):
    e = tb.table(spark, d, "events")
    rel = F.when((F.col("event_id") % 9 == 0) | (F.col("value") > 450.0), F.lit(None)).otherwise(F.col("value"))
    r = e.select("user_id", rel.alias("rel"))
    return mt.skip_sparse(r, ["user_id"], "rel", 0.5)


@register(
    "s4_p8_null_tokens_coerce", "S4,P8",
    sql="""WITH raw AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'NULL' WHEN event_id % 23 = 0 THEN 'n/a?'
                                        WHEN event_id % 29 = 0 THEN NULL
                                        ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) END AS txt FROM events)
           SELECT event_id, CASE WHEN txt IN ('NULL', 'NaN', 'N/A', '') THEN NULL ELSE TRY_CAST(txt AS DOUBLE) END AS value_read,
                  CASE WHEN txt IS NULL THEN -1e0 WHEN txt = 'NULL' THEN 0e0 ELSE coalesce(TRY_CAST(txt AS DOUBLE), 0e0) END AS value_plot
           FROM raw""",
)
def s4(spark, d):
    from ..sources import files as fs

    e = tb.table(spark, d, "events")
    txt = (F.when(F.col("event_id") % 9 == 0, "NULL").when(F.col("event_id") % 23 == 0, "n/a?")
           .when(F.col("event_id") % 29 == 0, F.lit(None).cast("string"))
           .otherwise(F.floor(F.col("value") * 100).cast("long").cast("string")))
    r = e.select("event_id", txt.alias("txt"))
    return r.select("event_id", fs.null_tokens_to_double(F.col("txt")).alias("value_read"),
                    fs.plot_fill(F.col("txt")).alias("value_plot"))
