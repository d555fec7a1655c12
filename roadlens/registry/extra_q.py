"""Forms of earlier operators that had no query of their own: kept rows (P7), drives without
profile (J13), controller averages (A17), summary record (K6), saved store (K5), step
profile (D17), errors over common columns (U3, A19)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import rnd
from ..operators import joins as jn
from ..operators import metrics as mt
from ..operators import sinks as sk
from ..operators import traffic as tf
from ..session import ensure_checkpoint_dir
from ..sources import tables as tb
from .core import register
from .joins_q import PROBE_SCALE, ROAD_CTES, with_road
from .logs_q import fuel_log, mpg_sql
from .phys_q import lead_log
from .sqlfrag import LEAD_CTES, LOG_CTES
from .traffic_q import D2_SQL


def _place(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register(
    "p7_rows_of_kept_drives", "P7",
    sql="""WITH r AS (SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN NULL ELSE value END AS rel FROM events),
                k AS (SELECT user_id FROM r GROUP BY user_id HAVING avg(CASE WHEN rel IS NULL THEN 1e0 ELSE 0e0 END) <= 5e-1)
           SELECT event_id, user_id, rel FROM r WHERE user_id IN (SELECT user_id FROM k)""",
    note="null rule: every second event, so drives of both kinds occur",
)
def p7_rows(spark, d):
    rel = F.when(F.col("event_id") % 2 == 0, F.lit(None)).otherwise(F.col("value"))
    r = tb.table(spark, d, "events").select("event_id", "user_id", rel.alias("rel"))
    return r.join(mt.skip_sparse(r, ["user_id"], "rel", 0.5).select("user_id"), "user_id", "left_semi").select("event_id", "user_id", "rel")


@register(
    "j13_drives_without_profile", "J13",
    sql="""SELECT traj_id, count(*) AS n_rows FROM drive_user u WHERE NOT EXISTS (SELECT 1 FROM tse WHERE tse.t = u.traj_id % 40) GROUP BY traj_id""",
    views=["drive_user", "tse"],
    note="a drive's profile time is its number modulo 40; profiles exist for days of the month only",
)
def j13_profiles(spark, d):
    u = tb.drive_user(spark, d).select("traj_id", (F.col("traj_id") % 40).alias("t"))
    return u.join(tb.tse(spark, d).select("t").distinct(), "t", "left_anti").groupBy("traj_id").agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "a17_controller_averages", "A17,J7",
    sql=f"""WITH m AS (SELECT run_id, split_part(id, '_', 2) AS controller, {mpg_sql()} AS mpg FROM fuel_log GROUP BY 1, 2),
                 a AS (SELECT controller, count(mpg) AS n_runs, round(avg(mpg), 6) AS mean_mpg FROM m GROUP BY controller)
            SELECT a.controller, a.n_runs, a.mean_mpg, round((a.mean_mpg / b.mean_mpg - 1) * 100, 6) AS pct_vs_baseline
            FROM a CROSS JOIN (SELECT mean_mpg FROM a WHERE controller = 'idm') b""",
    views=["veh_log"], ctes=LOG_CTES,
    note="averages over runs skip runs without fuel; baseline: idm",
)
def a17(spark, d):
    f = fuel_log(spark, d).withColumn("controller", F.split("id", "_").getItem(1))
    m = f.groupBy("run_id", "controller").agg(rnd(mt.mpg_from_sums(F.sum("speed"), F.sum("fuel")), 6).alias("mpg"))
    a = m.groupBy("controller").agg(F.count("mpg").alias("n_runs"), rnd(F.avg("mpg"), 6).alias("mean_mpg"))
    base = a.filter("controller = 'idm'").agg(F.max("mean_mpg").alias("_b"))  # one row
    return a.crossJoin(F.broadcast(base)).select("controller", "n_runs", "mean_mpg", rnd((F.col("mean_mpg") / F.col("_b") - 1) * 100, 6).alias("pct_vs_baseline"))


@register(
    "k6_traffic_summary_record", "K6,A18",
    sql=D2_SQL + """,
  lab AS (SELECT seg.traj_id, s.st AS state, (seg."end" - seg.start) * 1e-1 AS sec FROM seg JOIN s ON s.traj_id = seg.traj_id AND s.seq = seg.lab)
SELECT traj_id, state, round(sum(sec), 6) AS seconds, count(*) AS n_segments FROM lab GROUP BY traj_id, state""",
    views=["drive_type"],
    note="one JSON record per drive with maps from state to seconds and segments, written and read back",
)
def k6(spark, d):
    x = tb.drive_type(spark, d).withColumn("state", tf.traffic_state("velocity_kmh"))
    s = tf.segment_states(x, ["traj_id"], "seq", "state").withColumn("sec", (F.col("end") - F.col("start")) * 0.1)
    s = s.groupBy("traj_id", "state").agg(F.sum("sec").alias("sec"), F.count(F.lit(1)).alias("n"))
    pair = lambda c: F.map_from_entries(F.collect_list(F.struct("state", c)))  # noqa: E731  a handful of states
    record = s.groupBy("traj_id").agg(pair("sec").alias("seconds"), pair("n").alias("segments"))
    place = _place(spark, "summary")
    sk.write_json_records(record, place)
    back = spark.read.schema("traj_id string, seconds map<string,double>, segments map<string,bigint>").json(place)
    back = back.select("traj_id", F.explode("seconds").alias("state", "sec"), "segments")
    return back.select("traj_id", "state", rnd("sec", 6).alias("seconds"), F.element_at("segments", F.col("state")).alias("n_segments"))


@register(
    "k5_saved_store", "K5,R1",
    sql="""SELECT vec_id AS doc_id, label, CAST(len(embedding) AS INT) AS n_values, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM embeddings""",
    note="contents as JSON lines and vectors as Parquet, written and read back by id",
)
def k5(spark, d):
    e = tb.table(spark, d, "embeddings")
    place = _place(spark, "store")
    sk.write_json_records(e.select("vec_id", "label"), f"{place}/contents")
    e.select("vec_id", "embedding").write.parquet(f"{place}/vectors")
    contents = spark.read.schema("vec_id long, label int").json(f"{place}/contents")
    back = contents.join(spark.read.parquet(f"{place}/vectors"), "vec_id")
    return back.select(F.col("vec_id").alias("doc_id"), "label", F.size("embedding").alias("n_values"), rnd(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


@register(
    "d17_step_profile_difference", "D17,J1,J2",
    sql="""WITH prof AS (SELECT DISTINCT t FROM tse),
                probe AS (SELECT run_id, id_num, step, position, speed, step * 3.5e-1 AS probe_t FROM veh_log),
                m AS (SELECT p.*, coalesce(a.t, (SELECT min(t) FROM prof)) AS t FROM probe p ASOF LEFT JOIN prof a ON p.probe_t >= a.t),
                st AS (SELECT t, seg_start, avg_speed, lead(seg_start) OVER (PARTITION BY t ORDER BY seg_idx) AS seg_end FROM tse)
           SELECT run_id, id_num, step, m.t, round(avg_speed, 6) AS profile_speed, round(speed - avg_speed, 6) AS speed_difference
           FROM m LEFT JOIN st ON st.t = m.t AND position >= seg_start AND (seg_end IS NULL OR position < seg_end)""",
    views=["veh_log", "tse"],
    note="each segment's speed holds to the next segment's start; null before the first segment",
)
def d17(spark, d):
    v = tb.veh_log(spark, d, keep=False).select("run_id", "id_num", "step", "position", "speed", (F.col("step") * PROBE_SCALE).alias("probe_t"))
    m = jn.asof_join(v, tb.tse(spark, d).select("t").distinct(), [], "probe_t", "t", []).withColumnRenamed("t_match", "t")
    x = m.join(tf.profile_arrays(tb.tse(spark, d), ["t"], "seg_start", "avg_speed"), "t")
    held = F.get("zs", F.size(F.filter("xs", lambda s: s <= F.col("position"))) - 1)
    return x.select("run_id", "id_num", "step", "t", rnd(held, 6).alias("profile_speed"), rnd(F.col("speed") - held, 6).alias("speed_difference"))


def common_columns(a, b, but=()) -> list[str]:
    """Columns both frames have, in the first one's order; an error if there is none."""
    out = [c for c in a.columns if c in b.columns and c not in but]
    if not out:
        raise ValueError("the frames have no common column")
    return out


@register(
    "u3_a19_common_column_errors", "U3,A19",
    sql="""WITH a AS (SELECT run_id, id_num, step, speed, position FROM veh_log), b AS (SELECT run_id - 1 AS run_id, id_num, step, speed, position FROM veh_log),
                na AS (SELECT run_id, id_num, count(*) AS n FROM a GROUP BY 1, 2), nb AS (SELECT run_id, id_num, count(*) AS n FROM b GROUP BY 1, 2),
                e AS (SELECT a.run_id, a.id_num, sqrt(avg(pow(a.speed - b.speed, 2))) AS es, sqrt(avg(pow(a.position - b.position, 2))) AS ep
                      FROM a JOIN b ON a.run_id = b.run_id AND a.id_num = b.id_num AND a.step = b.step GROUP BY 1, 2)
           SELECT na.run_id, na.id_num, CASE WHEN na.n = nb.n THEN round(es, 6) END AS speed, CASE WHEN na.n = nb.n THEN round(ep, 6) END AS position,
                  CASE WHEN na.n = nb.n THEN round((es + ep) / 2, 6) END AS mean_error
           FROM na JOIN nb ON na.run_id = nb.run_id AND na.id_num = nb.id_num LEFT JOIN e ON e.run_id = na.run_id AND e.id_num = na.id_num""",
    views=["veh_log"],
    note="a vehicle's log against the same vehicle's in the next run; null where the lengths differ",
)
def u3(spark, d):
    v = tb.veh_log(spark, d).select("run_id", "id_num", "step", "speed", "position")
    keys = ["run_id", "id_num", "step"]
    a, b = v, v.withColumn("run_id", F.col("run_id") - 1)
    cols = common_columns(a, b, keys)
    size = lambda x, n: x.groupBy("run_id", "id_num").agg(F.count(F.lit(1)).alias(n))
    both = a.join(b.select(*keys, *(F.col(c).alias(f"_{c}") for c in cols)), keys)
    err = both.groupBy("run_id", "id_num").agg(*(F.sqrt(F.avg(F.pow(F.col(c) - F.col(f"_{c}"), 2))).alias(c) for c in cols))
    out = size(a, "_na").join(size(b, "_nb"), ["run_id", "id_num"]).join(err, ["run_id", "id_num"], "left")
    same = F.col("_na") == F.col("_nb")
    mean = sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols)
    return out.select("run_id", "id_num", *(F.when(same, rnd(c, 6)).alias(c) for c in cols), F.when(same, rnd(mean, 6)).alias("mean_error"))


def _board_id_sql(v):
    return (f"CASE WHEN {v} LIKE '%#sensor%' THEN 'sensor_' WHEN {v} LIKE '%human%' THEN 'human_' WHEN {v} LIKE '%av%' THEN 'av_' "
            f"WHEN {v} LIKE '%trajectory%' THEN 'human_' END || {v}")


@register(
    "k2_leaderboard_export", "K2,D19,J3,J4,F4,F12",
    sql=f"""WITH {ROAD_CTES},
      n AS (SELECT l.*, a.id AS leader_id, b.id AS follower_id, road.road_grade, road.altitude,
                   l.position - first_value(l.position) OVER (PARTITION BY l.run_id, l.id_num ORDER BY l.step) AS distance
            FROM lead_log l JOIN road ON road.run_id = l.run_id AND road.id_num = l.id_num AND road.step = l.step
            LEFT JOIN veh_log a ON a.run_id = l.run_id AND a.step = l.step AND a.id_num = l.id_num - 1
            LEFT JOIN veh_log b ON b.run_id = l.run_id AND b.step = l.step AND b.id_num = l.id_num + 1)
      SELECT round(t, 3) AS time, {_board_id_sql('id')} AS id, round(position, 6) AS x, 0 AS y, round(speed, 6) AS speed, round(headway, 6) AS headway,
             {_board_id_sql('leader_id')} AS leader_id, {_board_id_sql('follower_id')} AS follower_id, round(speed_difference, 6) AS leader_rel_speed,
             round(accel, 6) AS target_accel_with_noise_with_failsafe, round(accel, 6) AS target_accel_no_noise_no_failsafe,
             round(accel, 6) AS target_accel_with_noise_no_failsafe, round(accel, 6) AS target_accel_no_noise_with_failsafe,
             round(accel, 6) AS realized_accel, round(road_grade, 9) AS road_grade, 'edge0' AS edge_id, 0 AS lane_id, round(distance, 6) AS distance,
             round(distance, 6) AS relative_position, 'events' AS source_id, 'run_' || CAST(run_id AS VARCHAR) AS run_id, '2026-01-01' AS submission_date,
             (SELECT count(DISTINCT run_id) FROM veh_log) AS metadata_runs
      FROM n""",
    views=["veh_log"], ctes=LEAD_CTES,
    note="22 columns and a one-row metadata table, both written and read back; the fixture logs one acceleration, "
         "which fills the four target columns; the submission date is a parameter",
)
def k2(spark, d, submission_date="2026-01-01"):
    x = with_road(spark, lead_log(spark, d))
    near = tb.veh_log(spark, d).select("run_id", "step", "id_num", "id")
    side = lambda by, name: near.select("run_id", "step", (F.col("id_num") + by).alias("id_num"), F.col("id").alias(name))
    keys = ["run_id", "step", "id_num"]
    first = x.groupBy("run_id", "id_num").agg(F.min_by("position", "step").alias("_p0"))
    x = x.join(side(1, "_lead"), keys, "left").join(side(-1, "_follow"), keys, "left").join(first, ["run_id", "id_num"])
    distance = rnd(F.col("position") - F.col("_p0"), 6)
    accel = rnd("accel", 6)
    board = x.select(
        rnd("t", 3).alias("time"), tx.leaderboard_id("id").alias("id"), rnd("position", 6).alias("x"), F.lit(0).alias("y"), rnd("speed", 6).alias("speed"),
        rnd("headway", 6).alias("headway"), tx.leaderboard_id("_lead").alias("leader_id"), tx.leaderboard_id("_follow").alias("follower_id"),
        rnd("speed_difference", 6).alias("leader_rel_speed"),
        *(accel.alias(f"target_accel_{n}_noise_{f}_failsafe") for n, f in (("with", "with"), ("no", "no"), ("with", "no"), ("no", "with"))),
        accel.alias("realized_accel"), rnd("road_grade", 9).alias("road_grade"), F.lit("edge0").alias("edge_id"), F.lit(0).alias("lane_id"),
        distance.alias("distance"), distance.alias("relative_position"), F.lit("events").alias("source_id"),
        F.concat(F.lit("run_"), F.col("run_id").cast("string")).alias("run_id"), F.lit(submission_date).alias("submission_date"))
    place = _place(spark, "leaderboard")
    sk.write_emissions(board, f"{place}/emissions")
    back = spark.read.parquet(f"{place}/emissions")
    back.agg(F.lit("events").alias("source_id"), F.countDistinct("run_id").alias("metadata_runs"), F.lit(submission_date).alias("submission_date")).write.json(f"{place}/metadata")
    meta = spark.read.schema("metadata_runs long").json(f"{place}/metadata")
    return back.crossJoin(F.broadcast(meta))  # one row
