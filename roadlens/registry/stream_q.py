"""Streaming queries (X-1 .. X-8): availableNow runs over the events file, read back
as batch frames and compared with their batch twins in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..sources import tables as tb
from ..streaming import ops as st
from ..streaming import stacked as sk
from ..streaming import stateful as sf
from .core import register
from .metrics_q import LINES
from .phys_q import lead_log
from .sqlfrag import LEAD_CTES, fuel_sql
from .traffic_q import D2_SQL


def speed_stream(spark, d):
    return st.read_events_stream(spark, d).withColumn("speed", F.least(F.col("value"), F.lit(40.0)))


@register(
    "x1_tumbling_speed_summary", "X-1",
    sql="""SELECT strftime(time_bucket(INTERVAL '60 seconds', ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id,
                  count(*) AS n, round(avg(least(value, 4e1)), 6) AS mean_value, min(least(value, 4e1)) AS min_value,
                  max(least(value, 4e1)) AS max_value
           FROM events GROUP BY 1, 2""",
)
def x1(spark, d):
    r = st.run_update(st.tumbling_summary(speed_stream(spark, d), "user_id", "speed"), "x1", ["window_start", "user_id"])
    return r.select("window_start", "user_id", "n", rnd("mean_value", 6).alias("mean_value"), "min_value", "max_value")


@register(
    "x2_sliding_window_counts", "X-2",
    sql="""SELECT strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
                  count(*) AS n, round(sum(value), 6) AS total
           FROM (SELECT event_type, value, (epoch_us(ts) // 60000000) * 60 - k * 60 AS s
                 FROM events, unnest(generate_series(0, 5)) AS g(k)) GROUP BY 1, 2""",
    note="360 s windows every 60 s, half-open like Spark windows",
)
def x2(spark, d):
    r = st.run_update(st.sliding_counts(st.read_events_stream(spark, d), "event_type", "value"), "x2",
                      ["window_start", "event_type"])
    return r.select("window_start", "event_type", "n", rnd("total", 6).alias("total"))


@register(
    "x3_session_windows", "X-3",
    sql="""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                              OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '5 minutes' THEN 1 ELSE 0 END AS new_s
                      FROM events),
                s AS (SELECT user_id, ts, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
           SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start,
                  strftime(max(ts) + INTERVAL '5 minutes', '%Y-%m-%d %H:%M:%S') AS session_end, user_id, count(*) AS n
           FROM s GROUP BY user_id, sid""",
    note="append mode: a session is emitted once the watermark passes its end; an end marker closes the open ones",
)
def x3(spark, d):
    events = st.read_events_stream(spark, d)
    return st.run_append_to_end(lambda end: st.sessions(events.unionByName(end), "user_id"), spark, "x3").filter("user_id is not null")


@register(
    "x4_running_totals", "X-4,W9",
    sql="""SELECT user_id, count(*) AS n, round(sum(value), 6) AS total, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_time
           FROM events GROUP BY user_id""",
)
def x4(spark, d):
    r = st.run_update(st.running_totals(st.read_events_stream(spark, d), "user_id", "value"), "x4", ["user_id"])
    return r.select("user_id", "n", rnd("total", 6).alias("total"),
                    F.date_format(F.col("last_time").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("last_time"))


@register(
    "x6_threshold_alerts", "X-6",
    sql="""SELECT event_id, user_id, CASE WHEN value < 1e0 THEN 'low' ELSE 'high' END AS alert, value
           FROM events WHERE value < 1e0 OR value > 4.5e2""",
)
def x6(spark, d):
    return st.run_append(st.threshold_alerts(st.read_events_stream(spark, d), "value", 1.0, 450.0), "x6")


@register(
    "x7_attach_profile", "X-7,J1",
    sql="""SELECT e.event_id, t.t, t.seg_idx, round(t.avg_speed, 6) AS avg_speed
           FROM events e LEFT JOIN tse t ON t.t = CAST(day(e.ts) AS BIGINT) AND t.seg_idx = CAST(floor(hour(e.ts) / 3) AS INT)""",
    views=["tse"],
)
def x7(spark, d):
    ev = st.read_events_stream(spark, d)
    prof = tb.tse(spark, d).withColumn("_k", F.struct(F.col("t"), F.col("seg_idx")))
    key = F.struct(F.dayofmonth("ts").cast("long").alias("t"), F.floor(F.hour("ts") / 3).cast("int").alias("seg_idx"))
    j = st.attach_profile(ev.select("event_id", "ts"), prof.select("_k", "t", "seg_idx", "avg_speed"), key, "_k")
    out = st.run_append(j.select("event_id", "t", "seg_idx", "avg_speed"), "x7")
    return out.select("event_id", "t", "seg_idx", rnd("avg_speed", 6).alias("avg_speed"))


@register(
    "x8_drop_duplicates_in_watermark", "X-8",
    sql="""SELECT user_id, count(*) AS n, count(DISTINCT event_id) AS n_distinct FROM events GROUP BY user_id""",
    note="the stream is the events file read twice (every row duplicated); dedup on event_id",
)
def x8(spark, d):
    a, b = st.read_events_stream(spark, d), st.read_events_stream(spark, d)
    dedup = st.run_append(st.drop_late_duplicates(a.unionByName(b), ["event_id"]).select("event_id", "user_id"), "x8")
    return dedup.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_distinct"))


@register(
    "x5_stream_traffic_segments", "X-5,D2",
    sql=D2_SQL + """
SELECT seg.traj_id, s.st AS state, seg.start, seg."end" FROM seg JOIN s ON s.traj_id = seg.traj_id AND s.seq = seg.lab""",
    views=["drive_type"],
    note="closed segments and the open one as it stands; the last version of a segment counts",
)
def x5(spark, d):
    ev = st.read_events_stream(spark, d).withColumn("velocity_kmh", F.least(F.col("value"), F.lit(120.0)))
    return st.run_update(st.stream_segments(ev, "event_type", F.col("velocity_kmh")), "x5", ["traj_id", "start"])


@register(
    "x4_running_mpg", "X-4,W9",
    sql=f"""SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, round(sum(speed) / 1609.34e0 * 1e-1, 6) AS miles,
                   round(sum(fuel) / 3600e0 * 1e-1, 6) AS gallons,
                   round((sum(speed) / 1609.34e0 * 1e-1) / (sum(fuel) / 3600e0 * 1e-1 + 1e-6), 6) AS mpg
            FROM (SELECT *, {fuel_sql('speed', 'accel')} AS fuel FROM (
                    SELECT traj_id AS user_id, speed, (speed - coalesce(lag(speed) OVER (PARTITION BY traj_id ORDER BY seq), 0e0)) / 1e-1 AS accel
                    FROM drive_user)) GROUP BY user_id""",
    views=["drive_user"],
    note="value state with a TTL; the last version of a vehicle counts",
)
def x4m(spark, d):
    events = st.read_events_stream(spark, d)
    with sf.state_store(spark, empty_batches=False):
        r = st.run_update(sf.running_mpg(events, "user_id", F.least(F.col("value"), F.lit(40.0))), "x4-mpg", ["key"])
    return r.select("key", "n", *(rnd(c, 6).alias(c) for c in ("miles", "gallons", "mpg")))


@register(
    "x5_closed_segments", "X-5,D2",
    sql=D2_SQL + """
SELECT seg.traj_id, s.st AS state, seg.start, seg."end" FROM seg JOIN s ON s.traj_id = seg.traj_id AND s.seq = seg.lab""",
    views=["drive_type"],
    note="append mode: a segment is emitted when it closes, the last of a drive by an event-time timer that drops its state",
)
def x5b(spark, d):
    events = st.read_events_stream(spark, d)
    velocity = F.least(F.col("value"), F.lit(120.0))
    with sf.state_store(spark):
        return st.run_append_to_end(lambda end: sf.closed_segments(events.unionByName(end), "event_type", velocity), spark, "x5-closed")


@register(
    "x6_row_alerts", "X-6,W17",
    sql="""WITH x AS (SELECT run_id, id_num, step, headway, accel, speed, leader_speed,
                             CASE WHEN leader_speed < speed THEN headway / (speed - leader_speed) ELSE CAST('inf' AS DOUBLE) END AS ttc,
                             CASE WHEN speed > 0 THEN headway / speed ELSE 6e1 END AS gap FROM lead_log WHERE leader_speed IS NOT NULL),
                b AS (SELECT *, lag(headway) OVER w AS h0, lag(accel) OVER w AS a0, lag(ttc) OVER w AS t0 FROM x
                      WINDOW w AS (PARTITION BY run_id, id_num ORDER BY step)),
                f AS (SELECT *, abs(accel - a0) > 9e-1 * 1e-1 AND ((leader_speed > speed AND gap > 2e0) OR (leader_speed < speed AND ttc > 4.5e0)) AS changed FROM b)
           SELECT concat(run_id, '/', id_num) AS key, step, alert, round(value, 6) AS value FROM (
             SELECT *, 'cut_in' AS alert, headway - h0 AS value FROM f WHERE changed AND headway - h0 <= -3.5e0
             UNION ALL SELECT *, 'cut_out', headway - h0 FROM f WHERE changed AND headway - h0 >= 3.5e0
             UNION ALL SELECT *, 'crash', headway FROM f WHERE headway < 0 AND (h0 IS NULL OR h0 >= 0)
             UNION ALL SELECT *, 'low_ttc', ttc FROM f WHERE headway >= 0 AND ttc < 6e0 AND (t0 IS NULL OR t0 >= 6e0))""",
    views=["veh_log"], ctes=LEAD_CTES,
    note="keyed state holds the row before; the vehicle log is written and read as a stream",
)
def x6b(spark, d):
    rows = lead_log(spark, d).filter(F.col("leader_speed").isNotNull()).select("run_id", "id_num", *sf.ALERT_COLS)
    with sf.state_store(spark, empty_batches=False):
        r = st.run_append(sf.row_alerts(sf.stream_of(rows, "x6-log"), ["run_id", "id_num"]), "x6-alerts")
    return r.select("key", "step", "alert", rnd("value", 6).alias("value"))


@register(
    "x2_crossing_vehicles", "X-2,A7",
    sql="""WITH lines(line) AS (VALUES (0e0), (1e2), (2e2), (3e2), (4e2)),
                seen AS (SELECT run_id, id_num, (step // 10) - k AS w, min(position) AS lo, max(position) AS hi
                         FROM veh_log, unnest(generate_series(0, 5)) AS g(k) GROUP BY ALL)
           SELECT strftime(make_timestamp(w * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, run_id, line, count(*) AS n_crossing
           FROM seen JOIN lines ON lo < line AND hi > line GROUP BY ALL""",
    views=["veh_log"],
    note="two stacked aggregates; 6 s windows every 1 s (fixture scale of 360 s / 60 s), half-open as A7's are not",
)
def x2b(spark, d):
    log = tb.veh_log(spark, d, keep=False).select("run_id", "id_num", "position", "step")
    stream = sf.stream_of(log, "x2-log", time=F.timestamp_millis(F.col("step") * 100))
    make = lambda end: sk.crossing_vehicles(stream.unionByName(end), ["run_id"], "id_num", "position", LINES, "6 seconds", "1 second")
    return sk.run_to_end(make, [stream.schema], spark, "x2-crossing")


PROFILE_S = 3 * 3600


@register(
    "x7_live_profile_join", "X-7,J1",
    sql="""WITH p AS (SELECT CAST(floor(epoch(ts) / 10800) AS BIGINT) + 1 AS period, round(avg(least(value, 4e1)), 9) AS avg_speed FROM events GROUP BY 1)
           SELECT event_id, strftime(make_timestamp(p.period * 10800000000), '%Y-%m-%d %H:%M:%S') AS published, round(avg_speed, 6) AS avg_speed
           FROM events e LEFT JOIN p ON p.period = CAST(floor(epoch(e.ts) / 10800) AS BIGINT) AND p.period % 7 <> 3""",
    note="stream-stream outer join: each event with the profile of the three hours before, every seventh profile never comes",
)
def x7b(spark, d):
    events = st.read_events_stream(spark, d).select("event_id", "event_time")
    period = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / PROFILE_S) + 1
    prof = tb.table(spark, d, "events").groupBy(period.alias("period")).agg(rnd(F.avg(F.least(F.col("value"), F.lit(40.0))), 9).alias("avg_speed"))
    prof = prof.filter("period % 7 <> 3").select("avg_speed", F.timestamp_seconds(F.col("period") * PROFILE_S).alias("event_time"))
    live = sf.stream_of(prof, "x7-profiles")
    make = lambda a, b: sk.live_profile(events.unionByName(a), live.unionByName(b), ["avg_speed"], PROFILE_S, salt_by=F.col("event_id"))
    out = sk.run_to_end(make, [events.schema, live.schema], spark, "x7-live")
    return out.select("event_id", F.date_format(F.col("published").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("published"), rnd("avg_speed", 6).alias("avg_speed"))
