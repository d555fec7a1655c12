"""Traffic composites (D*, A18, W18) over the drive and traffic-profile adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import emissions as em
from ..operators import traffic as tf
from ..sources import tables as tb
from .core import register
from .logs_q import fuel_log
from .sqlfrag import LEAD_CTES

STATE_SQL = "CASE WHEN velocity_kmh < 4e1 THEN 'congestion' WHEN velocity_kmh < 8e1 THEN 'dense' ELSE 'freeflow' END"

D2_SQL = f"""WITH RECURSIVE
  s AS (SELECT traj_id, seq, {STATE_SQL} AS st FROM drive_type),
  f AS (SELECT traj_id, seq, st, lag(st) OVER (PARTITION BY traj_id ORDER BY seq) AS pst FROM s),
  n AS (SELECT traj_id, count(*) AS n FROM s GROUP BY traj_id),
  flips AS (SELECT traj_id, seq FROM f WHERE pst IS NOT NULL AND st <> pst),
  nodes AS (SELECT traj_id, seq AS node, seq + 100 AS probe FROM flips UNION ALL SELECT traj_id, 0, 100 FROM n),
  j0 AS (SELECT nd.traj_id, nd.node, fl.seq AS nxt FROM nodes nd ASOF LEFT JOIN flips fl
           ON nd.traj_id = fl.traj_id AND fl.seq >= nd.probe),
  chain(traj_id, node) AS (SELECT traj_id, 0 FROM n
                           UNION ALL
                           SELECT c.traj_id, j.nxt FROM chain c JOIN j0 j ON j.traj_id = c.traj_id AND j.node = c.node
                           WHERE j.nxt IS NOT NULL),
  seg AS (SELECT c.traj_id, c.node AS start, coalesce(j.nxt, n.n - 1) AS "end", coalesce(j.nxt - 1, n.n - 1) AS lab
          FROM chain c JOIN j0 j ON j.traj_id = c.traj_id AND j.node = c.node JOIN n ON n.traj_id = c.traj_id)"""


@register(
    "d2_traffic_state_segments", "D2",
    sql=D2_SQL + """
SELECT seg.traj_id, s.st AS state, seg.start, seg."end" FROM seg JOIN s ON s.traj_id = seg.traj_id AND s.seq = seg.lab""",
    views=["drive_type"],
)
def d2(spark, d):
    x = tb.drive_type(spark, d).withColumn("state", tf.traffic_state("velocity_kmh"))
    return tf.segment_states(x, ["traj_id"], "seq", "state")


@register(
    "a18_traffic_summary", "A18,D2",
    sql=D2_SQL + """,
  lab AS (SELECT s.st AS state, (seg."end" - seg.start) * 1e-1 AS sec FROM seg JOIN s ON s.traj_id = seg.traj_id AND s.seq = seg.lab)
SELECT coalesce(state, 'all') AS state, round(sum(sec), 6) AS seconds, count(*) AS n_segments,
       round(sum(sec) / (SELECT sum(sec) FROM lab) * 100, 6) AS percentage
FROM lab GROUP BY ROLLUP (state)""",
    views=["drive_type"],
)
def a18(spark, d):
    x = tb.drive_type(spark, d).withColumn("state", tf.traffic_state("velocity_kmh"))
    s = tf.traffic_summary(tf.segment_states(x, ["traj_id"], "seq", "state"))
    return s.select("state", rnd("seconds", 6).alias("seconds"), "n_segments", rnd("percentage", 6).alias("percentage"))


@register(
    "w18_d5_d6_bottlenecks", "D5,D6,W18",
    sql="""WITH r AS (SELECT t, seg_idx, avg_speed,
                             coalesce(lead(avg_speed) OVER w <= 6e1 AND lead(avg_speed) OVER w - avg_speed > 4e0, false) AS raw,
                             row_number() OVER w AS rn, lead(seg_idx) OVER w IS NULL AS is_last
                      FROM tse WINDOW w AS (PARTITION BY t ORDER BY seg_idx)),
                b AS (SELECT t, seg_idx, raw AND NOT coalesce(lag(raw) OVER (PARTITION BY t ORDER BY seg_idx), false)
                                         AND rn > 1 AND NOT is_last AS bottleneck FROM r),
                s AS (SELECT t, seg_idx, bottleneck,
                             row_number() OVER v > 5 AND sum(CAST(bottleneck AS INT)) OVER (v ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 4 AS standing
                      FROM b WINDOW v AS (PARTITION BY seg_idx ORDER BY t))
           SELECT t, seg_idx, bottleneck, standing, bottleneck AND NOT standing AS moving FROM s""",
    views=["tse"],
)
def w18(spark, d):
    f = tf.bottleneck_flags(tb.tse(spark, d), ["t"], "seg_idx", "avg_speed")
    s = tf.standing_bottlenecks(f, [], "seg_idx", "t")
    return s.select("t", "seg_idx", "bottleneck", "standing", "moving")


@register(
    "d4_window_smoothing_targets", "D4",
    sql="""WITH k AS (SELECT t, list(seg_start ORDER BY seg_idx) AS xs, list(avg_speed ORDER BY seg_idx) AS zs FROM tse GROUP BY t),
                g AS (SELECT t, CAST(i AS INT) AS grid_idx, xs, zs, len(xs) AS n, xs[1] + i * ((xs[len(xs)] - 1 - xs[1]) / 99) AS x0 FROM k, unnest(range(0, 100)) AS u(i)),
                a AS (SELECT *, len(list_filter(xs, lambda v: v < x0)) AS f FROM g),
                c AS (SELECT *, list_filter(range(f + 2, n), lambda j: xs[j + 1] >= x0 + 2e3 OR zs[j + 1] - list_avg(list_slice(zs, f + 1, j)) > 15)[1] AS j FROM a),
                e AS (SELECT *, least(x0 + 2e3, CASE WHEN j IS NULL THEN xs[n] ELSE xs[j + 1] END) AS fin FROM c),
                p AS (SELECT t, grid_idx, x0, f, fin, xs[i] AS xa, xs[i + 1] AS xb, zs[i] AS za, zs[i + 1] AS zb,
                             greatest(xs[i], x0) AS lo, least(xs[i + 1], fin) AS hi FROM e, unnest(range(1, n)) AS u(i)),
                q AS (SELECT *, za + (zb - za) * ((lo + hi) / 2 - xa) / (xb - xa) AS mid FROM p)
           SELECT t, grid_idx, round(any_value(x0), 6) AS x0,
                  round(CASE WHEN any_value(f) = 0 THEN 3e1 ELSE sum(CASE WHEN hi > lo THEN mid * (hi - lo) ELSE 0e0 END) / (any_value(fin) - any_value(x0)) END, 6) AS target_speed
           FROM q GROUP BY t, grid_idx""",
    views=["tse"],
    note="array fold per profile; the oracle integrates the profile over the window",
)
def d4(spark, d):
    arrs = tf.profile_arrays(tb.tse(spark, d), ["t"], "seg_start", "avg_speed")
    out = tf.window_smoothing_targets(arrs, ["t"], width=2000.0)
    return out.select("t", "grid_idx", rnd("x0", 6).alias("x0"), rnd("target_speed", 6).alias("target_speed"))


@register(
    "d11_travel_time", "D11",
    sql="""SELECT t, round(sum(dt), 6) AS travel_time, count(dt) AS n_intervals FROM (
             SELECT t, CASE WHEN v2 = v1 THEN dx / v1 ELSE dx * ln(v2 / v1) / (v2 - v1) END AS dt FROM (
               SELECT t, lead(seg_start) OVER w - seg_start AS dx, avg_speed AS v1, lead(avg_speed) OVER w AS v2
               FROM tse WINDOW w AS (PARTITION BY t ORDER BY seg_idx))) GROUP BY t""",
    views=["tse"],
)
def d11(spark, d):
    x = tf.travel_time(tb.tse(spark, d), ["t"], "seg_idx", "seg_start", "avg_speed")
    return x.select("t", rnd("travel_time", 6).alias("travel_time"), "n_intervals")


@register(
    "d12_random_chunks", "D12,L3",
    sql="""WITH n AS (SELECT traj_id, count(*) AS n FROM drive_user GROUP BY traj_id),
                dr AS (SELECT traj_id, n, d AS draw,
                              CASE WHEN n <= 20 THEN 0 ELSE ((traj_id * 2654435761 + d * 40503 + 42) % greatest(n - 20 + 1, 1)) END AS start
                       FROM n, unnest(generate_series(0, 1)) AS g(d))
           SELECT u.traj_id, dr.draw, u.seq, u.speed FROM drive_user u JOIN dr ON dr.traj_id = u.traj_id
           WHERE u.seq >= dr.start AND u.seq < dr.start + 20""",
    views=["drive_user"],
    note="two 20-row chunks per drive, seed 42",
)
def d12(spark, d):
    u = tb.drive_user(spark, d)
    x = tf.random_chunks(u, ["traj_id"], "seq", 20, 2, 42, F.col("traj_id"))
    return x.select("traj_id", "draw", "seq", "speed")


@register(
    "d18_a15_safety_counts", "D18,A15,F14",
    sql="""SELECT run_id, CAST(count(CASE WHEN headway > greatest(1.2e2, 6e0 * speed) THEN 1 END) AS BIGINT) AS n_gap_closing,
                  CAST(count(CASE WHEN headway < 6 * ((speed + 1 + speed * 4 / 30) - leader_speed) THEN 1 END) AS BIGINT) AS n_failsafe,
                  CAST(count(CASE WHEN headway < 0 THEN 1 END) AS BIGINT) AS n_crash, count(headway) AS n_rows
           FROM lead_log WHERE id LIKE '%av%' AND leader_speed IS NOT NULL GROUP BY run_id""",
    views=["veh_log"], ctes=LEAD_CTES,
)
def d18(spark, d):
    x = em.attach_leader(em.platoon_leader(fuel_log(spark, d)))
    x = x.withColumn("headway", F.col("leader_position") - F.col("position") - 5.0)
    av = x.filter(F.col("id").contains("av") & F.col("leader_speed").isNotNull())
    return tf.safety_counts(av, ["run_id"])
