"""Window-function queries (W*) over the drive adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics as ph
from ..functions.numeric import rnd
from ..operators import emissions as em
from ..operators import series as sr
from ..session import ensure_checkpoint_dir, materialize
from ..sources import tables as tb
from .core import register
from .logs_q import fuel_log
from .sqlfrag import LOG_CTES


def R(c, d=6):
    return rnd(c, d).alias(c)


HAV_SQL = """6371e3 * (2 * atan2(sqrt({a}), sqrt(1 - {a})))"""


def hav_sql(la1, lo1, la2, lo2):
    a = (f"(sin(radians({la2} - {la1}) / 2) * sin(radians({la2} - {la1}) / 2) + cos(radians({la1})) * cos(radians({la2}))"
         f" * sin(radians({lo2} - {lo1}) / 2) * sin(radians({lo2} - {lo1}) / 2))")
    return HAV_SQL.format(a=a)


@register(
    "w1_positions_from_speeds", "W1",
    sql="""SELECT traj_id, seq, round(coalesce(sum(speed * 1e-1) OVER (PARTITION BY traj_id ORDER BY seq
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0), 6) AS position
           FROM drive_user""",
    views=["drive_user"],
)
def w1(spark, d):
    x = sr.positions_from_speeds(tb.drive_user(spark, d), ["traj_id"], "seq", "speed")
    return x.select("traj_id", "seq", R("position"))


@register(
    "w2_gps_distance", "W2,F7",
    sql=f"""SELECT traj_id, seq, round(sum(coalesce(step_m, 0e0)) OVER (PARTITION BY traj_id ORDER BY seq
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) AS distance_gps
            FROM (SELECT traj_id, seq, {hav_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step_m
                  FROM raw_drive WINDOW w AS (PARTITION BY traj_id ORDER BY seq))""",
    views=["raw_drive"],
)
def w2(spark, d):
    x = sr.gps_distance(tb.raw_drive(spark, d), ["traj_id"], "seq")
    return x.select("traj_id", "seq", R("distance_gps", 3))


def bearing_sql(la1, lo1, la2, lo2):
    x = f"(cos({la2}) * sin({lo2} - {lo1}))"
    y = f"(cos({la1}) * sin({la2}) - sin({la1}) * cos({la2}) * cos({lo2} - {lo1}))"
    b = f"degrees(atan2({x}, {y}))"
    return f"(CASE WHEN {b} < 0 THEN {b} + 360 ELSE {b} END)"


@register(
    "w3_bearing_direction", "W3,F8",
    sql=f"""SELECT traj_id, seq, round(bearing, 6) AS bearing,
                   CASE WHEN bearing > 270 AND bearing < 360 THEN 'West'
                        WHEN bearing > 90 AND bearing < 190 THEN 'East' END AS driving_dir
            FROM (SELECT traj_id, seq, coalesce({bearing_sql('radians(lat)', 'radians(lon)',
                  'radians(lead(lat) OVER w)', 'radians(lead(lon) OVER w)')}, 0e0) AS bearing
                  FROM raw_drive WINDOW w AS (PARTITION BY traj_id ORDER BY seq))""",
    views=["raw_drive"],
)
def w3(spark, d):
    x = sr.bearing_next(tb.raw_drive(spark, d), ["traj_id"], "seq")
    return x.select("traj_id", "seq", R("bearing"), "driving_dir")


@register(
    "w4_gap_fill", "W4",
    sql="""WITH g AS (
             SELECT traj_id, seq, time, velocity_kmh, lat,
                    lead(time) OVER w AS nt, lead(velocity_kmh) OVER w AS nv, lead(lat) OVER w AS nl
             FROM raw_drive_gaps WINDOW w AS (PARTITION BY traj_id ORDER BY seq)),
           m AS (SELECT *, CASE WHEN abs(nt - time - 1e-1) > 1e-3 THEN CAST(floor(round((nt - time) / 1e-1, 3)) AS INT) ELSE 1 END AS miss FROM g),
           e AS (SELECT traj_id, seq AS src, k,
                   CASE WHEN k = 0 THEN time ELSE time + (nt - time) * k / miss END AS t,
                   CASE WHEN k = 0 THEN velocity_kmh ELSE velocity_kmh + (nv - velocity_kmh) * k / miss END AS v,
                   CASE WHEN k = 0 THEN lat ELSE lat + (nl - lat) * k / miss END AS la
                 FROM m, unnest(generate_series(0, greatest(coalesce(miss, 1) - 1, 0))) AS u(k))
           SELECT traj_id, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY src, k) - 1 AS BIGINT) AS seq,
                  round(t, 3) AS time, round(v, 6) AS velocity_kmh, round(la, 6) AS lat
           FROM e""",
    views=["raw_drive_gaps"],
)
def w4(spark, d):
    raw = tb.raw_drive(spark, d, with_gaps=True)
    x = sr.gap_fill(raw, ["traj_id"], "seq", "time", ["velocity_kmh", "lat"])
    return x.select("traj_id", "seq", R("time", 3), R("velocity_kmh"), R("lat"))


@register(
    "w6_moving_average", "W6",
    sql="""SELECT traj_id, seq, round(round(avg_v, 6) / 100, 6) AS moving_avg FROM (
             SELECT traj_id, seq, sum(velocity_kmh) OVER (PARTITION BY traj_id ORDER BY seq
                    ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS avg_v FROM drive_type) WHERE seq >= 99""",
    views=["drive_type"],
)
def w6(spark, d):
    x = sr.moving_sum(tb.drive_type(spark, d), ["traj_id"], "seq", "velocity_kmh", 100, "moving_sum")
    return x.select("traj_id", "seq", rnd(rnd("moving_sum") / 100, 6).alias("moving_avg"))


@register(
    "w7_trailing_average", "W7",
    sql="""SELECT traj_id, seq, round(round(sum(speed) OVER w, 6) / count(*) OVER w, 6) AS trailing_avg
           FROM drive_user WINDOW w AS (PARTITION BY traj_id ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    views=["drive_user"],
)
def w7(spark, d):
    x = sr.trailing_avg(tb.drive_user(spark, d), ["traj_id"], "seq", "speed", 10, denoise=6)
    return x.select("traj_id", "seq", R("trailing_avg"))


@register(
    "w8_rolling_mpg_ratio", "W8",
    sql="""SELECT run_id, id_num, step, round(sm / sg + 1e-6, 6) AS rolling_ratio FROM (
             SELECT run_id, id_num, step,
                    sum(speed / 1609.34e0 * 1e-1) OVER w AS sm, sum(fuel / 3600e0 * 1e-1) OVER w AS sg
             FROM fuel_log WINDOW w AS (PARTITION BY run_id, id_num ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
           WHERE step >= 19""",
    views=["veh_log"], ctes=LOG_CTES,
)
def w8(spark, d):
    x = fuel_log(spark, d).withColumns({"_m": ph.miles_per_step("speed"), "_g": ph.gallons_per_step("fuel")})
    x = sr.rolling_ratio(x, ["run_id", "id_num"], "step", "_m", "_g", 20)
    return x.select("run_id", "id_num", "step", R("rolling_ratio"))


@register(
    "w9_cumulative_fuel", "W9",
    sql="""SELECT run_id, id_num, step, round(te, 3) AS total_energy, round(tm, 6) AS total_miles,
                  round(te / 3600e0 * 1e-1, 6) AS total_gallons, round(tm / (te / 3600e0 * 1e-1 + 1e-6), 6) AS avg_mpg
           FROM (SELECT run_id, id_num, step,
                        sum(fuel) OVER (PARTITION BY run_id, id_num ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS te,
                        (position - first_value(position) OVER (PARTITION BY run_id, id_num ORDER BY step)) / 1609.34e0 AS tm
                 FROM fuel_log)""",
    views=["veh_log"], ctes=LOG_CTES,
)
def w9(spark, d):
    x = em.cumulative_fuel(fuel_log(spark, d))
    return x.select("run_id", "id_num", "step", R("total_energy", 3), R("total_miles"), R("total_gallons"), R("avg_mpg"))


@register(
    "w10_time_space_segments", "W10",
    sql="""SELECT run_id, id_num, step, t, round(position, 6) AS position, next_t, round(next_position, 6) AS next_position FROM (
             SELECT run_id, id_num, step, t, position, lead(t) OVER w AS next_t, lead(position) OVER w AS next_position
             FROM veh_log WINDOW w AS (PARTITION BY run_id, id_num ORDER BY step)) WHERE next_t IS NOT NULL""",
    views=["veh_log"],
)
def w10(spark, d):
    x = sr.next_point(tb.veh_log(spark, d), ["run_id", "id_num"], "step", ["t", "position"])
    return x.select("run_id", "id_num", "step", "t", R("position"), "next_t", R("next_position"))


@register(
    "w11_realized_accel", "W11",
    sql="""SELECT run_id, id_num, step, round(accel, 6) AS accel FROM acc""",
    views=["veh_log"], ctes=LOG_CTES[:1],
)
def w11(spark, d):
    return em.realized_accel(tb.veh_log(spark, d)).select("run_id", "id_num", "step", R("accel"))


@register(
    "w12_sharp_events", "W12",
    sql="""SELECT traj_id, CAST(count(CASE WHEN a < -1.5e0 THEN 1 END) AS BIGINT) AS sharp_braking,
                  CAST(count(CASE WHEN a > 1e0 THEN 1 END) AS BIGINT) AS sharp_accel, count(a) AS n_windows
           FROM (SELECT traj_id, (lead(velocity_kmh, 50) OVER w - velocity_kmh) / (lead(time, 50) OVER w - time) / 3.6e0 AS a
                 FROM raw_drive WINDOW w AS (PARTITION BY traj_id ORDER BY seq)) GROUP BY traj_id""",
    views=["raw_drive"],
)
def w12(spark, d):
    return sr.sharp_events(tb.raw_drive(spark, d), ["traj_id"], "seq", "time", "velocity_kmh")


@register(
    "w14_lag_features", "W14,W15",
    sql="""SELECT run_id, id_num, step, coalesce(lag(speed, 1) OVER w, 0e0) AS speed_lag1,
                  coalesce(lag(speed, 2) OVER w, 0e0) AS speed_lag2, coalesce(lag(speed, 3) OVER w, 0e0) AS speed_lag3
           FROM veh_log WINDOW w AS (PARTITION BY run_id, id_num ORDER BY step)""",
    views=["veh_log"],
)
def w14(spark, d):
    x = sr.lag_features(tb.veh_log(spark, d), ["run_id", "id_num"], "step", "speed", 3)
    return x.select("run_id", "id_num", "step", "speed_lag1", "speed_lag2", "speed_lag3")


@register(
    "w16_steps_since_seen", "W16",
    sql="""SELECT traj_id, seq, CAST(least(CASE WHEN last_seen IS NULL THEN 999999 ELSE seq - last_seen END, 10) AS BIGINT) AS steps_since_seen
           FROM (SELECT traj_id, seq, last(CASE WHEN speed >= 3e1 THEN seq END IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY seq
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_seen FROM drive_user)""",
    views=["drive_user"],
)
def w16(spark, d):
    x = sr.steps_since_seen(tb.drive_user(spark, d), ["traj_id"], "seq", F.col("speed") >= 30.0, 10)
    return x.select("traj_id", "seq", F.col("steps_since_seen").cast("long").alias("steps_since_seen"))


@register(
    "w19_valid_switch_pairs", "W19,P6,P10,K7",
    sql=f"""WITH b AS (
              SELECT traj_id, seq, lat, lon,
                     (lon < -86.58e0 AND lon > -86.685e0 AND lat > 35.98e0 AND lat < 36.07e0) AS valid,
                     coalesce({bearing_sql('radians(lat)', 'radians(lon)', 'radians(lead(lat) OVER w)', 'radians(lead(lon) OVER w)')}, 0e0) AS bearing
              FROM raw_drive WINDOW w AS (PARTITION BY traj_id ORDER BY seq)),
            s AS (SELECT traj_id, seq, valid, lead(valid) OVER (PARTITION BY traj_id ORDER BY seq) AS nv,
                         CASE WHEN bearing > 270 AND bearing < 360 THEN 'West' WHEN bearing > 90 AND bearing < 190 THEN 'East' END AS dir
                  FROM b),
            sw AS (SELECT traj_id, seq, dir, row_number() OVER (PARTITION BY traj_id ORDER BY seq) - 1 AS n FROM s WHERE nv IS NOT NULL AND valid <> nv),
            p AS (SELECT a.traj_id, a.n, a.seq AS start_row, c.seq AS end_row FROM sw a JOIN sw c
                    ON a.traj_id = c.traj_id AND c.n = a.n + 1 WHERE a.n % 2 = 0 AND a.dir = 'West')
            SELECT traj_id, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY n) - 1 AS BIGINT) AS k, start_row, end_row,
                   end_row - start_row AS n_rows FROM p""",
    views=["raw_drive"],
)
def w19(spark, d):
    x = sr.bearing_next(tb.raw_drive(spark, d), ["traj_id"], "seq")
    return sr.switch_pairs(x, ["traj_id"], "seq", ph.in_geofence("lat", "lon"), F.col("driving_dir"))


@register(
    "w19_valid_switch_pairs_east", "W19,P6,P10",
    sql=f"""WITH b AS (
              SELECT traj_id, seq, lat, lon,
                     (lon < -86.58e0 AND lon > -86.685e0 AND lat > 35.98e0 AND lat < 36.07e0) AS valid,
                     coalesce({bearing_sql('radians(lat)', 'radians(lon)', 'radians(lead(lat) OVER w)', 'radians(lead(lon) OVER w)')}, 0e0) AS bearing
              FROM raw_drive WINDOW w AS (PARTITION BY traj_id ORDER BY seq)),
            s AS (SELECT traj_id, seq, valid, lead(valid) OVER (PARTITION BY traj_id ORDER BY seq) AS nv,
                         CASE WHEN bearing > 270 AND bearing < 360 THEN 'West' WHEN bearing > 90 AND bearing < 190 THEN 'East' END AS dir
                  FROM b),
            sw AS (SELECT traj_id, seq, dir, row_number() OVER (PARTITION BY traj_id ORDER BY seq) - 1 AS n FROM s WHERE nv IS NOT NULL AND valid <> nv),
            p AS (SELECT a.traj_id, a.n, a.seq AS start_row, c.seq AS end_row FROM sw a JOIN sw c
                    ON a.traj_id = c.traj_id AND c.n = a.n + 1 WHERE a.n % 2 = 0 AND a.dir = 'East')
            SELECT traj_id, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY n) - 1 AS BIGINT) AS k, start_row, end_row,
                   end_row - start_row AS n_rows FROM p""",
    views=["raw_drive"],
    note="direction parameter East: the synthetic drives move east, so this variant exercises the pairing",
)
def w19e(spark, d):
    x = sr.bearing_next(tb.raw_drive(spark, d), ["traj_id"], "seq")
    return sr.switch_pairs(x, ["traj_id"], "seq", ph.in_geofence("lat", "lon"), F.col("driving_dir"), keep="East")


@register(
    "w20_last_row_per_vehicle", "W20",
    sql="""SELECT run_id, id_num, arg_max(step, step) AS step, round(arg_max(position, step), 6) AS position,
                  arg_max(speed, step) AS speed FROM veh_log GROUP BY run_id, id_num""",
    views=["veh_log"],
)
def w20(spark, d):
    x = sr.last_row(tb.veh_log(spark, d), ["run_id", "id_num"], "step", ["step", "position", "speed"])
    return x.select("run_id", "id_num", "step", R("position"), "speed")


@register(
    "w23_recent_mean", "W23",
    sql="""SELECT traj_id, seq, round(round(sum(velocity_kmh) OVER w, 6) / count(*) OVER w, 6) AS recent_mean
           FROM drive_type WINDOW w AS (PARTITION BY traj_id ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""",
    views=["drive_type"],
)
def w23(spark, d):
    x = sr.trailing_avg(tb.drive_type(spark, d), ["traj_id"], "seq", "velocity_kmh", 100, "recent_mean", denoise=6)
    return x.select("traj_id", "seq", R("recent_mean"))


MILE_ZERO = 74.3


@register(
    "d1_drive_preparation", "D1,W2,W3,W4,W5,W19,K7",
    sql=f"""WITH g AS (
              SELECT traj_id, seq, time, velocity_kmh, lat, lon, lead(time) OVER w AS nt, lead(velocity_kmh) OVER w AS nv,
                     lead(lat) OVER w AS nl, lead(lon) OVER w AS no
              FROM raw_drive_gaps WINDOW w AS (PARTITION BY traj_id ORDER BY seq)),
            m AS (SELECT *, CASE WHEN abs(nt - time - 1e-1) > 1e-3 THEN CAST(floor(round((nt - time) / 1e-1, 3)) AS INT) ELSE 1 END AS miss FROM g),
            e AS (SELECT traj_id, seq AS src, k,
                    CASE WHEN k = 0 THEN velocity_kmh ELSE velocity_kmh + (nv - velocity_kmh) * k / miss END AS v,
                    CASE WHEN k = 0 THEN lat ELSE lat + (nl - lat) * k / miss END AS lat,
                    CASE WHEN k = 0 THEN lon ELSE lon + (no - lon) * k / miss END AS lon
                  FROM m, unnest(generate_series(0, greatest(coalesce(miss, 1) - 1, 0))) AS u(k)),
            f AS (SELECT traj_id, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY src, k) - 1 AS BIGINT) AS seq, v, lat, lon FROM e),
            h AS (SELECT traj_id, seq, v, lat, lon, {hav_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step_m,
                         (lon < -86.58e0 AND lon > -86.685e0 AND lat > 35.98e0 AND lat < 36.07e0) AS valid,
                         coalesce({bearing_sql('radians(lat)', 'radians(lon)', 'radians(lead(lat) OVER w)', 'radians(lead(lon) OVER w)')}, 0e0) AS bearing
                  FROM f WINDOW w AS (PARTITION BY traj_id ORDER BY seq)),
            s AS (SELECT *, lead(valid) OVER (PARTITION BY traj_id ORDER BY seq) AS nvalid,
                         {MILE_ZERO!r}e0 - sum(coalesce(step_m, 0e0)) OVER (PARTITION BY traj_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS mile FROM h),
            sw AS (SELECT traj_id, seq, bearing > 90 AND bearing < 190 AS east, row_number() OVER (PARTITION BY traj_id ORDER BY seq) - 1 AS n
                   FROM s WHERE nvalid IS NOT NULL AND valid <> nvalid),
            p AS (SELECT a.traj_id, row_number() OVER (PARTITION BY a.traj_id ORDER BY a.n) - 1 AS k, a.seq AS start_row, c.seq AS end_row
                  FROM sw a JOIN sw c ON a.traj_id = c.traj_id AND c.n = a.n + 1 WHERE a.n % 2 = 0 AND a.east)
            SELECT p.traj_id || '_' || CAST(k AS VARCHAR) || '_' || CAST(end_row - start_row AS VARCHAR) AS name, count(*) AS n_rows,
                   round(max(mile), 3) AS first_mile, round(min(mile), 3) AS last_mile, round(sum(v), 3) AS sum_velocity
            FROM p JOIN s ON s.traj_id = p.traj_id AND s.seq >= p.start_row AND s.seq < p.end_row GROUP BY p.traj_id, k, start_row, end_row""",
    views=["raw_drive_gaps"],
    note="eastbound, the way the fixture drives; sub-trajectories written and read back",
)
def d1(spark, d):
    """Gap fill, smoothing, GPS distance, mile marker, bearing, geofence, direction, files."""
    import uuid

    keys = ["traj_id"]
    x = materialize(sr.gap_fill(tb.raw_drive(spark, d, with_gaps=True), keys, "seq", "time", ["velocity_kmh", "lat", "lon"]))
    pairs = sr.switch_pairs(sr.bearing_next(x, keys, "seq"), keys, "seq", ph.in_geofence("lat", "lon"), F.col("driving_dir"), keep="East")
    pairs = pairs.select(*keys, F.concat_ws("_", "traj_id", "k", "n_rows").alias("name"), "start_row", "end_row")
    smooth = sr.smooth(x, keys, "seq", "velocity_kmh").select(*keys, "seq", "smoothed")
    rows = sr.gps_distance(x, keys, "seq").join(smooth, [*keys, "seq"]).withColumn("mile_marker", MILE_ZERO - F.col("distance_gps"))
    inside = sr.rows_inside(rows, pairs, keys, "seq")
    place = f"{ensure_checkpoint_dir(spark)}/drives-{uuid.uuid4().hex}"
    inside.select("name", "seq", "velocity_kmh", "smoothed", "lat", "lon", "mile_marker").write.parquet(place)
    return spark.read.parquet(place).groupBy("name").agg(
        F.count(F.lit(1)).alias("n_rows"), rnd(F.max("mile_marker"), 3).alias("first_mile"), rnd(F.min("mile_marker"), 3).alias("last_mile"),
        rnd(F.sum("velocity_kmh"), 3).alias("sum_velocity"))
