"""Round trips through the file layouts of the readers (S1-S3, S6-S8): rows of ``events`` and of the vehicle log are written
as the folders and files that a reader expects, to the shared checkpoint folder, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import traffic as tf
from ..session import ensure_checkpoint_dir
from ..sources import files as fs
from ..sources import tables as tb
from ..sources.layout import write_files
from .core import register
from .traffic_q import D2_SQL


def _place(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


DRIVE_NAME = "CASE WHEN traj_id = 'view' THEN 'i680_view' ELSE traj_id END"


@register(
    "s1_drive_folders", "S1,F20",
    sql=f"""SELECT {DRIVE_NAME} AS traj_id, seq, round(seq * 1e-1, 6) AS time,
                   round(CASE WHEN traj_id = 'view' THEN velocity_kmh ELSE velocity_kmh / 3.6e0 END, 9) AS speed, (seq % 7) / 1e1 AS accel, lat, lon
            FROM raw_drive""",
    views=["raw_drive"],
    note="*/trajectory.csv; the drive named i680 is in m/s already",
)
def s1(spark, d):
    place = _place(spark, "drives")
    x = tb.raw_drive(spark, d).withColumn("file", F.concat(F.expr(DRIVE_NAME), F.lit("/trajectory.csv")))
    x = x.select("file", F.col("seq").alias("index"), F.col("time").alias("Time"), F.col("velocity_kmh").alias("Velocity"),
                 ((F.col("seq") % 7) / 10).alias("Acceleration"), F.col("lat").alias("LatitudeGPS"), F.col("lon").alias("LongitudeGPS"))
    write_files(x, place, "file", ["index"])
    r = fs.read_trajectories(spark, f"{place}/*/trajectory.csv")
    return r.select("traj_id", "seq", rnd("time", 6).alias("time"), rnd("speed", 9).alias("speed"), "accel", "lat", "lon")


@register(
    "s2_traffic_state_folders", "S2",
    sql="""WITH g AS (SELECT DISTINCT t, concat('week', t // 7) AS traj_id FROM tse),
                s AS (SELECT t, seg_idx, avg_speed, seg_start FROM tse)
           SELECT g.traj_id, CAST(g.t AS DOUBLE) AS t, CAST(k AS INT) AS seg_idx, s.avg_speed, s.avg_speed / 8 AS confidence, CAST(k AS DOUBLE) * g.t AS cvalue,
                  k * 1e3 - 1e3 AS seg_start
           FROM g CROSS JOIN unnest(range(0, 8)) AS u(k) LEFT JOIN s ON s.t = g.t AND s.seg_idx = k""",
    views=["tse"],
    note="speed, confidence and cvalue tables of a folder a week, with a segment list; segments without events are blank cells",
)
def s2(spark, d):
    place = _place(spark, "tse")
    t = tb.tse(spark, d)
    grid = t.select("t").distinct().withColumn("seg_idx", F.explode(F.sequence(F.lit(0), F.lit(7))))
    x = grid.join(t, ["t", "seg_idx"], "left").withColumn("folder", F.concat(F.lit("week"), F.floor(F.col("t") / 7).cast("string")))
    cells = {"speed": F.col("avg_speed"), "confidence": F.col("avg_speed") / 8, "cvalue": F.col("seg_idx").cast("double") * F.col("t")}
    lines = None
    for name, value in cells.items():
        body = x.groupBy("folder", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", value.cast("string").alias("v")))),
                                                        lambda s: F.coalesce(s["v"], F.lit(""))).alias("v"))  # eight cells a row
        body = body.select("folder", F.col("t").alias("_at"), F.concat_ws(",", F.col("t").cast("string"), F.array_join("v", ",")).alias("line"))
        head = x.select("folder").distinct().select("folder", F.lit(-1).cast("long").alias("_at"), F.lit("time, " + ", ".join(map(str, range(8)))).alias("line"))
        part = body.unionByName(head).withColumn("file", F.concat("folder", F.lit(f"/{name}.csv")))
        lines = part if lines is None else lines.unionByName(part)
    seg = x.select("folder").distinct().select("folder", F.lit(0).cast("long").alias("_at"), F.lit(str([1000.0 * k - 1000 for k in range(8)])).alias("line"),
                                               F.concat("folder", F.lit("/segments.json")).alias("file"))
    write_files(lines.unionByName(seg).select("file", "_at", "line"), place, "file", ["_at"], "text")
    return fs.read_tse(spark, f"{place}/week*").select("traj_id", "t", "seg_idx", "avg_speed", "confidence", "cvalue", "seg_start")


CONTROLLER = "CASE WHEN run_id % 3 = 0 THEN 'idm' WHEN run_id % 3 = 1 THEN 'rl_fs' ELSE 'rl' END"


@register(
    "s3_emission_files", "S3",
    sql=f"""SELECT {CONTROLLER} AS controller, concat('drive_', run_id) AS trajectory, step, id, round(speed, 6) AS speed, round(position, 6) AS position
            FROM veh_log""",
    views=["veh_log"],
    note="one log file a run; controller and trajectory are parsed from the file's name",
)
def s3(spark, d):
    place = _place(spark, "emissions")
    v = tb.veh_log(spark, d, keep=False).withColumn("file", F.concat(F.lit("x_"), F.expr(CONTROLLER), F.lit("_drive_"), F.col("run_id").cast("string"), F.lit(".csv")))
    given = {"time": F.col("t"), "step": F.col("step"), "id": F.col("id"), "position": F.col("position"), "speed": F.col("speed")}
    x = v.select("file", *(given.get(c, F.lit(None).cast("double")).alias(c) for c in fs.EMISSION_COLUMNS))
    write_files(x, place, "file", ["step", "id"])
    r = fs.read_emissions(spark, place)
    return r.select("controller", "trajectory", "step", "id", rnd("speed", 6).alias("speed"), rnd("position", 6).alias("position"))


DOCS_PER_FILE = 100


@register(
    "s6_situation_documents", "S6,F25",
    sql="""SELECT CAST(embedding[1] AS DOUBLE) AS speed, CAST(embedding[2] AS DOUBLE) AS headway, CAST(embedding[3] AS DOUBLE) AS leader_speed,
                  concat('keep ', label) AS action, concat('doc ', vec_id) AS situation_analysis FROM embeddings""",
    note="JSON arrays of up to 100 nested documents a file",
)
def s6(spark, d):
    place = _place(spark, "rag")
    e = tb.table(spark, d, "embeddings")
    num = lambda k: F.col("embedding")[k].cast("double")
    doc = F.to_json(F.struct(F.struct(num(0).alias("speed"), num(1).alias("headway"), num(2).alias("leader_speed")).alias("current_situation"),
                             F.concat(F.lit("keep "), F.col("label").cast("string")).alias("action"),
                             F.concat(F.lit("doc "), F.col("vec_id").cast("string")).alias("situation_analysis")))
    block = F.floor(F.col("vec_id") / DOCS_PER_FILE)
    x = e.groupBy(F.concat(F.lit("docs-"), block.cast("string"), F.lit(".json")).alias("file")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(doc), ","), F.lit("]")).alias("line"))  # a block of ids: bounded
    write_files(x, place, "file", [], "text")
    return fs.read_rag_json(spark, place).select("current_situation.*", "action", "situation_analysis")


@register(
    "s7_road_fit_file", "S7",
    sql="""SELECT CAST(hour(ts) AS DOUBLE) AS interval_number, hour(ts) * 5e-1 AS interval_start, hour(ts) * 5e-1 + 5e-1 AS interval_end,
                  round(avg(value), 6) AS slope, CAST(min(event_id) AS DOUBLE) AS intercept FROM events GROUP BY hour(ts)""",
    note="a fit table of half-mile intervals whose terms are hourly statistics of the events",
)
def s7(spark, d):
    place = _place(spark, "fit")
    h = F.hour("ts").cast("double")
    x = tb.table(spark, d, "events").groupBy(h.alias("interval_number")).agg(rnd(F.avg("value"), 6).alias("slope"), F.min("event_id").cast("double").alias("intercept"))
    x = x.select(F.lit("grade/fit.csv").alias("file"), "interval_number", (F.col("interval_number") * 0.5).alias("interval_start"),
                 (F.col("interval_number") * 0.5 + 0.5).alias("interval_end"), "slope", "intercept")
    write_files(x, place, "file", ["interval_number"])
    return fs.read_road_fit(spark, f"{place}/grade/fit.csv")


@register(
    "s8_traffic_state_file", "S8,K6,D2",
    sql=D2_SQL + """
SELECT seg.traj_id AS drive, s.st AS state, CAST(seg.start AS INT) AS start, CAST(seg."end" AS INT) AS "end"
FROM seg JOIN s ON s.traj_id = seg.traj_id AND s.seq = seg.lab""",
    views=["drive_type"],
    note="lists of [start, end] by state in the cells of one csv, a row a drive",
)
def s8(spark, d):
    place = _place(spark, "states")
    x = tb.drive_type(spark, d).withColumn("state", tf.traffic_state(F.col("velocity_kmh")))
    seg = tf.segment_states(x, ["traj_id"], "seq", "state")
    cell = lambda s: F.to_json(F.array_sort(F.collect_list(F.when(F.col("state") == s, F.array("start", "end")))))
    wide = seg.groupBy(F.col("traj_id").alias("data")).agg(*(cell(s).alias(s) for s in ("freeflow", "congestion", "dense")))
    write_files(wide.withColumn("file", F.lit("traffic_state.csv")), place, "file", ["data"])
    return fs.read_traffic_state(spark, f"{place}/traffic_state.csv")
