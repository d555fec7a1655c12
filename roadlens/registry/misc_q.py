"""Remaining windows, platoon-state metrics, string builders, projections, sinks and UDFs
(W5, W22, A12, A25, A26, F6, F26-F29, F31, P1, P9, K1, K3, K7, G1, G3)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.numeric import rnd
from ..operators import retrieval as rt
from ..operators import series as sr
from ..operators import joins as jn
from ..operators import sinks as sk
from ..operators import traffic as tf
from ..session import ensure_checkpoint_dir
from ..sources import tables as tb
from .core import register
from .joins_q import PROBE_SCALE
from .metrics_q import CUM_CTES, cum_log
from .phys_q import with_leader
from .sqlfrag import LEAD_CTES


@register(
    "w5_smoothing", "W5",
    sql="""WITH RECURSIVE p AS (
             SELECT traj_id, seq, velocity_kmh AS v, 0 AS k FROM drive_type
             UNION ALL
             SELECT traj_id, seq, 4.5e-1 * coalesce(lag(v) OVER w, v) + 1e-1 * v + 4.5e-1 * coalesce(lead(v) OVER w, v), k + 1
             FROM p WHERE k < 50 WINDOW w AS (PARTITION BY traj_id ORDER BY seq))
           SELECT traj_id, seq, round(v, 6) AS smoothed FROM p WHERE k = 50""",
    views=["drive_type"],
    note="50 passes of 3-tap smoothing as one 101-tap window; the oracle makes the passes",
)
def w5(spark, d):
    x = sr.smooth(tb.drive_type(spark, d), ["traj_id"], "seq", "velocity_kmh", passes=50, mu=0.9)
    return x.select("traj_id", "seq", rnd("smoothed", 6).alias("smoothed"))


@register(
    "w22_queue_length", "W22",
    sql="""WITH o AS (SELECT run_id, step, position, speed < 12 AS slow,
                             lag(speed < 12) OVER (PARTITION BY run_id, step ORDER BY position, id_num) AS pslow FROM veh_log),
                i AS (SELECT *, sum(CASE WHEN pslow IS NULL OR slow <> pslow THEN 1 ELSE 0 END)
                                OVER (PARTITION BY run_id, step ORDER BY position ROWS UNBOUNDED PRECEDING) AS isl FROM o),
                q AS (SELECT run_id, step, isl, max(position) - min(position) AS ext FROM i WHERE slow GROUP BY 1, 2, 3)
           SELECT s.run_id, s.step, round(coalesce(sum(q.ext), 0e0), 6) AS queue_length
           FROM (SELECT DISTINCT run_id, step FROM veh_log) s LEFT JOIN q ON q.run_id = s.run_id AND q.step = s.step
           GROUP BY s.run_id, s.step""",
    views=["veh_log"],
    note="dormant in the source; slow = speed < 12 m/s, islands along position per step",
)
def w22(spark, d):
    v = tb.veh_log(spark, d)
    w = Window.partitionBy("run_id", "step").orderBy("position", "id_num")
    x = v.withColumn("slow", F.col("speed") < 12).withColumn("_p", F.lag("slow").over(w))
    x = x.withColumn("isl", F.sum(F.when(F.col("_p").isNull() | (F.col("slow") != F.col("_p")), 1).otherwise(0))
                     .over(w.rowsBetween(Window.unboundedPreceding, 0)))
    q = x.filter("slow").groupBy("run_id", "step", "isl").agg((F.max("position") - F.min("position")).alias("ext"))
    s = v.select("run_id", "step").distinct().join(q, ["run_id", "step"], "left")
    return s.groupBy("run_id", "step").agg(rnd(F.coalesce(F.sum("ext"), F.lit(0.0)), 6).alias("queue_length"))


@register(
    "a12_platoon_step_state", "A12",
    sql="""WITH v AS (SELECT run_id, step, id_num, id, speed, total_miles, total_gallons,
                             sum(CASE WHEN id LIKE '%av%' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, step ORDER BY id_num
                                 ROWS UNBOUNDED PRECEDING) AS pl FROM cum),
                p AS (SELECT *, first_value(id_num) OVER (PARTITION BY run_id, step, pl ORDER BY id_num) AS av_id,
                             row_number() OVER (PARTITION BY run_id, step, pl ORDER BY id_num) AS rn FROM v WHERE pl > 0)
           SELECT run_id, step, av_id, count(*) AS n_followers, round(avg(speed), 6) AS platoon_speed,
                  round(sum(total_miles) / sum(total_gallons), 6) AS platoon_mpg
           FROM p WHERE rn BETWEEN 2 AND 6 AND id_num - av_id = rn - 1 GROUP BY run_id, step, av_id""",
    views=["veh_log"], ctes=CUM_CTES,
)
def a12(spark, d):
    c = cum_log(spark, d)
    w = Window.partitionBy("run_id", "step").orderBy("id_num")
    x = c.withColumn("pl", F.sum(F.when(F.col("id").contains("av"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.filter("pl > 0")
    wp = Window.partitionBy("run_id", "step", "pl").orderBy("id_num")
    x = x.withColumn("av_id", F.first("id_num").over(wp)).withColumn("rn", F.row_number().over(wp))
    x = x.filter((F.col("rn").between(2, 6)) & (F.col("id_num") - F.col("av_id") == F.col("rn") - 1))
    return x.groupBy("run_id", "step", "av_id").agg(
        F.count(F.lit(1)).alias("n_followers"), rnd(F.avg("speed"), 6).alias("platoon_speed"),
        rnd(F.try_divide(F.sum("total_miles"), F.sum("total_gallons")), 6).alias("platoon_mpg"))


@register(
    "a25_step_context", "A25",
    sql="""WITH h AS (SELECT run_id, max(step) AS horizon FROM cum GROUP BY run_id)
           SELECT c.run_id, c.step, round(avg(CASE WHEN id LIKE '%av%' THEN total_miles END), 9) AS avg_miles,
                  round(avg(CASE WHEN id LIKE '%av%' THEN total_gallons + 1e-6 END), 9) AS avg_gallons,
                  round(c.step / any_value(h.horizon), 6) AS time_frac,
                  max(CASE WHEN id_num = 1 THEN position END) AS av_pos
           FROM cum c JOIN h ON h.run_id = c.run_id GROUP BY c.run_id, c.step""",
    views=["veh_log"], ctes=CUM_CTES,
)
def a25(spark, d):
    c = cum_log(spark, d)
    h = c.groupBy("run_id").agg(F.max("step").alias("horizon"))
    av = F.col("id").contains("av")
    g = c.groupBy("run_id", "step").agg(
        rnd(F.avg(F.when(av, F.col("total_miles"))), 9).alias("avg_miles"),
        rnd(F.avg(F.when(av, F.col("total_gallons") + 1e-6)), 9).alias("avg_gallons"),
        F.max(F.when(F.col("id_num") == 1, F.col("position"))).alias("av_pos"))
    g = g.join(h, "run_id")
    return g.select("run_id", "step", "avg_miles", "avg_gallons", rnd(F.col("step") / F.col("horizon"), 6).alias("time_frac"), "av_pos")


@register(
    "a26_first_x_at_boundary", "A26,L1",
    sql="""WITH st AS (SELECT traj_id, min(seq) AS mn, max(seq) AS mx FROM drive_type GROUP BY traj_id),
                b AS (SELECT traj_id, unnest((CASE WHEN 575 <> mn THEN [mn] ELSE [] END) || [575, 1000, 1500]
                                      || (CASE WHEN 1500 <> mx THEN [mx] ELSE [] END)) AS boundary FROM st)
           SELECT b.traj_id, b.boundary, min(d.seq * 1e-1) AS boundary_x
           FROM b JOIN drive_type d ON d.traj_id = b.traj_id AND d.seq = b.boundary GROUP BY b.traj_id, b.boundary""",
    views=["drive_type"],
)
def a26(spark, d):
    x = tb.drive_type(spark, d).withColumn("time", F.col("seq") * 0.1)
    st = x.groupBy("traj_id").agg(F.min("seq").alias("_mn"), F.max("seq").alias("_mx"))
    b = st.select("traj_id", F.explode(F.concat(
        F.when(F.col("_mn") != 575, F.array("_mn")).otherwise(F.array().cast("array<long>")),
        F.array(F.lit(575), F.lit(1000), F.lit(1500)).cast("array<long>"),
        F.when(F.col("_mx") != 1500, F.array("_mx")).otherwise(F.array().cast("array<long>")))).alias("boundary"))
    j = b.join(x, (b.traj_id == x.traj_id) & (x.seq == b.boundary)).select(b.traj_id, "boundary", "time")
    return j.groupBy("traj_id", "boundary").agg(F.min("time").alias("boundary_x"))


@register(
    "f26_config_merge", "F26",
    sql="""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1) AS k,
                  coalesce(TRY_CAST(json_extract_string(props, '$.j') AS INT), 0) AS j FROM events""",
    note="defaults {k: -1, j: 0} overridden by each event's props",
)
def f26(spark, d):
    e = tb.table(spark, d, "events")
    defaults = F.create_map(F.lit("k"), F.lit(-1), F.lit("j"), F.lit(0))
    m = tx.merge_config(defaults, F.from_json("props", "map<string,int>"))
    return e.select("event_id", m["k"].alias("k"), m["j"].alias("j"))


PLATOON_SPEC_SQL = ("'(av human*' || CAST(o_custkey % 5 + 1 AS VARCHAR) || ')*' || CAST(o_orderkey % 3 + 1 AS VARCHAR)"
                    " || CASE WHEN o_orderkey % 2 = 0 THEN ' av#sensor' ELSE '' END")


@register(
    "f27_platoon_expansion", "F27,G5",
    sql="""SELECT o_orderkey AS platoon_id,
                  CAST((o_orderkey % 3 + 1) * (o_custkey % 5 + 2) + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_vehicles,
                  CAST((o_orderkey % 3 + 1) + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_av,
                  CAST((o_orderkey % 3 + 1) * (o_custkey % 5 + 1) AS BIGINT) AS n_human,
                  CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_tagged
           FROM orders""",
    note="platoon strings '(av human*a)*b [av#sensor]' built from orders; counts follow arithmetically",
)
def f27(spark, d):
    o = tb.table(spark, d, "orders")
    spec = F.concat(F.lit("(av human*"), (F.col("o_custkey") % 5 + 1).cast("string"), F.lit(")*"),
                    (F.col("o_orderkey") % 3 + 1).cast("string"),
                    F.when(F.col("o_orderkey") % 2 == 0, " av#sensor").otherwise(""))
    v = o.select(F.col("o_orderkey").alias("platoon_id"), F.posexplode(tx.expand_platoon(spec)).alias("pos", "veh"))
    return v.groupBy("platoon_id").agg(
        F.count(F.lit(1)).alias("n_vehicles"), F.count_if(F.col("veh.kind") == "av").cast("long").alias("n_av"),
        F.count_if(F.col("veh.kind") == "human").cast("long").alias("n_human"),
        F.count_if(F.size("veh.tags") > 0).cast("long").alias("n_tagged"))


@register(
    "f28_markdown_windows", "F28,L2",
    sql="""SELECT run_id, id_num, start, '| step | speed |' || chr(10) || '| ---- | ----- |' || chr(10) || array_to_string(rows, chr(10)) AS markdown
           FROM (SELECT run_id, id_num, step AS start,
                        list('| ' || CAST(step AS VARCHAR) || ' | ' || CAST(round(speed, 4) AS VARCHAR) || ' |' ORDER BY step)
                          OVER (PARTITION BY run_id, id_num ORDER BY step ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS rows
                 FROM veh_log) WHERE len(rows) = 10""",
    views=["veh_log"],
)
def f28(spark, d):
    v = tb.veh_log(spark, d).withColumn("speed4", rnd("speed", 4))
    w = rt.sliding_windows(v, ["run_id", "id_num"], "step", ["step", "speed4"], 10)
    body = tx.markdown_rows(F.col("rows"), ["step", "speed4"])
    return w.select("run_id", "id_num", "start", F.concat(F.lit("| step | speed |\n| ---- | ----- |\n"), body).alias("markdown"))


@register(
    "f6_f29_situation_prompt", "F6,F29,F25",
    sql="""SELECT run_id, id_num, step, 'Current situation: ' || 'speed: ' || CAST(round(speed, 2) AS VARCHAR) || ', headway: '
                  || CAST(round(headway, 2) AS VARCHAR) || ', leader_speed: ' || CAST(round(leader_speed, 2) AS VARCHAR) AS prompt
           FROM lead_log WHERE leader_speed IS NOT NULL""",
    views=["veh_log"], ctes=LEAD_CTES,
)
def f6(spark, d):
    x = with_leader(spark, d)
    situation = F.struct(rnd("speed", 2).alias("speed"), rnd("headway", 2).alias("headway"), rnd("leader_speed", 2).alias("leader_speed"))
    x = x.withColumn("current_situation", situation)
    text = tx.kv_text([(k, F.col(f"current_situation.{k}")) for k in ("speed", "headway", "leader_speed")])
    return x.select("run_id", "id_num", "step", F.format_string("Current situation: %s", text).alias("prompt"))


F31_K = 3


def _f31_sql():
    pairs = ", ".join(
        f"CASE WHEN n_real > {j} THEN round(sp[{j + 2}], 6) ELSE -1e0 END AS seg_{j}_speed, "
        f"CASE WHEN n_real > {j} THEN round(di[{j + 1}] - position, 6) ELSE -1e0 END AS seg_{j}_dist" for j in range(F31_K))
    return f"""WITH prof AS (SELECT DISTINCT t FROM tse),
      probe AS (SELECT run_id, id_num, step, position, step * 3.5e-1 AS probe_t FROM veh_log),
      m AS (SELECT p.*, coalesce(a.t, (SELECT min(t) FROM prof)) AS t FROM probe p ASOF LEFT JOIN prof a ON p.probe_t >= a.t),
      k AS (SELECT t, list(seg_start ORDER BY seg_idx) AS xs, list(avg_speed ORDER BY seg_idx) AS zs FROM tse GROUP BY t),
      j AS (SELECT m.*, xs, zs, len(list_filter(xs, lambda s: s <= m.position)) - 1 AS i FROM m JOIN k ON k.t = m.t),
      s AS (SELECT *, list_slice(zs, greatest(i, 0) + 1, i + {F31_K} + 1) AS sp, list_slice(xs, i + 2, i + {F31_K} + 1) AS di FROM j),
      n AS (SELECT *, greatest(least(len(sp) - 1, len(di)), 0) AS n_real FROM s)
      SELECT run_id, id_num, step, CAST(n_real AS INT) AS n_real, CASE WHEN len(sp) > 0 THEN round(sp[1], 6) ELSE -1e0 END AS local_speed, {pairs} FROM n"""


@register(
    "f31_padded_profile_features", "F31,D3,J1,J2",
    sql=_f31_sql(), views=["veh_log", "tse"],
    note="per logged row: speed of the own segment, then (speed, distance) of the next 3, -1 beyond the profile",
)
def f31(spark, d):
    v = tb.veh_log(spark, d, keep=False).select("run_id", "id_num", "step", "position", (F.col("step") * PROBE_SCALE).alias("probe_t"))
    m = jn.asof_join(v, tb.tse(spark, d).select("t").distinct(), [], "probe_t", "t", []).withColumnRenamed("t_match", "t")
    x = m.join(tf.profile_arrays(tb.tse(spark, d), ["t"], "seg_start", "avg_speed"), "t")
    x = x.withColumn("i", F.size(F.filter("xs", lambda s: s <= F.col("position"))) - 1)
    x = x.withColumn("sp", F.slice("zs", F.greatest(F.col("i"), F.lit(0)) + 1, F.col("i") + F31_K + 1 - F.greatest(F.col("i"), F.lit(0))))
    x = x.withColumn("di", F.transform(F.slice("xs", F.col("i") + 2, F31_K), lambda s: s - F.col("position")))
    x = x.withColumn("n_real", F.greatest(F.least(F.size("sp") - 1, F.size("di")), F.lit(0)))
    speeds = tx.pad_to(F.slice(F.slice("sp", 2, F31_K), F.lit(1), F.col("n_real")), F31_K)
    dists = tx.pad_to(F.slice("di", F.lit(1), F.col("n_real")), F31_K)
    x = x.withColumn("fs", speeds).withColumn("fd", dists)
    pairs = [c for j in range(F31_K) for c in (rnd(F.col("fs")[j], 6).alias(f"seg_{j}_speed"), rnd(F.col("fd")[j], 6).alias(f"seg_{j}_dist"))]
    return x.select("run_id", "id_num", "step", "n_real", rnd(F.coalesce(F.get("sp", F.lit(0)), F.lit(-1.0)), 6).alias("local_speed"), *pairs)


@register(
    "p1_k3_wide_vehicle_columns", "P1,P2,K3",
    sql="""SELECT run_id, step, max(CASE WHEN id_num = 1 THEN speed END) AS speed, max(CASE WHEN id_num = 1 THEN position END) AS position
           FROM veh_log GROUP BY run_id, step""",
    views=["veh_log"],
    note="wide {veh}__{key} table for all 15 vehicles, then vehicle 1's columns by prefix, prefix stripped",
)
def p1(spark, d):
    v = tb.veh_log(spark, d)
    wide = sk.wide_by_vehicle(v, ["run_id", "step"], "id_num", ["speed", "position"], list(range(15)))
    cols = [c for c in wide.columns if c.startswith("1__")]
    return wide.select("run_id", "step", *cols).withColumnsRenamed({c: c[len("1__"):] for c in cols})


@register(
    "p9_seeded_sample", "P9",
    sql="""SELECT event_id, user_id, value FROM events WHERE (event_id * 2654435761 + 42) % 1000 < 300""",
    note="Bernoulli sample frac 0.3 with a seeded integer hash (reproducible; the sampling is the operator)",
)
def p9(spark, d):
    e = tb.table(spark, d, "events")
    keep = F.pmod(F.pmod("event_id", F.lit(1000)) * (2654435761 % 1000) + 42, F.lit(1000)) < 300  # reduced first: no key overflows
    return e.filter(keep).select("event_id", "user_id", "value").sortWithinPartitions("value")


@register(
    "k1_sorted_emissions_sink", "K1,T1",
    sql="SELECT run_id, id_num, step, position FROM veh_log",
    views=["veh_log"],
    note="written range-partitioned on time and sorted by (time, id), read back",
)
def k1(spark, d):
    import uuid

    v = tb.veh_log(spark, d).select("run_id", "id_num", "step", "position", F.col("t").alias("time"), "id")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sinks/emissions-{uuid.uuid4().hex[:10]}"
    sk.write_emissions(v, path)
    return spark.read.parquet(path).select("run_id", "id_num", "step", "position")


@register(
    "k7_subtrajectory_files", "K7,D12",
    sql="""WITH n AS (SELECT traj_id, count(*) AS n FROM drive_user GROUP BY traj_id),
                dr AS (SELECT traj_id, n, d AS draw,
                              CASE WHEN n <= 20 THEN 0 ELSE ((traj_id * 2654435761 + d * 40503 + 42) % greatest(n - 20 + 1, 1)) END AS start
                       FROM n, unnest(generate_series(0, 1)) AS g(d))
           SELECT CAST(u.traj_id AS VARCHAR) || '_' || CAST(dr.draw AS VARCHAR) || '_' || CAST(count(*) AS VARCHAR) AS name, count(*) AS n_rows
           FROM drive_user u JOIN dr ON dr.traj_id = u.traj_id WHERE u.seq >= dr.start AND u.seq < dr.start + 20
           GROUP BY u.traj_id, dr.draw""",
    views=["drive_user"],
    note="chunks written one folder per name {traj}_{k}_{len}, read back",
)
def k7(spark, d):
    import uuid

    u = tb.drive_user(spark, d)
    c = tf.random_chunks(u, ["traj_id"], "seq", 20, 2, 42, F.col("traj_id"))
    n = c.groupBy("traj_id", "draw").agg(F.count(F.lit(1)).alias("_len"))
    c = c.join(n, ["traj_id", "draw"]).withColumn(
        "name", F.concat_ws("_", F.col("traj_id").cast("string"), F.col("draw").cast("string"), F.col("_len").cast("string")))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sinks/subtraj-{uuid.uuid4().hex[:10]}"
    sk.write_subtrajectories(c.select("name", "seq", "speed"), path, key="name")
    back = sk.read_subtrajectories(spark, path, "seq long, speed double, name string", key="name")
    return back.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


_NUM = re.compile(r"[-+]?[0-9]*\.?[0-9]+")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def numeric_embedding_udf(texts: pd.Series) -> pd.Series:
    """Batch embedding model as an Arrow-batched pandas UDF (the numeric embedding;
    a sentence model plugs in the same way)."""
    return texts.map(lambda t: [float(v) for v in _NUM.findall(t)] if t is not None else None)


@register(
    "g3_pandas_udf_embedding", "G3,G1",
    sql="""SELECT doc_id, CAST(len(v) AS BIGINT) AS n_numbers, list_max(v) AS max_number FROM (
             SELECT doc_id, list_transform(regexp_extract_all(text, '[-+]?[0-9]*\\.?[0-9]+'), lambda x: CAST(x AS DOUBLE)) AS v
             FROM documents)""",
)
def g3(spark, d):
    def embed(df):  # G1: a user trajectory_processor plugged with DataFrame.transform
        return df.withColumn("v", numeric_embedding_udf("text"))

    e = tb.table(spark, d, "documents").select("doc_id", "text").transform(embed)
    return e.select("doc_id", F.size("v").cast("long").alias("n_numbers"), F.array_max("v").alias("max_number"))
