"""Parts of operators that other queries leave out: memories and acceleration lags (W14, W15), all reward parts (F17), the
target-speed branch (F18), distance search (F22), the full window text (F28), the prompt with documents and the
window record (F29, L12), neighbour distances and the other profiles (D3), the overlay series (D18), index vectors
(R1), scenario and admission scores (R5, R6), the stored wide table (K3, P1) and the step context of every AV (A25)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import physics as ph
from ..functions import text as tx
from ..functions import vectors as vx
from ..functions.numeric import rnd
from ..operators import joins as jn
from ..operators import metrics as mt
from ..operators import retrieval as rt
from ..operators import series as sr
from ..operators import sinks as sk
from ..operators import traffic as tf
from ..plans.blocks import over_blocks
from ..session import ensure_checkpoint_dir, materialize
from ..sources import tables as tb
from .core import register
from .metrics_q import CUM_CTES, cum_log
from .more_q import PROBE_SCALE
from .phys_q import MPH_SQL, with_leader
from .retr_q import _dot, queries_, store
from .sqlfrag import LEAD_CTES, tag_sql, values_sql

K = ["run_id", "id_num", "step"]


def _listed(xs: str) -> str:
    """A list of numbers as text, six places each, the same in both engines."""
    return f"array_to_string(list_transform({xs}, lambda v: CAST(CAST(floor(v * 1e6 + 5e-1) AS BIGINT) AS VARCHAR)), ' ')"


def listed(xs):
    return F.array_join(F.transform(xs, lambda v: F.floor(v * 1e6 + 0.5).cast("string")), " ")


@register(
    "w14_w15_state_memory", "W14,W15",
    sql="""WITH x AS (SELECT * FROM lead_log WHERE leader_speed IS NOT NULL)
           SELECT x.run_id, x.id_num, x.step, accel AS accel_past_1, coalesce(lag(accel, 1) OVER w, 0e0) AS accel_past_2, coalesce(lag(accel, 2) OVER w, 0e0) AS accel_past_3,
                  coalesce(lag(leader_speed, 1) OVER w, 0e0) AS leader_speed_1, coalesce(lag(leader_speed, 2) OVER w, 0e0) AS leader_speed_2,
                  coalesce(m0.v, 0e0) AS speed_second_0, coalesce(m1.v, 0e0) AS speed_second_1
           FROM x LEFT JOIN (SELECT run_id AS r, id_num AS i, step AS s, speed AS v FROM x) m0 ON m0.r = x.run_id AND m0.i = x.id_num AND m0.s = x.step // 10 * 10
           LEFT JOIN (SELECT run_id AS r, id_num AS i, step AS s, speed AS v FROM x) m1 ON m1.r = x.run_id AND m1.i = x.id_num AND m1.s = x.step // 10 * 10 - 10
           WINDOW w AS (PARTITION BY x.run_id, x.id_num ORDER BY x.step)""",
    views=["veh_log"], ctes=LEAD_CTES,
    note="memory of the last full seconds beside lags of 0.1 s, for rows with a leader",
)
def w14(spark, d):
    x = sr.memory_features(with_leader(spark, d), ["run_id", "id_num"], "step", {"accel": 3}, {"speed": 2}, {"leader_speed": 2})
    return x.select(*K, *[f"accel_past_{i}" for i in (1, 2, 3)], "leader_speed_1", "leader_speed_2", "speed_second_0", "speed_second_1")


WEIGHTS = ph.REWARD | {"intervention_penalty": 2.0, "headway_penalty": 0.05, "speed_diff_weight": 0.01, "accel_delta_weight": 0.3, "max_headway": 60.0}


@register(
    "f17_all_reward_parts", "F17",
    sql="""WITH x AS (SELECT *, lag(accel) OVER (PARTITION BY run_id, id_num ORDER BY step) AS a0 FROM lead_log WHERE id LIKE '%av%' AND leader_speed IS NOT NULL),
                p AS (SELECT run_id, id_num, step, CASE WHEN headway < 0 THEN -5e1 ELSE 0e0 END AS crash, -1e-1 * greatest(fuel, 0e0) AS energy, -2e-1 * (accel * accel) AS acc,
                             CASE WHEN headway > greatest(6e1, 0e0 * speed) OR headway < 6 * ((speed + 1 + speed * 4 / 30) - leader_speed) THEN -4e-1 ELSE 0e0 END AS interv,
                             CASE WHEN headway > 1e1 AND speed > 1e0 THEN -5e-2 * (headway / speed) ELSE 0e0 END AS head,
                             -1e-2 * (2e1 - speed) * (2e1 - speed) AS sdiff, -3e-1 * (coalesce(a0, 0e0) - accel) * (coalesce(a0, 0e0) - accel) AS adelta FROM x)
           SELECT run_id, id_num, step, round((crash + energy + acc + interv + head + sdiff + adelta) / 1e1, 6) AS reward, round(interv, 6) AS intervention_reward,
                  round(head, 6) AS headway_reward, round(sdiff, 6) AS speed_diff_reward, round(adelta, 6) AS accel_delta_reward FROM p""",
    views=["veh_log"], ctes=LEAD_CTES,
    note="no weight is zero; target speed 20 m/s",
)
def f17(spark, d):
    x = with_leader(spark, d).filter(F.col("id").contains("av"))
    x = over_blocks(x, ["run_id", "id_num"], "step", 1, 0, lambda w: {"a0": F.coalesce(F.lag("accel", 1).over(w), F.lit(0.0))})
    r = ph.reward_components("headway", "speed", "leader_speed", "accel", "fuel", "a0", F.lit(20.0), WEIGHTS)
    return x.select(*K, *[rnd(r[c], 6).alias(c) for c in ("reward", "intervention_reward", "headway_reward", "speed_diff_reward", "accel_delta_reward")])


@register(
    "f18_target_speed_settings", "F18",
    sql=f"""SELECT run_id, id_num, step, round(greatest(round_even((CASE WHEN ts < leader_speed THEN ts * 6e-1 + leader_speed * 4e-1 ELSE ts END) / {MPH_SQL}, 0) * {MPH_SQL}, {MPH_SQL} * 20), 9)
                     AS speed_setting, CAST(CASE WHEN run_id % 2 = 0 THEN 1 ELSE 3 END AS INT) AS gap_setting
            FROM (SELECT *, speed * 9e-1 + 3e0 AS ts FROM lead_log WHERE leader_speed IS NOT NULL)""",
    views=["veh_log"], ctes=LEAD_CTES,
    note="target speed 0.9 v + 3; even runs have the headway flag",
)
def f18(spark, d):
    x = with_leader(spark, d).withColumn("ts", F.col("speed") * 0.9 + 3.0)
    on, off = (ph.acc_settings("speed", "leader_speed", "ts", flag) for flag in (True, False))
    even = F.col("run_id") % 2 == 0
    return x.select(*K, rnd(on["speed_setting"], 9).alias("speed_setting"), F.when(even, on["gap_setting"]).otherwise(off["gap_setting"]).alias("gap_setting"))


@register(
    "f22_negative_distance_top_k", "F22,R2",
    sql=f"""SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
                SELECT query_id, doc_id, -sqrt({_dot('df', 'df')}) AS score FROM (
                  SELECT q.vec_id AS query_id, s.vec_id AS doc_id, list_transform(CAST(q.embedding AS DOUBLE[]), lambda x, i: x - CAST(s.embedding[i] AS DOUBLE)) AS df
                  FROM embeddings q CROSS JOIN embeddings s WHERE q.vec_id % 20 = 0))) WHERE rank <= 5""",
)
def f22(spark, d):
    x = rt.nearest_by_distance(queries_(spark, d), "vec_id", "embedding", store(spark, d), "vec_id", "embedding", 5)
    return x.select("query_id", "doc_id", rnd("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register(
    "f28_window_text", "F28,L2,T5",
    sql="""SELECT run_id, id_num, start, concat('DataFrame with shape: 6 rows × 2 columns', chr(10), chr(10), 'Columns:', chr(10), '- step (int64)', chr(10), '- speed (float64)', chr(10), chr(10),
                    'Data:', chr(10), '| step | speed |', chr(10), '| ---- | ----- |', chr(10), array_to_string(rows[1:3] || rows[8:10], chr(10)), chr(10)) AS text
           FROM (SELECT run_id, id_num, step AS start, list('| ' || CAST(step AS VARCHAR) || ' | ' || CAST(round(speed, 4) AS VARCHAR) || ' |' ORDER BY step)
                          OVER (PARTITION BY run_id, id_num ORDER BY step ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS rows FROM veh_log) WHERE len(rows) = 10""",
    views=["veh_log"],
    note="windows of ten rows, the first and last three shown",
)
def f28(spark, d):
    v = tb.veh_log(spark, d).select("run_id", "id_num", "step", rnd("speed", 4).alias("speed"))
    w = rt.sliding_windows(v, ["run_id", "id_num"], "step", ["step", "speed"], 10)
    return w.select("run_id", "id_num", "start", tx.frame_text(F.col("rows"), {"step": "int64", "speed": "float64"}, 6).alias("text"))


# a window's answer in the two-task form, and the vector of its hypothetical situation
RESPONSE = ("concat('<task1>keep ', {p}, ' <action>', CAST({c} % 7 - 3 AS {s}), CASE WHEN {o} % 11 = 0 THEN ',bad' ELSE ', 0.5' END, '</action></task1>',"
            " CASE WHEN {o} % 13 = 0 THEN '' ELSE concat('<task2> because ', {p}, ' </task2>') END)")
STATE = ["speed", "headway", "leader_speed"]


def _response(string):
    return RESPONSE.format(p="o_orderpriority", c="o_custkey", o="o_orderkey", s=string)


@register(
    "l12_window_records", "L12,F29,F1,F3,R3,J4",
    sql=f"""WITH w AS (SELECT o_orderkey AS window_id, {_response('VARCHAR')} AS response, l.*, 20 * (o_orderkey // 20 % ((SELECT max(vec_id) FROM embeddings) // 20 + 1)) AS q
                       FROM orders JOIN lead_log l ON l.run_id = o_orderkey % 150 // 15 AND l.id_num = o_orderkey % 15 AND l.step = o_orderkey // 150 % 40
                       WHERE o_orderkey % 20 = 0 AND leader_speed IS NOT NULL),
                 s AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS e, {_dot('CAST(embedding AS DOUBLE[])', 'CAST(embedding AS DOUBLE[])')} AS nn FROM embeddings),
                 u AS (SELECT doc_id, e, list_transform(e, lambda x: x / sqrt(nn)) AS v FROM s),
                 t AS (SELECT q, doc_id, e FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS r FROM (
                         SELECT a.doc_id AS q, b.doc_id, b.e, {_dot('a.v', 'b.v')} AS score FROM u a CROSS JOIN u b WHERE a.doc_id IN (SELECT q FROM w))) WHERE r <= 30),
                 k AS (SELECT window_id, doc_id, e, row_number() OVER (PARTITION BY window_id ORDER BY l2, doc_id) AS r FROM (
                         SELECT window_id, t.doc_id, t.e, (speed - e[1]) * (speed - e[1]) + (headway - e[2]) * (headway - e[2]) + (leader_speed - e[3]) * (leader_speed - e[3]) AS l2
                         FROM w JOIN t USING (q))),
                 d AS (SELECT window_id, list(doc_id ORDER BY r) AS ids FROM k WHERE r <= 5 GROUP BY window_id),
                 x AS (SELECT *, {tag_sql('response', 'task1')} AS t1 FROM w)
            SELECT window_id, concat('speed: ', CAST(round(speed, 2) AS VARCHAR), ', headway: ', CAST(round(headway, 2) AS VARCHAR), ', leader_speed: ',
                     CAST(round(leader_speed, 2) AS VARCHAR)) AS situation, t1 AS action_explanation, {tag_sql('response', 'task2')} AS situation_analysis,
                   ({values_sql(tag_sql('t1', 'action'))})[1] AS first_action, round(accel, 6) AS true_accel, array_to_string(ids, ' ') AS retrieved_ids,
                   CAST(len(ids) AS BIGINT) AS n_situations
            FROM x LEFT JOIN d USING (window_id)""",
    views=["veh_log"], ctes=LEAD_CTES,
    note="windows named by the order keys divisible by 20; two-stage retrieval over the whole store",
)
def l12(spark, d):
    vec = store(spark, d)
    top = vec.agg(F.max("vec_id")).first()[0] or 0
    o = tb.table(spark, d, "orders").filter("o_orderkey % 20 = 0").select(
        F.col("o_orderkey").alias("window_id"), F.expr(_response("STRING")).alias("response"), F.expr("o_orderkey % 150 div 15").alias("run_id"),
        F.expr("o_orderkey % 15").alias("id_num"), F.expr("o_orderkey div 150 % 40").alias("step"), F.expr(f"20 * (o_orderkey div 20 % {top // 20 + 1})").alias("q"))
    # the log of the runs that windows name, and one row a window, read by three branches
    w = with_leader(spark, d, o.select("run_id").distinct()).join(o, ["run_id", "id_num", "step"])
    w = materialize(w.select("window_id", "response", "q", "accel", *STATE))
    found = rt.top_k(vec.join(w.select(F.col("q").alias("vec_id")).distinct(), "vec_id", "left_semi"), "vec_id", "embedding", vec, "vec_id", "embedding", rt.INTERMEDIATE_K)
    states = vec.select(F.col("vec_id").alias("doc_id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(STATE)])
    found = found.select(F.col("query_id").alias("q"), "doc_id").join(states, "doc_id")
    near = rt.nearest_of_found(w.select("window_id", "q", *STATE), "window_id", "q", found, "doc_id", STATE)
    rows = w.select("window_id", "response", *[rnd(c, 2).alias(c) for c in STATE], rnd("accel", 6).alias("accel"))
    r = rt.window_records(rows, "window_id", STATE, near, "response", {"accel": "true_accel"})
    return r.select("window_id", "situation", "action_explanation", "situation_analysis", F.col("action")[0].alias("first_action"), "true_accel",
                    F.array_join(F.transform("retrieved_ids", lambda i: i.cast("string")), " ").alias("retrieved_ids"),
                    F.regexp_count("documents", F.lit("Situation n:")).cast("long").alias("n_situations"))


def _d3_sql():
    part = {"down": "[greatest(i, 0) + 1:least(i + 3, n)]", "up": "[greatest(i - 3, 0) + 1:least(i, n)]", "local": "[greatest(i - 3, 0) + 1:least(i + 3, n)]"}
    cut = lambda a, p: f"(CASE WHEN {'least(i, n)' if p == 'up' else 'least(i + 3, n)'} <= {'greatest(i, 0)' if p == 'down' else 'greatest(i - 3, 0)'} THEN [] ELSE {a}{part[p]} END)"
    cols = ", ".join(f"{_listed(cut(a, p))} AS {name}_{p}" for name, a in (("confidence", "cs"), ("cvalue", "vs")) for p in part)
    return f"""WITH prof AS (SELECT DISTINCT t FROM tse), first_prof AS (SELECT min(t) AS t0 FROM prof),
      probe AS (SELECT run_id, id_num, step, position, step * 3.5e-1 AS probe_t FROM veh_log),
      m AS (SELECT p.run_id, p.id_num, p.step, p.position, coalesce(a.t, f.t0) AS t FROM probe p ASOF LEFT JOIN prof a ON p.probe_t >= a.t CROSS JOIN first_prof f),
      k AS (SELECT t, list(seg_start ORDER BY seg_idx) AS xs, list(avg_speed / 8 ORDER BY seg_idx) AS cs, list(seg_idx * t * 1e0 ORDER BY seg_idx) AS vs FROM tse GROUP BY t),
      j AS (SELECT m.*, xs, cs, vs, len(list_filter(xs, lambda s: s <= m.position)) - 1 AS i, len(xs) AS n FROM m JOIN k ON k.t = m.t)
      SELECT run_id, id_num, step, {_listed('list_transform(xs[i + 2:least(n, i + 4)], lambda s: s - position)')} AS next_dists,
             {_listed('list_transform(CASE WHEN i <= 0 THEN [] ELSE xs[greatest(i - 3, 0) + 1:i] END, lambda s: s - position)')} AS previous_dists, {cols} FROM j"""


@register("d3_segment_context", "D3", sql=_d3_sql(), views=["veh_log", "tse"], note="k = 3; confidence and c-value are stand-ins made from the profile")
def d3(spark, d):
    v = tb.veh_log(spark, d, keep=False).select("run_id", "id_num", "step", "position", (F.col("step") * PROBE_SCALE).alias("probe_t"))
    prof = tb.tse(spark, d).withColumns({"c": F.col("avg_speed") / 8, "v": (F.col("seg_idx") * F.col("t")).cast("double")})
    m = jn.asof_join(v, prof.select("t").distinct(), [], "probe_t", "t", []).withColumnRenamed("t_match", "t")
    cells = F.array_sort(F.collect_list(F.struct("seg_idx", "seg_start", "c", "v")))  # the segments of one profile
    arr = prof.groupBy("t").agg(cells.alias("a")).select("t", F.col("a.seg_start").alias("xs"), F.col("a.c").alias("cs"), F.col("a.v").alias("vs"))
    x = tf.segment_context(m.join(arr, "t"), "position", "xs", {"confidence": "cs", "cvalue": "vs"}, 3)
    names = ["next_dists", "previous_dists"] + [f"{n}_{p}" for n in ("confidence", "cvalue") for p in ("down", "up", "local")]
    return x.select(*K, *[listed(c).alias(c) for c in names])


@register(
    "d18_safety_overlay", "D18,F14",
    sql="""SELECT run_id, id_num, step, round(headway, 6) AS headway, round(gap_closing, 6) AS gap_closing, round(failsafe, 6) AS failsafe,
                  CASE WHEN headway < 0 THEN 'crash' WHEN headway < failsafe THEN 'failsafe' WHEN headway > gap_closing THEN 'gap_closing' ELSE 'free' END AS state
           FROM (SELECT *, greatest(1.2e2, 6e0 * speed) AS gap_closing, 6 * ((speed + 1 + speed * 4 / 30) - leader_speed) AS failsafe
                 FROM lead_log WHERE id LIKE '%av%' AND leader_speed IS NOT NULL)""",
    views=["veh_log"], ctes=LEAD_CTES,
)
def d18(spark, d):
    x = tf.safety_overlay(with_leader(spark, d).filter(F.col("id").contains("av")), K)
    return x.select(*K, *[rnd(c, 6).alias(c) for c in ("headway", "gap_closing", "failsafe")], "state")


@register(
    "r1_index_vectors", "R1,F5",
    sql="""SELECT doc_id, field, CAST(p - 1 AS INT) AS pos, v[p] AS number FROM (
             SELECT doc_id, field, list_transform(regexp_extract_all(txt, '[-+]?[0-9]*\\.?[0-9]+'), lambda x: CAST(x AS DOUBLE)) AS v
             FROM (UNPIVOT (SELECT doc_id, text, source, lang FROM documents) ON text, source, lang INTO NAME field VALUE txt)), unnest(generate_series(1, len(v))) AS g(p)""",
    note="every number of every field's vector",
)
def r1(spark, d):
    x = rt.index_fields(tb.table(spark, d, "documents"), "doc_id", ["text", "source", "lang"])
    return x.select("doc_id", "field", F.posexplode("vec").alias("pos", "number"))


@register(
    "r6_admission_scores", "R6,R5",
    sql=f"""WITH j AS (SELECT window_id, TRY_CAST({tag_sql('judge_response', 'coherence_score')} AS INT) / 5e0 AS scenario FROM judge),
                 e AS (SELECT vec_id, {_dot('CAST(a.embedding AS DOUBLE[])', 'CAST(b.embedding AS DOUBLE[])')} / (sqrt({_dot('CAST(a.embedding AS DOUBLE[])', 'CAST(a.embedding AS DOUBLE[])')})
                         * sqrt({_dot('CAST(b.embedding AS DOUBLE[])', 'CAST(b.embedding AS DOUBLE[])')})) AS logic
                       FROM embeddings a JOIN (SELECT vec_id - 1 AS at, embedding FROM embeddings) b ON b.at = a.vec_id)
            SELECT window_id, round(scenario, 6) AS scenario_score, round(logic, 6) AS logic_score, round(5e-1 * logic + 5e-1 * scenario, 6) AS admission_score
            FROM j JOIN e ON e.vec_id = window_id""".replace("SELECT vec_id, ", "SELECT a.vec_id, "),
    views=["judge"],
    note="scenario score out of five, logic score from two vectors, and the mean that decides on admission; an unreadable score gives null",
)
def r6(spark, d):
    j = tb.judge(spark, d).select("window_id", rt.scenario_score(F.col("judge_response"), "coherence_score").alias("scenario"))
    e = tb.table(spark, d, "embeddings").select("vec_id", vx.as_double("embedding").alias("v"))
    logic = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("n")), "vec_id").select(F.col("vec_id").alias("window_id"), vx.cosine("v", "n").alias("logic"))
    x = j.join(logic, "window_id")
    return x.select("window_id", rnd("scenario", 6).alias("scenario_score"), rnd("logic", 6).alias("logic_score"),
                    rnd(rt.admission_score(F.col("logic"), F.col("scenario")), 6).alias("admission_score"))


@register(
    "k3_p1_stored_wide_table", "K3,P1,P2,S4",
    sql="""SELECT run_id, CAST(step AS INT) AS timestep, round(-avg(speed) / 10, 6) AS reward, max(CASE WHEN id_num = 1 THEN speed END) AS speed,
                  max(CASE WHEN id_num = 1 THEN position END) AS position FROM veh_log GROUP BY run_id, step""",
    views=["veh_log"],
    note="written as text with base columns and NULL for what is missing, read back and coerced; one vehicle's columns, prefix stripped",
)
def k3(spark, d):
    from ..sources.files import null_tokens_to_double

    v = tb.veh_log(spark, d).withColumn("timestep", F.col("step"))
    path = f"{ensure_checkpoint_dir(spark)}/wide-{uuid.uuid4().hex}"
    sk.write_wide(v, path, ["run_id", "step"], "id_num", ["speed", "position"], list(range(15)),
                  {"timestep": F.max("timestep"), "reward": rnd(-F.avg("speed") / 10, 6)})
    wide = spark.read.parquet(path)
    cols = sk.vehicle_columns(wide, "1", ["speed", "position"])
    x = wide.select("run_id", *[null_tokens_to_double(F.col(f"`{c}`")).alias(c.removeprefix("1__")) for c in cols])
    return x.withColumn("timestep", F.col("timestep").cast("int"))


@register(
    "a25_context_of_every_av", "A25",
    sql="""WITH h AS (SELECT run_id, max(step) AS horizon FROM cum GROUP BY run_id),
                g AS (SELECT run_id, step, avg(CASE WHEN id LIKE '%av%' OR id LIKE '%human%' THEN total_miles END) AS miles,
                             avg(CASE WHEN id LIKE '%av%' OR id LIKE '%human%' THEN total_gallons + 1e-6 END) AS gallons FROM cum GROUP BY run_id, step)
           SELECT c.run_id, c.step, c.id_num, round(miles, 9) AS avg_miles, round(gallons, 9) AS avg_gallons, round(c.step / horizon, 6) AS time_frac, position AS av_pos
           FROM cum c JOIN g ON g.run_id = c.run_id AND g.step = c.step JOIN h ON h.run_id = c.run_id WHERE c.id LIKE '%av%'""",
    views=["veh_log"], ctes=CUM_CTES,
    note="humans counted too; a row for each AV",
)
def a25(spark, d):
    x = mt.step_context(cum_log(spark, d), humans=True)
    return x.select("run_id", "step", "id_num", rnd("avg_miles", 9).alias("avg_miles"), rnd("avg_gallons", 9).alias("avg_gallons"),
                    rnd("time_frac", 6).alias("time_frac"), "av_pos")


ADMISSION_ROOM = 3


@register(
    "r5_batch_admission", "R5",
    sql=f"""WITH u AS (SELECT vec_id, label, (vec_id * 37 % 101) / 1e2 AS score, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt({_dot('CAST(embedding AS DOUBLE[])', 'CAST(embedding AS DOUBLE[])')})) AS v FROM embeddings),
                 s AS (SELECT * FROM u WHERE label < 5), n AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS r FROM u WHERE label >= 5 AND vec_id % 20 = 0),
                 t AS (SELECT new_id, doc_id, old FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY cs DESC, doc_id) AS k FROM (
                         SELECT n.vec_id AS new_id, s.vec_id AS doc_id, s.score AS old, {_dot('n.v', 's.v')} AS cs FROM n CROSS JOIN s)) WHERE k <= 5),
                 a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY old, doc_id) AS w FROM t) WHERE w = 1),
                 c AS (SELECT n.vec_id AS new_id, n.score, a.doc_id FROM n JOIN a ON a.new_id = n.vec_id WHERE n.r > {ADMISSION_ROOM} AND n.score > a.old),
                 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, new_id) AS w FROM c) WHERE w = 1)
            SELECT coalesce(b.new_id, s.vec_id) AS doc_id, coalesce(b.score, s.score) AS score, CASE WHEN b.new_id IS NULL THEN 'kept' ELSE 'replaces' END AS origin, b.doc_id AS replaced_id
            FROM s LEFT JOIN b ON b.doc_id = s.vec_id
            UNION ALL SELECT vec_id, score, 'added', NULL FROM n WHERE r <= {ADMISSION_ROOM}""",
    note="store: the vectors of five labels; newcomers: the stated queries of the others, each with its five nearest; room for three",
)
def r5(spark, d):
    e = tb.table(spark, d, "embeddings").withColumn("score", F.col("vec_id") * 37 % 101 / 100)
    old, new = e.filter("label < 5"), e.filter("label >= 5 and vec_id % 20 = 0")
    near = rt.top_k(new, "vec_id", "embedding", old, "vec_id", "embedding", 5).select(F.col("query_id").alias("new_id"), "doc_id")
    return rt.admit_batch(old.select(F.col("vec_id").alias("doc_id"), "score"), new.select(F.col("vec_id").alias("new_id"), F.col("vec_id").alias("arrival"), "score"),
                          near, old.count() + ADMISSION_ROOM)
