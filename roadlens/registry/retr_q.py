"""Retrieval, store and window-scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..functions.numeric import rnd
from ..operators import retrieval as rt
from ..plans.ordering import dense_position
from ..sources import tables as tb
from .core import register
from .phys_q import lead_log
from .sqlfrag import LEAD_CTES, tag_sql, values_sql


def _dot(a, b):
    return f"list_reduce(list_transform({a}, lambda x, i: x * {b}[i]), lambda u, v: u + v)"


def _cos(a, b):
    na, nb = f"sqrt({_dot(a, a)})", f"sqrt({_dot(b, b)})"
    return f"(CASE WHEN {na} = 0 OR {nb} = 0 THEN 0e0 ELSE {_dot(a, b)} / ({na} * {nb}) END)"


def _unit(a):
    n = f"sqrt({_dot(a, a)})"
    return f"(CASE WHEN {n} = 0 THEN list_transform({a}, lambda x: x * 0e0) ELSE list_transform({a}, lambda x: x / {n}) END)"


STORE_CTE = ("store", f"""SELECT vec_id AS doc_id, {_unit('CAST(embedding AS DOUBLE[])')} AS dv,
                                list_slice(CAST(embedding AS DOUBLE[]), 1, 3) AS ds FROM embeddings""")
QUERY_CTE = ("q", f"""SELECT vec_id AS query_id, {_unit('CAST(embedding AS DOUBLE[])')} AS qv,
                            list_slice(CAST(embedding AS DOUBLE[]), 1, 3) AS qs
                     FROM embeddings WHERE vec_id % 20 = 0""")


def store(spark, d):
    """The whole index."""
    return tb.table(spark, d, "embeddings").withColumn("state", F.slice("embedding", 1, 3))


def queries_(spark, d):
    """The stated query set: every vector whose id is divisible by 20."""
    return store(spark, d).filter("vec_id % 20 = 0")


@register(
    "r5_store_admission", "R5,T2",
    sql="SELECT vec_id AS doc_id FROM embeddings ORDER BY label DESC, vec_id ASC LIMIT 100",
    note="batch ruling: capacity 100, best label first, earlier arrival (vec_id) on ties",
)
def r5(spark, d):
    return rt.admit(tb.table(spark, d, "embeddings"), "vec_id", "label", "vec_id", rt.STORE_LIMIT).select(F.col("vec_id").alias("doc_id"))


@register(
    "r2_f22_cosine_top_k", "R2,F22,J11",
    sql=f"""SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (
              SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
              FROM (SELECT query_id, doc_id, {_dot('qv', 'dv')} AS score FROM q CROSS JOIN store)) WHERE rank <= 5""",
    ctes=[STORE_CTE, QUERY_CTE],
)
def r2(spark, d):
    x = rt.top_k(queries_(spark, d), "vec_id", "embedding", store(spark, d), "vec_id", "embedding", 5)
    return x.select("query_id", "doc_id", rnd("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


R3_SQL = f"""SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, round(text_score, 6) AS text_score, round(state_l2, 6) AS state_l2 FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY state_l2 {{order}}, doc_id) AS rank FROM (
    SELECT *, {_dot('list_transform(qs, lambda x, i: x - ds[i])', 'list_transform(qs, lambda x, i: x - ds[i])')} AS state_l2 FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC, doc_id) AS r1 FROM (
        SELECT query_id, doc_id, qs, ds, {_dot('qv', 'dv')} AS text_score FROM q CROSS JOIN store)) WHERE r1 <= 30))
WHERE rank <= 5"""


@register("r3_two_stage_retrieval", "R3,T6", sql=R3_SQL.format(order="ASC"), ctes=[STORE_CTE, QUERY_CTE])
def r3(spark, d):
    x = rt.two_stage(queries_(spark, d), "vec_id", "embedding", "state", store(spark, d), "vec_id", "embedding", "state")
    return x.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", rnd("text_score", 6).alias("text_score"),
                    rnd("state_l2", 6).alias("state_l2"))


@register("r3_two_stage_reference_order", "R3,Q2", sql=R3_SQL.format(order="DESC"), ctes=[STORE_CTE, QUERY_CTE],
          note="order='reference': the source's farthest-first second stage, kept for parity")
def r3b(spark, d):
    x = rt.two_stage(queries_(spark, d), "vec_id", "embedding", "state", store(spark, d), "vec_id", "embedding", "state",
                     order="reference")
    return x.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", rnd("text_score", 6).alias("text_score"),
                    rnd("state_l2", 6).alias("state_l2"))


@register(
    "r1_embedding_index", "R1,F5,G3",
    sql="""SELECT doc_id, field, CAST(len(v) AS BIGINT) AS n_numbers, v[1] AS first_number FROM (
             SELECT doc_id, field, list_transform(regexp_extract_all(txt, '[-+]?[0-9]*\\.?[0-9]+'), lambda x: CAST(x AS DOUBLE)) AS v
             FROM (UNPIVOT (SELECT doc_id, text, source, lang FROM documents) ON text, source, lang INTO NAME field VALUE txt))""",
)
def r1(spark, d):
    x = rt.index_fields(tb.table(spark, d, "documents"), "doc_id", ["text", "source", "lang"])
    return x.select("doc_id", "field", F.size("vec").cast("long").alias("n_numbers"),
                    F.try_element_at("vec", F.lit(1)).alias("first_number"))


@register(
    "r4_store_operations", "R4,U4",
    sql="""WITH s0 AS (SELECT doc_id, text, 'original' AS origin FROM documents),
                removed AS (SELECT doc_id FROM labels WHERE toxic = 1),
                replaced AS (SELECT doc_id, concat('[revised] ', text) AS text, 'replaced' AS origin FROM documents
                             WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0)),
                added AS (SELECT 1000000000 + item_id AS doc_id, text, 'added' AS origin FROM benchmark),
                s1 AS (SELECT * FROM s0 WHERE doc_id NOT IN (SELECT doc_id FROM removed) AND doc_id NOT IN (SELECT doc_id FROM replaced)
                       UNION ALL SELECT * FROM replaced UNION ALL SELECT * FROM added)
           SELECT doc_id, origin, CAST(length(text) AS BIGINT) AS n_chars FROM s1""",
    note="one batch: remove toxic, replace low-quality (revised text), add benchmark items",
)
def r4(spark, d):
    docs = tb.table(spark, d, "documents").select("doc_id", "text", F.lit("original").alias("origin"))
    lab = tb.table(spark, d, "labels")
    removed = lab.filter("toxic = 1").select("doc_id")
    repl = (tb.table(spark, d, "documents").join(lab.filter("quality = 0 AND toxic = 0").select("doc_id"), "doc_id", "left_semi")
            .select("doc_id", F.concat(F.lit("[revised] "), F.col("text")).alias("text"), F.lit("replaced").alias("origin")))
    added = tb.table(spark, d, "benchmark").select((F.lit(1000000000) + F.col("item_id")).alias("doc_id"), "text",
                                                     F.lit("added").alias("origin"))
    s1 = rt_store_apply(docs, removed, repl, added)
    return s1.select("doc_id", "origin", F.length("text").cast("long").alias("n_chars"))


def rt_store_apply(store_df, removed, replaced, added):
    """Versioned rewrite - drop removed and replaced ids (anti join), union the
    replacements and additions."""
    keep = store_df.join(removed, "doc_id", "left_anti").join(replaced.select("doc_id"), "doc_id", "left_anti")
    return keep.unionByName(replaced).unionByName(added)


@register(
    "r7_masked_items", "R7",
    sql="""WITH g AS (SELECT conv_id, list(text ORDER BY turn) AS items FROM conversations GROUP BY conv_id)
           SELECT conv_id, CAST(p - 1 AS INT) AS masked_pos, CAST(length(array_to_string(list_transform(items,
                  lambda x, i: CASE WHEN i = p THEN '[MASK]' ELSE x END), chr(10))) AS BIGINT) AS prompt_chars,
                  CAST(length(items[p]) AS BIGINT) AS hint_chars
           FROM g, unnest(generate_series(1, len(items))) AS u(p)""",
)
def r7(spark, d):
    x = rt.masked_items(tb.table(spark, d, "conversations"), "conv_id", "turn", "text")
    return x.select("conv_id", "masked_pos", F.length("prompt").cast("long").alias("prompt_chars"),
                    F.length("hint").cast("long").alias("hint_chars"))


@register(
    "l1_chunk_positions", "L1,A26",
    sql="""WITH st AS (SELECT traj_id, min(seq) AS mn, max(seq) AS mx FROM drive_type GROUP BY traj_id),
                b AS (SELECT traj_id, (CASE WHEN 575 <> mn THEN [mn] ELSE [] END) || [575, 1000, 1500]
                                      || (CASE WHEN 1500 <> mx THEN [mx] ELSE [] END) AS bs FROM st),
                c AS (SELECT d.traj_id, d.seq, d.velocity_kmh, len(list_filter(bs, lambda v: v <= d.seq)) - 1 AS chunk, bs[-1] AS top
                      FROM drive_type d JOIN b ON b.traj_id = d.traj_id)
           SELECT traj_id, CAST(chunk AS INT) AS chunk, count(*) AS n_rows, min(seq) AS first_seq, round(avg(velocity_kmh), 6) AS mean_v
           FROM c WHERE chunk >= 0 AND seq < top GROUP BY traj_id, chunk""",
    views=["drive_type"],
    note="boundaries 575/1000/1500 (experiment values), positional ruling",
)
def l1(spark, d):
    x = rt.chunk_positions(tb.drive_type(spark, d), ["traj_id"], "seq", "seq", [575, 1000, 1500])
    return x.groupBy("traj_id", F.col("chunk").cast("int").alias("chunk")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("seq").alias("first_seq"), rnd(F.avg("velocity_kmh"), 6).alias("mean_v"))


WIN_CTE = ("win", """SELECT run_id, id_num, step AS start,
                            list(speed ORDER BY step) OVER (PARTITION BY run_id, id_num ORDER BY step ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS speeds
                     FROM veh_log""")


@register(
    "l2_sliding_windows", "L2",
    sql="""SELECT run_id, id_num, count(*) AS n_windows, round(sum(speeds[10] - speeds[1]), 6) AS sum_span
           FROM win WHERE len(speeds) = 10 GROUP BY run_id, id_num""",
    views=["veh_log"], ctes=[WIN_CTE],
)
def l2(spark, d):
    w = rt.sliding_windows(tb.veh_log(spark, d), ["run_id", "id_num"], "step", ["step", "speed"], 10)
    sp = F.transform("rows", lambda r: r["speed"])
    return w.groupBy("run_id", "id_num").agg(F.count(F.lit(1)).alias("n_windows"),
                                             rnd(F.sum(F.element_at(sp, 10) - F.element_at(sp, 1)), 6).alias("sum_span"))


#: ids or steps that one task numbers
POSITION_BLOCK = 4096


@register(
    "l3_l4_window_subset_prompt", "L3,L4",
    sql="""WITH w AS (SELECT run_id, id_num, start, row_number() OVER (ORDER BY run_id, id_num, start) - 1 AS wid
                      FROM win WHERE len(speeds) = 10),
                b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS bi, count(*) OVER () AS nb FROM benchmark)
           SELECT w.run_id, w.id_num, w.start, b.item_id AS prompt_item FROM (
               SELECT * FROM w ORDER BY (wid * 2654435761 + 42 * 97) % 4294967291, wid LIMIT 50) w
           JOIN b ON b.bi = ((w.wid * 2654435761 + 7 * 97) % 4294967291) % b.nb""",
    views=["veh_log"], ctes=[WIN_CTE],
    note="seeded subset of 50 windows (L3: count > 1) and one benchmark prompt per window (L4)",
)
def l3(spark, d):
    w = rt.sliding_windows(tb.veh_log(spark, d), ["run_id", "id_num"], "step", ["step"], 10)
    w = dense_position(w.withColumn("_one", F.lit(1)), ["_one"], ["run_id", "id_num", "start"],
                       bucket=F.struct("run_id", "id_num", F.floor(F.col("start") / POSITION_BLOCK)), name="wid").drop("_one")
    sub = w.orderBy(rt.seeded_order(F.col("wid"), 42), "wid").limit(50)
    b = tb.table(spark, d, "benchmark").select("item_id")
    block = F.coalesce(F.floor(F.col("item_id") / POSITION_BLOCK), F.lit(-(1 << 62)))  # a null id comes first
    b = dense_position(b.withColumn("_one", F.lit(1)), ["_one"], ["item_id"], bucket=block, name="bi").drop("_one")
    nb = b.agg(F.count(F.lit(1)).alias("nb"))
    x = sub.crossJoin(F.broadcast(nb)).withColumn("bi", F.pmod(rt.seeded_order(F.col("wid"), 7), F.col("nb")))
    return x.join(b, "bi").select("run_id", "id_num", "start", F.col("item_id").alias("prompt_item"))


# prediction tag -> logged column
L11_COLUMNS = {"future_speeds": "speed", "future_headway": "headway", "future_leader_speed": "leader_speed", "future_reward": "position"}


def _l11_sql():
    future = ", ".join(f"list_slice(list({c}) OVER z, 7, 10) AS t_{c}" for c in L11_COLUMNS.values())
    preds = ", ".join(f"{values_sql(tag_sql('response', t))} AS p_{c}" for t, c in L11_COLUMNS.items())
    diff = lambda c: f"list_transform(p_{c}, lambda x, i: x - t_{c}[i])"
    errors = ", ".join(f"CASE WHEN p_{c} IS NULL OR t_{c} IS NULL THEN NULL WHEN len(p_{c}) <> len(t_{c}) THEN 'nan'::DOUBLE "
                       f"ELSE sqrt({_dot(diff(c), diff(c))} / len(p_{c})) END AS e_{c}" for c in L11_COLUMNS.values())
    ok = " AND ".join(f"p_{c} IS NOT NULL" for c in L11_COLUMNS.values())
    out = ", ".join(f"round(e_{c}, 6) AS {t.removeprefix('future_')}_l2" for t, c in L11_COLUMNS.items())
    return f"""WITH w AS (SELECT run_id, id_num, step AS start, {future}, count(*) OVER z AS n FROM lead_log WHERE leader_speed IS NOT NULL
                   WINDOW z AS (PARTITION BY run_id, id_num ORDER BY step ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
      a AS (SELECT window_id, window_id % 150 // 15 AS run_id, window_id % 15 AS id_num, window_id // 150 % 40 AS start, {preds} FROM answer),
      j AS (SELECT a.*, {", ".join(f"t_{c}" for c in L11_COLUMNS.values())} FROM a LEFT JOIN w
            ON w.run_id = a.run_id AND w.id_num = a.id_num AND w.start = a.start AND n = 10),
      e AS (SELECT window_id, {ok} AS all_extractable, {errors} FROM j)
      SELECT window_id, all_extractable, {out},
             CASE WHEN all_extractable THEN round((e_speed + e_headway + e_leader_speed) / 3, 6) END AS overall_l2 FROM e"""


@register(
    "l11_window_scores", "L11,A19,A20,F3",
    sql=_l11_sql(), views=["veh_log", "answer"], ctes=LEAD_CTES,
    note="an answer's id names its window (run, vehicle, first step); windows of 10 rows, 6 seen and 4 future; every answer has a row, "
         "without errors where its window or a tag is missing; a tag of wrong length has a NaN error, which the mean leaves out",
)
def l11(spark, d):
    log = lead_log(spark, d).filter(F.col("leader_speed").isNotNull())
    u = F.col("window_id") % 150
    a = tb.answer(spark, d).select(
        "window_id", F.floor(u / 15).alias("run_id"), (F.col("window_id") % 15).alias("id_num"), (F.floor(F.col("window_id") / 150) % 40).alias("start"),
        *(tx.extract_values("response", t).alias(f"p_{c}") for t, c in L11_COLUMNS.items()))
    truth = rt.future_rows(log, a.select("run_id", "id_num", "start"), ["run_id", "id_num"], "step", list(L11_COLUMNS.values()), 6, 10)
    j = a.join(truth, ["run_id", "id_num", "start"], "left")
    for c in L11_COLUMNS.values():
        j = j.withColumn(f"e_{c}", F.when(F.col(f"p_{c}").isNotNull() & F.col(f"t_{c}").isNotNull(), vx.rmse(f"p_{c}", F.col(f"t_{c}"))))
    ok = F.lit(True)
    for c in L11_COLUMNS.values():
        ok = ok & F.col(f"p_{c}").isNotNull()
    kept = lambda x: F.when(F.isnan(x), x).otherwise(rnd(x, 6))  # noqa: E731  (rnd turns NaN into 0)
    overall = F.when(ok & F.col("t_speed").isNotNull(), kept(vx.nan_mean([F.col("e_speed"), F.col("e_headway"), F.col("e_leader_speed")])))
    return j.select("window_id", ok.alias("all_extractable"), *(kept(F.col(f"e_{c}")).alias(f"{t.removeprefix('future_')}_l2") for t, c in L11_COLUMNS.items()),
                    overall.alias("overall_l2"))

