"""String functions and answer / judge scoring queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import scoring as sc
from ..plans.ordering import dense_position
from ..sources import tables as tb
from .core import register
from .sqlfrag import strip_sql, tag_sql, tags_all_sql, values_sql


@register(
    "f1_extract_tag", "F1",
    sql=f"""SELECT page_id, {tag_sql('html', 'title')} AS title, {tag_sql('html', 'h1')} AS h1 FROM pages""",
)
def f1(spark, d):
    p = tb.table(spark, d, "pages")
    return p.select("page_id", tx.extract_tag("html", "title").alias("title"), tx.extract_tag("html", "h1").alias("h1"))


@register(
    "f2_extract_all_tags", "F2",
    sql=f"""SELECT page_id, CAST(len(li) AS BIGINT) AS n_li, li[1] AS first_li, li[-1] AS last_li
            FROM (SELECT page_id, {tags_all_sql('html', 'li')} AS li FROM pages)""",
)
def f2(spark, d):
    p = tb.table(spark, d, "pages").select("page_id", tx.extract_all_tags("html", "li").alias("li"))
    return p.select(
        "page_id", F.size("li").cast("long").alias("n_li"),
        F.try_element_at("li", F.lit(1)).alias("first_li"), F.try_element_at("li", F.lit(-1)).alias("last_li"),
    )


@register(
    "f3_extract_values", "F3",
    sql=f"""SELECT window_id, raw IS NOT NULL AS found, v IS NOT NULL AS valid, CAST(len(v) AS BIGINT) AS n_values,
                   v[1] AS v1, v[2] AS v2, v[3] AS v3, v[4] AS v4
            FROM (SELECT window_id, raw, {values_sql('raw')} AS v
                  FROM (SELECT window_id, {tag_sql('response', 'future_speeds')} AS raw FROM answer))""",
    views=["answer"],
)
def f3(spark, d):
    a = tb.answer(spark, d).select("window_id", tx.extract_tag("response", "future_speeds").alias("raw"))
    a = a.withColumn("v", tx.parse_values("raw"))
    return a.select(
        "window_id", F.col("raw").isNotNull().alias("found"), F.col("v").isNotNull().alias("valid"),
        F.when(F.col("v").isNotNull(), F.size("v").cast("long")).alias("n_values"),
        *[F.try_element_at("v", F.lit(i)).alias(f"v{i}") for i in range(1, 5)],
    )


@register(
    "f5_numeric_embedding_props", "F5",
    sql="""SELECT event_id, CAST(len(v) AS BIGINT) AS n_numbers, v[1] AS first_number FROM (
             SELECT event_id, list_transform(regexp_extract_all(props, '[-+]?[0-9]*\\.?[0-9]+'), lambda x: CAST(x AS DOUBLE)) AS v
             FROM events)""",
)
def f5a(spark, d):
    e = tb.table(spark, d, "events").select("event_id", tx.numeric_embedding("props").alias("v"))
    return e.select("event_id", F.size("v").cast("long").alias("n_numbers"), F.try_element_at("v", F.lit(1)).alias("first_number"))


@register(
    "f5_numeric_embedding_documents", "F5",
    sql="""SELECT doc_id, CAST(len(v) AS BIGINT) AS n_numbers, list_max(v) AS max_number, list_min(v) AS min_number FROM (
             SELECT doc_id, list_transform(regexp_extract_all(text, '[-+]?[0-9]*\\.?[0-9]+'), lambda x: CAST(x AS DOUBLE)) AS v
             FROM documents)""",
)
def f5b(spark, d):
    e = tb.table(spark, d, "documents").select("doc_id", tx.numeric_embedding("text").alias("v"))
    return e.select("doc_id", F.size("v").cast("long").alias("n_numbers"),
                    F.array_max("v").alias("max_number"), F.array_min("v").alias("min_number"))


@register(
    "f23_duration_text", "F23",
    sql="""SELECT user_id, s AS duration_s,
                  concat(CASE WHEN s // 86400 > 0 THEN CAST(s // 86400 AS VARCHAR) || 'd' ELSE '' END,
                         CASE WHEN (s % 86400) // 3600 > 0 THEN CAST((s % 86400) // 3600 AS VARCHAR) || 'h' ELSE '' END,
                         CASE WHEN (s % 3600) // 60 > 0 THEN CAST((s % 3600) // 60 AS VARCHAR) || 'm' ELSE '' END,
                         CAST(s % 60 AS VARCHAR), 's') AS duration_text
           FROM (SELECT user_id, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS BIGINT) AS s FROM events GROUP BY user_id)""",
)
def f23(spark, d):
    e = tb.table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    micros = F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))
    e = e.select("user_id", F.floor(micros / 1_000_000).cast("long").alias("duration_s"))
    return e.withColumn("duration_text", tx.duration_text("duration_s"))


@register(
    "f24_start_time_from_name", "F24",
    sql="""SELECT user_id, name, strftime(strptime(substr(name, 1, 19), '%Y-%m-%d-%H-%M-%S'), '%Y-%m-%d %H:%M:%S') AS start_time
           FROM (SELECT user_id, strftime(min(ts), '%Y-%m-%d-%H-%M-%S') || '_' || CAST(user_id AS VARCHAR) AS name
                 FROM events GROUP BY user_id)""",
)
def f24(spark, d):
    e = tb.table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("t0"))
    e = e.select("user_id", F.concat(F.date_format("t0", "yyyy-MM-dd-HH-mm-ss"), F.lit("_"), F.col("user_id").cast("string")).alias("name"))
    parsed = F.to_timestamp_ntz(F.substring("name", 1, 19), F.lit("yyyy-MM-dd-HH-mm-ss"))
    return e.withColumn("start_time", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss"))


@register(
    "f4_vehicle_id_parse", "F4,K2",
    sql="""SELECT DISTINCT id, CAST(split_part(split_part(id, '#', 1), '_', 1) AS INT) AS id_num,
                  split_part(split_part(id, '#', 1), '_', 2) AS controller, split_part(split_part(id, '#', 1), '_', 3) AS kind,
                  CASE WHEN id LIKE '%#sensor%' THEN 'sensor_' WHEN id LIKE '%human%' THEN 'human_'
                       WHEN id LIKE '%av%' THEN 'av_' WHEN id LIKE '%trajectory%' THEN 'human_' END || id AS leaderboard_id
           FROM veh_log""",
    views=["veh_log"],
)
def f4(spark, d):
    v = tb.veh_log(spark, d, keep=False).select("id").distinct()
    p = tx.vehicle_parts("id")
    return v.select("id", p["id_num"].alias("id_num"), p["controller"].alias("controller"), p["kind"].alias("kind"),
                    tx.leaderboard_id("id").alias("leaderboard_id"))


_FIVE = " AND ".join(f"coalesce(len({values_sql(tag_sql('response', t))}) = {n}, false)" for t, n in sc.ANSWER_TAGS.items())


@register(
    "l5_format_check", "L5,F1,F3",
    sql=f"""SELECT window_id, {_FIVE}
                   AND coalesce(length({strip_sql(tag_sql('response', 'reasoning'))}) >= 5, false) AS format_ok
            FROM answer""",
    views=["answer"],
)
def l5(spark, d):
    return tb.answer(spark, d).select("window_id", sc.format_ok(F.col("response")).alias("format_ok"))


@register(
    "l6_judge_verdict", "L6",
    sql=f"""SELECT window_id, CASE WHEN uf IS NULL OR coh IS NULL THEN -1 ELSE uf END AS user_friendly_score,
                   CASE WHEN uf IS NULL OR coh IS NULL THEN -1 ELSE coh END AS coherence_score,
                   CASE WHEN uf IS NOT NULL AND coh IS NOT NULL AND uf >= 7 AND coh >= 7 THEN 'yes' ELSE 'no' END AS verdict
            FROM (SELECT window_id, TRY_CAST({tag_sql('judge_response', 'user_friendly_score')} AS INT) AS uf,
                         TRY_CAST({tag_sql('judge_response', 'coherence_score')} AS INT) AS coh FROM judge)""",
    views=["judge"],
)
def l6(spark, d):
    j = tb.judge(spark, d)
    s = sc.judge_scores(F.col("judge_response"))
    return j.select("window_id", s["user_friendly_score"].alias("user_friendly_score"),
                    s["coherence_score"].alias("coherence_score"), s["verdict"].alias("verdict"))


def _outside_sql(v, hi):
    return f"coalesce(len(list_filter({v}, lambda x: x < 0 OR x > {hi})) > 0, false)"


@register(
    "l7_physical_limits", "L7",
    sql=f"""SELECT window_id, reason = '' AS physical_ok, reason FROM (
              SELECT window_id, CASE WHEN {_outside_sql('v', 50)} THEN 'Invalid speed detected'
                                     WHEN {_outside_sql('h', 200)} THEN 'Invalid headway detected'
                                     WHEN {_outside_sql('l', 50)} THEN 'Invalid leader speed detected' ELSE '' END AS reason
              FROM (SELECT window_id, {values_sql(tag_sql('response', 'future_speeds'))} AS v,
                           {values_sql(tag_sql('response', 'future_headway'))} AS h,
                           {values_sql(tag_sql('response', 'future_leader_speed'))} AS l FROM answer))""",
    views=["answer"],
)
def l7(spark, d):
    a = tb.answer(spark, d).select("window_id", *(tx.extract_values("response", t).alias(c) for t, c in
                                                  (("future_speeds", "v"), ("future_headway", "h"), ("future_leader_speed", "l"))))
    chk = sc.physical_check(F.col("v"), F.col("h"), F.col("l"))
    return a.select("window_id", chk["physical_ok"].alias("physical_ok"), chk["reason"].alias("reason"))


@register(
    "l8_majority_vote", "L8",
    sql="""SELECT pair_id, votes_a, votes_b,
                  CASE WHEN votes_a > votes_b THEN 'A' WHEN votes_b > votes_a THEN 'B'
                       WHEN pair_id % 2 = 0 THEN 'A' ELSE 'B' END AS winner,
                  CASE WHEN votes_a = votes_b THEN 'fallback' ELSE 'majority' END AS decided_by
           FROM (SELECT pair_id, CAST(count(CASE WHEN winner = 'A' THEN 1 END) AS BIGINT) AS votes_a,
                        CAST(count(CASE WHEN winner = 'B' THEN 1 END) AS BIGINT) AS votes_b FROM votes GROUP BY pair_id)""",
    views=["votes"],
)
def l8(spark, d):
    return sc.majority_vote(tb.votes(spark, d))


@register(
    "l9_knockout_champion", "L9",
    sql="""SELECT l_orderkey AS window_id, arg_min(slot, struct_pack(q := -l_quantity, s := slot)) AS champion_slot,
                  max(l_quantity) AS champion_score
           FROM (SELECT l_orderkey, l_quantity,
                        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS slot
                 FROM lineitem) GROUP BY l_orderkey""",
)
def l9(spark, d):
    li = tb.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = dense_position(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], name="slot")
    ent = li.select(F.col("l_orderkey").alias("window_id"), "slot", "l_quantity")
    return sc.knockout_champion(ent, "window_id", "slot", "l_quantity")


@register(
    "l10_first_passing_attempt", "L10",
    sql="""SELECT k.conv_id, b.turn AS attempt, b.n_chars, CASE WHEN b.turn IS NULL THEN 'No valid response' ELSE 'ok' END AS status
           FROM (SELECT DISTINCT conv_id FROM conversations) k
           LEFT JOIN (SELECT conv_id, min(turn) AS turn, arg_min(CAST(length(text) AS BIGINT), turn) AS n_chars
                      FROM conversations WHERE role = 'assistant' AND length(text) >= 400 GROUP BY conv_id) b
           ON k.conv_id = b.conv_id""",
    note="an attempt passes when it is an assistant turn of at least 400 characters",
)
def l10(spark, d):
    c = tb.table(spark, d, "conversations").withColumn("n_chars", F.length("text").cast("long"))
    passed = (F.col("role") == "assistant") & (F.col("n_chars") >= 400)
    return sc.first_passing(c, "conv_id", "turn", passed, ["n_chars"])
