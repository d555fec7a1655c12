"""Queries over the library's interfaces: named controllers (G2), planners (G6), table functions (G5), statistics by
callback (G4), catalogue reads (S5), the bracket decided by votes (L9) and the neighbour index (R8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import generators as gn
from ..functions.numeric import rnd
from ..operators import controllers as ct
from ..operators import joins as jn
from ..operators import metrics as mt
from ..operators import neighbors as nb
from ..operators import planners as pl
from ..operators import retrieval as rt
from ..operators import scoring as sc
from ..operators import traffic as tf
from ..plans.blocks import over_blocks
from ..plans.ordering import dense_position
from ..session import materialize
from ..sources import catalog
from ..sources import tables as tb
from .core import register
from .misc_q import PLATOON_SPEC_SQL
from .more_q import D8_CTES, PROBE_SCALE, _profiles
from .phys_q import _fs_sql, with_leader
from .retr_q import queries_, store
from .sqlfrag import LEAD_CTES, lit

# ---- R8 --------------------------------------------------------------------


@register("r8_approximate_neighbours", "R8", note="hyperplane buckets, exact re-rank; its recall is r8_recall")
def r8(spark, d):
    x = nb.approx_top_k(queries_(spark, d), "vec_id", "embedding", store(spark, d), "vec_id", "embedding", 5)
    return x.select("query_id", "doc_id", rnd("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register(
    "r8_recall", "R8,R2",
    sql="""SELECT count(*) AS n_queries, count(*) * least(5, (SELECT count(*) FROM embeddings)) AS n_true, true AS at_least_90
           FROM embeddings WHERE vec_id % 20 = 0""",
    note="the index against the exact search: nine of ten of the true five nearest are found",
)
def r8_recall(spark, d):
    s, q = store(spark, d), queries_(spark, d)
    exact = rt.top_k(q, "vec_id", "embedding", s, "vec_id", "embedding", 5)
    x = nb.recall(nb.approx_top_k(q, "vec_id", "embedding", s, "vec_id", "embedding", 5), exact)
    return x.select("n_queries", "n_true", (F.col("n_found") >= 0.9 * F.col("n_true")).alias("at_least_90"))


# ---- G2 --------------------------------------------------------------------

WHO = "CASE id_num % 4 WHEN 0 THEN 'idm' WHEN 1 THEN 'fs' WHEN 2 THEN 'time_gap' END"


@register(
    "g2_controller_dispatch", "G2,F15,F16",
    sql=f"""SELECT run_id, id_num, step, {WHO} AS controller,
                   round(CASE id_num % 4
                     WHEN 0 THEN 1.3e0 * (1 - (speed / 4.5e1) * (speed / 4.5e1) * (speed / 4.5e1) * (speed / 4.5e1)
                         - ((2e0 + greatest(0e0, speed * 1e0 + speed * (speed - leader_speed) / {lit(2 * (1.3 * 2.0) ** 0.5)})) / h)
                         * ((2e0 + greatest(0e0, speed * 1e0 + speed * (speed - leader_speed) / {lit(2 * (1.3 * 2.0) ** 0.5)})) / h))
                     WHEN 1 THEN {_fs_sql()}
                     WHEN 2 THEN least(greatest(2.3e-1 * (headway - 5e0 - 1.4e0 * speed) + 7e-2 * (leader_speed - speed), -3e0), 1.5e0) END, 6) AS accel_command
            FROM (SELECT *, CASE WHEN abs(headway) < 1e-3 THEN 1e-3 ELSE headway END AS h FROM lead_log WHERE leader_speed IS NOT NULL)""",
    views=["veh_log"], ctes=LEAD_CTES,
    note="two built-in controllers and a pandas plug-in in one pass; every fourth vehicle has none",
)
def g2(spark, d):
    reg = ct.builtin().plug_in("time_gap", ct.constant_time_gap)
    x = with_leader(spark, d).withColumn("controller", F.expr(WHO))
    return reg.accelerations(x, "controller", "accel_command").select("run_id", "id_num", "step", "controller", rnd("accel_command", 6).alias("accel_command"))


# ---- G6 --------------------------------------------------------------------


@register(
    "g6_planner_targets", "G6,D7,D8,D10",
    sql=f"""WITH RECURSIVE {D8_CTES},
            prof AS (SELECT DISTINCT t FROM tse),
            probe AS (SELECT run_id, id_num, step, step * 3.5e-1 AS probe_t, position + 7.56e2 AS q FROM veh_log),
            m AS (SELECT p.*, coalesce(a.t, (SELECT min(t) FROM prof)) AS t FROM probe p ASOF LEFT JOIN prof a ON p.probe_t >= a.t),
            i AS (SELECT *, least(greatest(floor((q + 2e4) / 1e2), 0), 408) AS lo FROM m)
            SELECT run_id, id_num, step, round(a.raw + (b.raw - a.raw) * (q - a.x) / (b.x - a.x), 6) AS smoothed_target,
                   round(a.target + (b.target - a.target) * (q - a.x) / (b.x - a.x), 6) AS limit_target
            FROM i JOIN tgt a ON a.t = i.t AND a.grid_idx = i.lo JOIN tgt b ON b.t = i.t AND b.grid_idx = i.lo + 1""",
    views=["veh_log", "tse"],
    note="two planners through one interface at every vehicle's position",
)
def g6(spark, d):
    v = tb.veh_log(spark, d, keep=False).select("run_id", "id_num", "step", "position", (F.col("step") * PROBE_SCALE).alias("probe_t"))
    v = jn.asof_join(v, tb.tse(spark, d).select("t").distinct(), [], "probe_t", "t", []).withColumnRenamed("t_match", "t")
    v = materialize(v.select("run_id", "id_num", "step", "position", "t"))
    prof = materialize(_profiles(spark, d))
    a = pl.plan_targets(v, "position", prof, ["t"], pl.smoothed_planner, name="smoothed_target")
    b = pl.plan_targets(a, "position", prof, ["t"], pl.speed_limit_planner, extra=("stand", "move"), name="limit_target")
    return b.select("run_id", "id_num", "step", rnd("smoothed_target", 6).alias("smoothed_target"), rnd("limit_target", 6).alias("limit_target"))


# ---- G5 --------------------------------------------------------------------


@register(
    "g5_gap_rows_table_function", "G5,W4",
    sql="""WITH g AS (SELECT traj_id, seq, time, velocity_kmh, lead(time) OVER w AS nt, lead(velocity_kmh) OVER w AS nv
                      FROM raw_drive_gaps WINDOW w AS (PARTITION BY traj_id ORDER BY seq)),
                m AS (SELECT *, CASE WHEN abs(nt - time - 1e-1) > 1e-3 THEN CAST(floor(round((nt - time) / 1e-1, 3)) AS INT) ELSE 1 END AS miss FROM g)
           SELECT traj_id, seq, CAST(k AS INT) AS k, round(CASE WHEN k = 0 THEN time ELSE time + (nt - time) * k / miss END, 3) AS time,
                  round(CASE WHEN k = 0 THEN velocity_kmh ELSE velocity_kmh + (nv - velocity_kmh) * k / miss END, 6) AS velocity_kmh
           FROM m, unnest(generate_series(0, greatest(coalesce(miss, 1) - 1, 0))) AS u(k)""",
    views=["raw_drive_gaps"],
    note="a Python table function by lateral join; w4_gap_fill is the explode form",
)
def g5_gaps(spark, d):
    raw = tb.raw_drive(spark, d, with_gaps=True).select("traj_id", "seq", "time", "velocity_kmh")
    x = over_blocks(raw, ["traj_id"], "seq", 0, 1, lambda w: {"nt": F.lead("time", 1).over(w), "nv": F.lead("velocity_kmh", 1).over(w)})
    x = gn.lateral(x, gn.missing_steps(), "time", "nt")
    blend = lambda c, n: F.when(F.col("k") == 0, F.col(c)).otherwise(F.col(c) + (F.col(n) - F.col(c)) * F.col("share"))
    return x.select("traj_id", "seq", "k", rnd(blend("time", "nt"), 3).alias("time"), rnd(blend("velocity_kmh", "nv"), 6).alias("velocity_kmh"))


@register(
    "g5_platoon_table_function", "G5,F27",
    sql="""SELECT o_orderkey AS platoon_id, CAST(pos AS INT) AS pos,
                  CASE WHEN pos = n THEN 'av' WHEN pos % (o_custkey % 5 + 2) = 0 THEN 'av' ELSE 'human' END AS kind,
                  CASE WHEN pos = n THEN 'sensor' ELSE '' END AS tags
           FROM (SELECT o_orderkey, o_custkey, (o_orderkey % 3 + 1) * (o_custkey % 5 + 2) AS n FROM orders) o,
                unnest(range(0, n + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END)) AS u(pos)""",
    note="one row per vehicle of the platoon texts of f27_platoon_expansion",
)
def g5_platoons(spark, d):
    specs = tb.table(spark, d, "orders").select(F.col("o_orderkey").alias("platoon_id"), F.expr(PLATOON_SPEC_SQL.replace("VARCHAR", "STRING")).alias("spec"))
    x = gn.lateral(specs, gn.platoon_vehicles(), "spec")
    return x.select("platoon_id", "pos", "kind", F.array_join("tags", "#").alias("tags"))


# ---- G4, S5 ------------------------------------------------------------------


@register(
    "g4_callback_statistics", "G4,A14",
    sql="""SELECT cp_path, round(avg(system_mpg), 6) AS system_mpg_mean, round(stddev_pop(system_mpg), 6) AS system_mpg_std,
                  min(system_mpg) AS system_mpg_min, max(system_mpg) AS system_mpg_max,
                  round(avg(headway_max), 6) AS headway_max_mean, round(stddev_pop(headway_max), 6) AS headway_max_std,
                  min(headway_max) AS headway_max_min, max(headway_max) AS headway_max_max
           FROM policy_run GROUP BY cp_path""",
    views=["policy_run"],
    note="callbacks by name over blocks of a group, by lots in Arrow batches; a14_metric_summary_pop is the Column form",
)
def g4(spark, d):
    x = mt.stat_callbacks(tb.policy_run(spark, d), ["cp_path"], ["system_mpg", "headway_max"], mt.moment_callbacks())
    cols = [(f"{c}_{s}", s) for c in ("system_mpg", "headway_max") for s in ("mean", "std", "min", "max")]
    return x.select("cp_path", *[(rnd(c, 6) if s in ("mean", "std") else F.col(c)).alias(c) for c, s in cols])


@register(
    "s5_catalogue", "S5",
    sql="SELECT table_name, column_name, CAST(ordinal_position AS INT) AS position, n_rows FROM information_schema.columns JOIN ("
        + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in tb.TABLES) + ") USING (table_name)",
    note="tables and columns from the catalogue, sizes by SQL with a bound parameter",
)
def s5(spark, d):
    views = catalog.open_tables(spark, d, prefix="cat_")
    x = catalog.table_columns(spark, [v for v in catalog.get_tables(spark, "cat_*") if v in views])
    return x.withColumn("table_name", F.substring("table_name", 5, 100))


@register(
    "s5_timestep_data", "S5,T8",
    sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 2.5e5 AND o_orderkey % 3 = 1",
    note="query_to_df with parameters over a named table",
)
def s5_sql(spark, d):
    catalog.open_tables(spark, d, ["orders"], prefix="run_")
    return catalog.query_to_df(spark, "SELECT o_orderkey, o_totalprice FROM run_orders WHERE o_totalprice > :price AND o_orderkey % 3 = :part", {"price": 2.5e5, "part": 1})


# ---- L9 --------------------------------------------------------------------


def _bracket_sql(rounds: int) -> str:
    """The bracket, round by round: the larger share of a match's votes, else the seeded draw."""
    ctes = ["""e0 AS (SELECT l_orderkey AS window_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS slot
               FROM lineitem), r0 AS (SELECT window_id, slot, slot AS champion, 0 AS n_votes, 0 AS n_draws FROM e0)"""]
    for k in range(rounds):
        ctes.append(f"""p{k} AS (SELECT window_id, slot // 2 AS match, max(CASE WHEN slot % 2 = 0 THEN champion END) AS a, max(CASE WHEN slot % 2 = 1 THEN champion END) AS b,
                              sum(n_votes) AS n_votes, sum(n_draws) AS n_draws FROM r{k} GROUP BY 1, 2),
                       c{k} AS (SELECT p.window_id, p.match, count(CASE WHEN winner = 'A' THEN 1 END) AS va, count(CASE WHEN winner = 'B' THEN 1 END) AS vb
                               FROM p{k} p JOIN votes v ON v.pair_id = p.window_id + 8 * p.a + p.b WHERE p.b IS NOT NULL GROUP BY 1, 2),
                       r{k + 1} AS (SELECT p.window_id, p.match AS slot,
                               CASE WHEN b IS NULL OR coalesce(va, 0) > coalesce(vb, 0) THEN a WHEN coalesce(vb, 0) > coalesce(va, 0) THEN b
                                    WHEN (p.window_id % 7919 * 31 + a * 17 + b * 13) % 2 = 0 THEN a ELSE b END AS champion,
                               n_votes + coalesce(va, 0) + coalesce(vb, 0) AS n_votes,
                               n_draws + CASE WHEN b IS NOT NULL AND coalesce(va, 0) = coalesce(vb, 0) THEN 1 ELSE 0 END AS n_draws
                               FROM p{k} p LEFT JOIN c{k} c ON c.window_id = p.window_id AND c.match = p.match)""")
    return f"WITH {', '.join(ctes)} SELECT window_id, CAST(champion AS BIGINT) AS champion, CAST(n_votes AS BIGINT) AS n_votes, CAST(n_draws AS BIGINT) AS n_draws FROM r{rounds}"


@register("l9_knockout_by_votes", "L9,L8", sql=_bracket_sql(6), views=["votes"],
          note="each match has the votes of the pair numbered window + 8 a + b; the SQL goes six rounds (64 lines an order)")
def l9_votes(spark, d):
    li = tb.table(spark, d, "lineitem")
    li = dense_position(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
                        F.floor(F.col("l_linenumber") / 1000).cast("long"), "slot")
    votes = tb.votes(spark, d)

    def votes_for(matches):
        pair = matches.withColumn("pair_id", F.col("window_id") + 8 * F.col("a") + F.col("b"))
        return pair.join(votes, "pair_id").select("window_id", "match", "winner")

    return sc.knockout_by_votes(li.select(F.col("l_orderkey").alias("window_id"), "slot"), "window_id", "slot", votes_for)
