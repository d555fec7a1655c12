"""Query registry: one named Spark plan per operator, with its DuckDB oracle SQL.

The oracle SQL reads the pre-registered driver tables; the adapter views of
FIXTURES.md are prepended as CTEs (``views=``). The adapters here differ from the
fixture text in three deliberate points: ``veh_log0`` keeps every row of each user
drive (no ``seq < 40`` cap), ``tse.t`` is cast to BIGINT (Spark ``day`` is INT) and
``veh_log.position`` sums speeds in integer cm/s (exact, so both engines agree to the
last bit whatever their summation order); ``tse.avg_speed`` is rounded to 9 decimals
for the same reason.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

# Adapter views, in DuckDB/ANSI SQL. Literals are written 1e-1 etc. so they are DOUBLE.
ADAPTER_SQL: dict[str, str] = {
    "drive_user": """
        SELECT user_id AS traj_id, event_id,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
               least(value, 4e1) AS speed, event_type
        FROM events""",
    "drive_type": """
        SELECT event_type AS traj_id, event_id,
               row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS seq,
               least(value, 1.2e2) AS velocity_kmh
        FROM events""",
    "veh_log0": """
        SELECT CAST(floor(traj_id / 15) AS BIGINT) AS run_id, traj_id % 15 AS id_num, seq AS step,
               seq * 1e-1 AS t, speed
        FROM drive_user""",
    "veh_log": """
        SELECT run_id, id_num, step, t, speed,
               concat(CAST(id_num AS VARCHAR), CASE WHEN id_num = 0 THEN '_trajectory_leader'
                      WHEN id_num IN (1, 8) THEN '_rl_av' ELSE '_idm_human' END) AS id,
               coalesce(sum(CAST(round(speed * 100) AS BIGINT)) OVER (PARTITION BY run_id, id_num ORDER BY step
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1e3 - 3e1 * id_num AS position
        FROM veh_log0""",
    "tse": """
        SELECT CAST(day(ts) AS BIGINT) AS t, CAST(floor(hour(ts) / 3) AS INT) AS seg_idx,
               CAST(floor(hour(ts) / 3) AS INT) * 1e3 - 1e3 AS seg_start,
               round(avg(least(value, 4e1)), 9) AS avg_speed
        FROM events GROUP BY 1, 2, 3""",
    "raw_drive": """
        SELECT traj_id, seq, seq * 1e-1 AS time, velocity_kmh,
               3.597e1 + (event_id % 120) / 1e3 AS lat, -8.67e1 + (seq % 150) / 1e3 AS lon
        FROM drive_type""",
    "raw_drive_gaps": """
        SELECT traj_id, seq, seq * 1e-1 AS time, velocity_kmh,
               3.597e1 + (event_id % 120) / 1e3 AS lat, -8.67e1 + (seq % 150) / 1e3 AS lon
        FROM drive_type WHERE seq % 17 NOT IN (5, 6)""",
    "policy_run": """
        SELECT l_suppkey AS cp_path, l_orderkey AS run, max(l_extendedprice) AS headway_max,
               min(l_quantity) AS headway_min, avg(l_quantity) AS system_mpg,
               count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS crash
        FROM lineitem GROUP BY 1, 2""",
    "votes": """
        SELECT l_orderkey AS pair_id, l_partkey AS voter,
               CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' ELSE '?' END AS winner
        FROM lineitem""",
    "answer": """
        SELECT o_orderkey AS window_id,
               concat('<reasoning>', o_orderstatus, ' ', o_orderpriority, '</reasoning><future_speeds>',
                      CAST(o_custkey % 60 AS VARCHAR), ', ', CAST(o_custkey % 7 AS VARCHAR), ',3,',
                      CASE WHEN o_orderkey % 11 = 0 THEN 'bad' ELSE '4' END, '</future_speeds><future_headway>',
                      CAST(o_custkey % 230 AS VARCHAR), ',10,20,30</future_headway><future_leader_speed>',
                      CAST(o_custkey % 55 AS VARCHAR), ',1,2,3</future_leader_speed><future_reward>0.1,0.2,0.3,0.4</future_reward><reward_coefficients>',
                      CASE WHEN o_orderkey % 7 = 0 THEN '1,2,3' ELSE '1,2,3,4' END, '</reward_coefficients>') AS response
        FROM orders""",
    # judge responses: two integer score tags, one unparsable in thirteen
    "judge": """
        SELECT o_orderkey AS window_id,
               concat('<user_friendly_score> ', CAST(o_custkey % 11 AS VARCHAR), ' </user_friendly_score><coherence_score>',
                      CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE CAST(o_orderkey % 10 AS VARCHAR) END,
                      '</coherence_score>') AS judge_response
        FROM orders""",
}

ADAPTER_DEPS: dict[str, list[str]] = {
    "veh_log0": ["drive_user"],
    "veh_log": ["veh_log0"],
    "raw_drive": ["drive_type"],
    "raw_drive_gaps": ["drive_type"],
}


def _closure(views) -> list[str]:
    out: list[str] = []

    def visit(v):
        for d in ADAPTER_DEPS.get(v, []):
            visit(d)
        if v not in out:
            out.append(v)

    for v in views:
        visit(v)
    return out


def with_views(body: str, views=(), ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the adapter CTEs it needs plus query-specific ``ctes``."""
    parts = [f"{v} AS ({ADAPTER_SQL[v]}\n)" for v in _closure(views)]
    parts += [f"{n} AS ({s}\n)" for n, s in (ctes or [])]
    body = body.strip()
    if not parts:
        return body
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[14:].lstrip()
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(parts) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(parts) + "\n" + body


def rs(expr: str, d: int = 6) -> str:
    """SQL twin of ``roadlens.functions.numeric.rnd``: floor(x * 10^d + 0.5) / 10^d."""
    return f"(floor(({expr}) * 1e{d} + 5e-1) / 1e{d})"


def _split_args(s: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in s:
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
            continue
        depth += ch == "("
        depth -= ch == ")"
        cur += ch
    out.append(cur)
    return out


def floor_rounds(sql: str) -> str:
    """Rewrite every two-argument ``round(x, d)`` into ``rs(x, d)`` so the oracle rounds
    exactly like ``functions.numeric.rnd`` on the Spark side."""
    import re

    out, i = "", 0
    pat = re.compile(r"(?<![A-Za-z0-9_])round\(", re.IGNORECASE)
    while True:
        m = pat.search(sql, i)
        if not m:
            return out + sql[i:]
        out += sql[i:m.start()]
        j, depth = m.end(), 1
        while depth:
            depth += sql[j] == "("
            depth -= sql[j] == ")"
            j += 1
        args = _split_args(sql[m.end():j - 1])
        if len(args) == 2:
            out += rs(floor_rounds(args[0]), int(args[1]))
        else:
            out += "round(" + floor_rounds(sql[m.end():j - 1]) + ")"
        i = j


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    survey: list[str] = field(default_factory=list)
    note: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, survey: str, sql: str | None = None, views=(), ctes=None, note: str = ""):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = Query(
            name=name,
            run=fn,
            sql=floor_rounds(with_views(sql, views, ctes)) if sql is not None else None,
            survey=[s.strip() for s in survey.split(",")],
            note=note,
        )
        return fn

    return deco
