"""Queries over the emission-like vehicle log (veh_log adapter)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import emissions as em
from ..operators import metrics as mt
from ..session import materialize
from ..sources import tables as tb
from .core import register
from .sqlfrag import LEAD_CTES, LOG_CTES

MPG_SQL = """
CASE WHEN sum({f}) / 3600e0 * 1e-1 > 0
     THEN (sum({s}) / 1609.34e0 * 1e-1) / (sum({f}) / 3600e0 * 1e-1) END"""


def mpg_sql(speed="speed", fuel="fuel", where=None):
    if where:
        speed = f"CASE WHEN {where} THEN {speed} END"
        fuel = f"CASE WHEN {where} THEN {fuel} END"
    return f"round({MPG_SQL.format(s=speed, f=fuel)}, 6)"


def fuel_log(spark, d, runs=None):
    """veh_log (of ``runs`` where given) + W11 realized accel + F9 fuel rate."""
    return materialize(em.with_fuel(em.realized_accel(tb.veh_log(spark, d, keep=False, runs=runs))))


@register(
    "a2_mpg_by_run",
    "A2,W1,W11,F9,F20,P4",
    sql=f"""SELECT run_id, {mpg_sql()} AS system_mpg, {mpg_sql(where="id LIKE '%av%'")} AS av_mpg
            FROM fuel_log GROUP BY run_id""",
    views=["veh_log"],
    ctes=LOG_CTES,
)
def a2_mpg_by_run(spark, d):
    return mt.mpg_metrics(fuel_log(spark, d), ["run_id"])
