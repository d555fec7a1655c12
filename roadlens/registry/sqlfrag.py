"""SQL text for the oracle side, generated from the same fixed values as the Columns."""

from __future__ import annotations

from ..functions.physics import FUEL_COEFFS as C
from ..functions.physics import GAL_PER_HOUR_PER_GRAM_PER_SEC as K


def lit(x: float) -> str:
    """DOUBLE literal in both engines (exponent form)."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def fuel_sql(v: str, a: str, g: str = "0e0") -> str:
    ap = f"greatest({a}, 0e0)"
    fc = (
        f"{lit(C['C0'])} + {lit(C['C1'])} * {v} + {lit(C['C2'])} * {v} * {v} + {lit(C['C3'])} * {v} * {v} * {v}"
        f" + {lit(C['p0'])} * {a} + {lit(C['p1'])} * {a} * {v} + {lit(C['p2'])} * {a} * {v} * {v}"
        f" + {lit(C['q0'])} * {ap} * {ap} + {lit(C['q1'])} * {ap} * {ap} * {v}"
        f" + {lit(C['z0'])} * {g} + {lit(C['z1'])} * {g} * {v}"
    )
    floor_ = f"CASE WHEN {v} <= {lit(C['vc'])} THEN {lit(C['beta0'])} ELSE 0e0 END"
    return f"(greatest({fc}, {floor_}) * {lit(K)})"


# veh_log with realized accel (W11) and fuel
ACC_CTE = (
    "acc",
    """SELECT *, (speed - coalesce(lag(speed) OVER (PARTITION BY run_id, id_num ORDER BY step), 0e0)) / 1e-1 AS accel
       FROM veh_log""",
)
FUEL_CTE = ("fuel_log", f"SELECT *, {fuel_sql('speed', 'accel')} AS fuel FROM acc")
LEAD_CTE = (
    "lead_log",
    """SELECT f.*, l.position AS leader_position, l.speed AS leader_speed,
              l.position - f.position - 5e0 AS headway, l.speed - f.speed AS speed_difference
       FROM fuel_log f LEFT JOIN fuel_log l
         ON l.run_id = f.run_id AND l.step = f.step AND l.id_num = f.id_num - 1""",
)
LOG_CTES = [ACC_CTE, FUEL_CTE]
LEAD_CTES = [ACC_CTE, FUEL_CTE, LEAD_CTE]


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def tag_sql(t: str, tag: str) -> str:
    pat = f"'(?s)<{tag}>(.*?)</{tag}>'"
    return f"(CASE WHEN regexp_matches({t}, {pat}) THEN {strip_sql(f'regexp_extract({t}, {pat}, 1)')} END)"


def tags_all_sql(t: str, tag: str) -> str:
    pat = f"'(?s)<{tag}>(.*?)</{tag}>'"
    return f"list_transform(regexp_extract_all({t}, {pat}, 1), lambda x: {strip_sql('x')})"


def values_sql(raw: str) -> str:
    """F3 on a raw string: list of doubles, NULL when any token is bad or raw is NULL."""
    vals = (f"list_transform(list_filter(list_transform(string_split({raw}, ','), lambda x: {strip_sql('x')}),"
            f" lambda x: x <> ''), lambda x: TRY_CAST(x AS DOUBLE))")
    return (f"(CASE WHEN {raw} IS NULL THEN NULL WHEN len(list_filter({vals}, lambda v: v IS NULL)) > 0 THEN NULL"
            f" ELSE {vals} END)")
