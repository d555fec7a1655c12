"""Vehicle-log (emissions) enrichment: the per-row columns of the logged table.

Input: one row per (run, vehicle, step) with at least speed and position. All
series windows go through ``plans.blocks`` keyed by (run, vehicle) so a very long
vehicle log is cut into bounded tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import physics as ph
from ..plans.blocks import over_blocks, running_sum

KEYS = ["run_id", "id_num"]


def realized_accel(df: DataFrame, keys=KEYS, seq="step", speed="speed", dt=ph.DT, name="accel") -> DataFrame:
    """(v - v_prev) / dt, first row with v_prev = 0."""
    return over_blocks(
        df, list(keys), seq, 1, 0,
        lambda w: {name: (F.col(speed) - F.coalesce(F.lag(speed, 1).over(w), F.lit(0.0))) / dt},
    )


def with_fuel(df: DataFrame, speed="speed", accel="accel", grade=0.0, name="fuel") -> DataFrame:
    """F9 column."""
    return df.withColumn(name, ph.fuel_rate(speed, accel, grade))


def attach_leader(
    df: DataFrame,
    run="run_id",
    step="step",
    id_col="id_num",
    leader_col="leader_num",
    cols=("position", "speed"),
    prefix="leader_",
) -> DataFrame:
    """Equi self-join of each row with its leader's row at the same step (left).

    Both sides are keyed by (run, step, vehicle); the shuffle is on (run, step), which
    spreads a run with many steps over all tasks.
    """
    lead = df.select(
        F.col(run).alias("_r"), F.col(step).alias("_s"), F.col(id_col).alias("_l"),
        *[F.col(c).alias(prefix + c) for c in cols],
    )
    cond = (F.col(run) == F.col("_r")) & (F.col(step) == F.col("_s")) & (F.col(leader_col) == F.col("_l"))
    return df.join(lead, cond, "left").drop("_r", "_s", "_l")


def platoon_leader(df: DataFrame) -> DataFrame:
    """Adapter rule: leader of vehicle n is n-1 (vehicle 0 has none)."""
    return df.withColumn("leader_num", F.when(F.col("id_num") > 0, F.col("id_num") - 1))


def enrich(df: DataFrame, dt=ph.DT) -> DataFrame:
    """Full emissions-style row from (run, id, step, position, speed).

    accel (W11), fuel (F9), leader columns (J4), headway / time gap / TTC / speed
    difference (F12), cumulative miles / gallons / fuel and avg_mpg (W9).
    """
    x = realized_accel(df, dt=dt)
    x = with_fuel(x)
    x = platoon_leader(x)
    x = attach_leader(x)
    hw = ph.headway("leader_position", "position")
    x = x.withColumns(
        {
            "headway": hw,
            "speed_difference": F.col("leader_speed") - F.col("speed"),
        }
    )
    x = x.withColumns(
        {
            "time_gap": ph.time_gap("headway", "speed"),
            "time_to_collision": ph.time_to_collision("headway", "speed", "leader_speed"),
        }
    )
    x = cumulative_fuel(x, dt=dt)
    return x


def cumulative_fuel(df: DataFrame, keys=KEYS, seq="step", dt=ph.DT) -> DataFrame:
    """total_energy = running sum of fuel; total_distance = position - first
    position; total_miles = distance / 1609.34; total_gallons = energy / 3600 * dt;
    avg_mpg = miles / (gallons + 1e-6)."""
    x = running_sum(df, list(keys), seq, {"total_energy": F.col("fuel")})
    first = df.groupBy(*keys).agg(F.min_by("position", seq).alias("_pos0"))
    x = x.join(first, on=list(keys), how="inner")
    x = x.withColumns(
        {
            "total_distance": F.col("position") - F.col("_pos0"),
            "total_gallons": F.col("total_energy") / 3600.0 * dt,
        }
    ).drop("_pos0")
    x = x.withColumn("total_miles", F.col("total_distance") / ph.METERS_PER_MILE)
    return x.withColumn("avg_mpg", F.col("total_miles") / (F.col("total_gallons") + 1e-6))
