"""Driver tables and the adapters that shape them into the domain forms.

Every adapter is a DataFrame plan over the parquet tables, so its work grows with
them. Orderings inside series use ``plans.ordering.dense_position`` (no single task
per series) and running sums use ``plans.blocks`` for the same reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..plans.blocks import running_sum
from ..plans.ordering import dense_position, time_bucket
from ..session import materialize

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def run_of(traj_id: str) -> F.Column:
    """A run is 15 vehicles of neighbouring numbers."""
    return F.floor(F.col(traj_id) / 15).cast("long")


def _user_drives(spark: SparkSession, sf_dir: str, with_positions: bool = False, runs: DataFrame | None = None) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type")
    if runs is not None:  # whole drives stay or go, so positions inside them are the same
        ev = ev.join(runs.select(F.col("run_id").alias("_run")), run_of("user_id") == F.col("_run"), "left_semi")
    speed = F.least(F.col("value"), F.lit(40.0))
    # W1 in exact integer arithmetic, on the same ordered pass: exclusive sum of cm/s
    sums = {"_cm": F.round(speed * 100).cast("long")} if with_positions else None
    ev = dense_position(ev, ["user_id"], ["ts", "event_id"], bucket=time_bucket("ts"), prefix_sums=sums)
    cols = [F.col("user_id").alias("traj_id"), "event_id", "seq", speed.alias("speed"), "event_type"]
    return ev.select(*cols, *(["_cm"] if with_positions else []))


def drive_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short drive per user (speeds in m/s, capped at 40)."""
    return materialize(_user_drives(spark, sf_dir))


def drive_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long drive per event type (velocity in km/h, capped at 120)."""
    ev = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")
    ev = dense_position(ev, ["event_type"], ["ts", "event_id"], bucket=time_bucket("ts"))
    return materialize(ev.select(
        F.col("event_type").alias("traj_id"),
        "event_id",
        "seq",
        F.least(F.col("value"), F.lit(120.0)).alias("velocity_kmh"),
    ))


def veh_log0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 15 vehicles; every user drive is one vehicle's log, all of its rows."""
    d = drive_user(spark, sf_dir)
    return d.select(
        F.floor(F.col("traj_id") / 15).cast("long").alias("run_id"),
        (F.col("traj_id") % 15).alias("id_num"),
        F.col("seq").alias("step"),
        (F.col("seq") * 0.1).alias("t"),
        "speed",
    )


def vehicle_id(id_num) -> F.Column:
    """Emission-style vehicle id: 0 is the recorded leader, 1 and 8 are AVs."""
    kind = (
        F.when(id_num == 0, F.lit("_trajectory_leader"))
        .when(id_num.isin(1, 8), F.lit("_rl_av"))
        .otherwise(F.lit("_idm_human"))
    )
    return F.concat(id_num.cast("string"), kind)


def veh_log(spark: SparkSession, sf_dir: str, keep: bool = True, runs: DataFrame | None = None) -> DataFrame:
    """Emission-like log: id, position from speeds (W1), leader of n is n-1. ``runs`` (run_id): the whole log of these runs
    only, for callers that join on the run anyway; other rows are left out before they are numbered.

    Positions come out of the same ordered pass that numbers the rows (one window
    stage and one small count table), summed in integer cm/s then divided once
    (cm/s * 0.1 s = mm)."""
    d = _user_drives(spark, sf_dir, with_positions=True, runs=runs)
    v = d.select(
        run_of("traj_id").alias("run_id"),
        (F.col("traj_id") % 15).alias("id_num"),
        F.col("seq").alias("step"),
        (F.col("seq") * 0.1).alias("t"),
        "speed",
        (F.col("_cm").cast("long") / 1e3 - 30.0 * (F.col("traj_id") % 15)).alias("position"),
    ).withColumn("id", vehicle_id(F.col("id_num")))
    v = v.select("run_id", "id_num", "step", "t", "speed", "id", "position")
    # ``keep``: materialize for callers that read it from several branches
    return materialize(v) if keep else v


def tse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic-state profiles: day = profile time, 3-hour bucket = segment."""
    ev = table(spark, sf_dir, "events").select("ts", "value")
    seg = F.floor(F.hour("ts") / 3).cast("int")
    return ev.groupBy(
        F.dayofmonth("ts").cast("long").alias("t"),
        seg.alias("seg_idx"),
        (seg * 1000.0 - 1000.0).alias("seg_start"),
    ).agg(rnd(F.avg(F.least(F.col("value"), F.lit(40.0))), 9).alias("avg_speed"))


def raw_drive(spark: SparkSession, sf_dir: str, with_gaps: bool = False) -> DataFrame:
    """GPS-like drive built from the long drives; optionally with dropped rows."""
    d = drive_type(spark, sf_dir)
    if with_gaps:
        d = d.filter(~(F.col("seq") % 17).isin(5, 6))
    return d.select(
        "traj_id",
        "seq",
        (F.col("seq") * 0.1).alias("time"),
        "velocity_kmh",
        (35.97 + (F.col("event_id") % 120) / 1e3).alias("lat"),
        (-86.7 + (F.col("seq") % 150) / 1e3).alias("lon"),
    )


def policy_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("cp_path"), F.col("l_orderkey").alias("run")).agg(
        F.max("l_extendedprice").alias("headway_max"),
        F.min("l_quantity").alias("headway_min"),
        F.avg("l_quantity").alias("system_mpg"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("crash"),
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("pair_id"),
        F.col("l_partkey").alias("voter"),
        F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "B").otherwise("?").alias("winner"),
    )


def answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("window_id"),
        F.concat(
            F.lit("<reasoning>"), F.col("o_orderstatus"), F.lit(" "), F.col("o_orderpriority"),
            F.lit("</reasoning><future_speeds>"),
            (F.col("o_custkey") % 60).cast("string"), F.lit(", "),
            (F.col("o_custkey") % 7).cast("string"), F.lit(",3,"),
            F.when(F.col("o_orderkey") % 11 == 0, "bad").otherwise("4"),
            F.lit("</future_speeds><future_headway>"), (F.col("o_custkey") % 230).cast("string"),
            F.lit(",10,20,30</future_headway><future_leader_speed>"), (F.col("o_custkey") % 55).cast("string"),
            F.lit(",1,2,3</future_leader_speed><future_reward>0.1,0.2,0.3,0.4</future_reward><reward_coefficients>"),
            F.when(F.col("o_orderkey") % 7 == 0, "1,2,3").otherwise("1,2,3,4"),
            F.lit("</reward_coefficients>"),
        ).alias("response"),
    )


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge responses: two integer score tags, one unparsable in thirteen."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("window_id"),
        F.concat(
            F.lit("<user_friendly_score> "), (F.col("o_custkey") % 11).cast("string"),
            F.lit(" </user_friendly_score><coherence_score>"),
            F.when(F.col("o_orderkey") % 13 == 0, "x").otherwise((F.col("o_orderkey") % 10).cast("string")),
            F.lit("</coherence_score>"),
        ).alias("judge_response"),
    )
