"""Sinks (K1-K7): writes laid out for the readers downstream.

Each writer takes a target folder; callers on a cluster pass a shared location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.layout import read_folders, write_folders


def write_emissions(df: DataFrame, path: str, time: str = "time", vid: str = "id", partitions: int | None = None) -> None:
    """K1: emissions sorted by (time, id): a range shuffle on time, then a local sort -
    files are globally ordered without a single-task sort."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, time).sortWithinPartitions(time, vid).write.mode("overwrite").parquet(path)



def wide_by_vehicle(df: DataFrame, keys: list[str], veh: str, values: list[str], vehicles: list) -> DataFrame:
    """K3: wide per-step table ``{veh}__{key}`` - pivot with the vehicle list given
    (no extra pass to find distinct values)."""
    aggs = [F.first(F.when(F.col(veh) == v, F.col(c)), ignorenulls=True).alias(f"{v}__{c}") for v in vehicles for c in values]
    return df.groupBy(*keys).agg(*aggs)


def write_json_records(df: DataFrame, path: str) -> None:
    """K4/K5/K6: JSON-lines records."""
    df.write.mode("overwrite").json(path)


def write_subtrajectories(df: DataFrame, path: str, key: str = "traj_id") -> None:
    """K7: one folder per sub-trajectory (partitioned by its name).

    Small rows, many folders: a task's time goes with its folders, not its bytes, so the number of tasks is given (left to itself, Spark
    merges them by bytes into a few), and each task puts its own folders in their place; the driver would one after another."""
    write_folders(df, path, key, _folder_tasks(df.sparkSession))


def read_subtrajectories(spark: SparkSession, path: str, schema: str, key: str = "traj_id") -> DataFrame:
    """K7: the rows of all folders of ``write_subtrajectories``, with their names as ``key``, one of the columns of ``schema``."""
    return read_folders(spark, path, key, schema, _folder_tasks(spark))


def _folder_tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def write_wide(df: DataFrame, path: str, keys: list[str], veh: str, values: list[str], vehicles: list, base: dict[str, F.Column]) -> None:
    """K3: the wide step table as it is stored: all text, ``base`` columns first, then ``{veh}__{key}``, missing values as the text NULL."""
    steps = df.groupBy(*keys).agg(*[c.alias(n) for n, c in base.items()])
    wide = steps.join(wide_by_vehicle(df, keys, veh, values, vehicles), keys)
    wide.select(*keys, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")).alias(c) for c in wide.columns if c not in keys]).write.parquet(path)


def vehicle_columns(wide: DataFrame, veh: str, keys: list[str] | None = None, base: tuple[str, ...] = ("timestep", "reward")) -> list[str]:
    """The base columns, then the columns of one vehicle, of all keys or those given."""
    own = [c for c in wide.columns if c.startswith(f"{veh}__") and (not keys or any(c.endswith(f"__{k}") for k in keys))]
    return [*base, *own]
