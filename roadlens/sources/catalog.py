"""Run tables by name - list them, list their columns, read them by SQL text with parameters.

The catalogue is Spark's own (temporary views over the parquet tables of a folder); there is no database connection."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import TABLES, table

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def open_tables(spark: SparkSession, folder: str, names=TABLES, prefix: str = "") -> list[str]:
    """Registers ``{prefix}{name}`` as a view for each parquet table of the folder; returns the view names."""
    views = []
    for name in names:
        view = _checked(prefix + name)
        table(spark, folder, name).createOrReplaceTempView(view)
        views.append(view)
    return views


def _checked(name: str) -> str:
    """A name that can stand in SQL as it is; others are refused, not quoted."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a table or column name: {name!r}")
    return name


def get_tables(spark: SparkSession, pattern: str = "*") -> list[str]:
    """Names of the tables and views in sight, sorted; ``*`` stands for any text."""
    return sorted(t.name for t in spark.catalog.listTables(pattern=pattern))


def get_column_names(spark: SparkSession, name: str) -> list[str]:
    """Columns of a table in order; a table that is not there raises."""
    return [c.name for c in spark.catalog.listColumns(_checked(name))]


def query_to_df(spark: SparkSession, sql: str, args: dict | list | None = None, **tables: DataFrame) -> DataFrame:
    """``spark.sql`` with bound parameters (``:name`` or ``?``) and frames by name (``{name}``)."""
    return spark.sql(sql, args=args, **tables) if args is not None else spark.sql(sql, **tables)


def get_timestep_data(spark: SparkSession, name: str, columns: list[str] | None = None, limit: int | None = None, order: str = "timestep") -> DataFrame:
    """Columns of a run table by ``order``; the first ``limit`` rows if given. The order column is read even if it is not asked for."""
    x = spark.table(_checked(name))
    columns = list(columns or x.columns)
    missing = set(columns) - set(x.columns)
    if missing:
        raise KeyError(f"no column {sorted(missing)} in {name}")
    if order in x.columns:
        x = x.orderBy(order)
    elif limit is not None:
        raise KeyError(f"a limit needs the order column {order!r} in {name}")
    x = x.select(*columns)
    return x if limit is None else x.limit(limit)


def table_columns(spark: SparkSession, views: list[str]) -> DataFrame:
    """(table_name, column_name, position, n_rows) of the views: names from the catalogue, sizes counted by SQL."""
    names = [(v, c, k) for v in views for k, c in enumerate(get_column_names(spark, v), 1)]
    listed = spark.createDataFrame(names, "table_name string, column_name string, position int")
    sizes = [query_to_df(spark, f"SELECT :name AS table_name, count(*) AS n_rows FROM {_checked(v)}", {"name": v}) for v in views]
    total = sizes[0]
    for s in sizes[1:]:
        total = total.unionByName(s)
    return listed.join(total, "table_name")
