"""Connected components of a link table by star contraction."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: rows of ids or links that a task handles at least, where a table is small
TASK_ROWS = 200_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, in no more tasks than those are worth (an exchange into many
    partitions costs files and tasks, whatever its size)."""
    tasks = max(1, math.ceil(rows / TASK_ROWS))
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, root): every id of a link with the smallest id it reaches.

    Rounds of large-star and small-star; a round's links go to the checkpoint folder and
    only their count and checksum come to the driver. Minima are aggregated before the
    exchange, so a node of very many links is no single task's list.
    """
    n = links.count()
    edges = cut_lineage(few(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), n))
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark, n = now, 2 * now[0]
        both = few(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), n)
        least = few(both.groupBy("u").agg(F.min("v").alias("m")), n).withColumn("m", F.least("u", "m"))
        star = few(both.join(least, "u"), n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        star = cut_lineage(few(star.distinct(), n))
        low = few(star.groupBy("u").agg(F.min("v").alias("m")), n)
        edges = cut_lineage(few(
            few(star.join(low, "u"), n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct(), n))
    n = 0 if mark is None else mark[0]
    tops = few(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct(), n)
    return few(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root")), n).unionByName(
        few(tops.join(edges.select(F.col("u").alias("id")), "id", "left_anti"), n))
