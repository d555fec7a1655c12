"""The window record (L12, F3): windows of one query share its list of found documents."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadlens.operators import retrieval as rt
from roadlens.sources import tables as tb

STATE = ["a", "b"]


def test_nearest_of_found_is_the_ranking_of_all_pairs_without_exchanging_them(spark):
    rng = random.Random(5)
    num = lambda: rng.choice([None, float("nan"), 0.0, 1.0, 1.0, 2.0, 7.5])
    windows = spark.createDataFrame([(k % 50 if k % 9 else 3, k % 4, num(), num()) for k in range(120)], "w long, q long, a double, b double")
    found = spark.createDataFrame([(k % 3, k % 17, num(), num()) for k in range(90)], "q long, d long, a double, b double")
    got = rt.nearest_of_found(windows, "w", "q", found, "d", STATE, 4)
    pairs = windows.join(found.select("q", "d", F.col("a").alias("x"), F.col("b").alias("y")), "q")
    l2 = (F.col("a") - F.col("x")) * (F.col("a") - F.col("x")) + (F.col("b") - F.col("y")) * (F.col("b") - F.col("y"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("w").orderBy(l2, "d"))).filter("rank <= 4")
    key = lambda x: sorted((r.w, r["rank"], r.d) for r in x.collect())
    assert key(got) == key(want) and got.count() > 100
    # k rows a window row leave the join at most, not one for each found document
    assert "Generate explode(slice(" in got._jdf.queryExecution().toString()


def test_log_of_some_runs_is_that_part_of_the_whole_log(spark, tmp_path):
    ev = spark.range(3000).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 977).alias("ts"),
                                  F.when(F.col("id") % 101 != 0, F.col("id") * 7 % 64).alias("user_id"), F.lit("x").alias("event_type"),
                                  (F.col("id") % 37 * 1.25).alias("value"))
    ev.write.parquet(f"{tmp_path}/events.parquet")
    runs = spark.createDataFrame([(1,), (3,), (99,), (None,)], "run_id long")
    rows = lambda x: sorted(map(tuple, x.collect()))
    part = rows(tb.veh_log(spark, str(tmp_path), runs=runs))
    assert part == rows(tb.veh_log(spark, str(tmp_path)).filter("run_id in (1, 3)")) and part
