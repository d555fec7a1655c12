"""Folders of sub-trajectories (K7, F8): one a name, written by all tasks."""

import re
from pathlib import Path

from pyspark.sql import functions as F

from roadlens.operators import sinks as sk


def test_folders_are_spread_over_tasks_and_hold_their_rows(spark, tmp_path):
    x = spark.range(600).select(F.concat_ws("_", (F.col("id") % 200).cast("string"), F.lit("0_3")).alias("name"), F.col("id").alias("seq"))
    place = str(tmp_path / "out")
    sk.write_subtrajectories(x, place, key="name")
    parts = list(Path(place).glob("name=*/part-*.parquet"))
    assert len(parts) == 200  # a file a folder
    tasks = {re.match(r"part-(\d+)", p.name).group(1) for p in parts}
    assert len(tasks) > 4  # merged by their few bytes into one or two tasks before
    back = spark.read.schema("seq long, name string").parquet(place)
    assert sorted(map(tuple, back.select("name", "seq").collect())) == sorted(map(tuple, x.collect()))
