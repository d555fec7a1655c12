"""Streams equal their batch twins however the events table is cut into files."""

import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def cut_events(spark, folder, files):
    """The events table as a folder of parts in time order; one event type is silent in the middle parts."""
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect()
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    size = -(-len(rows) // files)
    parts = [rows[i:i + size] for i in range(0, len(rows), size)]
    if files > 2:
        parts = [p if k in (0, len(parts) - 1) else [r for r in p if r.event_type != "click"] for k, p in enumerate(parts)]
    os.makedirs(f"{folder}/events.parquet")
    for k, p in enumerate(parts):
        place = f"{folder}/part-{k}"
        spark.createDataFrame(p, schema).coalesce(1).write.parquet(place)
        name = next(f for f in os.listdir(place) if f.endswith(".parquet"))
        os.rename(f"{place}/{name}", f"{folder}/events.parquet/{k:03d}.parquet")
        os.utime(f"{folder}/events.parquet/{k:03d}.parquet", (time.time() - 1000 + k, time.time() - 1000 + k))
    return folder


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("files", [1, 5])
def test_segments_do_not_depend_on_the_cut(spark, tmp_path, files):
    from roadlens.operators import traffic as tf
    from roadlens.streaming import ops as st

    folder = cut_events(spark, str(tmp_path / "cut"), files)
    ev = st.read_events_stream(spark, folder, 1).withColumn("v", F.least(F.col("value"), F.lit(120.0)))
    got = st.run_update(st.stream_segments(ev, "event_type", F.col("v"), 20), "t5", ["traj_id", "start"])
    batch = spark.read.parquet(f"{folder}/events.parquet").withColumn("state", tf.traffic_state(F.least(F.col("value"), F.lit(120.0))))
    w = __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("event_type").orderBy("ts", "event_id")
    batch = batch.withColumn("seq", F.row_number().over(w) - 1).withColumnRenamed("event_type", "traj_id")
    want = tf.segment_states(batch, ["traj_id"], "seq", "state", 20)
    assert rows_of(got) == rows_of(want.select("traj_id", "state", "start", "end"))


@pytest.mark.parametrize("name", ["x1_tumbling_speed_summary", "x3_session_windows", "x4_running_totals"])
def test_streams_read_a_folder_of_parts(spark, tmp_path, name):
    folder = cut_events(spark, str(tmp_path / "cut"), 2)
    run = E.queries()[name]
    assert rows_of(run(spark, folder)) == rows_of(run(spark, SF))


def test_every_event_is_in_a_session(spark):
    out = E.queries()["x3_session_windows"](spark, SF)
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
