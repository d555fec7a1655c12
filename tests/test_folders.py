"""Folders of keys (K7): made by the tasks on a local file system as Spark's writer makes them, read back without discovery of partitions."""

import os
import re
import uuid
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from roadlens.operators import sinks as sk
from roadlens.registry import load_all
from roadlens.sources import layout

NAMES = ["7_0_20", "a b", "x=1/2:3", "50%", "50%25", "c+d", "", None, "line\nend", "{y}[z]^", ".hidden"]
SCHEMA = "seq long, speed double, name string"


def odd_rows(spark):
    return spark.createDataFrame([(i * 3 + j, None if j == 1 else i + j / 2, n) for i, n in enumerate(NAMES) for j in range(3)], SCHEMA).select("name", "seq", "speed")


def rows_of(df):
    return sorted(map(tuple, df.select("name", "seq", "speed").collect()), key=str)


def layout_of(place):
    """Folders and files with the random part of a file's name cut, and their modes."""
    found = [p for p in Path(place).rglob("*") if p.parent != Path(place) or p.name != "._SUCCESS.crc"]
    return sorted((re.sub(r"part-\d+-[0-9a-f-]{36}", "part", str(p.relative_to(place))), p.stat().st_mode) for p in found)


def test_folders_are_those_of_sparks_writer(spark, tmp_path):
    x = odd_rows(spark)
    mine, other = str(tmp_path / "mine"), str(tmp_path / "other")
    x.limit(1).write.parquet(mine)  # is written over
    layout.write_folders(x, mine, "name", 1)
    x.repartition(1).write.partitionBy("name").parquet(other)
    assert layout_of(mine) == layout_of(other)
    read = [spark.read.schema(SCHEMA).parquet(p) for p in (mine, other)]  # Hadoop holds the files against their checksums
    assert rows_of(read[0]) == rows_of(read[1]) and read[0].count() == x.count()
    made, spark_made = (pq.ParquetFile(next(Path(p).glob("name=7_0_20/part-*"))) for p in (mine, other))
    assert made.schema_arrow.remove_metadata().equals(spark_made.schema_arrow.remove_metadata())
    assert made.metadata.row_group(0).column(0).compression == spark_made.metadata.row_group(0).column(0).compression
    assert rows_of(layout.read_folders(spark, mine, "name", SCHEMA, 3)) == rows_of(read[1])
    assert rows_of(layout.read_folders(spark, other, "name", SCHEMA, 5)) == rows_of(read[1])


def test_files_are_held_against_their_checksums(spark, tmp_path):
    place = str(tmp_path / "out")
    layout.write_folders(odd_rows(spark), place, "name", 2)
    part = next(Path(place).glob("name=7_0_20/part-*"))
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 1
    part.write_bytes(data)
    with pytest.raises(Exception, match="(?i)checksum"):
        spark.read.schema(SCHEMA).parquet(place).collect()


def test_other_file_systems_go_by_spark(spark, tmp_path, monkeypatch):
    x = odd_rows(spark)
    here, there = str(tmp_path / "here"), str(tmp_path / "there")
    layout.write_folders(x, here, "name", 2)
    monkeypatch.setattr(layout, "_local", lambda spark, place: (None, None))
    layout.write_folders(x, there, "name", 2)
    want = sorted([(n or None, s, v) for n, s, v in map(tuple, x.collect())], key=str)
    for place in (here, there):
        assert rows_of(layout.read_folders(spark, place, "name", SCHEMA, 2)) == want


def test_types_that_arrow_stores_otherwise_and_missing_columns(spark, tmp_path):
    x = spark.sql("SELECT id % 4 AS traj_id, id AS seq, timestamp_seconds(id) AS ts, CAST(id AS DECIMAL(9, 2)) AS d FROM range(20)")
    sk.write_subtrajectories(x, str(tmp_path / "a"))
    back = sk.read_subtrajectories(spark, str(tmp_path / "a"), "traj_id long, seq long, ts timestamp, d decimal(9,2)")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, x.collect()))
    y = spark.sql("SELECT id % 4 AS traj_id, CAST(id AS INT) AS seq, id % 3 = 0 AS b, date_add(DATE'2024-01-01', CAST(id AS INT)) AS day, encode(CAST(id AS STRING), 'utf-8') AS raw FROM range(20)")
    sk.write_subtrajectories(y, str(tmp_path / "b"))
    back = sk.read_subtrajectories(spark, str(tmp_path / "b"), "traj_id long, seq long, b boolean, day date, raw binary, none double")
    assert sorted(map(tuple, back.collect())) == sorted((*r, None) for r in y.collect())
    empty = y.filter("seq < 0")
    sk.write_subtrajectories(empty, str(tmp_path / "c"))
    assert os.path.exists(tmp_path / "c/_SUCCESS")
    assert sk.read_subtrajectories(spark, str(tmp_path / "c"), "traj_id long, seq long").count() == 0


def test_a_long_folder_is_one_file_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "ROW_GROUP", 300_000)
    x = spark.range(60_000).select(F.when(F.col("id") < 55_000, "long").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("name"), F.col("id").alias("seq"), F.rand(1).alias("speed"))
    place = str(tmp_path / "out")
    layout.write_folders(x, place, "name", 3)
    parts = list(Path(place).glob("name=long/part-*"))
    assert len(parts) == 1 and len(list(Path(place).glob("name=*"))) == 10
    assert pq.ParquetFile(parts[0]).metadata.num_row_groups > 2
    assert pq.read_table(parts[0], partitioning=None)["seq"].to_pylist() == list(range(55_000))
    assert rows_of(spark.read.schema(SCHEMA).parquet(place)) == rows_of(layout.read_folders(spark, place, "name", SCHEMA, 4)) == rows_of(x)


def test_a_repeated_task_leaves_the_same_files(tmp_path, monkeypatch):
    import pyspark

    class Task:
        attempt = 0

        @classmethod
        def get(cls):
            cls.attempt += 1
            return cls

        partitionId = staticmethod(lambda: 3)
        taskAttemptId = staticmethod(lambda: Task.attempt)

    monkeypatch.setattr(pyspark, "TaskContext", Task)
    write = layout._folder_writer(str(tmp_path), "name", "snappy", {}, 0o22)
    batches = [pa.record_batch({"name": ["a", "a", "b"], "seq": [1, 2, 3]}), pa.record_batch({"name": pa.array([], pa.string()), "seq": pa.array([], pa.int64())}),
               pa.record_batch({"name": ["b", "c"], "seq": [4, 5]})]
    seen = []
    for _ in range(2):
        assert next(iter(write(iter(batches)))).column(0).to_pylist() == [3]
        seen.append({p: p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()})
    assert seen[0] == seen[1] and len(seen[0]) == 6


def test_no_process_a_folder(spark, tmp_path):
    """Hadoop's local file system started four processes a folder: the pages that ended children of the JVM had touched show it."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()

    def pages():
        return int(Path(f"/proc/{pid}/stat").read_text().rsplit(")", 1)[1].split()[8])

    x = spark.range(900).select((F.col("id") % 300).cast("string").alias("name"), F.col("id").alias("seq"), F.rand(1).alias("speed")).localCheckpoint()
    before = pages()
    sk.write_subtrajectories(x, str(tmp_path / "out"), key="name")
    assert pages() - before < 300 * 20


def test_the_query_lists_no_folders_by_task(spark, tmp_path):
    """Discovery of partitions ran a task a folder and then the square of their number in the driver."""
    users = 150
    spark.range(users * 25).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id) AS ts", f"id % {users} AS user_id", "'a' AS event_type", "CAST(id % 50 AS DOUBLE) AS value",
                                       "'{}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "k7")
    try:
        rows = load_all()["k7_subtrajectory_files"].run(spark, str(tmp_path)).collect()
    finally:
        spark.sparkContext.setJobGroup(uuid.uuid4().hex, "after")
    assert sorted(r["name"] for r in rows) == sorted(f"{u}_{k}_20" for u in range(users) for k in range(2)) and {r["n_rows"] for r in rows} == {20}
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) < 2 * users
