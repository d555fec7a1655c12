"""Structured Streaming forms of the continuous questions (X-1 .. X-8).

Every operator is ``readStream`` -> transformations -> ``writeStream``. For tests and
the registry a stream runs with ``trigger(availableNow=True)`` into a parquet sink in
the shared checkpoint folder and is read back as a batch DataFrame, so its result can
be compared with the batch twin.

Aggregations use update mode through ``foreachBatch``: each micro-batch appends its
updated rows tagged with the batch id, and the reader keeps the latest row per key
(state stays bounded by the watermark; nothing is collected on the driver).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def read_events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """Stream the events table, a file or a folder of parts; event time as TIMESTAMP for
    watermarks. (The pattern matches the one name; a pattern keeps the file source from
    taking a single file for a partition root.)"""
    r = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{sf_dir}/events.parque[t]").withColumn("event_time", F.col("ts").cast("timestamp"))


def _scratch(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}-{uuid.uuid4().hex[:12]}"


def run_append(df: DataFrame, name: str) -> DataFrame:
    """Run a stateless / append-mode stream to completion; return its sink as a batch frame."""
    spark = df.sparkSession
    root = _scratch(spark, name)
    q = (df.writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/chk").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def run_append_to_end(make, spark: SparkSession, name: str) -> DataFrame:
    """Run an append-mode stream over a finite source and flush its open windows.

    ``make(markers)`` builds the stream from a stream of end markers (rows of EVENTS_SCHEMA
    to be united with the events). The query runs to the end of the source, then again from
    its own checkpoint with one marker far beyond any event: the watermark passes all open
    windows, which are emitted by the rule that emits all others. The marker's own rows have
    null keys and must be filtered out of the result."""
    root = _scratch(spark, name)
    end = spark.createDataFrame([], EVENTS_SCHEMA)
    end.write.parquet(f"{root}/marker")
    markers = spark.readStream.schema(EVENTS_SCHEMA).parquet(f"{root}/marker").withColumn("event_time", F.col("ts").cast("timestamp"))
    df = make(markers)
    for last in (False, True):
        if last:
            spark.range(1).select(F.lit("9000-01-01").cast("timestamp_ntz").alias("ts")).select(
                *(F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENTS_SCHEMA)
            ).write.mode("append").parquet(f"{root}/marker")
        q = (df.writeStream.format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/chk").outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def run_update(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an update-mode stream to completion through foreachBatch; the latest version
    of each key wins when read back."""
    spark = df.sparkSession
    root = _scratch(spark, name)
    out = f"{root}/out"

    def sink(batch: DataFrame, batch_id: int):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (df.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/chk")
         .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    schema = T.StructType(df.schema.fields + [T.StructField("_batch", T.LongType())])
    res = spark.read.schema(schema).parquet(out)
    w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return res.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_batch")


def after_watermark(condition, event_time):
    """``condition`` for rows that have an event time, in a form that names the time: a filter without it
    moves below the watermark, and drops end markers before they count."""
    return condition | event_time.isNull()


def _ntz_text(c) -> F.Column:
    return F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")


def tumbling_summary(events: DataFrame, key: str, value: str, width: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """X-1: per key and tumbling window: count, mean, min, max of the value."""
    return (events.withWatermark("event_time", delay)
            .groupBy(F.window("event_time", width).alias("w"), F.col(key))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"),
                 F.min(value).alias("min_value"), F.max(value).alias("max_value"))
            .select(_ntz_text(F.col("w.start")).alias("window_start"), key, "n", "mean_value", "min_value", "max_value"))


def sliding_counts(events: DataFrame, key: str, value: str, width: str = "360 seconds", slide: str = "60 seconds",
                   delay: str = "10 minutes") -> DataFrame:
    """X-2: sliding windows (360 s every 60 s) per key; half-open [start, end) windows."""
    return (events.withWatermark("event_time", delay)
            .groupBy(F.window("event_time", width, slide).alias("w"), F.col(key))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
            .select(_ntz_text(F.col("w.start")).alias("window_start"), key, "n", "total"))


def sessions(events: DataFrame, key: str, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """X-3: drives split by silence - a new session when the gap to the previous event is
    at least ``gap``; session end = last event + gap."""
    return (events.withWatermark("event_time", delay)
            .groupBy(F.session_window("event_time", gap).alias("s"), F.col(key))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(_ntz_text(F.col("s.start")).alias("session_start"), _ntz_text(F.col("s.end")).alias("session_end"), key, "n"))


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """X-4: running totals per key as a stateful aggregation (state = the totals)."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max("event_time").alias("last_time"))


def threshold_alerts(events: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """X-6 (stateless part): rows outside [lo, hi] become alerts."""
    return events.filter((F.col(value) < lo) | (F.col(value) > hi)).select(
        "event_id", "user_id", F.when(F.col(value) < lo, "low").otherwise("high").alias("alert"), value)


def attach_profile(events: DataFrame, profiles: DataFrame, key_expr, profile_key: str) -> DataFrame:
    """X-7: stream-static join of each event with the stored profile of its period
    (broadcast of the static side is left to its size)."""
    return events.withColumn("_pk", key_expr).join(profiles, F.col("_pk") == F.col(profile_key), "left").drop("_pk")


def drop_late_duplicates(events: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """X-8: duplicate rows within the watermark removed (state bounded by the delay)."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(keys)


SEGMENT_OUT = "traj_id string, state string, start long, end long"
SEGMENT_STATE = "start long, cur string, n long"


def _fold_segments(min_rows: int):
    """X-5 processor: the D2 fold carried across micro-batches in group state. Each call
    gives the segments it closed and the open one as it stands; a later version of a
    segment (same drive and start) replaces an earlier one. The state (start, label, rows
    so far) lives as long as the drive, so a pause changes neither numbers nor cuts."""
    import numpy as np
    import pandas as pd

    def fn(key, pdfs, state):
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts_us", "event_id"])
        labels = rows["label"].to_numpy()
        start, cur, n = state.get if state.exists else (0, labels[0], 0)
        prev = np.concatenate([[cur], labels[:-1]])
        out = []
        for j in np.nonzero(labels != prev)[0]:  # only the flips are visited
            i = n + int(j)
            if i - start >= min_rows:
                out.append((key[0], cur, start, i))
                start = i
            cur = labels[j]
        n += len(labels)
        state.update((int(start), str(cur), int(n)))
        out.append((key[0], cur, start, n - 1))
        yield pd.DataFrame(out, columns=["traj_id", "state", "start", "end"])

    return fn


def stream_segments(events: DataFrame, key: str, velocity, min_rows: int = 100) -> DataFrame:
    """X-5: traffic-state segmentation of each drive as a stateful stream, for update mode
    with (traj_id, start) as the key of a segment. Rows of a drive must come in time order
    over micro-batches (inside one they are sorted)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    from ..operators.traffic import traffic_state

    x = events.select(F.col(key).cast("string").alias("_k"), "event_id", F.unix_micros("event_time").alias("ts_us"), traffic_state(velocity).alias("label"))
    return x.groupBy("_k").applyInPandasWithState(_fold_segments(min_rows), SEGMENT_OUT, SEGMENT_STATE, "update", GroupStateTimeout.NoTimeout)
