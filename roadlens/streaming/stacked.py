"""Streams of more than one stateful step: crossing vehicles by two stacked aggregates (X-2) and the live
traffic profile by a stream-stream join (X-7). Both are for append mode: a row comes out once, when the watermark
passes it, and state is dropped then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ops

END = "9000-01-01 00:00:00"


def run_to_end(make, schemas: list[T.StructType], spark: SparkSession, name: str) -> DataFrame:
    """Runs an append-mode stream over finite sources and flushes what is open.

    ``make(*markers)`` builds the stream, given one stream of end markers for each of ``schemas`` (which name their
    ``event_time``), to be united with the sources. After the sources' end each marker stream gets one row,
    far beyond any other and null elsewhere, so the watermark passes all windows; marker rows that come out
    (an outer join gives them) are left out where the result has ``event_time``."""
    root = ops._scratch(spark, name)
    for k, schema in enumerate(schemas):
        spark.createDataFrame([], schema).write.parquet(f"{root}/marker-{k}")
    df = make(*(spark.readStream.schema(s).parquet(f"{root}/marker-{k}") for k, s in enumerate(schemas)))
    for last in (False, True):
        for k, schema in enumerate(schemas if last else ()):
            value = lambda f: F.lit(END if f.name == "event_time" else None).cast(f.dataType).alias(f.name)
            spark.range(1).select(*(value(f) for f in schema)).write.mode("append").parquet(f"{root}/marker-{k}")
        q = (df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/chk")
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    out = spark.read.schema(df.schema).parquet(f"{root}/out")
    return out.filter(F.col("event_time") < F.lit(END).cast("timestamp")) if "event_time" in df.columns else out


def crossing_vehicles(log: DataFrame, keys: list[str], id_col: str, pos: str, lines: list[float], width: str = "360 seconds",
                      slide: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """X-2: distinct vehicles that cross each line, per sliding window [start, end): (window_start, *keys, line, n_crossing).

    First least and greatest position per vehicle and window, then vehicles with the line strictly between them
    per window and line; a line that nobody crosses in a window has no row. Rows of a null id are left out. A hot
    run spreads by vehicle in the first step and, counted on the map side, is one row a window and line in the second."""
    named = log.withWatermark("event_time", delay).filter(ops.after_watermark(F.col(id_col).isNotNull(), F.col("event_time")))
    seen = named.groupBy(F.window("event_time", width, slide).alias("w"), *keys, id_col).agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"))
    at = seen.select("w", *keys, "lo", "hi", F.explode(F.array(*[F.lit(float(x)) for x in lines])).alias("line"))
    at = at.filter((F.col("lo") < F.col("line")) & (F.col("hi") > F.col("line")))
    return at.groupBy("w", *keys, "line").agg(F.count(F.lit(1)).alias("n_crossing")).select(
        F.date_format(F.col("w.start").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("window_start"), *keys, "line", "n_crossing")


def live_profile(rows: DataFrame, profiles: DataFrame, cols: list[str], period_s: int, delay: str = "10 minutes", salts: int = 8,
                 salt_by: Column | None = None) -> DataFrame:
    """X-7: each row with the live profile in force: published at ``event_time`` of ``profiles`` (a multiple of ``period_s``
    seconds), in force until the next one is due. Rows of a period without profile come out with nulls.

    An outer interval join of two streams with watermarks on both sides: either side may come first, up to the
    watermark. The equality is on the period; the rows of one (any share of the stream) are spread over ``salts`` copies of
    its few profile rows, by the hash of ``salt_by``."""
    period = lambda c: F.floor(F.unix_seconds(c) / period_s).cast("long")
    left = rows.withWatermark("event_time", delay).withColumns({
        "_period": period(F.col("event_time")), "_salt": F.lit(0) if salt_by is None else F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")})
    right = profiles.withWatermark("event_time", delay).select(F.col("event_time").alias("published"), *cols)
    right = right.withColumns({"_p": period(F.col("published")), "_s": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))})
    in_force = (F.col("_period") == F.col("_p")) & (F.col("_salt") == F.col("_s")) & (F.col("event_time") >= F.col("published")) & (
        F.col("event_time") < F.col("published") + F.expr(f"interval {int(period_s)} seconds"))
    return left.join(right, in_force, "leftOuter").drop("_period", "_salt", "_p", "_s")
