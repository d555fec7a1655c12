"""Readers for the file formats of the studied code base.

Each reader is ``spark.read`` with an explicit schema (no inference pass over the
data) plus column expressions; directory layouts become columns through
``_metadata.file_path`` so one read covers every drive / run in a folder tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values (must equal the studied code base) -------------------------
NULL_TOKENS = ["NULL", "NaN", "N/A", ""]
EMISSION_COLUMNS = [
    "time", "step", "id", "position", "speed", "accel", "headway", "leader_speed", "speed_difference",
    "time_gap", "time_to_collision", "leader_id", "follower_id", "road_grade", "altitude",
    "instant_energy_consumption", "total_energy_consumption", "total_distance_traveled", "total_miles",
    "total_gallons", "avg_mpg", "realized_accel", "target_accel_no_noise_no_failsafe",
    "target_accel_with_noise_no_failsafe", "target_accel_no_noise_with_failsafe", "vdes", "target_speed",
    "max_headway",
]
KMH_PER_MS = 3.6
# ------------------------------------------------------------------------------

RAW_DRIVE_SCHEMA = T.StructType([
    T.StructField("index", T.LongType()),
    T.StructField("Time", T.DoubleType()),
    T.StructField("Velocity", T.DoubleType()),
    T.StructField("Acceleration", T.DoubleType()),
    T.StructField("LatitudeGPS", T.DoubleType()),
    T.StructField("LongitudeGPS", T.DoubleType()),
])

EMISSION_SCHEMA = T.StructType([
    T.StructField(c, T.LongType() if c == "step" else (T.StringType() if c in ("id", "leader_id", "follower_id") else T.DoubleType()))
    for c in EMISSION_COLUMNS
])

ROAD_FIT_SCHEMA = "interval_number double, interval_start double, interval_end double, slope double, intercept double"
ELEVATION_FIT_SCHEMA = ("interval_number double, interval_start double, interval_end double, quadratic_term double, "
                        "linear_term double, intercept double")


def null_tokens_to_double(txt: Column) -> Column:
    """NA tokens -> NULL, then numeric coercion with bad text -> NULL (NaN -> NULL)."""
    v = F.when(txt.isin(*NULL_TOKENS), F.lit(None)).otherwise(txt.try_cast("double"))
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def plot_fill(txt: Column) -> Column:
    """``fillna(-1)`` then ``"NULL" -> 0`` then numeric coercion with bad -> 0, in that order."""
    v = txt.try_cast("double")
    return (F.when(txt.isNull(), F.lit(-1.0)).when(txt == "NULL", F.lit(0.0))
            .otherwise(F.coalesce(F.when(~F.isnan(v), v), F.lit(0.0))))


def read_trajectories(spark: SparkSession, path_glob: str) -> DataFrame:
    """Every ``*/trajectory.csv`` under a glob; traj_id from the folder name; velocity
    scaled km/h -> m/s unless the path holds ``i680`` (already m/s)."""
    df = spark.read.schema(RAW_DRIVE_SCHEMA).option("header", True).csv(path_glob)
    path = F.col("_metadata.file_path")
    scale = F.when(path.contains("i680"), F.lit(1.0)).otherwise(F.lit(1 / KMH_PER_MS))
    return df.select(
        F.regexp_extract(path, r"([^/]+)/trajectory\.csv$", 1).alias("traj_id"),
        F.col("index").alias("seq"), F.col("Time").alias("time"),
        (F.col("Velocity") * scale).alias("speed"), F.col("Acceleration").alias("accel"),
        F.col("LatitudeGPS").alias("lat"), F.col("LongitudeGPS").alias("lon"),
    )


def _text(spark: SparkSession, path: str, schema: str, wholetext: bool = False) -> DataFrame | None:
    """Text of the files a pattern matches; None where it matches none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).text(path, wholetext=wholetext)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_tse(spark: SparkSession, folder_glob: str) -> DataFrame:
    """``speed/confidence/cvalue.csv`` (header ``time, 0, 1, ...``) + ``segments.json``
    -> long (traj_id, t, seg_idx, seg_start, avg_speed, confidence, cvalue)."""
    def wide(name, value):
        # line by line: folders may have different numbers of segments, and each has its own header
        lines = _text(spark, f"{folder_glob}/{name}.csv", "line string")
        if lines is None:
            return spark.createDataFrame([], f"traj_id string, t double, seg_idx int, {value} double")
        lines = lines.withColumn("traj_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+\.csv$", 1))
        lines = lines.filter((F.trim("line") != "") & ~F.ltrim("line").startswith("time")).withColumn("f", F.split("line", ","))
        long = lines.select("traj_id", F.trim(F.col("f")[0]).try_cast("double").alias("t"), F.posexplode(F.slice("f", 2, 1 << 20)).alias("seg_idx", "x"))
        return long.select("traj_id", "t", "seg_idx", F.trim("x").try_cast("double").alias(value))

    s, c, v = wide("speed", "avg_speed"), wide("confidence", "confidence"), wide("cvalue", "cvalue")
    x = s.join(c, ["traj_id", "t", "seg_idx"], "left").join(v, ["traj_id", "t", "seg_idx"], "left")
    seg = _text(spark, f"{folder_glob}/segments.json", "value string", wholetext=True)
    if seg is None:
        return x.withColumn("seg_start", F.lit(None).cast("double")).select("traj_id", "seg_idx", "t", "avg_speed", "confidence", "cvalue", "seg_start")
    seg = seg.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/segments\.json$", 1).alias("traj_id"),
        F.posexplode(F.from_json("value", "array<double>")).alias("seg_idx", "seg_start"),
    )
    return x.join(seg, ["traj_id", "seg_idx"], "left")


def read_emissions(spark: SparkSession, paths: list[str] | str, fmt: str = "csv") -> DataFrame:
    """S3: emission logs; controller and trajectory parsed from a ``x_{controller}_{traj}``
    file name, ``rl_fs`` kept whole."""
    reader = spark.read.schema(EMISSION_SCHEMA)
    df = reader.option("header", True).csv(paths) if fmt == "csv" else reader.parquet(*([paths] if isinstance(paths, str) else paths))
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1)
    return df.withColumns({
        "controller": F.regexp_extract(stem, r"^[^_]+_(rl_fs|[^_]+)_", 1),
        "trajectory": F.regexp_extract(stem, r"^[^_]+_(?:rl_fs|[^_]+)_(.*)$", 1),
    })


def read_null_csv(spark: SparkSession, path: str, numeric: list[str]) -> DataFrame:
    """All columns as text, NA tokens -> NULL, listed columns coerced to double."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.withColumns({c: null_tokens_to_double(F.col(c)) for c in numeric})


def read_rag_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested situation documents (one JSON array or object per file)."""
    schema = T.StructType([
        T.StructField("current_situation", T.StructType([
            T.StructField("speed", T.DoubleType()), T.StructField("headway", T.DoubleType()),
            T.StructField("leader_speed", T.DoubleType())])),
        T.StructField("action_explanation", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("hypothetical_situation", T.StringType()),
        T.StructField("situation_analysis", T.StringType()),
        T.StructField("embedding_model", T.StringType()),
    ])
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_road_fit(spark: SparkSession, path: str, elevation: bool = False) -> DataFrame:
    """Grade or elevation polynomial fit intervals (miles)."""
    return spark.read.schema(ELEVATION_FIT_SCHEMA if elevation else ROAD_FIT_SCHEMA).option("header", True).csv(path)


def read_traffic_state(spark: SparkSession, path: str) -> DataFrame:
    """``data, freeflow, congestion, dense`` cells holding list-of-pairs literals ->
    long (drive, state, start, end)."""
    df = spark.read.option("header", True).option("quote", '"').csv(path)
    parts = []
    for state in ("freeflow", "congestion", "dense"):
        p = df.select(F.col("data").alias("drive"), F.lit(state).alias("state"),
                      F.explode(F.from_json(F.col(state), "array<array<int>>")).alias("seg"))
        parts.append(p.select("drive", "state", F.col("seg")[0].alias("start"), F.col("seg")[1].alias("end")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
