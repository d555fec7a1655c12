"""Keyed state across micro-batches: running MPG (X-4), segments closed by timers (X-5), alerts
that need the row before (X-6). All three are ``transformWithStateInPandas`` processors on the
RocksDB state store; processors are built inside functions, so they are pickled by value and
executors need no copy of the package.

Order: rows of a key must come in time order over micro-batches; inside one they are sorted by
(time, tie). Only the columns a processor needs are handed over, and a micro-batch is bounded by
the source (``maxFilesPerTrigger`` / ``maxBytesPerTrigger``), which bounds what one hot key gives to one call.

State: X-4 and X-6 hold one small value a key and drop it by TTL (processing time); X-5 holds one a
drive and drops it by an event-time timer when the drive has been silent for ``idle``.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics as ph
from . import ops

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession, empty_batches: bool = True):
    """Sets the RocksDB provider for queries started inside. ``empty_batches=False`` for state with
    a TTL: with processing time, batches without data would otherwise follow each other for ever."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


# ---- X-4 ----------------------------------------------------------------------

MPG_OUT = "key string, n long, miles double, gallons double, mpg double, last_us long"


def _mpg_processor(ttl_ms: int | None):
    from pyspark.sql.streaming import StatefulProcessor

    coeff, scale, per_mile, dt = dict(ph.FUEL_COEFFS), ph.GAL_PER_HOUR_PER_GRAM_PER_SEC, ph.METERS_PER_MILE, ph.DT

    class RunningMpg(StatefulProcessor):
        def init(self, handle):
            self.totals = handle.getValueState("totals", "n long, speed double, miles double, gallons double, last_us long", *([] if ttl_ms is None else [ttl_ms]))

        def handleInputRows(self, key, rows, timerValues):
            import numpy as np
            import pandas as pd

            x = pd.concat(list(rows), ignore_index=True).sort_values(["us", "tie"])
            n, last, miles, gallons, last_us = self.totals.get() if self.totals.exists() else (0, 0.0, 0.0, 0.0, None)
            v = x["speed"].to_numpy(float)
            a = np.diff(v, prepend=last) / dt
            up = np.maximum(a, 0.0)
            c = coeff
            rate = (c["C0"] + c["C1"] * v + c["C2"] * v * v + c["C3"] * v * v * v + c["p0"] * a + c["p1"] * a * v + c["p2"] * a * v * v
                    + c["q0"] * up * up + c["q1"] * up * up * v)
            rate = np.maximum(rate, np.where(v <= c["vc"], c["beta0"], 0.0)) * scale
            n += len(v)
            miles += float(v.sum()) / per_mile * dt
            gallons += float(rate.sum()) / 3600.0 * dt
            last_us = max(int(x["us"].iloc[-1]), last_us or int(x["us"].iloc[-1]))
            self.totals.update((n, float(v[-1]), miles, gallons, last_us))
            yield pd.DataFrame({"key": [key[0]], "n": [n], "miles": [miles], "gallons": [gallons], "mpg": [miles / (gallons + 1e-6)], "last_us": [last_us]})

        def close(self):
            pass

    return RunningMpg()


def running_mpg(events: DataFrame, key: str, speed: Column, tie: str = "event_id", ttl_ms: int | None = 30 * 24 * 3600 * 1000) -> DataFrame:
    """X-4: (key, n, miles, gallons, mpg, last_us) of each vehicle after every micro-batch that has rows of it.

    Acceleration is against the row before, also of an earlier micro-batch (0 before the first); fuel is F9; mpg is
    miles / (gallons + 1e-6). A key without rows for ``ttl_ms`` of processing time is dropped and starts anew
    (None: never). Rows with a null key or speed are left out."""
    x = events.select(F.col(key).cast("string").alias("key"), F.unix_micros("event_time").alias("us"), F.col(tie).alias("tie"), speed.cast("double").alias("speed"))
    x = x.filter("key is not null and speed is not null")
    return x.groupBy("key").transformWithStateInPandas(_mpg_processor(ttl_ms), MPG_OUT, "update", "none" if ttl_ms is None else "processingTime")


# ---- X-5 ----------------------------------------------------------------------

SEGMENT_OUT = "traj_id string, state string, start long, end long"


def _segment_processor(min_rows: int, idle_ms: int, names: list[str]):
    from pyspark.sql.streaming import StatefulProcessor

    class Segments(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.drive = handle.getValueState("drive", "start long, cur string, n long, last_ms long")

        def handleInputRows(self, key, rows, timerValues):
            import numpy as np
            import pandas as pd

            # a hot drive's rows are kept as numbers, not as frames of texts and times
            us, tie, code = (np.concatenate(c) for c in zip(*((x["us"].to_numpy(np.int64), x["tie"].to_numpy(), x["code"].to_numpy(np.int8)) for x in rows)))
            order = np.lexsort((tie, us))
            at, code = us[order] // 1000, code[order]
            del us, tie, order
            out = []
            if self.drive.exists():
                start, cur, n, last = self.drive.get()
                cur = names.index(cur)
            else:
                start, cur, n, last = 0, int(code[0]), 0, int(at[0])
                self.handle.registerTimer(int(at[-1]) + idle_ms + 1)  # one timer a drive; it moves itself on when it fires
            # rows come before timers in a micro-batch: a silence is seen here too, wherever the rows are cut
            quiet = np.flatnonzero(np.diff(at, prepend=last) > idle_ms).tolist()
            edges = sorted({0, *quiet, len(at)})
            for lo, hi in zip(edges, edges[1:]):
                if lo in quiet:
                    out.append((key[0], names[cur], start, n - 1))
                    start, cur, n = 0, int(code[lo]), 0
                part = code[lo:hi]
                for j in np.flatnonzero(part != np.concatenate([np.array([cur], np.int8), part])[:-1]):  # only the flips are visited
                    i = n + int(j)
                    if i - start >= min_rows:
                        out.append((key[0], names[cur], start, i))
                        start = i
                    cur = int(part[j])
                n += len(part)
            self.drive.update((int(start), names[cur], int(n), max(int(at[-1]), last)))
            yield pd.DataFrame(out, columns=["traj_id", "state", "start", "end"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            out = []
            if self.drive.exists():
                start, cur, n, last_ms = self.drive.get()
                if last_ms + idle_ms >= timerValues.getCurrentWatermarkInMs():
                    self.handle.registerTimer(last_ms + idle_ms + 1)
                else:
                    out.append((key[0], cur, start, n - 1))
                    self.drive.clear()
            yield pd.DataFrame(out, columns=["traj_id", "state", "start", "end"])

        def close(self):
            pass

    return Segments()


def closed_segments(events: DataFrame, key: str, velocity: Column, min_rows: int = 100, idle: str = "30 days", delay: str = "10 minutes",
                    tie: str = "event_id") -> DataFrame:
    """X-5 for append mode: a traffic-state segment is emitted once, when it closes. A drive ends with a silence of more than
    ``idle``: its last segment closes when the watermark (or its next row) is that far, its state is dropped, and
    later rows are a new drive numbered from 0. Rows with a null key or time are left out."""
    from ..operators.traffic import STATES, traffic_state

    code = F.array_position(F.array(*[F.lit(s) for s in STATES]), traffic_state(velocity)) - 1
    x = events.withWatermark("event_time", delay).select(F.col(key).cast("string").alias("key"), F.col("event_time").alias("ts"), F.unix_micros("event_time").alias("us"),
                                                         F.col(tie).alias("tie"), code.cast("byte").alias("code"))
    x = x.filter(ops.after_watermark(F.col("key").isNotNull(), F.col("ts"))).filter(F.col("ts").isNotNull())
    idle_ms = int(events.sparkSession.sql(f"SELECT unix_millis(timestamp '1970-01-01 00:00:00+00:00' + interval {idle})").first()[0])
    return x.groupBy("key").transformWithStateInPandas(_segment_processor(min_rows, idle_ms, list(STATES)), SEGMENT_OUT, "append", "eventTime")


# ---- X-6 ----------------------------------------------------------------------

#: fixed values: jump of the gap (m), change of the acceleration per second, safe time headway and TTC (s)
GAP_JUMP, ACCEL_JUMP, SAFE_HEADWAY, SAFE_TTC = 3.5, 0.9, 2.0, 4.5
LOW_TTC = 6.0

ALERT_OUT = "key string, step long, alert string, value double"
ALERT_COLS = ["step", "headway", "accel", "speed", "leader_speed"]


def _alert_processor(ttl_ms: int | None, low_ttc: float):
    from pyspark.sql.streaming import StatefulProcessor

    jump, accel_jump, safe_headway, safe_ttc, dt = GAP_JUMP, ACCEL_JUMP, SAFE_HEADWAY, SAFE_TTC, ph.DT

    class Alerts(StatefulProcessor):
        def init(self, handle):
            self.before = handle.getValueState("before", "headway double, accel double, ttc double", *([] if ttl_ms is None else [ttl_ms]))

        def handleInputRows(self, key, rows, timerValues):
            import numpy as np
            import pandas as pd

            x = pd.concat(list(rows), ignore_index=True).sort_values("step")
            step = x["step"].to_numpy()
            h, a, v, vl = (x[c].to_numpy(float) for c in ("headway", "accel", "speed", "leader_speed"))
            ph_, pa, pt = self.before.get() if self.before.exists() else (np.nan, np.nan, np.nan)
            with np.errstate(divide="ignore", invalid="ignore"):
                rv = vl - v
                ttc = np.where(rv < 0, h / -rv, np.inf)
                gap = np.where(v > 0, h / v, 60.0)
                safe = ((rv > 0) & (gap > safe_headway)) | ((rv < 0) & (np.where(rv < 0, -h / rv, 60.0) > safe_ttc))
            h0, a0, t0 = (np.concatenate([[p], s[:-1]]) for p, s in ((ph_, h), (pa, a), (pt, ttc)))
            changed = safe & (np.abs(a - a0) > accel_jump * dt)
            with np.errstate(invalid="ignore"):
                found = {"cut_in": (h - h0 <= -jump) & changed, "cut_out": (h - h0 >= jump) & changed,
                         "crash": (h < 0) & ~(h0 < 0), "low_ttc": (h >= 0) & (ttc < low_ttc) & ~(t0 < low_ttc)}
            self.before.update((float(h[-1]), float(a[-1]), float(ttc[-1])))
            value = {"cut_in": h - h0, "cut_out": h - h0, "crash": h, "low_ttc": ttc}
            out = [pd.DataFrame({"key": key[0], "step": step[m], "alert": name, "value": value[name][m]}) for name, m in found.items() if m.any()]
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"key": [], "step": [], "alert": [], "value": []}).astype(
                {"key": str, "step": "int64", "alert": str, "value": float})

        def close(self):
            pass

    return Alerts()


def row_alerts(rows: DataFrame, keys: list[str], low_ttc: float = LOW_TTC, ttl_ms: int | None = 24 * 3600 * 1000) -> DataFrame:
    """X-6: (key, step, alert, value) for append mode, from ``step, headway, accel, speed, leader_speed`` of each vehicle
    (``key``: the values of ``keys`` joined by a slash). Against the row before, also of an earlier micro-batch:

    * ``cut_in`` / ``cut_out`` - the gap falls / grows by 3.5 m or more while the acceleration changes by more than 0.9
      times the step and time headway or TTC is safe (W17); value: change of the gap;
    * ``crash`` - the gap becomes negative; value: the gap;
    * ``low_ttc`` - time to collision falls below ``low_ttc`` s; value: the TTC.

    A first row has no row before: it can be a crash or a low TTC only. The same holds after ``ttl_ms`` of processing time
    without rows (None: never). Rows with a null key or null among the columns are left out."""
    x = rows.select(F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"), *keys, *[F.col(c) for c in ALERT_COLS]).dropna().drop(*keys)
    x = x.select("key", F.col("step").cast("long").alias("step"), *[F.col(c).cast("double").alias(c) for c in ALERT_COLS[1:]])
    return x.groupBy("key").transformWithStateInPandas(_alert_processor(ttl_ms, low_ttc), ALERT_OUT, "append", "none" if ttl_ms is None else "processingTime")


# ---- a derived table as a stream ----------------------------------------------------

def stream_of(df: DataFrame, name: str, order: Column | None = None, cuts: list | None = None, time: Column | None = None) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it as a stream, with ``event_time`` = ``time`` if given.

    ``cuts``: values of ``order`` that cut the table; the pieces are written one after the other and
    each is a micro-batch of its own (tests cut at every place). Without cuts: one micro-batch."""
    spark = df.sparkSession
    place = f"{ops._scratch(spark, name)}/rows"
    df = df if time is None else df.withColumn("event_time", time)
    if not cuts:
        df.write.parquet(place)
        return spark.readStream.schema(df.schema).parquet(place)
    edges = [None, *sorted(cuts), None]
    for lo, hi in zip(edges, edges[1:]):
        part = df if lo is None else df.filter(order >= lo)
        part = part if hi is None else part.filter(order < hi)
        part.coalesce(1).write.mode("append").parquet(place)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(place)
