"""Keyed state over micro-batches: one answer however the rows are cut, state that is dropped, timers, stacked steps."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from roadlens.streaming import ops as st
from roadlens.streaming import stacked as sk
from roadlens.streaming import stateful as sf

T0 = datetime(2024, 1, 1)


def rows_of(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert [v for v in x if not isinstance(v, float)] == [v for v in y if not isinstance(v, float)]
        assert [v for v in x if isinstance(v, float)] == pytest.approx([v for v in y if isinstance(v, float)], rel=1e-9, abs=1e-9)


@pytest.fixture(scope="module")
def events(spark):
    import random

    rng = random.Random(7)
    rows = [(k, T0 + timedelta(seconds=7 * k), rng.choice(["a", "a", "a", "b", "c"]), rng.choice([20.0, 25.0, 60.0, 100.0, 31.5])) for k in range(400)]
    rows += [(900, T0, None, 3.0), (901, T0, "a", None)]
    return spark.createDataFrame(rows, "event_id long, event_time timestamp, who string, v double")


def brute_mpg(events):
    from roadlens.functions import physics as ph

    out = {}
    c = ph.FUEL_COEFFS
    for r in sorted(events.collect(), key=lambda r: (r.event_time, r.event_id)):
        if r.who is None or r.v is None:
            continue
        n, last, miles, gallons = out.get(r.who, (0, 0.0, 0.0, 0.0))
        v, a = r.v, (r.v - last) / 0.1
        up = max(a, 0.0)
        fc = (c["C0"] + c["C1"] * v + c["C2"] * v**2 + c["C3"] * v**3 + c["p0"] * a + c["p1"] * a * v + c["p2"] * a * v * v + c["q0"] * up * up
              + c["q1"] * up * up * v)
        fuel = max(fc, c["beta0"] if v <= c["vc"] else 0.0) * 1.268
        out[r.who] = (n + 1, v, miles + v / 1609.34 * 0.1, gallons + fuel / 3600 * 0.1)
    return sorted((gallons, who, miles, miles / (gallons + 1e-6), n) for who, (n, _, miles, gallons) in out.items())


@pytest.mark.parametrize("cuts", [[], [1, 2, 80, 81, 250]])
def test_running_mpg_does_not_depend_on_the_cut(spark, events, cuts):
    stream = sf.stream_of(events, "t-x4", F.col("event_id"), cuts)
    with sf.state_store(spark, empty_batches=False):
        got = st.run_update(sf.running_mpg(stream, "who", F.col("v")), "t-x4", ["key"]).drop("last_us")
    close(sorted(rows_of(got)), brute_mpg(events))


def test_running_mpg_forgets_a_silent_key(spark, events, tmp_path):
    """A key without rows for the time to live starts anew; one that is never dropped goes on."""
    counts = {}
    for ttl in (1500, None):
        place, chk, out = (f"{tmp_path}/{ttl}-{x}" for x in ("rows", "chk", "out"))
        first = events.filter("event_id < 200")
        first.coalesce(1).write.parquet(place)

        def run():
            stream = spark.readStream.schema(events.schema).parquet(place)
            with sf.state_store(spark, empty_batches=False):
                q = (sf.running_mpg(stream, "who", F.col("v"), ttl_ms=ttl).writeStream.outputMode("update").option("checkpointLocation", chk)
                     .foreachBatch(lambda b, i: b.withColumn("_batch", F.lit(i)).write.mode("append").parquet(out)).trigger(availableNow=True).start())
                q.awaitTermination()

        run()
        time.sleep(2)
        events.filter("event_id between 200 and 399").coalesce(1).write.mode("append").parquet(place)
        run()
        counts[ttl] = {r.key: r.n for r in spark.read.parquet(out).groupBy("key").agg(F.max_by("n", "_batch").alias("n")).collect()}
    whole = {r.who: r["count"] for r in events.filter("event_id < 400").groupBy("who").count().collect()}
    late = {r.who: r["count"] for r in events.filter("event_id between 200 and 399").groupBy("who").count().collect()}
    assert counts[None] == whole and counts[1500] == late


def brute_segments(rows, min_rows, idle_s):
    """(end, start, state, traj) of drives cut by ``idle_s`` of silence."""
    out, drives = [], {}
    for r in sorted(rows, key=lambda r: (r.event_time, r.event_id)):
        if r.who is not None:
            d = drives.setdefault(r.who, [[]])
            if d[-1] and (r.event_time - d[-1][-1][0]).total_seconds() > idle_s:
                d.append([])
            d[-1].append((r.event_time, "congestion" if r.v < 40 else "dense" if r.v < 80 else "freeflow"))
    for who, parts in drives.items():
        for part in parts:
            labels = [s for _, s in part]
            start = 0
            for i in range(1, len(labels)):
                if labels[i] != labels[i - 1] and i - start >= min_rows:
                    out.append((i, start, labels[i - 1], who))
                    start = i
            out.append((len(labels) - 1, start, labels[-1], who))
    return sorted(out)


@pytest.mark.parametrize("cuts", [[], [3, 120, 121, 300]])
def test_closed_segments(spark, events, cuts):
    rows = events.filter("v is not null")
    stream = sf.stream_of(rows, "t-x5", F.col("event_id"), cuts)
    make = lambda end: sf.closed_segments(stream.unionByName(end), "who", F.col("v"), 4)
    with sf.state_store(spark):
        got = sk.run_to_end(make, [stream.schema], spark, "t-x5")
    assert rows_of(got) == brute_segments(rows.collect(), 4, 1e9)


def test_a_timer_closes_a_silent_drive(spark):
    """Silence longer than ``idle``, seen by the watermark, ends a drive: its state goes and numbers start again."""
    at = lambda k, s: (k, T0 + timedelta(seconds=s), "a", 20.0 if k % 9 < 5 else 60.0)
    rows = [at(k, k) for k in range(30)] + [(100 + k, T0 + timedelta(seconds=3600 + k), "b", 90.0) for k in range(5)] + [at(200 + k, 9000 + k) for k in range(10)]
    df = spark.createDataFrame(rows, "event_id long, event_time timestamp, who string, v double")
    stream = sf.stream_of(df, "t-timer", F.col("event_id"), [100, 200])
    make = lambda end: sf.closed_segments(stream.unionByName(end), "who", F.col("v"), 3, "10 minutes", "1 second")
    with sf.state_store(spark):
        got = sk.run_to_end(make, [stream.schema], spark, "t-timer")
    assert rows_of(got) == brute_segments(df.collect(), 3, 600)


def brute_alerts(rows, low):
    out, before = [], {}
    for r in sorted((r for r in rows if None not in tuple(r)), key=lambda r: (r.run, r.car, r.step)):
        key = f"{r.run}/{r.car}"
        rv = r.leader_speed - r.speed
        ttc = r.headway / -rv if rv < 0 else float("inf")
        th = r.headway / r.speed if r.speed > 0 else 60.0
        safe = rv > 0 and th > 2 or rv < 0 and -r.headway / rv > 4.5
        if key in before:
            h0, a0, t0 = before[key]
            if safe and abs(r.accel - a0) > 0.9 * 0.1:
                if r.headway - h0 <= -3.5:
                    out.append(("cut_in", key, r.step, r.headway - h0))
                if r.headway - h0 >= 3.5:
                    out.append(("cut_out", key, r.step, r.headway - h0))
        else:
            h0, t0 = 0.0, float("inf")
        if r.headway < 0 <= h0:
            out.append(("crash", key, r.step, r.headway))
        if r.headway >= 0 and ttc < low <= t0:
            out.append(("low_ttc", key, r.step, ttc))
        before[key] = (r.headway, r.accel, ttc)
    return sorted(out)


def test_alerts_do_not_depend_on_the_cut(spark):
    """Every place to cut a short log gives one answer."""
    import random

    rng = random.Random(2)
    rows = [(run, car, step, rng.choice([-1.0, 2.0, 9.0, 30.0, 34.0, 50.0]), rng.choice([0.0, 0.05, 1.0, -1.0]), rng.choice([0.0, 10.0, 20.0]),
             rng.choice([5.0, 15.0, 25.0])) for run in (1, 2) for car in (1, 2) for step in range(14)]
    rows += [(1, None, 3, 1.0, 1.0, 1.0, 1.0), (3, 1, 0, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "run long, car long, step long, headway double, accel double, speed double, leader_speed double")
    want = brute_alerts(df.collect(), sf.LOW_TTC)
    assert {w[0] for w in want} == {"cut_in", "cut_out", "crash", "low_ttc"}
    for cuts in ([], list(range(1, 14)), [5], [9, 10]):
        stream = sf.stream_of(df, "t-x6", F.col("step"), cuts)
        with sf.state_store(spark, empty_batches=False):
            got = st.run_append(sf.row_alerts(stream, ["run", "car"]), "t-x6")
        close(rows_of(got), want)


@pytest.mark.parametrize("cuts", [[], [40, 41, 77]])
def test_crossing_vehicles(spark, cuts):
    import random

    rng = random.Random(4)
    rows, want = [], {}
    for car in [1, 2, 3, 4, 5, None]:
        x = rng.uniform(-50, 0)
        for step in range(100):
            x += rng.uniform(0, 4)
            rows.append((1, car, step, x))
    lines = [0.0, 100.0, 150.0]
    for w in range(-5, 10):
        for line in lines:
            n = 0
            for car in range(1, 6):
                xs = [p for _, c, s, p in rows if c == car and 10 * w <= s < 10 * w + 60]
                n += bool(xs) and min(xs) < line < max(xs)
            if n:
                want[(line, n, 1, (datetime(1970, 1, 1) + timedelta(seconds=w)).strftime("%Y-%m-%d %H:%M:%S"))] = 1
    df = spark.createDataFrame(rows, "run long, car long, step long, position double")
    stream = sf.stream_of(df, "t-x2", F.col("step"), cuts, time=F.timestamp_millis(F.col("step") * 100))
    make = lambda end: sk.crossing_vehicles(stream.unionByName(end), ["run"], "car", "position", lines, "6 seconds", "1 second", "2 seconds")
    got = sk.run_to_end(make, [stream.schema], spark, "t-x2")
    assert rows_of(got) == sorted(want)


@pytest.mark.parametrize("late", [False, True])
def test_live_profile(spark, late):
    """Profiles before or after the rows they apply to; a period without profile gives nulls; nothing twice."""
    rows = spark.createDataFrame([(k, T0 + timedelta(seconds=37 * k)) for k in range(200)], "event_id long, event_time timestamp")
    prof = spark.createDataFrame([(float(k), T0 + timedelta(seconds=600 * k)) for k in range(13) if k not in (2, 5)], "speed double, event_time timestamp")
    a = sf.stream_of(rows, "t-x7a", F.col("event_id"), [50, 120])
    b = sf.stream_of(prof, "t-x7b", F.col("speed"), [3.0, 9.0] if late else [])
    make = lambda x, y: sk.live_profile(a.unionByName(x), b.unionByName(y), ["speed"], 600, "60 minutes", salt_by=F.col("event_id"))
    got = sk.run_to_end(make, [a.schema, b.schema], spark, "t-x7")
    want = sorted((k, None if (p := 37 * k // 600) in (2, 5) or p > 12 else float(p)) for k in range(200))
    assert sorted((r.event_id, r.speed) for r in got.collect()) == want


def test_settings_are_restored(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with pytest.raises(RuntimeError), sf.state_store(spark):
        assert spark.conf.get(key) == sf.ROCKSDB
        raise RuntimeError
    assert spark.conf.get(key, None) == before
