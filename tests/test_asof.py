"""As-of join: bursts of times, hot keys, ties, nulls and cells of a few rows against a plain search."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from roadlens.operators import joins as jn
from roadlens.operators import retrieval as rt


def brute(left, right, clamp):
    by_key = {}
    for k, t, v in right:
        if k is not None and t is not None:
            by_key.setdefault(k, {})[t] = v
    out = []
    for i, k, t in left:
        times = sorted(by_key.get(k, {}))
        at = bisect.bisect_right(times, t) - 1 if t is not None else -1
        if t is not None and times and (at >= 0 or clamp):
            m = times[max(at, 0)]
            out.append((i, m, by_key[k][m]))
        else:
            out.append((i, None, None))
    return sorted(out)


@pytest.mark.parametrize("cell_rows", [None, 25, 3])
@pytest.mark.parametrize("clamp", [True, False])
def test_bursts_and_hot_keys(spark, cell_rows, clamp):
    """99 of 100 times in a hundredth of the range; one key has most rows."""
    rng = random.Random(6)
    when = lambda: rng.uniform(500, 510) if rng.random() < 0.99 else rng.uniform(0, 1000)
    key = lambda: "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
    right = list({(k, t): (k, t, n) for n in range(400) for k, t in [(key(), round(when(), 2))]}.values()) + [("a", None, -1)]
    left = [(i, key(), round(when(), 2)) for i in range(600)] + [(900, "a", None), (901, "gone", 505.0), (902, "hot", right[0][1])]
    r = spark.createDataFrame(right, "k string, at double, v long").repartition(3)
    x = spark.createDataFrame(left, "i long, k string, t double").repartition(4)
    got = jn.asof_join(x, r, ["k"], "t", "at", ["v"], clamp, cell_rows)
    assert got.columns == ["i", "k", "t", "at_match", "v"]
    assert sorted((g.i, g.at_match, g.v) for g in got.collect()) == brute(left, right, clamp)


def test_without_keys_and_empty_sides(spark):
    r = spark.createDataFrame([(t, 10 * t) for t in (2, 4, 9)], "at long, v long")
    x = spark.createDataFrame([(t,) for t in range(12)], "t long")
    got = {g.t: (g.at_match, g.v) for g in jn.asof_join(x, r, [], "t", "at", ["v"], cell_rows=2).collect()}
    assert got == {t: ((2, 20) if t < 4 else (4, 40) if t < 9 else (9, 90)) for t in range(12)}
    assert {(g.at_match, g.v) for g in jn.asof_join(x, r.limit(0), [], "t", "at", ["v"]).collect()} == {(None, None)}
    assert jn.asof_join(x.limit(0), r, [], "t", "at", ["v"]).collect() == []


def test_equal_times_in_one_cell(spark):
    r = spark.createDataFrame([("a", 5.0, n) for n in range(50)] + [("a", 7.0, 99)], "k string, at double, v long")
    x = spark.createDataFrame([(i, "a", 5.0 + i % 3) for i in range(90)], "i long, k string, t double")
    got = jn.asof_join(x, r, ["k"], "t", "at", ["v"], cell_rows=5).collect()
    assert len(got) == 90 and all(g.at_match == (7.0 if g.t >= 7 else 5.0) for g in got)


def test_seeded_order_takes_any_key(spark):
    keys = [0, 1, 3_000_000_000, 4_000_000_000, (1 << 63) - 1, -5]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", rt.seeded_order(F.col("k"), 42).alias("o")).collect()
    p = 4294967291
    assert {g.k: g.o for g in got} == {k: (k % p * 2654435761 + 42 * 97) % p for k in keys}
