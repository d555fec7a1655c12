"""Scale helpers equal their single-task twins (tiny blocks force the cross-block paths)."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from roadlens.plans.blocks import carry_forward, over_blocks, running_sum
from roadlens.plans.ordering import dense_position, value_bucket


def _series(spark, n_keys=4, n=57, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n_keys):
        m = n + 13 * k
        for i in range(m):
            rows.append((k, i, float(rng.normal()), None if rng.random() < 0.4 else float(rng.integers(0, 9))))
    return spark.createDataFrame(rows, "k long, seq long, v double, c double")


def test_dense_position_matches_row_number(spark):
    df = _series(spark).withColumn("t", F.col("seq") * 3 + 1)
    got = dense_position(df.drop("seq"), ["k"], ["t"], bucket=value_bucket("t", 10.0), name="pos")
    w = Window.partitionBy("k").orderBy("t")
    ref = df.withColumn("pos2", F.row_number().over(w) - 1)
    j = got.join(ref, ["k", "t"])
    assert j.count() == df.count()
    assert j.filter("pos <> pos2").count() == 0


def test_over_blocks_bounded_frames(spark):
    df = _series(spark)
    got = over_blocks(df, ["k"], "seq", 3, 2, lambda w: {
        "lag2": F.lag("v", 2).over(w), "lead2": F.lead("v", 2).over(w),
        "s": F.sum("v").over(w.rowsBetween(-3, 2))}, block=7)
    w = Window.partitionBy("k").orderBy("seq")
    ref = df.select("k", "seq", F.lag("v", 2).over(w).alias("r_lag2"), F.lead("v", 2).over(w).alias("r_lead2"),
                    F.sum("v").over(w.rowsBetween(-3, 2)).alias("r_s"))
    j = got.join(ref, ["k", "seq"])
    assert j.count() == df.count() == got.count()
    bad = j.filter(~F.col("lag2").eqNullSafe(F.col("r_lag2")) | ~F.col("lead2").eqNullSafe(F.col("r_lead2"))
                   | (F.abs(F.col("s") - F.col("r_s")) > 1e-9))
    assert bad.count() == 0


def test_running_sum_and_carry(spark):
    df = _series(spark)
    got = running_sum(df, ["k"], "seq", {"cs": F.col("v")}, block=5)
    got = running_sum(got, ["k"], "seq", {"cx": F.col("v")}, exclusive=True, block=5)
    got = carry_forward(got, ["k"], "seq", {"lc": F.col("c")}, block=5)
    w = Window.partitionBy("k").orderBy("seq")
    ref = df.select("k", "seq",
                    F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("r_cs"),
                    F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("r_cx"),
                    F.last("c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("r_lc"))
    j = got.join(ref, ["k", "seq"])
    assert j.count() == df.count()
    bad = j.filter((F.abs(F.col("cs") - F.col("r_cs")) > 1e-9) | (F.abs(F.col("cx") - F.col("r_cx")) > 1e-9)
                   | ~F.col("lc").eqNullSafe(F.col("r_lc")))
    assert bad.count() == 0


def test_dense_position_prefix_sums(spark):
    df = _series(spark).withColumn("t", F.col("seq") * 3 + 1).withColumn("iv", (F.col("seq") % 7).cast("long"))
    got = dense_position(df.drop("seq"), ["k"], ["t"], bucket=value_bucket("t", 10.0), name="pos",
                         prefix_sums={"cs": F.col("iv")})
    w = Window.partitionBy("k").orderBy("t")
    ref = df.withColumn("cs2", F.coalesce(F.sum("iv").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = got.join(ref, ["k", "t"])
    assert j.count() == df.count()
    assert j.filter("cs <> cs2").count() == 0


def test_asof_join_is_the_last_earlier_row(spark):
    import bisect
    import random

    from roadlens.operators.joins import asof_join

    r = random.Random(4)
    right = sorted({(k, round(r.expovariate(0.01), 1)) for k in "ab" for _ in range(60)})
    left = [(i, r.choice("abc"), round(r.uniform(-20, 700), 1)) for i in range(500)]
    ldf = spark.createDataFrame(left, "i long, k string, t double")
    rdf = spark.createDataFrame([(k, t, f"{k}{t}") for k, t in right], "k string, rt double, name string")
    for clamp in (True, False):
        got = {x.i: (x.rt_match, x.name) for x in asof_join(ldf, rdf, ["k"], "t", "rt", ["name"], clamp).collect()}
        assert len(got) == len(left)
        for i, k, t in left:
            times = [x for kk, x in right if kk == k]
            at = bisect.bisect_right(times, t) - 1
            at = max(at, 0) if clamp else at
            want = (times[at], f"{k}{times[at]}") if times and at >= 0 else (None, None)
            assert got[i] == want
    plan = asof_join(ldf, rdf, ["k"], "t", "rt", ["name"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert asof_join(ldf, rdf.limit(0), ["k"], "t", "rt", ["name"]).filter("name is null").count() == len(left)
