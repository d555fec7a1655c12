"""Neighbour index, controllers, planners, table functions, callbacks, catalogue and the bracket decided by votes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.functions import generators as gn
from roadlens.functions import physics as ph
from roadlens.functions import text as tx
from roadlens.operators import controllers as ct
from roadlens.operators import metrics as mt
from roadlens.operators import neighbors as nb
from roadlens.operators import planners as pl
from roadlens.operators import retrieval as rt
from roadlens.operators import scoring as sc
from roadlens.operators import traffic as tf
from roadlens.sources import catalog

SF = "/root/testdata/sf0.01"


# ---- R8 ----

def test_recall_on_the_given_vectors(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = e.filter("vec_id % 20 = 0")
    exact = rt.top_k(q, "vec_id", "embedding", e, "vec_id", "embedding", 5)
    found = nb.approx_top_k(q, "vec_id", "embedding", e, "vec_id", "embedding", 5)
    r = nb.recall(found, exact).first()
    assert r.n_true == 5 * q.count() and r.n_found >= 0.9 * r.n_true
    # what is found has the exact score and a rank without holes
    both = found.join(exact.select("query_id", "doc_id", F.col("score").alias("s")), ["query_id", "doc_id"])
    assert both.filter(F.abs(F.col("score") - F.col("s")) > 1e-12).count() == 0
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in found._jdf.queryExecution().toString()


def test_neighbours_of_copies_odd_vectors_and_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(nb, "CHUNK", 7)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    rows = [(k, base[k % 40].tolist() if k % 3 else base[0].tolist()) for k in range(300)]  # a third is one vector
    rows += [(1000, None), (1001, [1.0, 2.0]), (None, base[1].tolist()), (1002, [0.0] * 8)]
    store = spark.createDataFrame(rows, "id long, vec array<double>")
    q = store.filter("id % 20 = 0")
    found = nb.approx_top_k(q, "id", "vec", store, "id", "vec", 5, (nb.Hyperplanes(8, tables=4, bits=5), 32))  # every bucket: exact
    exact = rt.top_k(q.filter(F.size("vec") == 8), "id", "vec", store.filter((F.size("vec") == 8) & F.col("id").isNotNull()), "id", "vec", 5)
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id) for r in df.collect())
    assert key(found) == key(exact)
    assert nb.approx_top_k(q, "id", "vec", store.limit(0), "id", "vec", 5).collect() == []
    assert nb.approx_top_k(q.limit(0), "id", "vec", store, "id", "vec", 5).collect() == []


def test_probes_cost_least_margin_first():
    h = nb.Hyperplanes(6, tables=3, bits=4)
    v = np.random.default_rng(0).normal(size=(9, 6))
    p = nb._projected(v, h)
    got = nb._probed(p, 16)
    assert (got[:, :, 0] == nb._buckets(p)).all() and all(len(set(x)) == 16 for x in got.reshape(-1, 16))
    one = np.abs(p).argmin(2)
    assert (got[:, :, 1] == (nb._buckets(p) ^ (1 << one))).all()


# ---- G2 ----

@pytest.fixture(scope="module")
def logged(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["idm", "fs", "time_gap", "mine", None]), rng.uniform(0, 35), rng.uniform(0, 35), rng.uniform(-2, 120)) for k in range(500)]
    return spark.createDataFrame(rows, "step long, who string, speed double, leader_speed double, headway double").repartition(4)


def test_mixed_controllers_equal_each_alone(spark, logged):
    seen = []

    def mine(speed, leader_speed, headway, gain=2.0):
        return gain * (leader_speed - speed)

    reg = ct.builtin().plug_in("time_gap", ct.constant_time_gap).plug_in("mine", mine, gain=0.5)
    assert reg.names() == ["fs", "idm", "mine", "time_gap"] and not seen
    got = {r.step: r.out for r in reg.accelerations(logged, "who", "out").collect()}
    alone = logged.select("step", "who", ph.idm_accel("speed", "leader_speed", "headway").alias("idm"),
                          ph.follower_stopper_accel("speed", "leader_speed", "headway").alias("fs"),
                          (0.5 * (F.col("leader_speed") - F.col("speed"))).alias("mine"),
                          F.least(F.greatest(0.23 * (F.col("headway") - 5 - 1.4 * F.col("speed")) + 0.07 * (F.col("leader_speed") - F.col("speed")), F.lit(-3.0)),
                                  F.lit(1.5)).alias("time_gap"))
    for r in alone.collect():
        want = None if r.who is None else r[r.who]
        assert got[r.step] == (want if want is None else pytest.approx(want, abs=1e-12))


def test_unknown_and_repeated_names(spark, logged):
    reg = ct.builtin()
    with pytest.raises(Exception, match="unknown controller: time_gap"):
        reg.accelerations(logged.filter("who = 'time_gap'"), "who").collect()
    assert reg.accelerations(logged.filter("who is null"), "who").filter("accel is not null").count() == 0
    for name in ("idm", ""):
        with pytest.raises(ValueError):
            reg.register(name, ph.idm_accel)


# ---- G6 ----

def test_planners_equal_their_frame_forms(spark):
    rng = random.Random(9)
    rows = [(t, [-1000.0 + 900.0 * k for k in range(9)], [rng.uniform(3, 38) for _ in range(9)], [2600.0] if t % 2 else None, [rng.choice([800.0, 4100.0])] if t % 3 else [])
            for t in range(6)]
    prof = spark.createDataFrame(rows, "t long, xs array<double>, zs array<double>, stand array<double>, move array<double>")
    d8 = tf.speed_limit_profiles(prof, ["t"]).collect()
    for t, xs, zs, stand, move in rows:
        mine = sorted((r for r in d8 if r.t == t), key=lambda r: r.grid_idx)
        grid, smooth = pl.smoothed_grid(xs, zs)
        _, limit = pl.limited_grid(xs, zs, stand or (), move)
        assert np.allclose(grid, [r.x for r in mine]) and np.allclose(smooth, [r.raw for r in mine], atol=1e-9)
        assert np.allclose(limit, [r.target_speed for r in mine], atol=1e-9)


def test_hot_road_is_cut_and_odd_rows(spark):
    prof = spark.createDataFrame([(1, [0.0, 1000.0], [10.0, 30.0]), (2, [0.0, 500.0], [20.0, 5.0])], "road long, xs array<double>, zs array<double>")
    rows = [(k, 1, float(k)) for k in range(1000)] + [(2000, 2, 10.0), (2001, 3, 10.0), (2002, 1, None), (2003, None, 1.0), (2000, 2, 10.0)]
    v = spark.createDataFrame(rows, "id long, road long, pos double")
    sizes = []
    out = pl.plan_targets(v, "pos", prof, ["road"], pl.smoothed_planner, block=100)
    got = sorted(((r.id, r.target_speed) for r in out.collect()), key=lambda x: x[0])
    assert len(got) == len(rows) and not sizes
    want = pl.smoothed_planner(np.arange(1000.0), [0.0, 1000.0], [10.0, 30.0])
    assert np.allclose([x for _, x in got[:1000]], want)
    assert got[1000] == got[1001] and got[1000][1] is not None and [x for _, x in got[1002:]] == [None] * 3
    assert pl.plan_targets(v.limit(0), "pos", prof, ["road"], pl.smoothed_planner).collect() == []
    with pytest.raises(ValueError):
        pl.plan_targets(v.withColumn("target_speed", F.lit(1)), "pos", prof, ["road"], pl.smoothed_planner)


# ---- G5 ----

def test_table_functions_equal_explode(spark):
    specs = ["(av human*2)*3 av#sensor", "av#a#b*2 human", "human*3", "", None, "(av#x human)*2"]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(specs)], "id long, spec string")
    got = gn.lateral(df, gn.platoon_vehicles(), "spec").select("id", "pos", "kind", "tags")
    want = df.select("id", F.posexplode(tx.expand_platoon("spec")).alias("pos", "v")).select("id", "pos", "v.kind", "v.tags")
    key = lambda x: sorted((r.id, r.pos, r.kind, tuple(r.tags)) for r in x.collect())
    assert key(got) == key(want) and len(key(got)) > 10
    steps = spark.createDataFrame([(0.0, 0.1), (0.1, 0.5), (0.5, None), (None, 0.6)], "t double, n double")
    assert [(r.t, r.k) for r in gn.lateral(steps, gn.missing_steps(), "t", "n").orderBy("t", "k").collect()] == [
        (None, 0), (0.0, 0), (0.1, 0), (0.1, 1), (0.1, 2), (0.1, 3), (0.5, 0)]


# ---- G4 ----

def test_callbacks(spark):
    rng = random.Random(5)
    rows = [("hot" if k % 2 else f"g{k % 7}", rng.uniform(-5, 5) if k % 11 else None) for k in range(600)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").withColumn("id", F.monotonically_increasing_id())
    got = {r.g: r for r in mt.stat_callbacks(df, ["g"], ["x"], mt.moment_callbacks()).collect()}
    for r in df.groupBy("g").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
        mine = got[r.g]
        want = (r.m, r.s, r.lo, r.hi)
        assert (mine.x_mean, mine.x_std, mine.x_min, mine.x_max) == (want if r.m is None else pytest.approx(want, abs=1e-9))


# ---- S5 ----

def test_catalogue(spark):
    views = catalog.open_tables(spark, SF, ["orders", "region"], prefix="t5_")
    assert views == catalog.get_tables(spark, "t5_*")
    assert catalog.get_column_names(spark, "t5_region") == spark.table("t5_region").columns
    sizes = {(r.table_name, r.n_rows) for r in catalog.table_columns(spark, views).collect()}
    assert sizes == {(v, spark.table(v).count()) for v in views}
    got = catalog.query_to_df(spark, "SELECT count(*) AS n FROM {o} WHERE o_orderkey > ?", [10], o=spark.table("t5_orders"))
    assert got.first().n == spark.table("t5_orders").filter("o_orderkey > 10").count()
    head = catalog.get_timestep_data(spark, "t5_orders", ["o_orderkey"], 3, "o_orderkey")
    assert [r.o_orderkey for r in head.collect()] == [r.o_orderkey for r in spark.table("t5_orders").orderBy("o_orderkey").limit(3).collect()]
    for call in (lambda: catalog.get_timestep_data(spark, "t5_orders", ["no"]), lambda: catalog.get_timestep_data(spark, "t5_orders", limit=3)):
        with pytest.raises(KeyError):
            call()
    with pytest.raises(ValueError):
        catalog.get_column_names(spark, "region; DROP TABLE x")


# ---- L9 ----

def brute_champion(key, n, votes):
    field, cast, drawn = list(range(n)), 0, 0
    while len(field) > 1:
        nxt = []
        for a, b in zip(field[::2], field[1::2]):
            got = votes.get((key, a, b), [])
            va, vb = got.count("A"), got.count("B")
            cast += va + vb
            drawn += va == vb
            first = va > vb or va == vb and ((key % 7919) * 31 + a * 17 + b * 13) % 2 == 0
            nxt.append(a if first else b)
        field = nxt + field[len(field) // 2 * 2:]
    return field[0], cast, drawn


def test_bracket_by_votes(spark):
    rng = random.Random(8)
    sizes = {k: rng.choice([1, 2, 3, 5, 8, 13]) for k in range(40)} | {10**13: 4, 99: 200}
    votes = {(k, a, b): [rng.choice(["A", "B", "?", None]) for _ in range(rng.choice([0, 1, 3]))] for k, n in sizes.items() if n < 20 for a in range(n) for b in range(a + 1, n)}
    votes |= {(99, a, b): ["A" if a % 3 else "B"] for a in range(200) for b in range(a + 1, min(200, a + 130))}
    table = spark.createDataFrame([(k, a, b, w) for (k, a, b), ws in votes.items() for w in ws], "key long, a long, b long, winner string")
    entrants = spark.createDataFrame([(k, s) for k, n in sizes.items() for s in range(n)] + [(None, 0), (7, None)], "key long, slot long")
    out = sc.knockout_by_votes(entrants, "key", "slot", lambda m: m.join(table, ["key", "a", "b"]).select("key", "match", "winner"))
    got = {r.key: (r.champion, r.n_votes, r.n_draws) for r in out.collect()}
    assert got == {k: brute_champion(k, n, votes) for k, n in sizes.items()}
    assert sc.knockout_by_votes(entrants.limit(0), "key", "slot", lambda m: m.join(table, ["key", "a", "b"])).collect() == []
