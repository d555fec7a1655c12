"""Exact neighbours by cells against brute force: ties, copies, nulls, odd lengths, NaN, and no plan over all pairs."""

import math

import numpy as np
import pytest

from roadlens.operators import cells
from roadlens.operators import neighbors as nb
from roadlens.operators import retrieval as rt


def _fold(q, d, distance):
    if q is None or d is None or len(q) != len(d) or None in q or None in d:
        return None
    total = 0.0
    for a, b in zip(q, d):
        total += (a - b) * (a - b) if distance else a * b
    return -math.sqrt(total) if distance else total


def _order(score, doc_id):
    nan = score is not None and math.isnan(score)
    return (score is None, not nan, 0.0 if nan or score is None else -score, doc_id is not None, doc_id or 0)


@pytest.mark.parametrize("distance", [False, True])
def test_cells_give_the_best_pairs_of_all(spark, monkeypatch, distance):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 5)).tolist()
    rows = [(i, base[i % 30]) for i in range(90)] + [(None, base[0]), (None, base[1]), (90, None), (91, [1.0, None, 2.0, 3.0, 4.0]), (92, [1.0, 2.0]),
                                                     (93, []), (94, [float("nan")] * 5), (95, [0.0] * 5), (7, base[2]), (96, [1e200] * 5)]
    monkeypatch.setattr(cells, "QUERY_BLOCK", 5)
    monkeypatch.setattr(cells, "STORE_BLOCK", 17)
    monkeypatch.setattr(cells, "SCORES", 64)
    store = spark.createDataFrame(rows, "doc_id long, _dv array<double>")
    asked = [r for r in rows if r[0] is not None and (r[0] % 9 == 0 or r[0] >= 90)]
    queries = spark.createDataFrame(asked, "query_id long, _qv array<double>")
    got = {}
    for r in cells.best_pairs(queries, store, 4, distance).collect():
        got.setdefault(r.query_id, []).append((r.score, r.doc_id))
    for query_id, q in asked:
        want = sorted(((_fold(q, d, distance), i) for i, d in rows), key=lambda x: _order(*x))[:4]
        mine = sorted(got[query_id], key=lambda x: _order(*x))[:4]
        assert [(str(s), i) for s, i in mine] == [(str(s), i) for s, i in want]


def test_search_has_no_plan_over_all_pairs(spark):
    e = spark.createDataFrame([(i, [float(i), 1.0, float(-i)]) for i in range(60)], "vec_id long, v array<double>")
    q = e.filter("vec_id % 20 = 0")
    for x in (rt.top_k(q, "vec_id", "v", e, "vec_id", "v", 3), rt.nearest_by_distance(q, "vec_id", "v", e, "vec_id", "v", 3),
              rt.two_stage(q, "vec_id", "v", "v", e, "vec_id", "v", "v")):
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
        assert x.groupBy("query_id").count().count() == 3
    empty = e.limit(0)
    assert rt.top_k(q, "vec_id", "v", empty, "vec_id", "v", 3).collect() == [] and rt.top_k(empty, "vec_id", "v", e, "vec_id", "v", 3).collect() == []


def test_index_search_shuffles_no_pairs(spark):
    rng = np.random.default_rng(5)
    e = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "vec_id long, v array<double>")
    x = nb.approx_top_k(e.filter("vec_id % 20 = 0"), "vec_id", "v", e, "vec_id", "v", 5, (nb.Hyperplanes(8, tables=3, bits=4), 16))
    assert "Join" not in x._jdf.queryExecution().optimizedPlan().toString()
    exact = rt.top_k(e.filter("vec_id % 20 = 0"), "vec_id", "v", e, "vec_id", "v", 5)
    assert sorted(map(tuple, x.select("query_id", "rank", "doc_id", "score").collect())) == sorted(map(tuple, exact.select("query_id", "rank", "doc_id", "score").collect()))


def test_only_hot_groups_are_cut_into_blocks(spark, monkeypatch):
    from roadlens.operators import metrics as mt

    monkeypatch.setattr(mt, "CALLBACK_ROWS", 50)
    rows = [("hot", i, float(i)) for i in range(400)] + [(f"g{i % 5}", i, float(i)) for i in range(60)] + [(None, i, 1.0) for i in range(3)] + [("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, i long, x double")
    callbacks = {"blocks": (lambda v: [float(len(v))], lambda p: len(p)), "n": (lambda v: [float(len(v))], lambda p: p.sum())}
    got = {r.g: (r.x_blocks, r.x_n) for r in mt.stat_callbacks(df, ["g"], ["x"], callbacks).collect()}
    assert got.pop("none") == (None, None) and got[None] == (1, 3)
    assert got["hot"][1] == 400 and 4 <= got["hot"][0] <= 8
    assert all(got[f"g{k}"] == (1, 12) for k in range(5))


def test_rows_meet_their_drive_pairs_by_block(spark):
    from pyspark.sql import functions as F

    from roadlens.operators import series as sr

    rows = spark.createDataFrame([("a", i) for i in range(3000)] + [("b", i) for i in range(40)] + [(None, 5)], "t string, seq long")
    pairs = spark.createDataFrame([("a", "x", 5, 7), ("a", "y", 1000, 2500), ("a", "z", 2500, 2501), ("b", "w", 30, 90), ("b", "e", 3, 3), (None, "n", 0, 9)],
                                  "t string, name string, start_row long, end_row long")
    x = sr.rows_inside(rows, pairs, ["t"], "seq")
    assert {r["name"]: r["n"] for r in x.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()} == {"x": 2, "y": 1500, "z": 1, "w": 10}
    assert "_b" in x._jdf.queryExecution().optimizedPlan().toString() and set(x.columns) == {"t", "seq", "name", "start_row", "end_row"}
