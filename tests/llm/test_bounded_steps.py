"""Operators 7 and 8: what a step's tasks and a task's sums take."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from roadlens.llm import quality_classifier, quality_rules


def test_pool_adds_up_a_piece_at_a_time():
    q = quality_classifier
    r = np.random.default_rng(2)
    vectors = r.normal(size=(q.VOCAB, q.DIM)).astype(np.float32)
    texts = [b"", b"one", b"- --", *(" ".join(f"w{k}" for k in r.integers(0, 900, n)).encode() for n in (40, 5000, 60000))]
    rows = [q.rows_of(q._tokens([t]).h, q.NONE) for t in texts]
    tracemalloc.start()
    got = q.pool(texts, vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for x, at in zip(got, rows):
        v = vectors[at].astype(np.float64)
        want = np.concatenate([v.mean(axis=0), (v * v).mean(axis=0)]) if len(at) else np.zeros(2 * q.DIM)
        assert np.allclose(x, want, rtol=1e-6, atol=1e-7)
    one_vector_a_token = max(map(len, rows)) * q.DIM * 4
    assert peak < 2 * one_vector_a_token  # vectors and squares of a whole text at once, and their sums, took more


def test_steps_run_in_as_many_tasks_as_their_rows_need(spark):
    q = quality_rules
    x = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), (F.col("id") % 2).cast("string").alias("source"),
                                 *[(F.hash("id", F.lit(i)) % 1000 / 250).alias(c) for i, c in enumerate(q.X)])
    few, many = (sorted(map(tuple, q.robust_outliers(x.repartition(n), 2).select("doc_id", F.round("d2", 6)).collect())) for n in (2, 64))
    assert few == many and len(few) == 1200
    assert q.robust_outliers(x.repartition(64), 2).rdd.getNumPartitions() <= 4  # the 64 partitions of the texts before, in every step
