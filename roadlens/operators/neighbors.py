"""Approximate nearest neighbours by random-hyperplane buckets, with exact re-ranking.

Index: ``tables`` sets of ``bits`` orthonormal hyperplanes (seeded, so the same on every run) give each unit vector a bucket
per table; equal vectors are one entry that carries its ``k`` smallest ids. A query probes the
buckets whose flipped bits cost it the least margin, in every table. A table's entries are cut into parts of about ``CHUNK``
by the hash of their ids, so a bucket of any size is spread over the parts; each block of queries meets each part in one
call, which scores a query with the entries of its probed buckets only (matrix products by bucket, then the same dot product
as the exact search, R2) and gives its ``k`` best. The last step drops repeats. There is no plan over all pairs, and pairs
are never shuffled; what a query costs is the size of the buckets it probes.

``calibrate`` picks the number of probes: the fewest that find ``target`` of the true neighbours inside a bounded sample.
Recall on the whole store is at least about that (neighbours only get nearer with more rows) and is measured by ``recall``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..session import materialize

TABLES, MAX_BITS, SEED = 8, 12, 17
SAMPLE_ROWS, SAMPLE_QUERIES, TARGET = 2000, 200, 0.96
#: entries of a table and queries that one call has at most (about), queries and pairs that it scores at a time
CHUNK, QUERY_BLOCK, QUERY_SLICE, PAIRS = 65536, 8192, 1024, 1 << 21


@dataclass(frozen=True)
class Hyperplanes:
    """Buckets of unit vectors of ``dim`` numbers."""

    dim: int
    tables: int = TABLES
    bits: int = 8
    seed: int = SEED

    def planes(self) -> np.ndarray:
        """(dim, tables * bits): orthonormal inside a table (as far as ``dim`` allows)."""
        rng = np.random.default_rng(self.seed)
        sets = []
        for _ in range(self.tables):
            cols = [np.linalg.qr(rng.normal(size=(self.dim, self.dim)))[0] for _ in range(-(-self.bits // self.dim))]
            sets.append(np.concatenate(cols, axis=1)[:, :self.bits])
        return np.concatenate(sets, axis=1)


def _projected(vectors: np.ndarray, h: Hyperplanes) -> np.ndarray:
    """(rows, tables, bits) signed distances."""
    return (vectors @ h.planes()).reshape(len(vectors), h.tables, h.bits)


def _buckets(projected: np.ndarray) -> np.ndarray:
    return (projected > 0) @ (1 << np.arange(projected.shape[2]))


def _probed(projected: np.ndarray, probes: int) -> np.ndarray:
    """(rows, tables, probes) buckets by the sum of margins of the flipped bits, own bucket first."""
    bits = projected.shape[2]
    flips = np.arange(1 << bits)
    cost = np.abs(projected) @ ((flips[:, None] >> np.arange(bits)) & 1).T.astype(float)
    order = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
    return _buckets(projected)[:, :, None] ^ order


def _sample(store: DataFrame, did: str, dvec: str, dim: int, rows: int) -> np.ndarray:
    """At most ``rows`` distinct unit vectors, smallest hash first (only they reach the driver)."""
    x = store.select(vx.as_double(dvec).alias("v")).filter(F.size("v") == dim).select(vx.unit("v").alias("v"))
    x = x.withColumn("h", F.xxhash64("v")).distinct().orderBy("h", "v").limit(rows).collect()
    return np.array([r.v for r in x]).reshape(-1, dim)


def calibrate(store: DataFrame, did: str, dvec: str, k: int, rows: int | None = None, target: float = TARGET) -> tuple[Hyperplanes, int] | None:
    """(hyperplanes, probes) for a store; None where it has no vector. Reads the store's size and a bounded sample."""
    first = store.filter(F.size(dvec) > 0).select(F.size(dvec).alias("n")).groupBy("n").count().orderBy(F.col("count").desc(), "n").first()
    if first is None:
        return None
    dim, n = int(first["n"]), int(first["count"])
    bits = int(min(MAX_BITS, max(4, round(np.log2(max(n, 1) / 32)))))
    h = Hyperplanes(dim, bits=bits)
    v = _sample(store, did, dvec, dim, rows or SAMPLE_ROWS)
    q = v[:: max(1, len(v) // SAMPLE_QUERIES)]
    score = q @ v.T
    score[np.arange(len(q)), np.arange(len(v))[:: max(1, len(v) // SAMPLE_QUERIES)]] = -2  # itself is no neighbour here
    true = np.argsort(-score, axis=1)[:, :min(k, len(v) - 1)] if len(v) > 1 else np.zeros((len(q), 0), int)
    buckets, probed = _buckets(_projected(v, h)), _probed(_projected(q, h), 1 << bits)
    # at which probe a true neighbour is met first, over the tables
    met = (probed[:, None, :, :] == buckets[true][:, :, :, None]).argmax(3).min(2) if true.size else np.zeros((1, 1), int)
    at = np.sort(met.ravel())
    return h, int(at[min(len(at) - 1, int(np.ceil(target * len(at))) - 1)]) + 1


def index(store: DataFrame, did: str, dvec: str, h: Hyperplanes, k: int) -> DataFrame:
    """(tab, bucket, ids, dv): every distinct vector in each table, with its ``k`` smallest ids. Null vectors and vectors
    of another length are left out."""
    v = store.select(F.col(did).cast("long").alias("doc_id"), vx.as_double(dvec).alias("v")).filter((F.size("v") == h.dim) & F.col("doc_id").isNotNull())
    v = v.select("doc_id", vx.unit("v").alias("dv"))
    least = v.withColumn("_r", F.row_number().over(Window.partitionBy("dv").orderBy("doc_id"))).filter(F.col("_r") <= k)
    classes = least.groupBy("dv").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            dv = batch.column("dv")
            got = _buckets(_projected(np.asarray(dv.flatten()).reshape(-1, h.dim), h))
            row = pa.array(np.repeat(np.arange(len(got)), h.tables))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(h.tables), len(got)), pa.int32()), pa.array(got.ravel(), pa.int32()),
                                              batch.column("ids").take(row), dv.take(row)], names=["tab", "bucket", "ids", "dv"])

    return materialize(classes.select("ids", "dv").mapInArrow(assign, "tab int, bucket int, ids array<long>, dv array<double>"))


def approx_top_k(queries: DataFrame, qid: str, qvec: str, store: DataFrame, did: str, dvec: str, k: int,
                 setting: tuple[Hyperplanes, int] | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) as R2's ``top_k``, of the documents in the probed buckets (fewer
    than ``k`` rows where those hold fewer). Queries without a vector of the store's length have no rows."""
    setting = calibrate(store, did, dvec, k) if setting is None else setting
    if setting is None:
        return store.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    h, probes = setting
    entries = index(store, did, dvec, h, k)

    def probe(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            qv = batch.column("qv")
            got = _probed(_projected(np.asarray(qv.flatten()).reshape(-1, h.dim), h), probes).astype(np.uint16)
            row = pa.array(np.repeat(np.arange(len(got)), h.tables))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(h.tables), len(got)), pa.int32()), batch.column("query_id").take(row), qv.take(row),
                                              pa.array([p.tobytes() for q in got for p in q], pa.binary())], names=["tab", "query_id", "qv", "probed"])

    q = queries.select(F.col(qid).cast("long").alias("query_id"), vx.as_double(qvec).alias("v")).filter((F.size("v") == h.dim) & F.col("query_id").isNotNull())
    asked = q.select("query_id", vx.unit("v").alias("qv")).mapInArrow(probe, "tab int, query_id long, qv array<double>, probed binary")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = max(1, -(-entries.count() // (h.tables * CHUNK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    asked = asked.withColumn("block", at(blocks, "query_id", "qv")).withColumn("part", every(parts))
    held = entries.withColumn("part", at(parts, "ids")).withColumn("block", every(blocks))
    cell = ["tab", "part", "block"]
    met = asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(_met_in_cell(k), "query_id long, ids array<long>, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("ids")[0])
    # an entry meets a query once a table at most, so the k best are among the first k * tables
    met = met.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k * h.tables).drop("_r").distinct()
    docs = met.select("query_id", F.explode("ids").alias("doc_id"), "score")
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return docs.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def _met_in_cell(k: int):
    """The call of a cell (a table's part and a block of queries): each query meets the entries of the buckets it probes, a bucket
    at a time as a matrix product; its ``k`` best leave the cell, scored anew in the order of ``vectors.dot``. A vector
    that holds a null has null scores (last), NaN is the greatest score."""
    pairs_held, slice_rows = PAIRS, QUERY_SLICE

    def matrix(column):
        import pyarrow as pa

        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        values = column.flatten()
        shape = (len(column), -1)
        return values.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(shape), values.is_null().to_numpy(zero_copy_only=False).reshape(shape).any(axis=1)

    def exact(q, v):
        total = np.zeros(len(q))
        for j in range(q.shape[1]):
            total += q[:, j] * v[:, j]
        return total

    def first_k(i, score, place):
        order = np.lexsort((place, -score, i))
        i = i[order]
        return order[np.arange(len(i)) - np.searchsorted(i, i) < k]

    def run(asked, held):
        import pyarrow as pa

        kept = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))]  # query, entry, score, without a score
        if asked.num_rows and held.num_rows:
            held = held.take(pa.array(np.argsort(held["bucket"].to_numpy(), kind="stable")))
            bucket = held["bucket"].to_numpy()
            names, start = np.unique(bucket, return_index=True)
            end = np.append(start[1:], len(bucket))
            (v, v_null), (q, q_null) = matrix(held["dv"]), matrix(asked["qv"])
            first = held["ids"].combine_chunks()
            first = first.flatten().to_numpy()[first.offsets.to_numpy()[:-1] - first.offsets[0].as_py()]
            probed = np.frombuffer(b"".join(asked["probed"].to_pylist()), np.uint16).reshape(len(q), -1).astype(np.int64)
            plain = np.isfinite(v).all() and np.isfinite(q).all() and not v_null.any() and not q_null.any()
            slack = 64 * (q.shape[1] + 4) * np.finfo(float).eps  # unit vectors

            def key(i, j, s):
                if plain:
                    return s
                s = np.where(np.isnan(s), np.inf, s)
                return np.where(q_null[i] | v_null[j], -np.inf, s)

            def settled(i, j, s):
                """Only what can be among the k best of its query."""
                i, j, s = np.concatenate(i), np.concatenate(j), np.concatenate(s)
                order = np.lexsort((-s, i))
                i, j, s = i[order], j[order], s[order]
                head = np.searchsorted(i, i)
                last = np.minimum(head + k, np.searchsorted(i, i, "right")) - 1
                near = s >= s[last] - slack
                i, j, s, last, head = i[near], j[near], s[near], s[last][near], (last - head + 1 == k)[near]
                return i, j, s, i[head], last[head]

            for a in range(0, len(q), slice_rows):
                rows = np.arange(a, min(a + slice_rows, len(q)))
                order = np.argsort(probed[rows], axis=None, kind="stable")
                want, who = probed[rows].ravel()[order], a + order // probed.shape[1]
                lo, hi = np.searchsorted(want, names), np.searchsorted(want, names, "right")
                least = np.full(len(q), -np.inf)
                i_s, j_s, s_s, n = [], [], [], 0
                for b in np.flatnonzero(hi > lo):
                    i, part = who[lo[b]:hi[b]], v[start[b]:end[b]]
                    with np.errstate(all="ignore"):
                        s = q[i] @ part.T
                    s = key(i[:, None], np.arange(start[b], end[b])[None, :], s)
                    x, y = np.nonzero(s >= (least[i] - slack)[:, None])
                    i_s.append(i[x])
                    j_s.append(start[b] + y)
                    s_s.append(s[x, y])
                    n += len(x)
                    if n > pairs_held:
                        i, j, s, full, bound = settled(i_s, j_s, s_s)
                        least[full] = bound
                        i_s, j_s, s_s, n = [i], [j], [s], len(i) // 2
                if not i_s:
                    continue
                i, j, _, _, _ = settled(i_s, j_s, s_s)
                with np.errstate(all="ignore"):
                    s = np.concatenate([exact(q[i[c:c + (1 << 16)]], v[j[c:c + (1 << 16)]]) for c in range(0, len(i), 1 << 16)])
                best = first_k(i, key(i, j, s), first[j])
                kept.append((i[best], j[best], s[best], q_null[i[best]] | v_null[j[best]]))
        i, j, s, none = (np.concatenate(x) for x in zip(*kept))
        return pa.table({"query_id": asked["query_id"].take(pa.array(i)), "ids": held["ids"].take(pa.array(j)), "score": pa.array(s, mask=none)})

    return run


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_queries, n_true, n_found): how many of the exact neighbours were found."""
    both = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"))
