"""Operator 8 - quality classifier on random-indexing word vectors.

*Word vectors.* Tokens are runs of letters (case kept) and runs of marks. Every token that stands
often enough has a vector of its own: all those whose corpus count reaches the least power of 2^(1/16)
that at most ``OWN`` tokens reach. The rest share ``VOCAB`` hash buckets (``shared_share`` tells how many
occurrences do). Each row has a fixed sparse index vector (``ONES`` entries of +1 or -1 among ``DIM``);
its context vector is the sum of the index vectors of the tokens up to ``REACH`` places before or after its
occurrences, over **all** documents. Counts are summed map-side first; a task adds its texts into one
table of fixed size, and the tables are summed by slices, in two exchanges, as streams. Vectors are
damped (signed square root), centred and scaled to length one.

*Documents* are the mean of their tokens' vectors and the mean of the squares.

*Network*: one hidden tanh layer and a logistic output in numpy, fitted by Adam with L2
on four fifths of the sample; the temperature that divides its output minimizes the
likelihood loss on the last fifth. The sample is at most ``max_rows`` labelled documents by
hash order (a documented bound), never those with crc32(doc_id as text) mod 5 = 0. Labels,
language, source and id are no inputs.

Null or empty text: the zero vector, scored like any other. Without both labels in the
sample every score is the share of label 1 (0.5 without labels). Repeated rows are scored
each; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import blocks as B

OWN = 1 << 15
VOCAB = 1 << 14
DIM = 64
ONES = 4
REACH = 2
HIDDEN = 24
MAX_ROWS = 8_000
THRESHOLD = 0.3
SLICES = 128
FANS = 16
CHUNK = 1 << 17
#: tokens whose vectors are added up at once
PIECE = 1 << 11
#: text added to the table at once (adding costs the table's size)
CONTEXT_CHUNK = 1 << 23
#: text whose tokens are found at once
TOKEN_CHUNK = 1 << 19
STEPS_PER_DOUBLING = 16
#: leading bits of a hash that address the rows of frequent tokens
SLOT_BITS = 22


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - (VOCAB - 1).bit_length())).astype(np.int64)


NONE = np.zeros(0, np.uint64)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def rows_of(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Table row of each token: its own (``own`` is sorted, one a slot), or its bucket's, behind those."""
    if not len(own):
        return bucket(h)
    cache = B.process_cache("own_rows")
    if not np.array_equal(cache.get("own", NONE), own):
        table = np.zeros(1 << SLOT_BITS, np.int32)
        table[_slots(own)] = np.arange(len(own), dtype=np.int32)
        cache.update(own=own, table=table)
    at = cache["table"][_slots(h)]  # addressed directly: a search in the sorted hashes takes most of the time otherwise
    return np.where(own[at] == h, at, len(own) + bucket(h))


def index_vectors(own: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of each row's index vector."""
    shared = B.mix(np.arange(VOCAB * ONES, dtype=np.uint64) + np.uint64(0xABCDEF)).reshape(VOCAB, ONES)
    h = np.concatenate([B.mix(own[:, None] * np.uint64(ONES) + np.arange(ONES, dtype=np.uint64) + np.uint64(0x1357)), shared])
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, n): occurrences of every token of the corpus."""

    def count(batches):
        for batch in batches:
            texts = B.utf8(batch.column(0))
            for start, end in B.text_chunks(texts, CONTEXT_CHUNK):
                h, n = np.unique(np.concatenate([runs.h for _, runs in _token_pieces(texts[start:end])]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return docs.select(text_col).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def frequent_tokens(counts: DataFrame, own: int = OWN) -> np.ndarray:
    """Hashes of the tokens with a vector of their own, sorted: at most ``own``. Of tokens whose hashes share the first
    ``SLOT_BITS`` bits (one in 128 of them) the first alone has one."""
    counts = cut_lineage(counts.withColumn("step", F.floor(F.log2("n") * STEPS_PER_DOUBLING).cast("long")))
    steps = sorted(counts.groupBy("step").count().collect(), key=lambda r: -r["step"])  # a row per step: under 64 * STEPS_PER_DOUBLING
    least, total = None, 0
    for r in steps:
        total += r["count"]
        if total > own:
            break
        least = r["step"]
    if least is None:
        return NONE
    h = np.sort(np.array([r["h"] for r in counts.filter(F.col("step") >= least).select("h").collect()], np.int64).view(np.uint64))
    return h[np.unique(_slots(h), return_index=True)[1]]


def shared_share(counts: DataFrame, own: np.ndarray) -> float:
    """Share of all token occurrences whose token shares a bucket's vector."""
    table = counts.sparkSession.createDataFrame([(int(h),) for h in own.view(np.int64)], "h long")
    rest, total = counts.join(F.broadcast(table.withColumn("own", F.lit(1))), "h", "left").agg(
        F.sum(F.when(F.col("own").isNull(), F.col("n"))), F.sum("n")).first()
    return float(rest or 0) / total if total else 0.0


def _tokens(texts: list[bytes]) -> B.Runs:
    return B.Runs(texts, lower=False, marks=True)


def _token_pieces(texts: list[bytes]):
    """(number of the first text, tokens) of pieces: finding tokens takes some 30 times the size of the text."""
    for start, end in B.text_chunks(texts, TOKEN_CHUNK):
        yield start, _tokens(texts[start:end])


def add_contexts(table: np.ndarray, texts: list[bytes], index, own: np.ndarray = NONE) -> None:
    """Add the contexts of all tokens of ``texts`` to ``table`` (a row per row of the index)."""
    place, sign = index
    pieces = [(rows_of(runs.h, own), runs.doc + start) for start, runs in _token_pieces(texts or [b""])]
    ids, doc = (np.concatenate(x) for x in zip(*pieces))
    flat = table.ravel()
    for gap in range(1, REACH + 1):
        a, b = ids[:-gap], ids[gap:]
        ok = doc[:-gap] == doc[gap:]
        for x, y in ((a[ok], b[ok]), (b[ok], a[ok])):
            for k in range(ONES):
                flat += np.bincount(x * DIM + place[y, k], weights=sign[y, k], minlength=len(flat))


def context_table(docs: DataFrame, text_col: str = "text", own: np.ndarray = NONE) -> np.ndarray:
    """Context vectors of all rows over all documents ((len(own) + VOCAB) x DIM numbers)."""
    size = len(own) + VOCAB
    height = -(-size // SLICES)

    def gather(batches):
        index, table, some = index_vectors(own), np.zeros((size, DIM)), False
        for batch in batches:
            texts = B.utf8(batch.column(0))
            for start, end in B.text_chunks(texts, CONTEXT_CHUNK):
                add_contexts(table, texts[start:end], index, own)
                some = True
        if some:
            squeeze = pa.Codec("zstd", 1)
            parts = [squeeze.compress(table[s * height:(s + 1) * height].astype("<i8").tobytes(), asbytes=True) for s in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key, squeeze = None, 0, pa.Codec("zstd", 1)
        for batch in batches:
            key = batch.column("slice")[0].as_py()
            n = max(0, min(height, size - key * height)) * DIM
            total = np.zeros(n, np.int64) if total is None else total
            for raw in batch.column("sums"):
                total += np.frombuffer(squeeze.decompress(raw.as_buffer(), 8 * n, asbytes=True), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([squeeze.compress(total.tobytes(), asbytes=True)], pa.binary())], names=["slice", "sums"])

    parts = docs.select(text_col).mapInArrow(gather, "slice int, sums binary").withColumn("fan", F.spark_partition_id() % FANS)
    sums = parts.groupBy("slice", "fan").applyInArrow(add, "slice int, sums binary").groupBy("slice").applyInArrow(add, "slice int, sums binary")
    table = np.zeros((size, DIM))
    squeeze = pa.Codec("zstd", 1)
    for row in sums.collect():  # SLICES rows of fixed size
        part = table[row["slice"] * height:(row["slice"] + 1) * height]
        part[:] = np.frombuffer(squeeze.decompress(row["sums"], part.size * 8, asbytes=True), "<i8").reshape(part.shape)
    return table


def word_vectors(table: np.ndarray) -> np.ndarray:
    damped = np.sign(table) * np.sqrt(np.abs(table))
    used = np.abs(table).sum(axis=1) > 0
    if used.any():
        damped[used] /= np.linalg.norm(damped[used], axis=1, keepdims=True) + 1e-12
        damped[used] -= damped[used].mean(axis=0)
        damped[used] /= np.linalg.norm(damped[used], axis=1, keepdims=True) + 1e-12
    return damped.astype(np.float32)


def pool(texts: list[bytes], vectors: np.ndarray, own: np.ndarray = NONE) -> np.ndarray:
    """Mean vector and mean square of each text's tokens."""
    out = np.zeros((len(texts), 2 * DIM))
    for start, end in B.text_chunks(texts, CHUNK):
        runs = _tokens(texts[start:end])
        rows = rows_of(runs.h, own)
        for d in np.flatnonzero(runs.count):
            sums = out[start + d]
            for a in range(runs.first[d], runs.first[d + 1], PIECE):
                v = vectors[rows[a:min(a + PIECE, runs.first[d + 1])]]  # stays in a core's cache
                sums[:DIM] += v.sum(axis=0, dtype=np.float64)
                v *= v
                sums[DIM:] += v.sum(axis=0, dtype=np.float64)
            sums /= runs.count[d]
    return out


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, steps: int = 400, l2: float = 1e-4, seed: int = 7) -> dict:
    """Two layers by full-batch Adam; inputs are standardized."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    p[3][0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1):
        a = np.tanh(z @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -30, 30))) - y) / len(y)
        back = np.outer(d, p[2]) * (1 - a * a)
        for i, g in enumerate((z.T @ back + l2 * p[0], back.sum(axis=0), a.T @ d + l2 * p[2], np.array([d.sum()]))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    return {"mean": mean, "scale": scale, "p": p, "t": 1.0}


def logits(net: dict, x: np.ndarray) -> np.ndarray:
    a = np.tanh(np.clip((x - net["mean"]) / net["scale"], -6, 6) @ net["p"][0] + net["p"][1])
    return a @ net["p"][2] + net["p"][3]


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits z with the least likelihood loss, on a fixed grid."""
    grid = np.exp(np.linspace(-2, 2, 81))
    loss = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def _held_out(doc_id):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """Word vectors of the corpus and the calibrated network."""
    own = frequent_tokens(token_counts(docs, text_col))
    vectors = word_vectors(context_table(docs, text_col, own))
    picked = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~_held_out(id_col)).groupBy(F.col(id_col).alias("doc_id"))
              .agg(F.min(F.col(label_col)).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")

    def features(batches):
        for batch in batches:
            x = pool(B.utf8(batch.column("text")), vectors, own).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(features, "doc_id long, label int, x binary").collect()  # max_rows vectors
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    y = np.array([float(r["label"] > 0) for r in rows])
    if not len(y) or y.min() == y.max():
        return {"vectors": vectors, "own": own, "net": None, "share": float(y.mean()) if len(y) else 0.5}
    x = np.array([np.frombuffer(r["x"], "<f4") for r in rows], np.float64)
    last = B.mix(np.array([r["doc_id"] for r in rows], np.int64).view(np.uint64)) % np.uint64(5) == 0
    if last.all() or not last.any() or y[~last].min() == y[~last].max():
        last = np.zeros(len(y), bool)
    net = fit_network(x[~last], y[~last])
    net["t"] = temperature(logits(net, x[last]), y[last]) if last.any() else 1.0
    return {"vectors": vectors, "own": own, "net": net, "share": float(y.mean())}


def score(model: dict):
    """A column function text -> probability of label 1."""

    def prob(texts: pd.Series) -> pd.Series:
        if model["net"] is None:
            return pd.Series(np.full(len(texts), model["share"]))
        z = logits(model["net"], pool(B.utf8(texts.tolist()), model["vectors"], model["own"])) / model["net"]["t"]
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return F.pandas_udf(prob, "double")


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score) of every document."""
    model = train(docs, labels, max_rows, id_col, text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(_held_out(id_col), F.lit(False)).alias("held_out"), score(model)(F.col(text_col)).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    scored = quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
