"""Operator 2 - toxicity severity by cumulative-link ordinal regression.

``labels.toxic`` says whether, not how much, so grades are made from it: 0 for clean
documents; toxic ones are 1, 2 or 3 by the share of their words that the label points to
(thirds of the toxic training rows).

*Features* are hashed word runs of letters and their first four bytes (endings vary, stems
do not), folded to lower case. Those are kept whose log odds between toxic and clean
training documents (counts by document, add one half) stand ``MIN_Z`` standard errors
above zero, the strongest ``MAX_FEATURES`` of them. A feature's value is log(1 + its
occurrences per thousand words).

*Model*: P(grade >= k) = sigmoid(w.x - c_k) with one w and ordered cut points c_1 < c_2 <
c_3 (first cut, then positive steps), by full-batch gradient steps (Adam) on the
negative log likelihood with an L2 penalty. Expected severity is the sum of the three
probabilities (0 to 3). A document is toxic when its
probability of a grade above 0 exceeds ``TOXIC``.

Training reads a sample of at most ``max_rows`` labelled documents, chosen by a hash of
the id (a documented bound); scoring covers every whole text.

Null or empty text: all features 0. Unlabelled or null labels are not trained on. Without
a labelled toxic and a labelled clean document nothing is toxic (severity 0). Repeated
rows are scored each; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

MAX_ROWS = 10_000
MAX_FEATURES = 1024
MIN_Z = 3.2
GRADES = 3
TOXIC = 0.3
HEAD = 4


def _features(texts: list[bytes]):
    """(document, feature hash) of every occurrence, and words by document."""
    runs = B.Runs(texts)
    return np.concatenate([runs.doc, runs.doc]), np.concatenate([runs.h, runs.heads(HEAD) + np.uint64(1)]), runs.count


def sample_ids(labels: DataFrame, max_rows: int, id_col: str, label_col: str) -> DataFrame:
    """At most ``max_rows`` labelled ids by hash order, a conflicting repeat by its largest label."""
    return (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
            .agg(F.max(F.col(label_col)).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))


def _document_counts(batches):
    """Per batch: in how many toxic and clean documents each feature stands."""
    for batch in batches:
        texts, label = B.utf8(batch.column("text")), np.asarray(batch.column("label"))
        for start, end in B.text_chunks(texts):
            doc, h, _ = _features(texts[start:end])
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            uniq, inverse = np.unique(h[new], return_inverse=True)
            toxic = label[start:end][doc[new]] > 0
            pos = np.bincount(inverse, weights=toxic, minlength=len(uniq)).astype(np.int64)
            both = np.bincount(inverse, minlength=len(uniq))
            yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(pos), pa.array(both - pos)], names=["h", "pos", "neg"])


def values(texts: list[bytes], chosen: np.ndarray) -> np.ndarray:
    """Dense (document, chosen feature) values; ``chosen`` is sorted."""
    out = np.zeros((len(texts), len(chosen)), np.float64)
    if not len(chosen):
        return out
    for start, end in B.text_chunks(texts):
        doc, h, n = _features(texts[start:end])
        at = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
        hit = chosen[at] == h
        np.add.at(out, (doc[hit] + start, at[hit]), 1.0)
        out[start:end] = np.log1p(1000.0 * out[start:end] / np.maximum(n, 1)[:, None])
    return out


def fit_ordinal(x: np.ndarray, grade: np.ndarray, l2: float = 1e-3, steps: int = 600) -> dict:
    """Shared weights and ordered cut points by Adam on the mean negative log likelihood."""
    n, d = x.shape
    share = [(np.sum(grade >= k) + 0.5) / (n + 1) for k in range(1, GRADES + 1)]
    cut = [np.log((1 - s) / s) for s in share]
    theta = np.concatenate([np.zeros(d), [cut[0]], np.log(np.maximum(np.diff(cut), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, c = theta[:d], np.cumsum(np.concatenate([theta[d:d + 1], np.exp(theta[d + 1:])]))
        z = x @ w
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - c, -40, 40)))  # P(grade >= k)
        edge = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
        slope = np.hstack([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))])
        mass = np.maximum(edge[rows, grade] - edge[rows, grade + 1], 1e-12)
        up, down = slope[rows, grade] / mass, slope[rows, grade + 1] / mass
        g_z = -(up - down) / n
        g_c = np.zeros(GRADES + 2)
        np.add.at(g_c, grade, up / n)
        np.add.at(g_c, grade + 1, -down / n)
        g_c = g_c[1:GRADES + 1]
        tail = np.cumsum(g_c[::-1])[::-1]
        grad = np.concatenate([x.T @ g_z + l2 * w, tail[:1], tail[1:] * np.exp(theta[d + 1:])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta = theta - 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return {"w": theta[:d], "c": np.cumsum(np.concatenate([theta[d:d + 1], np.exp(theta[d + 1:])]))}


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1..GRADES."""
    return 1 / (1 + np.exp(-np.clip((x @ model["w"])[:, None] - model["c"], -40, 40)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Fit on the bounded sample; the model is a few thousand numbers."""
    picked = sample_ids(labels, max_rows, id_col, label_col)
    sample = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")  # max_rows ids
    pos, neg = picked.agg(F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("label") <= 0).cast("long")), F.lit(0))).first()
    empty = {"h": np.zeros(0, np.uint64), "w": np.zeros(0), "c": np.full(GRADES, 40.0)}
    if not pos or not neg:
        return empty
    counts = sample.select("text", "label").mapInArrow(_document_counts, "h long, pos long, neg long").groupBy("h").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (pos - F.col("pos") + 0.5)) - F.log((F.col("neg") + 0.5) / (neg - F.col("neg") + 0.5))
    error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.greatest(pos - F.col("pos"), F.lit(0)) + 0.5) + 1 / (F.col("neg") + 0.5) + 1 / (F.greatest(neg - F.col("neg"), F.lit(0)) + 0.5))
    best = counts.filter((F.col("pos") <= pos) & (F.col("neg") <= neg)).withColumn("z", odds / error).filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "h").limit(MAX_FEATURES).collect()
    if not best:
        return empty
    chosen = np.sort(np.array([r["h"] for r in best], np.int64).view(np.uint64))

    def extract(batches):
        for batch in batches:
            texts = B.utf8(batch.column("text"))
            for start, end in B.text_chunks(texts):
                x = values(texts[start:end], chosen)
                row, at = np.nonzero(x)
                cut = pa.array(np.searchsorted(row, np.arange(len(x) + 1)), pa.int32())
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(cut, pa.array(at, pa.int32())),
                     pa.ListArray.from_arrays(cut, pa.array(x[row, at]))], names=["doc_id", "label", "at", "x"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(extract, "doc_id long, label int, at array<int>, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["x"]))  # max_rows sparse rows (and repeats of their ids)
    x, toxic = np.zeros((len(rows), len(chosen))), np.array([r["label"] > 0 for r in rows])
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["x"]
    density = np.expm1(x).sum(axis=1)
    thirds = np.quantile(density[toxic], [1 / 3, 2 / 3]) if toxic.any() else np.zeros(2)
    grade = np.where(toxic, 1 + (density > thirds[0]).astype(int) + (density > thirds[1]), 0)
    return {"h": chosen, **fit_ordinal(x, grade)}


def severity(model: dict):
    """A column function text -> struct(expected_severity, grade, toxic)."""

    def score(texts: pd.Series) -> pd.DataFrame:
        raw = B.utf8(texts.tolist())
        parts = [probabilities(model, values(raw[start:end], model["h"])) for start, end in B.text_chunks(raw)]
        p = np.concatenate([np.zeros((0, GRADES)), *parts])
        mass = np.hstack([np.ones((len(p), 1)), p]) - np.hstack([p, np.zeros((len(p), 1))])
        return pd.DataFrame({"expected_severity": p.sum(axis=1), "grade": mass.argmax(axis=1).astype("int32"), "toxic": p[:, 0] > TOXIC})

    return F.pandas_udf(score, "expected_severity double, grade int, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_severity, grade, toxic) of every document."""
    model = train(docs, labels, max_rows, id_col, text_col)
    return docs.select(F.col(id_col).alias("doc_id"), severity(model)(F.col(text_col)).alias("s")).select("doc_id", "s.*")


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
