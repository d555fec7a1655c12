"""Operator 9 - benchmark decontamination by spaced-seed hashing.

Words are runs of ASCII letters, digits and longer characters, folded to ASCII lower case,
so marks and case do not hide a passage. A seed is a fixed mask over consecutive words; its
hash takes the words at the mask's ones and ignores the others. Item hashes and document
hashes are joined, and every hit fixes a diagonal (document position less item position).
Around it the words are compared one by one: item and document overlap if some ``WINDOW``
consecutive aligned words (all words of a shorter item) hold at least 80 percent equal ones.

The masks leave no gap: whichever 2 of 13 words are replaced, one of the two default masks
still fits between. Items below ``WINDOW`` words have masks of their length (``SHORT``), with
the same property for all the words the rule lets differ (tests try all).

Items are taken in blocks of at most ``block_words`` words, so what is broadcast has that
bound; every block meets all documents (a stated query set against all rows). With several
blocks the results of one are written to the checkpoint folder before the next index is built,
so the driver holds one at a time. Hits stay in the task that holds the document; no text is
exchanged.

Null or empty texts hold nothing, items without words match nothing. Repeated rows are
judged each; item ids may repeat. Extra columns pass through. An empty benchmark clears
everything.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import blocks as B

MASKS = ("11110011", "1100101011")
#: by words of an item below WINDOW: none may differ up to 4 words, one up to 9, two up to 12
SHORT = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("111", "1101"), 6: ("1111", "11011"), 7: ("11011",),
         8: ("111011", "110111"), 9: ("1111011", "1101111"), 10: ("111011", "1101011", "1110011"),
         11: ("1101011", "1110011"), 12: ("111011", "11010011")}
WINDOW = 13
PERCENT = 80
BLOCK_WORDS = 500_000


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash at every position where the mask fits into consecutive words h."""
    n = max(0, len(h) - len(mask) + 1)
    out = np.full(n, len(mask), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            out = B.mix(out + h[j:j + n])
    return out


class Index:
    """Items of one block: words, and each mask's sorted hashes with (item, position)."""

    def __init__(self, items: list[tuple], masks=MASKS):
        self.ids = [i for i, _ in items]
        runs = B.Runs(B.utf8([t for _, t in items]))
        self.h, self.first, self.count = runs.h, runs.first, runs.count
        self.masks = []
        by_length = {n: SHORT.get(n) or tuple(m[:n] for m in masks) for n in sorted(set(self.count.tolist()) - {0})}
        for mask in dict.fromkeys(m for some in by_length.values() for m in some):
            hs, item, pos = [], [], []
            for i, n in enumerate(self.count.tolist()):
                if n and mask in by_length[n]:
                    s = _seeds(self.h[self.first[i]:self.first[i + 1]], mask)
                    hs.append(s)
                    item.append(np.full(len(s), i))
                    pos.append(np.arange(len(s)))
            if hs:
                hs, item, pos = map(np.concatenate, (hs, item, pos))
                order = np.lexsort((pos, item, hs))
                some = np.zeros(1 << 16, bool)
                some[(hs >> np.uint64(48)).astype(np.int64)] = True
                self.masks.append((mask, hs[order], item[order], pos[order], some))

    def overlaps(self, texts: list[bytes]):
        """Per (document, item) the best overlap: (doc, item, doc_start, length, matched), by document."""
        runs = B.Runs(texts)
        found = []
        for mask, hs, item, pos, some in self.masks:
            s = _seeds(runs.h, mask)
            near = np.flatnonzero(some[(s >> np.uint64(48)).astype(np.int64)])
            near = near[runs.doc[near] == runs.doc[near + len(mask) - 1]]
            lo, hi = np.searchsorted(hs, s[near]), np.searchsorted(hs, s[near], side="right")
            n = hi - lo
            p, k = np.repeat(near, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.column_stack([runs.doc[p], item[k], p - pos[k]]))
        found = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
        best = {}
        for d, i, diagonal in found.tolist():
            size = int(self.count[i])
            lo = max(diagonal, int(runs.first[d]))
            hi = min(diagonal + size, int(runs.first[d + 1]))
            need = min(WINDOW, size)
            if hi - lo < need:
                continue
            at = int(self.first[i]) - diagonal
            equal = np.concatenate([[0], np.cumsum(runs.h[lo:hi] == self.h[at + lo:at + hi])])
            run = equal[need:] - equal[:-need]
            if 100 * int(run.max()) >= PERCENT * need:
                row = (int(equal[-1]), -(lo - int(runs.first[d])), hi - lo)
                best[d, i] = max(best.get((d, i), row), row)
        return sorted((d, i, -row[1], row[2], row[0]) for (d, i), row in best.items())


def index_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS):
    """(index, whether it is the only one) of blocks of items, one after the other; a block comes to the driver at most."""
    words = F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")) + 1
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = benchmark.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * int(total) // block_words)) if total > block_words else 1
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        yield Index(sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))), blocks == 1


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, doc_start, length, matched): the best overlap of each contaminated pair.

    doc_start is the first aligned word of the document, length the aligned words, matched the equal ones.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    place = None
    for index, only in index_blocks(benchmark, text_col="text", block_words=block_words):
        part = docs.mapInArrow(_search(index), "doc_id long, item_id long, doc_start long, length long, matched long")
        if only:
            return part
        place = place or _new_place(docs)
        part.write.mode("append").parquet(place)
        del index, part  # before the next one is built
    return docs.sparkSession.read.parquet(place)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows that overlap an item; all columns stay."""
    place = None
    names = [F.xxhash64(text_col).alias("_t1"), F.xxhash64(F.lit(9), F.col(text_col)).alias("_t2")]  # 128 bits: equal texts go together
    for index, only in index_blocks(benchmark, block_words=block_words):
        holds = _holds(index)(F.col(text_col))
        if only:
            return docs.filter(~holds)
        place = place or _new_place(docs)
        docs.filter(holds).select(*names).distinct().write.mode("append").parquet(place)
        del index, holds  # before the next one is built
    gone = docs.sparkSession.read.parquet(place)
    return docs.join(gone, (names[0] == gone["_t1"]) & (names[1] == gone["_t2"]), "left_anti")


def _new_place(docs: DataFrame) -> str:
    return f"{ensure_checkpoint_dir(docs.sparkSession)}/decontamination-{uuid.uuid4().hex}"


def _search(index: Index):
    """Batches of (doc_id, text) to rows of ``contamination``; sent with the task: at most block_words words."""

    def search(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), B.utf8(batch.column(1))
            rows = []
            for start, end in B.text_chunks(texts):
                rows += [(ids[start + d], index.ids[i], s, n, m) for d, i, s, n, m in index.overlaps(texts[start:end])]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["doc_id", "item_id", "doc_start", "length", "matched"])

    return search


def _holds(index: Index):
    """A column function: whether a text overlaps an item of the block."""

    def holds(texts: pd.Series) -> pd.Series:
        raw, out = B.utf8(texts.tolist()), np.zeros(len(texts), bool)
        for start, end in B.text_chunks(raw):
            out[[start + row[0] for row in index.overlaps(raw[start:end])]] = True
        B.give_back()
        return pd.Series(out)

    return F.pandas_udf(holds, "boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
