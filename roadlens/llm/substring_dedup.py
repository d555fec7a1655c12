"""Operator 3 - substring dedup by recompression.

Every document is a string of word names (64-bit fingerprints, so a name is global: equal
words get one name on every executor). A round renames maximal runs ``a a a`` and then
pairs ``a b`` with ``a`` in the left half and ``b`` in the right half of the alphabet (one
bit of the name, drawn anew each round). Both steps look at neighbours only, so equal
substrings get the same symbols except near their ends.

How far the difference reaches: a run step and a pair step change at most one symbol each
at an end, and a symbol of round ``r`` spans at most ``2^r`` words outside runs, so after
``r`` rounds the two parses agree from word ``2 (2^r - 1)`` on. ``rounds_for`` takes the
most rounds for which the symbol over a window's middle word still lies in the agreeing
part, together with ``w/2 - 2^r + 1`` words before its start and ``w/2`` from it on.

Spark exchanges the names of the highest symbols over all blocks (see ``blocks``); a symbol whose name stands
once in the corpus ends there. Those left send that context as a second key. A window is a candidate if its middle
symbol was left by both, or if a run touches it (runs may be cut differently at its ends). Candidates
are then verified: their full word sequences, as 96-bit fingerprints, are exchanged the same way,
and the first holder in (id, position) order keeps the words.

Null or empty text: no words. Rows with equal ids are documents of their own, in (id,
text) order; a null id comes first. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

WINDOW = 20
_BASE2 = 0xD1342543DE82EF95
NULL_ID = -(1 << 63)


def rounds_for(window: int) -> int:
    r = 0
    while window - window // 2 >= 3 * 2 ** (r + 1) - 2 and window // 2 >= 3 * 2 ** (r + 1) - 3:
        r += 1
    return r


def recompress(words: B.Words, rounds: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """((names, start words) of the symbols after each round, whether a word is in a named run)."""
    name, start, doc = words.h, np.arange(len(words.h)), words.doc
    in_run = np.zeros(len(words.h) + 1, np.int64)
    levels = []
    for r in range(rounds):
        n = len(name)
        if n < 2:
            levels.append((name, start))
            continue
        # runs of one symbol
        head = np.ones(n, bool)
        head[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(head)
        length = np.diff(np.append(at, n))
        long = length > 1
        ends = np.append(start, len(words.h))
        np.add.at(in_run, start[at[long]], 1)
        np.add.at(in_run, ends[at[long] + length[long]], -1)
        name, start, doc = name[at], start[at], doc[at]
        name = np.where(long, B.mix(name * np.uint64(3) + length.astype(np.uint64)), name)
        # pairs: left symbols have the round's bit 0, right symbols have it 1
        side = (B.mix(name + np.uint64(0x51ED27 + r)) >> np.uint64(63)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~side[:-1] & side[1:] & (doc[:-1] == doc[1:])
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        joined = name.copy()
        joined[:-1] = np.where(pair[:-1], B.mix(name[:-1] * np.uint64(5) + B.mix(name[1:] + np.uint64(11))), name[:-1])
        keep = ~second
        name, start, doc = joined[keep], start[keep], doc[keep]
        levels.append((name, start))
    return levels or [(name, start)], np.cumsum(in_run[:-1]) > 0


class _Block:
    """What all passes derive from a block's texts, and from the answers that it got so far."""

    def __init__(self, table: pa.Table, window: int, n_buckets: int, width: int):
        self.ids, self.texts = B.block_docs(table)
        self.words = B.Words(self.texts)
        self.window, self.n_buckets, self.width = window, n_buckets, width
        r = rounds_for(window)
        before, after = window // 2 - 2 ** r + 1, window - window // 2
        levels, self.in_run = recompress(self.words, r)
        self.names, self.start = levels[-1]
        self.n = len(self.words.h)
        start = self.start
        ctx, inside = self.words.windows(before + after)
        lo = start - before
        self.anchored = (lo >= 0) & (lo < len(ctx))
        self.anchored[self.anchored] = inside[lo[self.anchored]]
        self.surroundings = np.zeros(len(start), np.uint64)
        self.surroundings[self.anchored] = ctx[lo[self.anchored]]

    def exchange(self, answers, phase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The keys of an exchange: (symbols that those before left, distinct keys, index of each symbol's key, how often a
        key stands here). First the names of the highest symbols, then the surroundings of those left."""
        left = np.ones(len(self.start), bool)
        for k in range(phase + 1):
            names = self.surroundings if k else self.names
            left = left & self.anchored if k else left
            uniq, inverse, local = np.unique(B.truncate(names[left], self.width), return_inverse=True, return_counts=True)
            if k < phase:
                again = B.answers_in(_phase(answers, k, self.n_buckets), B.bucket_cuts(uniq, self.n_buckets), True) | (local > 1)
                left = left.copy()
                left[left] = again[inverse]
            if k:
                break
        return left, uniq, inverse, local

    def candidates(self, answers):
        """Window starts to verify, with 96-bit fingerprints (high 64, low 32): those whose middle is in a symbol that both
        exchanges left, or that a run touches."""
        start = self.start
        shared = np.append(self.exchange(answers, 2)[0], False)
        high, inside = self.words.windows(self.window)
        p = np.flatnonzero(inside)
        symbol = np.searchsorted(start, p + self.window // 2, side="right") - 1
        runs = np.concatenate([[0], np.cumsum(self.in_run)])
        p = p[shared[symbol] | (runs[p + self.window] > runs[p])]
        second = B.mix(self.words.h + np.uint64(0x2545F4914F6CDD1D))
        low, _ = self.words.windows(self.window, _BASE2, second)
        return p, high[p], (low[p] & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _phase(answers: pa.Table, phase: int, n_buckets: int) -> pa.Table:
    """The answers of one round, under the numbers of their buckets."""
    bucket = np.asarray(answers.column("bucket"))
    mine = answers.filter(pa.array(bucket // n_buckets == phase))
    return mine.set_column(mine.schema.get_field_index("bucket"), "bucket", pa.array(np.asarray(mine.column("bucket")) % n_buckets, pa.int32()))


def _first_of_each(high, low):
    """(positions of first occurrences in order, index of each entry's first occurrence among them)."""
    order = np.lexsort((np.arange(len(high)), low, high))
    h, lo = high[order], low[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
    lead = order[new]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    rank = np.argsort(lead, kind="stable")
    place = np.empty(len(lead), np.int64)
    place[rank] = np.arange(len(lead))
    return lead[rank], place[group]


def _by_bucket(high, n_buckets):
    bucket = B.bucket_of(high, n_buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a ``window``-word sequence that starts earlier too.

    Returns (doc_id, n_words, n_removed, kept_text): kept words joined by one space.
    """
    total = B.text_bytes(docs, text_col)
    n_blocks, n_buckets = B.block_counts(docs, total)
    width = B.key_width(total)
    blocked = B.blocked(docs, n_blocks, id_col, text_col)
    by_block = blocked.groupBy("blk")

    def send(phase):
        def fn(key, table, answers=None):
            if not table.num_rows:
                return B.table_of([], B.BLOB)
            b = _Block(table, window, n_buckets, width)
            return B.table_of(B.key_blobs(key[0].as_py(), b.exchange(answers, phase)[1], n_buckets, width), B.BLOB)

        return (lambda key, table: fn(key, table)) if not phase else (lambda key, table, answers: fn(key, table, answers))

    known = None
    for phase in (0, 1):  # a symbol whose name, or surroundings, stand once in all blocks ends there
        sent = by_block.applyInArrow(send(0), B.BLOB_SCHEMA) if known is None else by_block.cogroup(known.groupBy("blk")).applyInArrow(send(phase), B.BLOB_SCHEMA)
        told = sent.groupBy("bucket").applyInArrow(B.repeated_in_blocks(), B.ANSWER_SCHEMA).withColumn("bucket", F.col("bucket") + phase * n_buckets)
        known = told if known is None else known.unionByName(told)
    shared, last = known, 2

    def send_windows(key, table, answers):
        if not table.num_rows:
            return B.table_of([], B.BLOB)
        b = _Block(table, window, n_buckets, width)
        p, high, low = b.candidates(answers)
        lead, _ = _first_of_each(high, low)
        p, high, low = p[lead], high[lead], low[lead]
        order, cut = _by_bucket(high, n_buckets)
        ids = np.array([NULL_ID if i is None else i for i in b.ids], np.int64)[b.words.doc[p]] if len(p) else np.zeros(0, np.int64)
        rows = []
        for k in np.flatnonzero(np.diff(cut)):
            o = order[cut[k]:cut[k + 1]]
            blob = np.int64(len(o)).tobytes() + high[o].tobytes() + low[o].tobytes() + np.diff(ids[o], prepend=0).tobytes()
            rows.append((int(k), key[0].as_py(), blob))
        return B.table_of(rows, B.BLOB)

    def find_first(key, table):
        blks, sizes, high, low, ids = [], [], [], [], []
        for blk, blob in B.blobs_in(table):
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            blks.append(blk)
            sizes.append(n)
            high.append(np.frombuffer(blob, np.uint64, n, 8))
            low.append(np.frombuffer(blob, np.uint32, n, 8 + 8 * n))
            ids.append(np.cumsum(np.frombuffer(blob[8 + 12 * n:], np.int64)))
        high, low, ids = map(np.concatenate, (high, low, ids))
        order = np.lexsort((np.arange(len(ids)), ids, low, high))
        h, lo = high[order], low[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
        first = np.zeros(len(order), bool)
        first[order[new]] = True
        return B.answer_rows(key[0].as_py() + last * n_buckets, blks, sizes, first, True)

    firsts = by_block.cogroup(shared.groupBy("blk")).applyInArrow(send_windows, B.BLOB_SCHEMA).groupBy("bucket").applyInArrow(
        find_first, B.ANSWER_SCHEMA)

    def remove(key, table, answers):
        rows = []
        if table.num_rows:
            b = _Block(table, window, n_buckets, width)
            p, high, low = b.candidates(answers)
            lead, place = _first_of_each(high, low)
            order, cut = _by_bucket(high[lead], n_buckets)
            late = _phase(answers, last, n_buckets)
            kept = np.zeros(len(lead), bool)
            kept[order] = B.answers_in(late, cut, True)
            gone = np.ones(len(p), bool)
            gone[lead[kept]] = False
            cover = np.zeros(b.n + 1, np.int64)
            np.add.at(cover, p[gone], 1)
            np.add.at(cover, p[gone] + window, -1)
            keep = np.cumsum(cover[:-1]) == 0
            for d, (i, text) in enumerate(zip(b.ids, b.texts)):
                s, e = b.words.first[d], b.words.first[d + 1]
                words, flags = text.split(), keep[s:e]
                n_kept = int(flags.sum())
                if n_kept < len(words):
                    words = compress(words, flags.tolist())
                rows.append((i, int(e - s), int(e - s) - n_kept, b" ".join(words).decode()))
        return B.table_of(rows, [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    return by_block.cogroup(shared.unionByName(firsts).groupBy("blk")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, kept_text string")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))
