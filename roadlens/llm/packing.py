"""Operator 6 - best-fit packing, repacked until lower bounds certify it.

Documents become token pieces of at most ``capacity`` ids (``token_pieces``), and pieces
are packed into sequences by best-fit decreasing inside packing partitions of a bounded
number of pieces (``pack``). Dual-feasible functions give every partition a lower bound of
its sequence count: sizes, Martello-Toth thresholds (sizes above ``C - t`` count as ``C``,
below ``t`` as 0) and Fekete-Schepers' ``u_k``; a partition that meets its bound is
certified. Rounds follow while the whole table is above its own bound: partitions with
a gap release the pieces of the sequences that hold ``RELEASE`` of their free room,
certified ones those of their emptiest sequence; these are dealt anew to fewer partitions
and packed again. A round that does not lower the count ends it, and the better placing stays.

Only lengths matter to the bound of the whole table, so the driver sees at most
``capacity`` counts. Null text: empty (its document is the end id alone). Rows with equal
ids are documents of their own. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import blocks as B

CAPACITY = 2048
#: pieces of one packing task
PIECES = 50_000
#: words whose ids a Python worker remembers
MEMO_WORDS = 300_000
#: documents whose distinct words are looked up at once
BATCH = 1024
MAX_ROUNDS = 6

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = PIECE_SCHEMA + ", part int, bin int, offset long, released boolean, bins long"
#: share of a task's free room that its emptiest sequences release
RELEASE = 0.9


def word_ids(path: str | None, memo_words: int = MEMO_WORDS):
    """A function set[bytes] of words -> dict word -> little-endian 32-bit ids; for a tokenizer of other rules, a
    function of that kind over whole texts (its ``whole`` is true).

    The tokenizer of ``word_bpe_49k.json`` drops white space and never joins across it, so a text's ids are its
    words' ids in order. It also parts letters from marks and lowers case, so a word of
    letters and closing marks has its stem's ids, then the marks'. A stem of Latin letters
    needs the merges only. All other words go through the whole tokenizer one by one.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, pre_tokenizers

    cache = B.process_cache("word_ids")
    if cache.get("path") != (path,):
        import public_tokenizers

        known = public_tokenizers.path("word_bpe_49k.json")
        tokenizer = Tokenizer.from_file(path or known)
        same = path is None or _rules(tokenizer) == _rules(Tokenizer.from_file(known))
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = {o: as_bytes(chr(o))[0][0] for o in range(0xC0, 0x100)}
        cache.update(path=(path,), tokenizer=tokenizer, letters=letters, words={}, stems={}, same=same)
    tokenizer, letters = cache["tokenizer"], cache["letters"]
    if not cache["same"]:
        whole = lambda t: np.array(tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes()

        def of_texts(texts: set[bytes]) -> dict:
            return {t: whole(t) for t in texts}

        of_texts.whole = True
        return of_texts
    plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")

    def solve_stems(stems: list[str]) -> list[bytes]:
        pairs = tokenizer.model.tokenize  # the merges alone: a stem is one lower-case run of letters
        ids = ([t.id for t in pairs(w if w.isascii() else w.translate(letters))] for w in stems)
        return [struct.pack(f"<{len(i)}I", *i) for i in ids]

    def solve_words(words: list[bytes]) -> list[bytes]:
        parts = []
        for w in words:
            m = plain.fullmatch(t := w.decode())
            parts.append((m[1].lower(), m[2]) if m else t)
        stems = {p[0] for p in parts if isinstance(p, tuple)}
        known = B.remembered(cache["stems"], stems, solve_stems, memo_words)
        marks, out = {"": b""}, []
        for p in parts:
            tail = p if isinstance(p, str) else p[1]
            if tail not in marks:
                marks[tail] = np.array(tokenizer.encode(tail, add_special_tokens=False).ids, "<u4").tobytes()
            out.append(marks[tail] if isinstance(p, str) else known[p[0]] + marks[tail])
        return out

    return lambda words: B.remembered(cache["words"], words, solve_words, memo_words)


def _rules(tokenizer) -> list:
    """What decides how a text is cut into words and a word into pieces, but for the vocabulary."""
    rules = json.loads(tokenizer.to_str())
    model = {k: v for k, v in rules["model"].items() if k not in ("vocab", "merges")}
    return [model, *(rules.get(k) for k in ("normalizer", "pre_tokenizer", "post_processor", "added_tokens"))]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text", memo_words: int = MEMO_WORDS) -> DataFrame:
    """One row per piece of each document's ids (its words' ids, then ``end_id``)."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        look_up = word_ids(path, memo_words)
        whole = getattr(look_up, "whole", False)
        for batch in batches:
            cols = [[], [], [], [], []]
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), BATCH):
                raw_texts = [(t.as_py() or "").encode() for t in texts[at:at + BATCH]]
                words = [[t] if whole else t.split() for t in raw_texts]
                memo = look_up(set().union(*words))
                for doc_id, ws in zip(ids[at:at + BATCH], words):
                    raw = b"".join(map(memo.__getitem__, ws)) + end
                    n = len(raw) // 4
                    for k, s in enumerate(range(0, n, capacity)):
                        e = min(n, s + capacity)
                        for c, v in zip(cols, (doc_id, k, s, e - s, zlib.crc32(raw[4 * s:4 * e]))):
                            c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=list(names))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, PIECE_SCHEMA)


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Fewest sequences that ``counts`` pieces of ``sizes`` can need, by dual-feasible functions."""
    if not len(sizes):
        return 0
    weight = np.bincount(sizes, weights=counts, minlength=capacity + 1).astype(np.int64)
    number, volume = np.cumsum(weight), np.cumsum(weight * np.arange(capacity + 1))
    best = -(-int(volume[-1]) // capacity)
    t = np.arange(1, capacity // 2 + 1)
    whole = number[-1] - number[capacity - t]
    rest = volume[capacity - t] - volume[t - 1]
    best = max(best, int((whole + -(-rest // capacity)).max()))
    x = np.arange(capacity + 1)
    for k in range(1, 41):
        u = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)  # times k
        best = max(best, -(-int((weight * u).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence of each piece, offset there, free room of each sequence); pieces come largest first."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some sequence has exactly r free
    seq, offset, free = np.empty(len(length), np.int64), np.empty(len(length), np.int64), []
    for i, n in enumerate(length.tolist()):
        fits = rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                rooms &= ~(1 << r)
        else:
            r, b = capacity, len(free)
            free.append(capacity)
        seq[i], offset[i] = b, capacity - r
        free[b] = r - n
        if r > n:
            room[r - n].append(b)
            rooms |= 1 << (r - n)
    return seq, offset, np.array(free, np.int64)


def _pack_once(pieces: DataFrame, parts: int, seed: int, capacity: int) -> DataFrame:
    """Deal pieces to ``parts`` tasks, pack each; with each piece its sequence, and its task's bound and count."""

    def pack_part(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        length = frame["length"].to_numpy()
        seq, offset, free = best_fit_decreasing(length, capacity)
        sizes, counts = np.unique(length, return_counts=True)
        order = np.argsort(-free, kind="stable")
        released = np.zeros(len(free), bool)
        if len(free) > lower_bound(sizes, counts, capacity):  # a gap: the emptiest sequences
            released[order[np.cumsum(free[order]) - free[order] < RELEASE * free.sum()]] = True
        else:  # certified: the emptiest one at most
            released[order[0]] = True
        released &= free > 0
        frame = frame.assign(bin=seq.astype("int32"), offset=offset, released=released[seq], bins=len(free))
        return frame[[c.split()[0] for c in _PLACED.split(", ")]]

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(seed)), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInPandas(pack_part, _PLACED)


def _bins(placed: DataFrame) -> int:
    return int(placed.select("part", "bins").distinct().agg(F.coalesce(F.sum("bins"), F.lit(0))).first()[0])


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_task: int = PIECES) -> DataFrame:
    """Place each piece (columns of PIECE_SCHEMA); adds sequence_id and offset, and drops none."""
    names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
    pieces = cut_lineage(pieces.select(*names))
    histogram = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    n = sum(r["count"] for r in histogram)
    bound = lower_bound(np.array([r["length"] for r in histogram], np.int64), np.array([r["count"] for r in histogram]), capacity)
    placed = cut_lineage(_pack_once(pieces, max(1, -(-n // per_task)), 0, capacity))
    total = _bins(placed)
    number = (F.col("part").cast("long") * F.lit(1 << 31) + F.col("bin"))
    done, open_ = None, placed
    for step in range(1, MAX_ROUNDS + 1):
        closed = open_.filter("not released").withColumn("sequence_id", number + F.lit((step - 1) << 56))
        kept = closed if done is None else done.unionByName(closed)
        left = open_.filter("released")
        if total <= bound:
            break
        m, old = left.agg(F.count("*"), F.countDistinct("part", "bin")).first()
        parts = max(1, -(-m // per_task))
        again = cut_lineage(_pack_once(left.select(*names), parts, step, capacity))
        new = _bins(again)
        if new >= old:
            break
        total += new - old
        done, open_ = kept, again
        if parts == 1:
            break
    last = open_.withColumn("sequence_id", number + F.lit((step if open_ is not placed else 0) << 56))
    out = last if done is None else done.unionByName(last)
    return out.select(*names, "sequence_id", "offset")


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Tokenize and pack all documents. ``memo_words``: words that a worker remembers (memory against time, never results)."""
    return pack(token_pieces(docs, capacity, path, memo_words=memo_words), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
