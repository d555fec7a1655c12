"""Shared helpers: document blocks, word fingerprints and the two-way key exchange.

*Blocks.* ``blocked`` gives each row a block number, a pure function of the row, so a
recomputed task sees the same block. A block holds about ``BLOCK_BYTES`` of text; one
exchange by block feeds every later pass (Spark reuses it inside a plan).

*Two-way exchange.* A block sends its **distinct** 64-bit keys, sorted, as one binary
value per bucket (``key_blobs``). A bucket task looks at all blocks' keys, and answers
every block with one small binary (a bit or byte per key, in the order sent). So a key
that a third of all rows share costs one entry per block, not one per row, and the text
itself never travels with the keys. Answers come back by block (``answers``).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: text per block and key bytes per bucket (both only set the task size).
BLOCK_BYTES = 3 << 19
BUCKET_BYTES = 8 << 20

BLOB_SCHEMA = "bucket int, blk int, blob binary"
ANSWER_SCHEMA = "blk int, bucket int, answer binary"


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of the column (0 for an empty table): sizes blocks and buckets."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"])


def block_counts(docs: DataFrame, total: int) -> tuple[int, int]:
    """(blocks, buckets) for ``total`` bytes of text; never fewer than the shuffle partitions."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(parts, math.ceil(total / BLOCK_BYTES)), max(parts, math.ceil(total / BUCKET_BYTES))


def key_width(total: int) -> int:
    """Bytes of a key that candidate filters ship: enough that about one key in a
    thousand meets another by chance. Filters only propose, so this is not a matter of results."""
    return min(8, max(4, math.ceil((math.log2(max(total, 2)) + 10) / 8)))


def blocked(docs: DataFrame, n_blocks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns (_id, _text, blk); null text reads as empty. The id orders rows, so it must be a number."""
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).select(
        "_id", "_text", F.pmod(F.xxhash64("_id", "_text"), F.lit(n_blocks)).cast("int").alias("blk"))


def block_docs(table: pa.Table) -> tuple[list, list[bytes]]:
    """ids and UTF-8 texts of a block, ordered by (id, text), a null id first."""
    ids = table.column("_id").to_pylist()
    texts = [t.as_buffer().to_pybytes() for t in table.column("_text").cast(pa.large_binary()).combine_chunks()] if len(ids) else []
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker (functions are pickled by value, so
    their own globals live only as long as a task)."""
    import sys
    import types

    mod = sys.modules.setdefault("_roadlens_llm_cache", types.ModuleType("_roadlens_llm_cache"))
    return mod.__dict__.setdefault(name, {})


def forget_words() -> None:
    """Frees the word memos that token operators left in this worker."""
    memos = [m for name in ("word_ids", "token_count") for m in _memos(process_cache(name)) if m]
    if memos:
        for memo in memos:
            memo.clear()
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: a worker outlives its task, and what it holds is missing to the next stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _memos(cache: dict) -> list[dict]:
    counter = cache.get("counter")
    return [m for m in (cache.get("words"), cache.get("stems"), counter and counter.memo) if m]


def remembered(cache: dict, wanted: set, solve, limit: int) -> dict:
    """{key: solve(key)} for ``wanted``. ``solve`` takes a list of keys that are not remembered.

    Two generations of at most ``limit`` keys: what is asked for again moves to the young one.
    """
    young, old = cache.setdefault("young", {}), cache.setdefault("old", {})
    out, new = {}, []
    for k in wanted:
        v = young.get(k)
        if v is None:
            v = old.get(k)
            if v is None:
                new.append(k)
                continue
            young[k] = v
        out[k] = v
    for k, v in zip(new, solve(new)):
        out[k] = young[k] = v
    if len(young) > limit:
        cache["old"], cache["young"] = young, {}
    return out


# ---- 64-bit fingerprints (all arithmetic wraps modulo 2^64) ----

#: powers that a worker keeps (16 bytes each); longer tables, for very long texts, go with their task
POWERS_KEPT = 1 << 22
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(_M1)
    x ^= x >> np.uint64(33)
    x *= np.uint64(_M2)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^(n-1) and the inverses."""
    cache = process_cache("powers")
    got = cache.get(base)
    if got is None or len(got[0]) < n:
        m = -(-n // (1 << 18)) << 18
        inv = pow(base, -1, 1 << 64)
        a = np.full(m, base, np.uint64)
        b = np.full(m, inv, np.uint64)
        a[0] = b[0] = 1
        got = (np.multiply.accumulate(a), np.multiply.accumulate(b))
        if m <= POWERS_KEPT:
            cache[base] = got
    return got[0][:n], got[1][:n]


def byte_values() -> np.ndarray:
    """A fixed random-looking 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def prefix_sums(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    pw, _ = powers(len(values), base)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * pw, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Fingerprint of values[start:end], wherever the span stands."""
    _, inv = powers(len(sums), base)
    return mix((sums[end] - sums[start]) * inv[start])


#: bytes from which a token is hashed by itself
LONG_TOKEN = 256


def token_hash(data: np.ndarray, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of tokens data[start:end]. Long ones get a cryptographic hash each: a polynomial modulo 2^64 has
    pairs of structured texts of 1,024 bytes with one value, whatever its base."""
    h = span_hash(sums, start, end)
    for i in np.flatnonzero(end - start > LONG_TOKEN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block of texts, as fingerprints.

    starts/ends: byte positions in ``data``; doc: index of the word's document;
    first[d]..first[d+1]: word range of document d; h: 64-bit fingerprint.
    """

    def __init__(self, texts: list[bytes]):
        forget_words()
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = np.zeros(256, bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[1:] = ~space[self.data]
        step = np.diff(inside)
        self.starts = np.flatnonzero(step == 1)
        self.ends = np.flatnonzero(step == -1)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        at = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.starts, at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.h = token_hash(self.data, prefix_sums(byte_values()[self.data]), self.starts, self.ends)

    def windows(self, k: int, base: int = _BASE, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, whether it lies in one document) of every k consecutive words."""
        v = self.h if values is None else values
        n = max(0, len(v) - k + 1)
        i = np.arange(n)
        return span_hash(prefix_sums(v, base), i, i + k, base), self.doc[:n] == self.doc[k - 1:k - 1 + n]


def letter_table(marks: bool = False) -> np.ndarray:
    """Byte -> class: 0 other, 1 ASCII letter or digit or part of a longer character; with
    ``marks`` 2 for visible ASCII marks."""
    kind = np.zeros(256, np.int8)
    if marks:
        kind[33:127] = 2
    for a, b in (("0", "9"), ("A", "Z"), ("a", "z")):
        kind[ord(a):ord(b) + 1] = 1
    kind[128:] = 1
    return kind


class Runs:
    """Runs of bytes of one class (see ``letter_table``) in texts: positions, documents, hashes.

    ``data`` is folded to ASCII lower case if ``lower``.
    """

    def __init__(self, texts: list[bytes], lower: bool = True, marks: bool = False):
        forget_words()
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        kind = np.zeros(len(self.data) + 1, np.int8)
        kind[1:] = letter_table(marks)[self.data]
        edge = np.flatnonzero(np.diff(kind))  # a class ends or begins
        nxt = np.append(edge[1:], len(self.data))
        inside = kind[edge + 1] > 0
        self.starts, self.ends = edge[inside], nxt[inside]
        self.kind = kind[self.starts + 1]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        at = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.starts, at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.sums = prefix_sums(byte_values()[self.data])
        self.h = token_hash(self.data, self.sums, self.starts, self.ends)

    def heads(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes (of the whole run where shorter)."""
        return span_hash(self.sums, self.starts, np.minimum(self.starts + n, self.ends))


def text_chunks(texts: list[bytes], limit: int = BLOCK_BYTES):
    """(start, end) ranges of texts with about ``limit`` bytes, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def utf8(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow text column or of Python strings; null is empty."""
    values = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else column
    return [b"" if v is None else v.encode() for v in values]


# ---- the two-way exchange ----

def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Monotone in the key: bucket order is key order."""
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def truncate(keys: np.ndarray, width: int) -> np.ndarray:
    """Keep the leading ``width`` bytes."""
    return keys if width >= 8 else keys >> np.uint64(64 - 8 * width) << np.uint64(64 - 8 * width)


def pack_sorted(keys: np.ndarray, width: int) -> bytes:
    """Sorted distinct keys of ``width`` leading bytes as gaps of a fixed number of bytes; a
    gap of all ones adds its value and goes on."""
    k = keys >> np.uint64(64 - 8 * width)
    gaps = np.diff(k)
    mean = int(gaps.mean()) if len(gaps) else 0
    size = min(8, max(1, -(-(3 * mean + 1).bit_length() // 8)))
    more = np.uint64((1 << 8 * size) - 1)
    over = (gaps // more).astype(np.int64)
    symbols = np.full(len(gaps) + int(over.sum()), more, "<u8")
    symbols[np.cumsum(over) + np.arange(len(gaps))] = gaps % more
    head = np.array([len(keys), len(symbols), size, k[0] if len(k) else 0], "<u8")
    return head.tobytes() + symbols.view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack_sorted(blob: bytes) -> tuple[np.ndarray, int]:
    """(the keys, as integers of their leading bytes; bytes read)."""
    n, m, size, first = (int(x) for x in np.frombuffer(blob, "<u8", 4))
    raw = np.zeros((m, 8), np.uint8)
    raw[:, :size] = np.frombuffer(blob, np.uint8, m * size, 32).reshape(m, size)
    symbols = raw.view("<u8").ravel()
    sums = np.cumsum(symbols)[symbols != np.uint64((1 << 8 * size) - 1)]
    return np.concatenate([[np.uint64(first)], np.uint64(first) + sums])[:n], 32 + m * size


def key_blobs(blk: int, uniq: np.ndarray, n_buckets: int, width: int, extra: np.ndarray | None = None) -> list[tuple]:
    """Rows of BLOB_SCHEMA for sorted distinct ``uniq``: the packed keys, then ``extra`` (a byte per key;
    wider counts as bytes up to 255, then four bytes for each of 255 or more)."""
    cut = np.searchsorted(bucket_of(uniq, n_buckets), np.arange(n_buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(cut)):
        s, e = cut[b], cut[b + 1]
        blob = pack_sorted(uniq[s:e], width)
        if extra is not None:
            part = extra[s:e]
            blob += np.minimum(part, 255).astype(np.uint8).tobytes()
            if part.dtype != np.uint8:
                blob += part[part >= 255].astype("<u4").tobytes()
        out.append((int(b), int(blk), blob))
    return out


def table_of(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table({name: pa.array(list(c), kind) for (name, kind), c in zip(schema, cols)})


BLOB = [("bucket", pa.int32()), ("blk", pa.int32()), ("blob", pa.binary())]
ANSWER = [("blk", pa.int32()), ("bucket", pa.int32()), ("answer", pa.binary())]


def blobs_in(table: pa.Table) -> list[tuple[int, bytes]]:
    """(blk, blob) of a bucket, by block."""
    return sorted(zip(table.column("blk").to_pylist(), table.column("blob").to_pylist()))


def counts_over_blocks(table: pa.Table) -> tuple[list[int], list[int], np.ndarray]:
    """For each key of each blob, in order: in how many documents it stands, summed over
    the blocks' own counts when sent (as bytes: clipped), else one a block. Returns blocks, sizes, counts."""
    blks, sizes, keys, weights = [], [], [], []
    for blk, blob in blobs_in(table):
        k, read = unpack_sorted(blob)
        blks.append(blk)
        sizes.append(len(k))
        keys.append(k)
        if len(blob) > read:
            weight = np.frombuffer(blob, np.uint8, len(k), read).astype(np.int64)
            if len(blob) > read + len(k):
                weight[weight == 255] = np.frombuffer(blob, "<u4", -1, read + len(k))
        else:
            weight = np.ones(len(k), np.int64)
        weights.append(weight)
    all_keys = np.concatenate(keys)
    _, inv = np.unique(all_keys, return_inverse=True)
    total = np.bincount(inv, weights=np.concatenate(weights)).astype(np.int64)
    return blks, sizes, total[inv]


def answer_rows(bucket: int, blks: list[int], sizes: list[int], values: np.ndarray, bits: bool) -> pa.Table:
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    rows = []
    for i, blk in enumerate(blks):
        v = values[at[i]:at[i + 1]]
        rows.append((blk, bucket, (np.packbits(v) if bits else v.astype(np.uint8)).tobytes()))
    return table_of(rows, ANSWER)


def answers_in(table: pa.Table, cut: np.ndarray, bits: bool, dtype=np.uint8) -> np.ndarray:
    """The answers of a block, in the order of its keys. cut: key ranges by bucket."""
    out = np.zeros(int(cut[-1]), bool if bits else dtype)
    for b, raw in zip(table.column("bucket").to_pylist(), table.column("answer").to_pylist()):
        n = int(cut[b + 1] - cut[b])
        v = np.frombuffer(raw, np.uint8 if bits else dtype)
        out[cut[b]:cut[b + 1]] = np.unpackbits(v, count=n).astype(bool) if bits else v[:n]
    return out


def bucket_cuts(sorted_keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return np.searchsorted(bucket_of(sorted_keys, n_buckets), np.arange(n_buckets + 1))


def repeated_in_blocks():
    """Bucket side of a filter: a bit per key, set where a second block has it or where a
    block sent a count of two or more."""

    def reduce(key, table):
        blks, sizes, counts = counts_over_blocks(table)
        return answer_rows(key[0].as_py(), blks, sizes, counts >= 2, True)

    return reduce
