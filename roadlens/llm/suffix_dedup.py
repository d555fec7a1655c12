"""Operator 5 - byte-exact dedup from a column-wise collection order (BWT and LCP).

The collection is built one column at a time: a round prepends one more byte to the
current suffix of *every* document of the collection. The column read in the current
suffix order is the round's piece of the collection's Burrows-Wheeler transform; sorting
it stably gives the next order, and the common prefix of two neighbours with equal bytes
is one more than the minimum of the old common prefixes between them (``Collection``).

Rounds over whole texts would be as many as the longest text has bytes, each passing over
the transform of the whole corpus, so the collection is cut along places that equal
strings agree on:

* every ``min_bytes`` string has an anchor, its smallest k-gram fingerprint (leftmost),
  so equal strings have it at the same offset;
* the strings of one anchor whose offsets fall in one range of ``SUB`` share all but
  ``SUB - 1`` bytes at either side - their interior. A *unit* is such a range: interior,
  left flank, right flank.

Equal strings lie in units of equal interior, and those form one collection: its columns
are the right flank (last to first), the interior in one step (equal by construction,
``min_bytes - SUB + 1`` bytes) and the left flank. After the column ``t`` left of the
interior, a string at offset ``t`` stands elsewhere iff a neighbour's common prefix is at
least ``min_bytes``. Interiors that stand once are sorted out first by the two-way key
exchange of ``blocks``; the columns of the others travel through Spark's shuffle files,
bucketed by interior, which are the sequential external files here. A block sends equal
units once. Interiors met ``hot`` times or more (a passage inside a large share of all
rows, a long run of one byte) do not form one group: their strings go as single 64-bit keys
through the exchange. The bucket decides that, from whole counts and for all blocks alike.

Null or empty text: no bytes. Rows with equal ids are documents of their own. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

MIN_BYTES = 400
HOT = 1 << 15
END = 256  # symbol beyond a document's edge: equal to nothing


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For each p, the place of the smallest of values[p:p+w] (leftmost among equals, by the leading bits)."""
    n = len(values)
    bits = np.uint64(max(1, int(n).bit_length()))
    packed = (values >> bits << bits) | np.arange(n, dtype=np.uint64)
    m = -(-n // w) * w
    padded = np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = packed
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n - w + 1], ahead[w - 1:n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


class Collection:
    """Suffix order and common prefixes of strings in groups, grown by one column a round."""

    def __init__(self, group: np.ndarray):
        """group: small integers; strings of different groups are never compared."""
        self.n = len(group)
        self.order = _stable(group, np.arange(self.n))
        self.group = group
        g = group[self.order]
        self.lcp = np.zeros(self.n + 1, np.int32)
        self.lcp[0] = self.lcp[-1] = -1
        self.lcp[1:-1][g[1:] != g[:-1]] = -1

    def insert(self, column: np.ndarray) -> None:
        """Prepend column[s] to string s's current suffix."""
        old = self.lcp
        bwt = column[self.order]
        perm = _stable(self.group[self.order], np.argsort(bwt, kind="stable"))
        symbol = bwt[perm]
        new = np.zeros(self.n + 1, np.int32)
        new[old == -1] = -1  # groups keep their places
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] != END) & (new[1:-1] != -1)) + 1
        x, y = perm[same - 1], perm[same]
        near = y == x + 1
        new[same[near]] = old[y[near]] + 1
        far = ~near
        if far.any():
            cuts = np.column_stack([x[far] + 1, y[far] + 1]).ravel()
            new[same[far]] = np.minimum.reduceat(old, cuts)[::2] + 1
        self.order, self.lcp = self.order[perm], new

    def insert_equal(self, length: int) -> None:
        """Prepend ``length`` columns that are equal within each group."""
        self.lcp[self.lcp >= 0] += length

    def repeated(self, length: int) -> np.ndarray:
        """Strings whose current suffix shares ``length`` symbols with another one's."""
        return self.order[np.maximum(self.lcp[:-1], self.lcp[1:]) >= length]


def _stable(group: np.ndarray, perm: np.ndarray) -> np.ndarray:
    """``perm`` stably sorted by group[perm] (16-bit radix passes)."""
    g = group[perm]
    perm = perm[np.argsort((g & 0xFFFF).astype(np.uint16), kind="stable")]
    if len(g) and g.max() > 0xFFFF:
        perm = perm[np.argsort((group[perm] >> 16).astype(np.uint16), kind="stable")]
    return perm


class _Block:
    """Units of a block of texts."""

    def __init__(self, table, min_bytes: int, n_buckets: int, width: int):
        self.ids, self.texts = B.block_docs(table)
        self.min = min_bytes
        self.sub = max(1, min(64, min_bytes // 6))
        k = max(1, min_bytes // 6)
        sizes = np.fromiter((len(t) for t in self.texts), np.int64, len(self.texts))
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        n = len(self.data)
        self.sums = B.prefix_sums(B.byte_values()[self.data])
        w = min_bytes - k + 1
        if n >= min_bytes:
            i = np.arange(n - k + 1)
            anchor = sliding_argmin(B.span_hash(self.sums, i, i + k), w)
            end = np.repeat(self.at[1:], sizes)
            p = np.flatnonzero(np.arange(len(anchor)) + min_bytes <= end[:len(anchor)])
            part = (anchor[p] - p) // self.sub
            inner = anchor[p] - self.sub * part  # the interior starts here
            new = np.ones(len(p), bool)
            new[1:] = (inner[1:] != inner[:-1]) | (part[1:] != part[:-1]) | (p[1:] != p[:-1] + 1)
            head = np.flatnonzero(new)
            self.first, self.last = p[head], p[np.append(head[1:], len(p)) - 1] if len(p) else p[head]
            self.inner, part = inner[head], part[head]
        else:
            self.first = self.last = self.inner = part = np.zeros(0, np.int64)
        self.full = B.mix(B.span_hash(self.sums, self.inner, self.inner + self.inside) + part.astype(np.uint64))
        self.uniq, self.inverse, self.local = np.unique(B.truncate(self.full, width), return_inverse=True, return_counts=True)
        self.cut = B.bucket_cuts(self.uniq, n_buckets)

    @property
    def inside(self) -> int:
        return self.min - self.sub + 1

    def units(self, kind):
        """(indices of units to order by columns, of units whose strings go one by one).

        kind: the bucket's class of each key. It alone decides, so all blocks send an interior the same way.
        """
        kind = kind[self.inverse]
        return np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)

    def flanks(self, u: np.ndarray) -> np.ndarray:
        """Rows: SUB-1 left bytes (nearest first), SUB-1 right bytes, the two true lengths."""
        f, start = self.sub - 1, self.inner[u]
        doc = np.searchsorted(self.at, start, side="right") - 1
        stop = start + self.inside
        left = np.minimum(start - self.at[doc], f)
        right = np.minimum(self.at[doc + 1] - stop, f)
        out = np.zeros((len(u), 2 * f + 2), np.uint8)
        j = np.arange(f)
        out[:, :f] = self.data[np.maximum(start[:, None] - 1 - j, 0)] * (j < left[:, None])
        out[:, f:2 * f] = self.data[np.minimum(stop[:, None] + j, len(self.data) - 1)] * (j < right[:, None])
        out[:, 2 * f], out[:, 2 * f + 1] = left, right
        return out

    def grouped(self, u: np.ndarray):
        """Distinct (interior, flanks) among units u: leaders, place of each unit, size, flank rows."""
        rows = self.flanks(u)
        sums = self.full[u].copy()
        pad = -rows.shape[1] % 8
        words = np.pad(rows, ((0, 0), (0, pad))).view(np.uint64)
        for c in range(words.shape[1]):
            sums = B.mix(sums + words[:, c])
        _, lead, place, size = np.unique(sums, return_index=True, return_inverse=True, return_counts=True)
        return lead, place, size, rows

    def window_keys(self, u: np.ndarray):
        """(starts, 64-bit keys) of every string of units u."""
        size = self.last[u] - self.first[u] + 1
        p = np.repeat(self.first[u], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return p, B.mix(B.span_hash(self.sums, p, p + self.min) + np.uint64(29))


def _order_bucket(table, min_bytes: int, sub: int, bucket: int):
    """Column-wise order of the units of a bucket; a 64-bit mask of repeated offsets for each."""
    f = sub - 1
    blks, sizes, keys, rows = [], [], [], []
    for blk, blob in B.blobs_in(table):
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        blks.append(blk)
        sizes.append(n)
        keys.append(np.frombuffer(blob, np.uint64, n, 8))
        rows.append(np.frombuffer(blob, np.uint8, offset=8 + 8 * n).reshape(n, 2 * f + 2))
    rows = np.concatenate(rows)
    _, group, size = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    mask = np.zeros(len(rows), np.uint64)
    some = np.flatnonzero(size[group] > 1)
    if len(some):
        columns = np.ascontiguousarray(rows[some].T)
        left, right = columns[2 * f], columns[2 * f + 1]
        c = Collection(np.unique(group[some], return_inverse=True)[1])
        for j in range(f - 1, -1, -1):
            c.insert(np.where(j < right, columns[f + j], END).astype(np.uint16))
        c.insert_equal(min_bytes - sub + 1)
        mask[some[c.repeated(min_bytes)]] |= np.uint64(1)
        for t in range(1, sub):
            c.insert(np.where(t <= left, columns[t - 1], END).astype(np.uint16))
            mask[some[c.repeated(min_bytes)]] |= np.uint64(1 << t)
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return B.table_of([(blk, bucket, mask[at[i]:at[i + 1]].tobytes()) for i, blk in enumerate(blks)], B.ANSWER)


def _clipped(counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts, 255).astype(np.uint8)


def _shift(answers, low: int, high: int):
    """Answers of the buckets low..high-1, renumbered from 0."""
    bucket = np.asarray(answers.column("bucket"))
    part = answers.filter(pa.array((bucket >= low) & (bucket < high)))
    return part.set_column(part.schema.get_field_index("bucket"), "bucket", pa.array(np.asarray(part.column("bucket")) - low, pa.int32()))


def suffix_dedup(docs: DataFrame, min_bytes: int = MIN_BYTES, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a ``min_bytes`` string that also starts anywhere else.

    Returns (doc_id, n_bytes, n_removed, spans array<struct<start, end>>, kept binary).
    """
    total = B.text_bytes(docs, text_col)
    n_blocks, nb = B.block_counts(docs, total)
    width = B.key_width(total)
    sub = max(1, min(64, min_bytes // 6))
    by_block = B.blocked(docs, n_blocks, id_col, text_col).groupBy("blk")

    def send_keys(key, table):
        b = _Block(table, min_bytes, nb, width)
        return B.table_of(B.key_blobs(key[0].as_py(), b.uniq, nb, width, b.local), B.BLOB)

    def count_keys(key, table):
        """A class per key: 0 stands once, 1 to be ordered by columns, 2 hot."""
        blks, sizes, counts = B.counts_over_blocks(table)
        return B.answer_rows(key[0].as_py(), blks, sizes, np.where(counts >= hot, 2, counts >= 2), False)

    shared = by_block.applyInArrow(send_keys, B.BLOB_SCHEMA).groupBy("bucket").applyInArrow(count_keys, B.ANSWER_SCHEMA)

    def shared_units(b, answers):
        return b.units(B.answers_in(answers, b.cut, False))

    def send_units(key, table, answers):
        if not table.num_rows:
            return B.table_of([], B.BLOB)
        b = _Block(table, min_bytes, nb, width)
        u, hot_u = shared_units(b, answers)
        blk, out = key[0].as_py(), []
        lead, _, _, rows = b.grouped(u)
        keys = b.full[u[lead]]
        bucket = B.bucket_of(keys, nb)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(nb + 1))
        for k in np.flatnonzero(np.diff(cut)):
            o = order[cut[k]:cut[k + 1]]
            out.append((int(k), blk, np.int64(len(o)).tobytes() + keys[o].tobytes() + rows[lead[o]].tobytes()))
        if len(hot_u):
            uniq, local = np.unique(b.window_keys(hot_u)[1], return_counts=True)
            out += [(k + nb, blk, blob) for k, blk, blob in B.key_blobs(blk, uniq, nb, 8, _clipped(local))]
        return B.table_of(out, B.BLOB)

    def order_units(key, table):
        bucket = key[0].as_py()
        if bucket < nb:
            return _order_bucket(table, min_bytes, sub, bucket + nb)
        blks, sizes, counts = B.counts_over_blocks(table)
        return B.answer_rows(bucket + nb, blks, sizes, counts >= 2, True)

    masks = by_block.cogroup(shared.groupBy("blk")).applyInArrow(send_units, B.BLOB_SCHEMA).groupBy("bucket").applyInArrow(
        order_units, B.ANSWER_SCHEMA)

    def remove(key, table, answers):
        out = []
        if table.num_rows:
            b = _Block(table, min_bytes, nb, width)
            u, hot_u = shared_units(b, _shift(answers, 0, nb))
            starts = []
            lead, place, size, _ = b.grouped(u)
            bucket = B.bucket_of(b.full[u[lead]], nb)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(nb + 1))
            mask = np.zeros(len(lead), np.uint64)
            mask[order] = B.answers_in(_shift(answers, nb, 2 * nb), cut, False, np.uint64)
            mask[size > 1] = np.uint64(0xFFFFFFFFFFFFFFFF)
            mask = mask[place]
            for t in range(sub):
                p = b.inner[u] - t
                ok = (mask >> np.uint64(t) & np.uint64(1)).astype(bool) & (p >= b.first[u]) & (p <= b.last[u])
                starts.append(p[ok])
            if len(hot_u):
                p, keys = b.window_keys(hot_u)
                uniq, inverse, local = np.unique(keys, return_inverse=True, return_counts=True)
                again = B.answers_in(_shift(answers, 2 * nb, 3 * nb), B.bucket_cuts(uniq, nb), True) | (local > 1)
                starts.append(p[again[inverse]])
            p = np.concatenate(starts)
            cover = np.bincount(p, minlength=len(b.data) + 1)
            cover[min_bytes:] -= np.bincount(p + min_bytes, minlength=len(b.data) + 1)[min_bytes:]
            gone = np.cumsum(cover[:len(b.data)]) > 0
            for d, (i, text) in enumerate(zip(b.ids, b.texts)):
                g = gone[b.at[d]:b.at[d + 1]]
                edge = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0))
                spans = [{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)]
                kept = np.frombuffer(text, np.uint8)[~g].tobytes() if spans else text
                out.append((i, len(text), len(text) - len(kept), spans, kept))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return B.table_of(out, [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.binary())])

    return by_block.cogroup(shared.unionByName(masks).groupBy("blk")).applyInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
