"""Operator 10 - exact n-gram Jaccard join by set-relation skipping.

A document's set is its distinct ``k``-word shingles (64-bit fingerprints). Equal sets are
one class (128-bit sums of the set), and one document stands for each, so a group of
copies never meets itself.

*Index.* Shingles are ordered by how many class documents hold them, rarest first (counts
of the two-way exchange over all shingles, then the fingerprint). Two sets of the wanted
similarity share one of their first ``n - ceil(t n) + 1``. Those make the index; shingles
that stand once are not in it, and a set of which none is left has no partner.

*Skipping within a list.* A list is sorted by set size and cut in blocks that carry their
size range and most elements left from the list's position on; a set passes over blocks
(then entries) that the size bound, the position bound or a 512-bit parity signature
(Hamming distance at most the symmetric difference) rule out.

*Skipping between sets.* First, a list's sets are compared with its leaders only: a set
with a possible leader is a candidate of that leader and takes over the leader's answers,
otherwise it leads. Candidates are verified on their whole sets. Sets that verified links
connect have one answer, so a second pass derives theirs from the first: for each two
components that meet in a list, the pair nearest by signature is verified. In a third,
all possible pairs between the components still different are. Every pair the index
proposes is thus verified, refuted by a bound, or already in one component; no list is
capped. Lists longer than ``LIST`` sets are dealt to tasks in chunks; in the later passes only
entries outside a list's largest component go to more than one of its chunks.

Empty texts have empty sets and stand alone. Rows with equal ids are one node of the link
graph. A null id counts as the smallest. Extra columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from . import blocks as B
from .graph import components, few

SHINGLE = 5
SIMILARITY = 80  # percent
NULL_ID = -(1 << 63)
LIST = 2048
SKIP = 64  # entries of a skip block
BITS = 512
#: ids (8 bytes each) that may be broadcast to thin out a table
BROADCAST_IDS = 500_000
#: pairs that a task verifies
VERIFY_PAIRS = 5000


class _Sets:
    """Shingle sets of texts: (doc, h) sorted by document, then fingerprint."""

    def __init__(self, texts: list[bytes], k: int):
        words = B.Words([t.lower() for t in texts])
        h, inside = words.windows(k)
        doc = words.doc[:len(h)][inside]
        h = h[inside]
        count = np.diff(words.first)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            sums = B.prefix_sums(words.h)
            s, e = words.first[short], words.first[short + 1]
            doc = np.concatenate([doc, short])
            h = np.concatenate([h, B.mix(B.span_hash(sums, s, e) + (e - s).astype(np.uint64))])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.h, self.doc = h[new], doc[new]
        self.size = np.bincount(self.doc, minlength=len(texts))
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    def sums(self, salt: int) -> np.ndarray:
        total = np.zeros(len(self.h) + 1, np.uint64)
        np.cumsum(B.mix(self.h + np.uint64(salt)), out=total[1:])
        return (total[self.at[1:]] - total[self.at[:-1]]).view(np.int64)


def set_classes(docs: DataFrame, n_blocks: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """Per row (_id, blk, n, s1, s2): the size of its set and the class fingerprint."""

    def fingerprint(batches):
        for batch in batches:
            rows = ([], [], [])
            texts = B.utf8(batch.column("_text"))
            for start, end in B.text_chunks(texts):
                part = _Sets(texts[start:end], k)
                for r, v in zip(rows, (part.size.astype(np.int64), part.sums(1), part.sums(7))):
                    r.append(v)
            n, s1, s2 = (np.concatenate(r) if r else np.zeros(0, np.int64) for r in rows)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("blk"), pa.array(n), pa.array(s1), pa.array(s2)],
                                             names=["_id", "blk", "n", "s1", "s2"])
        B.give_back()

    return B.blocked(docs, n_blocks, id_col, text_col).mapInArrow(fingerprint, "_id long, blk int, n long, s1 long, s2 long").withColumn(
        "_id", F.coalesce("_id", F.lit(NULL_ID)))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def _possible(n1, left1, bits1, n2, left2, bits2, t: int) -> np.ndarray:
    """Which pairs the size, position and signature bounds leave (t in percent)."""
    both = n1 + n2
    ok = (100 * np.minimum(n1, n2) >= t * np.maximum(n1, n2)) & ((100 + t) * np.minimum(left1, left2) >= t * both)
    if ok.any():
        at = np.flatnonzero(ok)
        pick = lambda x: x if np.ndim(x) == 0 else x[at]
        pick_bits = lambda x: x if x.ndim == 1 else x[at]
        apart = _popcount(pick_bits(bits1) ^ pick_bits(bits2))
        ok[at] = (100 + t) * apart <= (100 - t) * (pick(n1) + pick(n2))
    return ok


class _List:
    """A list of the index, by set size, with skip blocks."""

    def __init__(self, n, left):
        self.n, self.left = n, left
        cut = np.arange(0, len(n), SKIP)
        self.low, self.high = np.minimum.reduceat(n, cut), np.maximum.reduceat(n, cut)
        self.most = np.maximum.reduceat(left, cut)

    def near(self, i: int, t: int) -> np.ndarray:
        """Entries of the blocks that set i can't pass over, beyond i."""
        n, left = self.n[i], self.left[i]
        ok = (100 * n >= t * self.low) & (100 * self.high >= t * n) & ((100 + t) * np.minimum(self.most, left) >= t * (n + np.maximum(self.low, -(-t * n // 100))))
        ok[:i // SKIP] = False
        e = (np.flatnonzero(ok)[:, None] * SKIP + np.arange(SKIP)).ravel()
        return e[(e > i) & (e < len(self.n))]


def _leader_pairs(n, left, bits, t: int):
    """Pairs (leader, member) of one list."""
    index, free = _List(n, left), np.ones(len(n), bool)
    a, b = [], []
    for i in range(len(n)):
        if free[i]:
            e = index.near(i, t)
            e = e[free[e]]
            e = e[_possible(n[i], left[i], bits[i], n[e], left[e], bits[e], t)]
            free[e] = False
            a.append(np.full(len(e), i))
            b.append(e)
    return np.concatenate(a), np.concatenate(b)


def _cross_pairs(n, left, bits, comp, side, t: int, best: bool):
    """Possible pairs of one list whose components differ (of different sides where side has
    two values); with ``best`` only the nearest by signature for each two components."""
    index, a, b = _List(n, left), [], []
    for i in range(len(n)):
        e = index.near(i, t)
        e = e[comp[e] != comp[i]]
        if side is not None:
            e = e[side[e] != side[i]]
        e = e[_possible(n[i], left[i], bits[i], n[e], left[e], bits[e], t)]
        a.append(np.full(len(e), i))
        b.append(e)
    a, b = np.concatenate(a), np.concatenate(b)
    if best and len(a):
        order = np.lexsort((_popcount(bits[a] ^ bits[b]), np.maximum(comp[a], comp[b]), np.minimum(comp[a], comp[b])))
        a, b = a[order], b[order]
        lo, hi = np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])
        new = np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        a, b = a[new], b[new]
    return a, b


_PAIR = [("a", pa.int64()), ("b", pa.int64())]


def _bucket_pairs(t: int, second: bool, best: bool):
    """All lists of a bucket -> candidate pairs of ids."""

    def pairs(table):
        col = lambda c: np.asarray(table.column(c))
        token, chunk, ids, n, pos = (col(c).astype(np.int64) for c in ("token", "chunk", "id", "n", "pos"))
        if not len(ids):
            return table_of_pairs([], [])
        comp = col("comp").astype(np.int64)
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        order = np.lexsort((ids, n, chunk, token))
        token, chunk, ids, n, comp, bits = (x[order] for x in (token, chunk, ids, n, comp, bits))
        left = n - pos[order]
        side = col("side").astype(np.int64)[order] if second else None
        head = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (chunk[1:] != chunk[:-1])]))
        size = np.diff(np.append(head, len(ids)))
        two = head[size == 2]
        ok = _possible(n[two], left[two], bits[two], n[two + 1], left[two + 1], bits[two + 1], t) & (ids[two] != ids[two + 1])
        if second:
            ok &= comp[two] != comp[two + 1]
        a, b = [two[ok]], [two[ok] + 1]
        for s, m in zip(head[size > 2].tolist(), size[size > 2].tolist()):
            z = slice(s, s + m)
            if second:
                if (comp[z] == comp[s]).all():
                    continue
                halves = side[z] if side[z].min() != side[z].max() else None
                x, y = _cross_pairs(n[z], left[z], bits[z], comp[z], halves, t, best)
            else:
                x, y = _leader_pairs(n[z], left[z], bits[z], t)
            a.append(x + s)
            b.append(y + s)
        a, b = np.concatenate(a), np.concatenate(b)
        return table_of_pairs(ids[a], ids[b])

    return pairs


def table_of_pairs(a, b) -> pa.Table:
    pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]).reshape(-1, 2), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _small(ids: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(ids) if rows <= BROADCAST_IDS else ids


def _verified(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Pairs whose whole sets reach the similarity.

    A pair is checked in the slot of its ``b``. A slot gets the sets of its own ``b`` once, and each ``a`` that any of
    its pairs names once: the set of a leader of very many goes to every slot, not along with every pair."""
    n = pairs.count()
    if not n:
        return pairs
    slots = max(1, -(-n // VERIFY_PAIRS))
    at = pairs.select("a", "b", F.pmod(F.xxhash64("b", F.lit(11)), F.lit(slots)).cast("int").alias("slot"))
    wanted = at.select("slot", F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = cut_lineage(few(wanted, n))
    held = sets.join(_small(wanted, wanted.count()), "id").select("slot", "id", "shingles")

    def check(key, pairs, held):
        kept = []
        if len(pairs) and len(held):
            of = {}
            column = held.column("shingles").combine_chunks()
            values, ends = column.flatten().to_numpy(), np.asarray(column.value_lengths()).cumsum()
            for i, e, m in zip(held.column("id").to_pylist(), ends, np.asarray(column.value_lengths())):
                of.setdefault(i, []).append(values[e - m:e])
            for x, y in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
                for p in of.get(x, ()):  # an id may stand for several sets
                    if any(100 * (both := len(np.intersect1d(p, q, assume_unique=True))) >= t * (len(p) + len(q) - both) for q in of.get(y, ())):
                        kept.append((x, y))
                        break
            del of, values
        B.give_back()
        return B.table_of(kept, _PAIR)

    return at.groupBy("slot").cogroup(held.groupBy("slot")).applyInArrow(check, "a long, b long")


def jaccard_join(docs: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id): class_id is the smallest id of an equal set."""
    spark, t = docs.sparkSession, similarity
    total = B.text_bytes(docs, text_col)
    n_blocks, n_buckets = B.block_counts(docs, total)
    width = B.key_width(total)
    rows = cut_lineage(set_classes(docs, n_blocks, k, id_col, text_col))
    classes = rows.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("_id", "blk")).alias("rep"))
    chosen = classes.select("rep.blk", "rep._id").groupBy("blk").agg(F.collect_set("_id").alias("ids"))  # by block: bounded
    none = F.lit(None)
    chosen = chosen.select("blk", none.cast("int").alias("bucket"), none.cast("binary").alias("answer"), "ids")
    by_block = B.blocked(docs, n_blocks, id_col, text_col).groupBy("blk")

    def class_sets(table, notes):
        """Sets of the block's class documents, and their ids."""
        wanted = {i for ids in notes.column("ids").to_pylist() if ids for i in ids}
        ids, texts = B.block_docs(table)
        ids = [NULL_ID if i is None else i for i in ids]
        pick = [j for j, i in enumerate(ids) if i in wanted]
        sets = _Sets([texts[j] for j in pick], k)
        keys, inverse, counts = np.unique(B.truncate(sets.h, width), return_inverse=True, return_counts=True)
        return [ids[j] for j in pick], sets, keys, inverse, counts

    def send_keys(key, table, notes):
        if not table.num_rows:
            return B.table_of([], B.BLOB)
        _, _, keys, _, counts = class_sets(table, notes)
        B.give_back()
        return B.table_of(B.key_blobs(key[0].as_py(), keys, n_buckets, width, np.minimum(counts, 255).astype(np.uint8)), B.BLOB)

    def rank_keys(key, table):
        """A byte per key: 0 stands once, else about 8 steps to a doubling of the count."""
        blks, sizes, counts = B.counts_over_blocks(table)
        rank = np.where(counts < 2, 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(counts, 2) / 2))))
        return B.answer_rows(key[0].as_py(), blks, sizes, rank.astype(np.uint8), False)

    ranks = by_block.cogroup(chosen.groupBy("blk")).applyInArrow(send_keys, B.BLOB_SCHEMA).groupBy("bucket").applyInArrow(
        rank_keys, B.ANSWER_SCHEMA).select("blk", "bucket", "answer", none.cast("array<bigint>").alias("ids"))

    def index_sets(key, table, notes):
        kinds = [("id", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("tokens", pa.list_(pa.int64())),
                 ("pos", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))]
        if not table.num_rows:
            return B.table_of([], kinds)
        ids, sets, keys, inverse, _ = class_sets(table, notes)
        answers = notes.filter(pa.compute.is_valid(notes.column("answer")))
        rank = B.answers_in(answers, B.bucket_cuts(keys, n_buckets), False).astype(np.int64)[inverse]
        order = np.lexsort((sets.h, rank, sets.doc))
        pos = np.arange(len(order)) - sets.at[sets.doc]
        n = sets.size[sets.doc]
        use = np.flatnonzero((pos < n - (t * n + 99) // 100 + 1) & (rank[order] > 0))
        docs_used = np.unique(sets.doc[use])
        bits = np.zeros((len(ids), BITS), np.uint8)  # parity only: wrapping is right
        np.add.at(bits, (sets.doc, (sets.h % np.uint64(BITS)).astype(np.int64)), 1)
        packed = np.packbits(bits & 1, axis=1)
        cut = np.searchsorted(sets.doc[use], np.arange(len(ids) + 1))
        h = sets.h.view(np.int64)
        out = []
        for d in docs_used.tolist():
            u = use[cut[d]:cut[d + 1]]
            out.append((ids[d], int(sets.size[d]), packed[d].tobytes(), h[order[u]], pos[u], rank[order[u]], h[sets.at[d]:sets.at[d + 1]]))
        out = B.table_of(out, kinds)
        del sets, keys, inverse, rank, order, pos, n, use, h
        B.give_back()
        return out

    table = f"{ensure_checkpoint_dir(spark)}/jaccard-{uuid.uuid4().hex}"
    by_block.cogroup(ranks.unionByName(chosen).groupBy("blk")).applyInArrow(
        index_sets, "id long, n long, bits binary, tokens array<long>, pos array<long>, ranks array<long>, shingles array<long>").write.parquet(table)
    stored = spark.read.parquet(table)
    sets = stored.select("id", "shingles")
    entries = stored.select("id", "n", "bits", F.explode(F.arrays_zip("tokens", "pos", "ranks")).alias("e")).select(
        "id", "n", "bits", F.col("e.tokens").alias("token"), F.col("e.pos").alias("pos"),
        # chunks of a list: its count is 2 * 2^(rank / 8) at most one step more
        F.greatest(F.lit(1), F.ceil(F.pow(F.lit(2.0), (F.col("e.ranks") + 8) / 8) / LIST)).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.col("chunks")).cast("int")
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(n_buckets)).cast("int")

    first = entries.select("id", "n", "bits", "token", "pos", own.alias("chunk"), F.col("id").alias("comp"))
    tried = cut_lineage(first.groupBy(slot("token", "chunk").alias("slot")).applyInArrow(
        _group_pairs(t, False, False), "a long, b long").filter("a <> b").distinct())
    links = cut_lineage(_verified(tried, sets, t))
    joined = cut_lineage(components(links))

    def crossing(joined: DataFrame, best: bool) -> DataFrame:
        """Untried possible pairs between different components.

        The largest component of a list is dealt to chunks; only entries of the others meet each of them, and
        each other, chunk by chunk."""
        label = entries.join(_small(joined.withColumnRenamed("root", "comp"), joined.count()), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        parts = label.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"))
        lists = parts.groupBy("token").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("comps"))
        lists = cut_lineage(lists.filter("comps > 1").select("token", F.col("top.comp").alias("major"), F.ceil(F.col("top.n") / LIST).cast("int").alias("cm"),
                                                             F.ceil((F.col("all") - F.col("top.n")) / LIST).cast("int").alias("cv")))
        mine = label.join(_small(lists, lists.count()), "token").withColumn("in_major", F.col("comp") == F.col("major"))
        mine = mine.withColumns({"m": F.pmod(F.xxhash64("id", F.lit(3)), F.col("cm")).cast("int"), "v": F.pmod(F.xxhash64("id", F.lit(5)), F.col("cv")).cast("int")})
        upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        place = lambda chunk, side: F.struct(chunk.cast("int").alias("chunk"), side.cast("long").alias("side"))
        lead = F.transform(upto("cv"), lambda o: place(F.col("m") * F.col("cv") + o, F.lit(0)))
        visit = F.transform(upto("cm"), lambda o: place(o * F.col("cv") + F.col("v"), F.lit(1)))
        among = F.transform(upto("cv"), lambda o: place(
            (F.col("cm") + F.least(o, F.col("v"))) * F.col("cv") + F.greatest(o, F.col("v")), F.signum((F.col("v") - o).cast("double"))))
        spread = mine.select("id", "n", "bits", "token", "pos", "comp", F.explode(F.when(F.col("in_major"), lead).otherwise(F.concat(visit, among))).alias("at"))
        spread = spread.select("id", "n", "bits", "token", "pos", "comp", "at.chunk", "at.side")
        found = spread.groupBy(slot("token", "chunk").alias("slot")).applyInArrow(_group_pairs(t, True, best), "a long, b long")
        return cut_lineage(found.filter("a <> b").distinct().join(tried, ["a", "b"], "left_anti"))

    for best in (True, False):  # the nearest pair of two components settles most of the others
        late = crossing(joined, best)
        more = cut_lineage(_verified(late, sets, t))
        links = links.unionByName(more)
        tried = tried.unionByName(late)
        if not more.isEmpty():
            joined = cut_lineage(components(links))
    root = joined

    named = rows.join(classes.withColumn("class_id", F.col("rep._id")).drop("rep"), ["n", "s1", "s2"], "left")
    out = named.join(root.withColumnRenamed("id", "class_id"), "class_id", "left")
    ids = out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("class_id", "_id").alias("class_id"),
                     F.coalesce("root", "class_id", "_id").alias("component_id"))
    return ids.select(*(F.nullif(c, F.lit(NULL_ID)).alias(c) if c != "n_shingles" else c for c in ids.columns))


def _group_pairs(t: int, second: bool, best: bool):
    pairs = _bucket_pairs(t, second, best)

    def of_group(key, table):
        out = pairs(table)
        B.give_back()
        return out

    return of_group


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_join(docs).select("doc_id", "n_shingles", "component_id")
