"""Operator 11 - phrase collocations by direct-address tiling of ranked pairs.

Words get ids by frequency rank inside their language. Pairs of neighbouring ids are counted in tiles of
256 x 256 ids: tiles with many pairs by a dense ``bincount`` over their cells, sparse tiles as sorted (cell, count)
lists. Frequent pairs are ranked again and become the ids of the next round: a phrase of k + 1 words is the pair
of its first and its last k words, both frequent themselves, so four rounds give all phrases of 2 to 5 words.

Jobs. One narrow pass turns texts into *units* (about 4 MB of one language): a dictionary and a code for
each word. Every round (words first, then pairs): units count, map-side, and send what they counted by group of words or
tiles; groups are merged over at most ``FAN`` units a task, ``MERGED`` at a time; groups answer units with the new ids,
again at most ``FAN`` units a task; units keep the ids by position. Text is read once and never shuffled; a
word or pair that stands everywhere is one entry per unit, and a hot tile is never more than 65,536 entries of each. Ranks are dense positions over the counts of
a language, so a language with a third of all rows is spread too. State is written to the checkpoint folder.

Scores are exact: products of up to 38 digits. A candidate inside a longer one of the same count also
stands in one that is a single word longer (counts only fall with length), so one join by the round's ids decides.
Joins by a first or last part salt the low ranks.

Null lang is ``und``, null text is empty, no text no rows. Words are matched byte for byte after A-Z is lower-cased.
Repeated rows count as often as they stand; doc_id and extra columns are not read. Ties: see ``collocations``.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import dense_position
from ..session import ensure_checkpoint_dir
from . import blocks as B

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
UNIT_BYTES = 4 << 20
FAN = 512
MERGED = 64
DENSE = 4096
HOT_RANK, SALTS = 1024, 32

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(46 if c in _BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))

UNIT = "unit long, lang string, n long, words binary, ids binary"
BLOB = "lang string, grp int, unit long, blob binary"


class Store:
    """Tables of one run under the shared checkpoint folder."""

    def __init__(self, spark):
        self.spark, self.place = spark, f"{ensure_checkpoint_dir(spark)}/phrases-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.place}/{name}")
        return self.spark.read.parquet(f"{self.place}/{name}")


# ---- binary values: parts of several arrays, compressed ----

def _squeeze(*parts: np.ndarray) -> bytes:
    raw = b"".join(p.tobytes() for p in parts)
    return np.array([len(raw), *(p.nbytes for p in parts)], "<i8").tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unsqueeze(blob: bytes, *kinds: str) -> list[np.ndarray]:
    size, *lengths = np.frombuffer(blob, "<i8", len(kinds) + 1).tolist()
    raw = pa.Codec("zstd", 1).decompress(blob[8 * len(kinds) + 8:], size, asbytes=True)
    ends = np.cumsum(lengths)
    return [np.frombuffer(raw[e - n:e], kind) for n, e, kind in zip(lengths, ends, kinds)]


def _ints(values: np.ndarray) -> bytes:
    """Integers from -1 on, one byte plane after the other (ranks of frequent words are small)."""
    wide = 4 if values.max(initial=0) < (1 << 32) - 2 else 8
    return _squeeze(np.array([wide], "<i8"), (values + 1).astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T.copy())


def _ints_of(blob: bytes) -> np.ndarray:
    wide, planes = _unsqueeze(blob, "<i8", "u1")
    return planes.reshape(int(wide[0]), -1).T.copy().view(f"<u{wide[0]}").ravel().astype(np.int64) - 1


def _counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as a byte each, and those of 255 or more in full."""
    return np.minimum(values, 255).astype(np.uint8), values[values >= 255].astype("<i8")


def _counts_of(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    values = low.astype(np.int64)
    values[low == 255] = high
    return values


# ---- units ----

def encode(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, code of each word in order with -1 between pieces)."""
    tokens = b".".join(texts).translate(_TABLE).replace(b".", b" . ").split()
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    at = words.index(b".").as_py()
    if at >= 0:
        codes[codes == at] = -1
        codes[codes > at] -= 1
        words = pa.concat_arrays([words[:at], words[at + 1:]])
    return words, codes


def pack_words(words: pa.Array, codes: np.ndarray, counts: np.ndarray) -> bytes:
    sizes = np.array([len(w) for w in words.to_pylist()], "<u4")
    return _squeeze(sizes, codes.astype("<u4"), *_counts(counts), np.frombuffer(b"".join(words.to_pylist()), np.uint8))


def unpack_words(blob: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    sizes, codes, low, high, data = _unsqueeze(blob, "<u4", "<u4", "u1", "<i8", "u1")
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
    return words, codes.astype(np.int64), _counts_of(low, high)


_UNIT = [("unit", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.binary()), ("ids", pa.binary())]
_STATE = [("unit", pa.int64()), ("lang", pa.string()), ("ids", pa.binary())]


def units_of(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Rows of UNIT: texts of a partition by language, encoded."""

    def pack(batches):
        from pyspark import TaskContext

        first, number, held, size = TaskContext.get().partitionId() << 32, 0, {}, {}

        def unit(lang):
            nonlocal number
            words, codes = encode(held.pop(lang))
            del size[lang]
            number += 1
            counts = np.bincount(codes[codes >= 0], minlength=len(words))
            row = (first + number, lang, int(counts.sum()), pack_words(words, np.arange(len(words)), counts), _ints(codes))
            return B.table_of([row], _UNIT).to_batches()[0]

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                held.setdefault(lang, []).append(text.encode())
                size[lang] = size.get(lang, 0) + len(held[lang][-1])
                if size[lang] >= UNIT_BYTES:
                    yield unit(lang)
                elif len(size) > 1 and sum(size.values()) >= 8 * UNIT_BYTES:  # very many languages
                    yield unit(max(size, key=size.get))
        for lang in list(held):
            yield unit(lang)

    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).mapInArrow(pack, UNIT)


# ---- tiles ----

def pair_codes(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Tile (i // 256, j // 256) in the high bits, cell in the low 16."""
    return (i >> 8 << 39) | (j >> 8 << 16) | (i & 255) << 8 | (j & 255)


def pair_ids(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (codes >> 39 << 8) | (codes >> 8 & 255), (codes >> 16 & (1 << 23) - 1) << 8 | (codes & 255)


def count_tiles(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct codes, their counts): dense cells where a tile has many entries, a sort elsewhere."""
    order = np.argsort(codes >> 16, kind="stable")
    codes = codes[order]
    weights = None if weights is None else weights[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(codes >> 16)) + 1, [len(codes)]]) if len(codes) else np.array([0])
    sizes = np.diff(cut)
    out, sparse = [], np.ones(len(codes), bool)
    for t in np.flatnonzero(sizes >= DENSE):
        s, e = cut[t], cut[t + 1]
        cells = np.zeros(1 << 16, np.int64)
        if weights is None:
            cells += np.bincount(codes[s:e] & 0xFFFF, minlength=1 << 16)
        else:
            np.add.at(cells, codes[s:e] & 0xFFFF, weights[s:e])
        hit = np.flatnonzero(cells)
        out.append(((codes[s] >> 16 << 16) + hit, cells[hit]))
        sparse[s:e] = False
    uniq, inverse = np.unique(codes[sparse], return_inverse=True)
    sums = np.zeros(len(uniq), np.int64)
    np.add.at(sums, inverse, 1 if weights is None else weights[sparse])
    out.append((uniq, sums))
    codes, counts = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(codes)
    return codes[order], counts[order]


def pack(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted codes and their counts: tiles (gaps), entries per tile, the two bytes of the cells, counts."""
    tiles, sizes = np.unique(codes >> 16, return_counts=True)
    return _squeeze(np.diff(tiles, prepend=0).astype("<i8"), sizes.astype("<u4"), (codes >> 8 & 255).astype(np.uint8), (codes & 255).astype(np.uint8), *_counts(counts))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    tiles, sizes, upper, lower, low, high = _unsqueeze(blob, "<i8", "<u4", "u1", "u1", "u1", "<i8")
    return np.repeat(np.cumsum(tiles), sizes) << 16 | upper.astype(np.int64) << 8 | lower, _counts_of(low, high)


def _merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(blobs), MERGED):
        parts = [(codes, counts), *map(unpack, blobs[at:at + MERGED])]
        codes, counts = count_tiles(*(np.concatenate(x) for x in zip(*parts)))
    return codes, counts


def _merged_words(blobs: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    words, counts = pa.array([], pa.binary()), np.zeros(0, np.int64)
    for at in range(0, len(blobs), MERGED):
        parts = [unpack_words(b) for b in blobs[at:at + MERGED]]
        coded = pa.concat_arrays([words, *(w for w, _, _ in parts)]).dictionary_encode()
        sums = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(sums, coded.indices.to_numpy(), np.concatenate([counts, *(c for _, _, c in parts)]))
        words, counts = coded.dictionary, sums
    return words, counts


# ---- a round: blobs of units, what is frequent in a group, answers, new ids ----

_BLOB = [("lang", pa.string()), ("grp", pa.int32()), ("unit", pa.int64()), ("blob", pa.binary())]


def _by_group(state: DataFrame, column: str, split) -> DataFrame:
    """Rows of BLOB: what each unit counted, by group (``split`` gives (group, blob) pairs)."""

    def count(batches):
        for batch in batches:
            for unit, lang, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                yield from B.table_of([(lang, int(g), unit, blob) for g, blob in split(raw)], _BLOB).to_batches()

    return state.select("unit", "lang", column).mapInArrow(count, BLOB)


def word_blobs(units: DataFrame, groups: int) -> DataFrame:
    def split(raw):
        words, codes, counts = unpack_words(raw)
        data = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(w) for w in words.to_pylist()])]).astype(np.int64)
        sums = B.prefix_sums(B.byte_values()[data])
        group = (B.span_hash(sums, ends[:-1], ends[1:]) % np.uint64(groups)).astype(np.int64)  # deals words out, no more
        for g in np.unique(group):
            mine = np.flatnonzero(group == g)
            yield g, pack_words(words.take(pa.array(mine)), codes[mine], counts[mine])

    return _by_group(units, "words", split)


def pair_blobs(state: DataFrame, groups: int) -> DataFrame:
    def split(raw):
        ids = _ints_of(raw)
        both = (ids[:-1] >= 0) & (ids[1:] >= 0)
        codes, counts = count_tiles(pair_codes(ids[:-1][both], ids[1:][both]))
        group = (B.mix((codes >> 16).astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        codes, counts, group = codes[order], counts[order], group[order]
        cut = np.flatnonzero(np.diff(group, prepend=-1, append=groups))
        for s, e in zip(cut, cut[1:]):
            yield group[s], pack(codes[s:e], counts[s:e])

    return _by_group(state, "ids", split)


def _tree(blobs: DataFrame, units: int, merge) -> DataFrame:
    """Blobs of a group merged until at most FAN are left."""

    def fn(key, table):
        return B.table_of([(key[0].as_py(), key[1].as_py(), key[2].as_py(), merge(table.column("blob").to_pylist()))], _BLOB)

    while units > FAN:
        units = math.ceil(units / FAN)
        blobs = blobs.withColumn("unit", F.pmod(F.xxhash64("unit", F.lit(units)), F.lit(units))).groupBy("lang", "grp", "unit").applyInArrow(fn, BLOB)
    return blobs


def frequent_words(blobs: DataFrame, units: int, min_count: int) -> DataFrame:
    """(lang, grp, word, f) of words with f >= ``min_count``."""

    def merge(blobs):
        words, counts = _merged_words(blobs)
        return pack_words(words, np.zeros(len(words), np.int64), counts)

    def reduce(key, table):
        words, counts = _merged_words(table.column("blob").to_pylist())
        often = np.flatnonzero(counts >= min_count)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(often), pa.string()), "grp": pa.array([key[1].as_py()] * len(often), pa.int32()),
                         "word": words.take(pa.array(often)).cast(pa.string()), "f": pa.array(counts[often], pa.int64())})

    return _tree(blobs, units, merge).groupBy("lang", "grp").applyInArrow(reduce, "lang string, grp int, word string, f long")


def frequent_pairs(blobs: DataFrame, units: int, min_count: int) -> DataFrame:
    """(lang, grp, i, j, f) of pairs with f >= ``min_count``."""

    def reduce(key, table):
        codes, counts = _merged(table.column("blob").to_pylist())
        often = counts >= min_count
        i, j = pair_ids(codes[often])
        return pa.table({"lang": pa.array([key[0].as_py()] * len(i), pa.string()), "grp": pa.array([key[1].as_py()] * len(i), pa.int32()),
                         "i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "f": pa.array(counts[often], pa.int64())})

    return _tree(blobs, units, lambda blobs: pack(*_merged(blobs))).groupBy("lang", "grp").applyInArrow(reduce, "lang string, grp int, i long, j long, f long")


def _renewed(state: DataFrame, blobs: DataFrame, known: DataFrame, cols: list[str], units: int, find, renew) -> DataFrame:
    """(unit, lang, ids): groups tell each unit the ids of what it sent (``find``), and units apply them (``renew``)."""
    salts = math.ceil(units / FAN)

    def answer(key, mine, known):
        rows = []
        if len(mine) and len(known):
            look = find(known)
            for unit, blob in zip(mine.column("unit").to_pylist(), mine.column("blob").to_pylist()):
                codes, ids = look(blob)
                if len(codes):
                    rows.append((key[0].as_py(), key[1].as_py(), unit, _squeeze(codes.astype("<i8"), ids.astype("<i8"))))
        return B.table_of(rows, _BLOB)

    def apply(key, mine, told):
        rows = []
        if len(mine) and len(told):
            codes, ids = (np.concatenate(x) for x in zip(*(_unsqueeze(b, "<i8", "<i8") for b in told.column("blob").to_pylist())))
            order = np.argsort(codes)
            rows = [(key[0].as_py(), lang, _ints(renew(_ints_of(raw), codes[order], ids[order])))
                    for lang, raw in zip(mine.column("lang").to_pylist(), mine.column("ids").to_pylist())]
        return B.table_of(rows, _STATE)

    salt = F.pmod(F.xxhash64("unit", F.lit(7)), F.lit(salts)).cast("int")
    copies = known.select("lang", "grp", *cols, "id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    told = blobs.withColumn("salt", salt).groupBy("lang", "grp", "salt").cogroup(copies.groupBy("lang", "grp", "salt")).applyInArrow(answer, BLOB)
    return state.select("unit", "lang", "ids").groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(apply, "unit long, lang string, ids binary")


def _at(codes: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each is among sorted ``codes``, where)."""
    at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
    return codes[at] == asked, at


def word_ids(units: DataFrame, blobs: DataFrame, words: DataFrame, n_units: int) -> DataFrame:
    """The units with ranks for codes, -1 for rare words."""

    def find(known):
        import pyarrow.compute as pc

        values, ids = known.column("word").combine_chunks().cast(pa.binary()), known.column("id").to_numpy()

        def look(blob):
            asked, codes, _ = unpack_words(blob)
            at = pc.index_in(asked, value_set=values)
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            return codes[hit], ids[at.drop_null().to_numpy()]

        return look

    def renew(old, codes, ids):
        table = np.full(int(max(old.max(initial=0), codes.max())) + 2, -1, np.int64)
        table[codes] = ids
        return table[old]  # code -1: the last entry

    return _renewed(units, blobs, words, ["word"], n_units, find, renew)


def pair_state(state: DataFrame, blobs: DataFrame, pairs: DataFrame, n_units: int) -> DataFrame:
    """The units with the id of the pair that starts at each position, -1 where none does; units without any go."""

    def find(known):
        codes = pair_codes(known.column("i").to_numpy(), known.column("j").to_numpy())
        order = np.argsort(codes)
        codes, ids = codes[order], known.column("id").to_numpy()[order]

        def look(blob):
            asked, _ = unpack(blob)
            hit, at = _at(codes, asked)
            return asked[hit], ids[at[hit]]

        return look

    def renew(old, codes, ids):
        both = np.flatnonzero((old[:-1] >= 0) & (old[1:] >= 0))
        hit, at = _at(codes, pair_codes(old[both], old[both + 1]))
        new = np.full(len(old), -1, np.int64)
        new[both[hit]] = ids[at[hit]]
        return new

    return _renewed(state, blobs, pairs, ["i", "j"], n_units, find, renew)


def ranked(counts: DataFrame, ties: list[str]) -> DataFrame:
    """Add ``id``: rank by f inside the language, from 0."""
    return dense_position(counts, ["lang"], [F.col("f").desc(), *ties], -F.col("f"), "id")


# ---- phrases ----

def _part(rows: DataFrame, parts: DataFrame, on: str, cols: dict[str, Column]) -> DataFrame:
    """``rows`` with columns of the part whose id is ``on``; low ranks, which stand in very many phrases, by salt."""
    salt = F.when(F.col(on) < HOT_RANK, F.pmod(F.xxhash64("i", "j"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    copies = F.when(F.col("id") < HOT_RANK, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    small = parts.select("lang", F.col("id").alias(on), *[c.alias(k) for k, c in cols.items()], F.explode(copies).alias("_salt"))
    return rows.withColumn("_salt", salt).join(small, ["lang", on, "_salt"]).drop("_salt")


def grown(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(lang, id, i, j, f, words, lf, rf): lf / rf are the counts of the phrase's first / last 1, 2, ... words."""
    first = _part(pairs, parts, "i", {"words_i": F.col("words"), "lf": F.concat("lf", F.array("f"))})
    both = _part(first, parts, "j", {"words_j": F.slice("words", -1, 1), "rf": F.concat("rf", F.array("f"))})
    return both.select("lang", "id", "i", "j", "f", F.concat("words_i", "words_j").alias("words"), "lf", "rf")


def uncovered(phrases: DataFrame, longer: DataFrame) -> DataFrame:
    """Phrases that stand in no longer one of the same count."""
    cover = longer.select("lang", F.explode(F.array("i", "j")).alias("id"), F.col("f").alias("top")).groupBy("lang", "id").agg(F.max("top").alias("top"))
    return phrases.join(cover, ["lang", "id"], "left").filter(F.col("top").isNull() | (F.col("top") < F.col("f"))).drop("top")


def scored(phrases: DataFrame, totals: DataFrame, words: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) at the lowest-scoring cut; ties go to the shortest first part."""
    big = lambda c: c.cast("decimal(18,0)")
    a, n = big(F.col("f")), big(F.col("n"))

    rows = phrases.join(totals, "lang").withColumns({"_a": a, "_n": n, "_t": F.lit(1000).cast("decimal(4,0)")})
    cuts = []
    for k in range(1, words):
        rows = rows.withColumns({"_l": big(F.col("lf")[k - 1]), "_r": big(F.col("rf")[words - k - 1])})
        rows = rows.withColumn(f"_s{k}", F.expr("(_a * _n * _t) div (_l * _r)"))
        cuts.append(F.struct(F.col(f"_s{k}").alias("score"), F.lit(k).alias("k"), F.col("lf")[k - 1].alias("l"), F.col("rf")[words - k - 1].alias("r")))
    best = F.array_min(F.array(*cuts))
    return rows.withColumn("_b", best).select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.col("_b.l").alias("l"),
                                              F.col("_b.r").alias("r"), "n", F.col("_b.score").alias("score"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, lang_col: str = "lang",
                 text_col: str = "text") -> DataFrame:
    """The first ``top`` phrases of each language by score, count (both descending) and phrase (bytes ascending):
    lang, rank (from 1), phrase, a, l, r, n, score."""
    store = Store(docs.sparkSession)
    units = store(units_of(docs, lang_col, text_col), "units")
    n_units = max(1, units.count())
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_units * UNIT_BYTES // B.BUCKET_BYTES)
    sent = store(word_blobs(units, groups), "words-sent")
    words = store(ranked(frequent_words(sent, n_units, min_count), ["word"]), "words")
    totals = store(units.select("lang", "n").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    state = store(word_ids(units, sent, words, n_units), "ids-1")
    none = F.array().cast("array<bigint>")
    parts = words.select("lang", "id", "f", F.array("word").alias("words"), none.alias("lf"), none.alias("rf"))
    found = []
    for k in range(2, max_words + 1):
        blobs = store(pair_blobs(state, groups), f"pairs-{k}")
        pairs = store(ranked(frequent_pairs(blobs, n_units, min_count), ["i", "j"]), f"ranked-{k}")
        if k < max_words:
            state = store(pair_state(state, blobs, pairs, n_units), f"ids-{k}")
        parts = store(grown(pairs, parts), f"phrases-{k}")
        found.append(parts)
    out = None
    for k, phrases in enumerate(found, 2):
        kept = scored(uncovered(phrases, found[k - 1]) if k < max_words else phrases, totals, k)
        out = kept if out is None else out.unionByName(kept)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS s
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
g AS (
  SELECT lang, k, array_to_string(s[i:i + k - 1], ' ') AS p, count(*) AS f
  FROM (SELECT lang, s, k, unnest(range(1, len(s) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k)) GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM g WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, p, f, string_split(p, ' ') AS s FROM g WHERE k >= 2 AND f >= 100),
cover AS (
  SELECT lang, array_to_string(s[i:i + m - 1], ' ') AS p, max(f) AS f
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, x.f AS l, y.f AS r, n.n, c.cut, (1000::HUGEINT * c.f * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
  JOIN g x ON x.lang = c.lang AND x.p = array_to_string(c.s[1:c.cut], ' ')
  JOIN g y ON y.lang = c.lang AND y.p = array_to_string(c.s[c.cut + 1:c.k], ' ')
  JOIN n ON n.lang = c.lang
  LEFT JOIN cover o ON o.lang = c.lang AND o.p = c.p WHERE o.f IS NULL OR 100 * o.f < 100 * c.f),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM top WHERE rank <= 2000
"""


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
