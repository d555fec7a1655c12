"""Operator 12 - trie of conversation prefixes, by whole-sequence collapse.

1. Turns are reduced to a digest of (role, text) and a word count before any exchange; texts never travel.
2. Conversations are rebuilt (the first turns may come from the first conversation of their group of 20)
   and each turn gets the fingerprint of the prefix that it ends: four sums of 32 bits of a SHA-256 of (depth, turn
   digest) over the prefix, so a prefix is a running sum and no prefix is ever materialised.
3. Identical conversations collapse to one weighted sequence with its smallest conversation as representative
   and a list of all that end there; only representatives go on.
4. A sequence that is a proper prefix of another is dropped by an anti-join: the rest are the leaves.
5. Weighted prefixes are aggregated to nodes: members, smallest member, leaves below.

Saved tokens of a subtree: every node is owned by the smallest leaf below it, so a leaf owns the lower
end of its path. A subtree's sum is the sum of what its leaves own, less what the owner of its top
owns above - one running sum and one aggregate, linear in the turns of leaves (no pairs of node and ancestor).

Hot keys: all aggregates combine on the map side. A long conversation is numbered, summed and joined by (conversation,
block of ``BLOCK`` turns); a node with very many children gets its id to them over ``SALTS`` salted copies.
A list of ends is hashed in pieces of 65,536 consecutive ids; the pieces of one list are joined in a
stream of bounded memory.

Null conv_id: no conversation, left out. Null turn comes first; equal turns are ordered by the SHA-256 of
``length(role):role text`` (repeated rows are turns of their own). Null role or text is empty. No conversations: no
nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import dense_position
from ..session import cut_lineage
from . import blocks as B

GROUP, HEADS = 20, 4
BLOCK = 1 << 16
HOT_CHILDREN, SALTS = 4096, 64
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "k1", "k2"]


def _blocks(convs: DataFrame, length: str, **cols: Column) -> DataFrame:
    """A row for each block of a conversation's positions: joins by (conv, blk) have no hot key."""
    last = F.shiftright(F.col(length), 16).cast("int")
    return convs.select("conv", F.explode(F.sequence(F.lit(0), last)).alias("blk"), *[c.alias(k) for k, c in cols.items()])


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, pos, digest, words): the numbered turns, position from 0."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    bucket = F.coalesce(F.shiftright("turn", 12), F.lit(-(1 << 62)))
    return dense_position(turns, ["conv"], [F.col("turn").asc_nulls_first(), F.col("digest")], bucket, "pos").select("conv", "pos", "digest", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, len) of every conversation; (conv, len, depth, digest, words) of its rebuilt turns and, at depth 0, its root."""
    turns = cut_lineage(turns_of(conversations))
    count = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = count.select("conv", "n", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS)).alias("h"),
                         (F.col("conv") - F.col("conv") % GROUP).alias("base"))
    first = count.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(first, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = cut_lineage(convs.withColumn("len", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    heads = turns.filter((F.col("pos") < HEADS - 1) & (F.col("conv") % GROUP == 0)).withColumnRenamed("conv", "base")
    shared = convs.filter("m > 0").join(heads, "base").filter("pos < m").select("conv", "len", (F.col("pos") + 1).alias("depth"), "digest", "words")
    own = turns.withColumn("blk", F.shiftright("pos", 16)).join(_blocks(convs, "n", len=F.col("len"), h=F.col("h"), m=F.col("m")), ["conv", "blk"])
    own = own.filter("pos >= h").select("conv", "len", (F.col("m") + F.col("pos") - F.col("h") + 1).alias("depth"), "digest", "words")
    root = convs.select("conv", "len", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("words"))
    return convs.select("conv", "len"), root.unionByName(shared).unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, len, depth, words, k1, k2, p1, p2): each rebuilt turn with the keys of its prefix and of the prefix before."""
    sha = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "digest"), 256)
    turns = turns.withColumn("e", sha)
    parts = {f"s{i}": F.coalesce(F.conv(F.substring("e", 8 * i + 1, 8), 16, 10).cast("long"), F.lit(0).cast("long")) for i in range(4)}
    summed = dense_position(turns, ["conv"], ["depth"], F.shiftright("depth", 16), "_at", parts)
    before = [F.col(k) for k in parts]
    upto = [F.col(k) + v for k, v in parts.items()]
    depth = F.col("depth")
    key = lambda sums, d, salt: F.xxhash64(F.lit(salt), *sums, d.cast("long"))
    return summed.select("conv", "len", "depth", "words", key(upto, depth, 1).alias("k1"), key(upto, depth, 2).alias("k2"),
                         key(before, depth - 1, 1).alias("p1"), key(before, depth - 1, 2).alias("p2"))


def end_lists(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the sequences that conversations ``ends`` (conv, depth, k1, k2) end in."""
    ids = F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))
    pieces = ends.groupBy(*NODE, F.shiftright("conv", 16).alias("piece")).agg(F.array_join(ids, ",").alias("ids"))
    pieces = cut_lineage(pieces)
    many = pieces.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"), F.min("ids").alias("ids"))
    one = many.filter("n = 1").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))

    def stream(batches):
        """Rows of a partition, ordered by list and piece: one running hash at a time."""
        last, sha = None, None
        for batch in batches:
            rows = []
            for key in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key[:3] != last:
                    if last is not None:
                        rows.append((*last, sha.hexdigest()))
                    last, sha = key[:3], hashlib.sha256(key[3].encode())
                else:
                    sha.update(b"," + key[3].encode())
            if rows:
                yield B.table_of(rows, schema).to_batches()[0]
        if last is not None:
            yield B.table_of([(*last, sha.hexdigest())], schema).to_batches()[0]

    schema = [("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())]
    rest = pieces.join(many.filter("n > 1").select(*NODE), NODE).repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids")
    return one.unionByName(rest.mapInArrow(stream, "depth long, k1 long, k2 long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per trie node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(conversations)
    rows = cut_lineage(prefixes(turns))
    ends = rows.filter("depth = len").select("conv", *NODE)
    sequences = ends.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("weight"))
    proper = rows.filter("depth < len").select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select("conv", F.lit(1).alias("leaf"))
    kept = cut_lineage(sequences.join(leaves, "conv", "left").select("conv", "weight", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.col("depth").alias("len")))

    blocked = rows.drop("len").withColumn("blk", F.shiftright("depth", 16))
    paths = blocked.join(_blocks(kept, "len", weight=F.col("weight"), leaf=F.col("leaf")), ["conv", "blk"])
    nodes = cut_lineage(paths.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").cast("long").alias("n_leaves"),
        F.min(F.when(F.col("leaf") == 1, F.col("conv"))).alias("owner"), F.max("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2")))

    # what each leaf owns, and what it owns above a node
    owned = nodes.select("owner", *NODE, ((F.col("n_convs") - 1) * F.col("words")).alias("w"))
    above = dense_position(owned, ["owner"], ["depth"], F.shiftright("depth", 16), "_at", {"above": F.col("w")}).select(*NODE, "above")
    totals = _blocks(kept.filter("leaf = 1").join(owned.groupBy(F.col("owner").alias("conv")).agg(F.sum("w").alias("t")), "conv"), "len", t=F.col("t"))
    below = blocked.join(totals, ["conv", "blk"]).groupBy(*NODE).agg(F.sum("t").alias("t"))

    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(above, NODE).join(below, NODE).join(children, NODE, "left").join(end_lists(ends), NODE, "left")
    full = cut_lineage(full.select(
        *NODE, "p1", "p2", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        (F.col("t") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))

    # the parent's id: over salted copies where it has very many children
    tops = full.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                                                F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = tops.filter(F.col("n_children") >= HOT_CHILDREN).drop("n_children").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = full.withColumn("salt", F.pmod(F.xxhash64("k1", "k2"), F.lit(SALTS)).cast("int")).join(hot, ["depth", "p1", "p2", "salt"], "left")
    cold = salted.filter("parent_conv_id is null").drop("parent_conv_id").join(
        tops.filter(F.col("n_children") < HOT_CHILDREN).drop("n_children"), ["depth", "p1", "p2"], "left")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return salted.filter("parent_conv_id is not null").select(*out).unionByName(cold.select(*out))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY i) AS s,
         list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
           lambda ch: [unicode(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS crc
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.s[1:xor(c.crc, 4294967295) % 4], []), c.s[xor(c.crc, 4294967295) % 4 + 1:]) AS s
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS prefix FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
nodes AS (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(prefix[d].x, '[^\x20\x09-\x0D]+')) END AS w
  FROM p GROUP BY d, prefix),
children AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
subtree AS (
  SELECT top, u.prefix[1:top] AS prefix, sum(u.w) AS saved, count(*) FILTER (k.n IS NULL) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS top FROM nodes) u LEFT JOIN children k ON k.d = u.d AND k.prefix = u.prefix GROUP BY 1, 2)
SELECT v.conv_id::BIGINT AS conv_id, v.d::BIGINT AS depth, up.conv_id::BIGINT AS parent_conv_id, v.n_convs::BIGINT AS n_convs,
       coalesce(k.n, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM nodes v LEFT JOIN children k ON k.d = v.d AND k.prefix = v.prefix
JOIN subtree s ON s.top = v.d AND s.prefix = v.prefix
LEFT JOIN nodes up ON up.d = v.d - 1 AND up.prefix = v.prefix[1:v.d - 1]
"""


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
