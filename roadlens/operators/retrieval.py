"""Situation retrieval and the document store.

Scale shape: retrieval searches the whole store. Queries are a stated set; blocks of them meet blocks
of the store in cells of bounded size, and each cell keeps its best k per query before the
next exchange (``operators.cells``). Admission (R5) alone has a capacity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..plans.blocks import over_blocks
from ..plans.ordering import dense_position
from .cells import best_pairs

# ---- fixed values (must equal the studied code base) -------------------------
INTERMEDIATE_K = 30
FINAL_K = 5
STORE_LIMIT = 100
LOGIC_WEIGHT = 0.5
SCENARIO_SCALE = 5.0
# ------------------------------------------------------------------------------

def admit(docs: DataFrame, doc_id: str, score: str, arrival: str, max_size: int = STORE_LIMIT) -> DataFrame:
    """R5 (batch ruling): the store fills in arrival order, then a newcomer replaces the
    worst-scored document only when strictly better; over a batch this converges to the
    ``max_size`` best scores, ties kept by earlier arrival. The limit is the store
    capacity (the operator's semantics), a TakeOrdered of bounded size."""
    return docs.orderBy(F.col(score).desc(), F.col(arrival).asc(), F.col(doc_id).asc()).limit(max_size)


def top_k(queries: DataFrame, qid: str, qvec: str, store: DataFrame, did: str, dvec: str, k: int) -> DataFrame:
    """R2: cosine top-k per query over the whole store, best first, ties by document id;
    empty store -> empty. Vectors are normalised once a side, so a pair costs one dot
    product; each cell of queries and documents keeps its best per query (``operators.cells``)."""
    st = store.select(F.col(did).alias("doc_id"), vx.unit(vx.as_double(dvec)).alias("_dv"))
    q = queries.select(F.col(qid).alias("query_id"), vx.unit(vx.as_double(qvec)).alias("_qv"))
    pairs = best_pairs(q, st, k)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def two_stage(queries: DataFrame, qid: str, qvec: str, qstate: str, store: DataFrame, did: str, dvec: str, dstate: str,
              k1: int = INTERMEDIATE_K, k2: int = FINAL_K, order: str = "nearest") -> DataFrame:
    """Top ``k1`` of the whole store by cosine of the text vectors, then ``k2`` of those
    by squared L2 of the state vectors; ``order='nearest'`` (ruling Q2) or ``'reference'``
    (the source's farthest-first slice). k capped by the store size."""
    st = store.select(F.col(did).alias("doc_id"), vx.unit(vx.as_double(dvec)).alias("_dv"), vx.as_double(dstate).alias("_ds"))
    q = queries.select(F.col(qid).alias("query_id"), vx.unit(vx.as_double(qvec)).alias("_qv"), vx.as_double(qstate).alias("_qs"))
    pairs = best_pairs(q, st, k1).withColumnRenamed("score", "text_score")
    w1 = Window.partitionBy("query_id").orderBy(F.col("text_score").desc(), F.col("doc_id"))
    s1 = pairs.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k1)
    diff = F.zip_with("_qs", "_ds", lambda a, b: a - b)
    s1 = s1.withColumn("state_l2", vx.dot(diff, diff))
    key = F.col("state_l2").asc() if order == "nearest" else F.col("state_l2").desc()
    w2 = Window.partitionBy("query_id").orderBy(key, F.col("doc_id"))
    s2 = s1.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k2)
    return s2.select("query_id", "rank", "doc_id", "text_score", "state_l2")


def nearest_of_found(windows: DataFrame, key: str, query: str, found: DataFrame, did: str, state: list[str], k: int = FINAL_K) -> DataFrame:
    """R3's second stage for windows that share queries: of the documents found for a window's query, the ``k`` nearest to its own
    state by squared L2, ties by document id. ``windows``: (``key``, ``query``, ``state``); ``found``: (``query``, ``did``, ``state`` of the
    document), a bounded list a query. Returns (``key``, rank, ``did``, ``state`` of the document).

    A window meets its query's list as one row and keeps ``k`` of it, so the pairs of windows and documents are not
    exchanged; rows that repeat a key are ranked together, from their own ``k`` each."""
    lists = found.groupBy(query).agg(F.collect_list(F.struct(F.col(did).alias("doc"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(state)])).alias("_list"))
    apart = lambda x: sum((F.col(c) - x[f"s{i}"]) * (F.col(c) - x[f"s{i}"]) for i, c in enumerate(state))
    scored = F.transform("_list", lambda x: F.struct(apart(x).alias("l2"), *[x[f] for f in ("doc", *(f"s{i}" for i in range(len(state))))]))
    best = windows.join(lists, query).select(key, F.explode(F.slice(F.sort_array(scored), 1, k)).alias("_b"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_b.l2", "_b.doc"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select(key, "rank", F.col("_b.doc").alias(did), *[F.col(f"_b.s{i}").alias(c) for i, c in enumerate(state)])


def index_fields(docs: DataFrame, doc_id: str, fields: list[str]) -> DataFrame:
    """Long embedding index (doc_id, field, vec) - one row per text field, vector
    from the numeric embedding (F5); a model UDF can replace ``numeric_embedding``."""
    long = docs.select(doc_id, *fields).unpivot([doc_id], fields, "field", "text")
    return long.select(doc_id, "field", tx.numeric_embedding("text").alias("vec"))


def chunk_positions(df: DataFrame, keys: list[str], pos: str, value: str, boundaries: list[int]) -> DataFrame:
    """L1: chunks by boundary positions; the column's min / max are added when missing;
    rows ``[b_i, b_{i+1})`` by sorted position (so the last row is dropped, ruling Q5)."""
    stats = df.groupBy(*keys).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    b = F.array(*[F.lit(int(x)) for x in boundaries]).cast("array<long>")
    bounds = F.concat(
        F.when(F.lit(int(boundaries[0])) != F.col("_mn"), F.array(F.col("_mn").cast("long"))).otherwise(F.array().cast("array<long>")),
        b,
        F.when(F.lit(int(boundaries[-1])) != F.col("_mx"), F.array(F.col("_mx").cast("long"))).otherwise(F.array().cast("array<long>")),
    )
    x = df.join(stats.withColumn("_b", bounds).select(*keys, "_b"), on=keys, how="inner")
    p = F.col(pos)
    x = x.withColumn("chunk", F.size(F.filter("_b", lambda v: v <= p)) - 1)
    return x.filter((F.col("chunk") >= 0) & (p < F.element_at("_b", -1))).drop("_b")


def sliding_windows(df: DataFrame, keys: list[str], seq: str, cols: list[str], w: int) -> DataFrame:
    """L2: every full window of ``w`` rows, stride 1 (n - w + 1 per key), as one row per
    window holding the rows in order (bounded frame of w rows over blocks)."""
    x = over_blocks(df, keys, seq, 0, w - 1, lambda win: {
        "rows": F.collect_list(F.struct(*[F.col(c) for c in cols])).over(win.rowsBetween(0, w - 1))})
    return x.filter(F.size("rows") == w).select(*keys, F.col(seq).alias("start"), "rows")


def future_rows(df: DataFrame, windows: DataFrame, keys: list[str], seq: str, cols: list[str], seen: int, w: int) -> DataFrame:
    """For the windows named by (keys, ``start``), the last ``w - seen`` of their ``w`` rows as arrays ``t_{col}``; windows that are
    not full are left out. Only the rows that some named window needs meet it, by an equi-join on (keys, seq): the log is
    neither windowed nor copied. ``seq`` must be dense."""
    steps = list(range(seen, w))
    need = windows.distinct().select(*keys, "start", F.explode(F.array(*[F.lit(k) for k in steps])).alias("_k")).withColumn(seq, F.col("start") + F.col("_k"))
    met = df.select(*keys, seq, *cols).join(need, [*keys, seq])
    at = lambda c: F.array(*[F.max(F.when(F.col("_k") == k, F.col(c))) for k in steps]).alias(f"t_{c}")
    return met.groupBy(*keys, "start").agg(F.count(F.lit(1)).alias("_n"), *[at(c) for c in cols]).filter(F.col("_n") == len(steps)).drop("_n")


def seeded_order(key: Column, seed: int) -> Column:
    """Seeded pseudo-random order used by L3/L4 and P9 (reproducible in SQL: integer hash). Exact for any 64-bit key: the
    product passes 64 bits."""
    prime = 4294967291
    return F.pmod(F.pmod(key.cast("long"), F.lit(prime)).cast("decimal(38,0)") * 2654435761 + seed * 97, F.lit(prime)).cast("long")


#: items of a group that may be masked one by one: its prompts hold the square of that
MASK_ITEMS = 10_000


def masked_items(groups: DataFrame, key: str, pos: str, item: str, mask: str = "[MASK]", max_items: int = MASK_ITEMS) -> DataFrame:
    """For each item of a group, the group's items with that one masked (others kept).

    n prompts of n items each: the output grows with the square of a group, so a group of more than ``max_items`` is refused
    (counted first, on the map side), not cut, and no task gathers more than that."""
    largest = groups.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if largest > max_items:
        raise ValueError(f"a group has {largest} items; at most {max_items} can be masked one by one")
    g = groups.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(item).alias("v")))).alias("_it"))
    g = g.select(key, F.transform("_it", lambda s: s["v"]).alias("_items"))
    x = g.select(key, "_items", F.posexplode("_items").alias("masked_pos", "hint"))
    prompt = F.array_join(F.transform("_items", lambda v, i: F.when(i == F.col("masked_pos"), F.lit(mask)).otherwise(v)), "\n")
    return x.select(key, "masked_pos", prompt.alias("prompt"), "hint")


def nearest_by_distance(queries: DataFrame, qid: str, qvec: str, store: DataFrame, did: str, dvec: str, k: int) -> DataFrame:
    """F22 / R2 with the negative L2 distance as the score: the ``k`` greatest per query over the whole store, ties by document id."""
    st = store.select(F.col(did).alias("doc_id"), vx.as_double(dvec).alias("_dv"))
    q = queries.select(F.col(qid).alias("query_id"), vx.as_double(qvec).alias("_qv"))
    pairs = best_pairs(q, st, k, distance=True)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def scenario_score(judge_text: Column, tag: str = "score") -> Column:
    """The judge's integer score as a share of its scale; null where the tag is missing or no integer."""
    return tx.extract_tag(judge_text, tag).try_cast("int") / SCENARIO_SCALE


def admission_score(logic: Column, scenario: Column, weight: float = LOGIC_WEIGHT) -> Column:
    """Weighted mean of logic and scenario score; null if either is."""
    return weight * logic + (1 - weight) * scenario


def window_records(windows: DataFrame, key: str, state: list[str], retrieved: DataFrame, response: str, first_cols: dict[str, str]) -> DataFrame:
    """The record of each window. ``windows``: one row each with its first row's columns and the model's ``response``;
    ``retrieved``: (``key``, rank, doc_id) and the documents' ``state`` columns.

    Returns ``key``; ``situation`` and ``documents`` as the prompt has them; action_explanation and situation_analysis (tags task1, task2);
    ``action``, the numbers of task1's action tag (null if any is bad); ``first_cols`` renamed; ``retrieved_ids``, best first
    (empty for a window without documents)."""
    docs = retrieved.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", *state))).alias("_docs"))  # k of a window
    x = windows.join(docs, key, "left").withColumn("_docs", F.coalesce("_docs", F.array().cast(docs.schema["_docs"].dataType)))
    task1 = tx.extract_tag(F.col(response), "task1")
    return x.select(key, tx.kv_text([(c, F.col(c)) for c in state]).alias("situation"), tx.documents_text(F.col("_docs"), state).alias("documents"),
                    task1.alias("action_explanation"), tx.extract_tag(F.col(response), "task2").alias("situation_analysis"),
                    tx.extract_values(task1, "action").alias("action"), *[F.col(c).alias(n) for c, n in first_cols.items()],
                    F.transform("_docs", lambda d: d["doc_id"]).alias("retrieved_ids"))


def admit_batch(store: DataFrame, newcomers: DataFrame, retrieved: DataFrame, max_size: int) -> DataFrame:
    """What a batch of newcomers does to a store of at most ``max_size`` documents.

    ``store`` (doc_id, score), ``newcomers`` (new_id, arrival, score), ``retrieved`` (new_id, doc_id): the documents that each newcomer's
    window had retrieved. While there is room, newcomers are added as they arrive. Each other one aims at the worst-scored document it
    retrieved (ties: smallest id) and takes its place if its score is strictly higher; of several that aim at one document the
    best does (ties: the earlier). Returns (doc_id, score, origin, replaced_id), origin ``kept``, ``added`` or ``replaces``. Newcomers without
    a score or without retrieved documents of the store come in only while there is room. Only the store's size comes to the driver."""
    from ..plans.broadcast import maybe_broadcast

    room = max(0, max_size - store.count())
    added = newcomers.orderBy("arrival", "new_id").limit(room)
    rest = newcomers.join(maybe_broadcast(added.select("new_id"), room), "new_id", "left_anti")
    small = maybe_broadcast(store.select("doc_id", F.col("score").alias("_old")), max_size)
    aims = retrieved.join(small, "doc_id").groupBy("new_id").agg(F.min(F.struct("_old", "doc_id")).alias("_aim"))
    better = rest.join(aims, "new_id").filter(F.col("score") > F.col("_aim._old"))
    order = F.struct(F.col("score"), -F.col("arrival"), -F.col("new_id"))
    winners = better.groupBy(F.col("_aim.doc_id").alias("doc_id")).agg(F.max_by(F.struct("new_id", "score"), order).alias("_w"))
    x = store.join(winners, "doc_id", "left")
    won = F.col("_w").isNotNull()
    kept = x.select(F.when(won, F.col("_w.new_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(won, F.col("_w.score")).otherwise(F.col("score")).alias("score"),
                    F.when(won, "replaces").otherwise("kept").alias("origin"), F.when(won, F.col("doc_id")).alias("replaced_id"))
    return kept.unionByName(added.select(F.col("new_id").alias("doc_id"), "score", F.lit("added").alias("origin"), F.lit(None).cast("long").alias("replaced_id")))
