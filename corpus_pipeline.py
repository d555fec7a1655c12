"""Training-data pipeline over ``documents``: STAGES run in order, each on what the last kept.

1. toxicity - drops documents that the ordinal model calls toxic (operator 2);
2. line_dedup - drops boilerplate lines by source (operator 4);
3. near_duplicates - keeps the smallest id of each group of documents whose 5-word shingle
   sets are linked by a Jaccard similarity of 0.8 or more (operator 10);
4. decontamination - drops documents that overlap a benchmark item (operator 9);
5. packing - token pieces placed in sequences (operator 6).

All but the last return the columns of ``documents`` (any further ones pass through);
``n_chars`` follows the text where lines went. Nulls, empty texts, ties and repeated rows
follow the operators' rules; ids need not be unique, and of a group's rows with equal ids the
one with the smallest text hash stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm.decontamination import decontaminate
from roadlens.llm.jaccard_join import BROADCAST_IDS, jaccard_join
from roadlens.llm.line_dedup import drop_boilerplate, free_name
from roadlens.llm.packing import best_fit_packing
from roadlens.llm.toxicity import severity, train
from roadlens.session import cut_lineage, ensure_checkpoint_dir


#: words that a worker remembers while packing: fewer than alone, for workers keep memory over all stages
MEMO_WORDS = 50_000
#: seed of the second hash of a row
SECOND_HASH = 40961


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(~severity(model)(F.col("text"))["toxic"])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(docs, "source", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(free_name("_dropped", docs.columns)) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document without words is linked with nothing and stays.

    Rows are linked and dropped by a key of their own, from two hashes of all columns, so ids may be
    null or repeat. Equal rows share a key and stand once in the join; one of them stays.
    """
    key, rank, again = (free_name(n, docs.columns) for n in ("_row_key", "_rank", "_again"))
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]  # maps have no hash
    keyed, twice = _keyed(docs.withColumn(key, F.xxhash64(*plain)).withColumn(again, F.xxhash64(F.lit(SECOND_HASH), *plain[::-1])), key, again)
    repeats = not twice.isEmpty()

    def once(rows: DataFrame, keys: DataFrame) -> DataFrame:
        """``rows`` with one row for each of ``keys``."""
        keys = _small(keys)
        return rows.join(keys, key, "left_anti").unionByName(rows.join(keys, key, "left_semi").dropDuplicates([key]))

    single = once(keyed, twice) if repeats else keyed
    groups = jaccard_join(single.select(key, "text"), id_col=key).withColumnRenamed("doc_id", key)
    worded = cut_lineage(groups.filter("n_shingles > 0").select(key, "component_id"))
    # of a group the row with the smallest id stays, then the one with the smallest text hash
    named = worded.join(single.select(key, F.struct("doc_id", F.xxhash64("text").alias("text"), F.col(key).alias("key")).alias(rank)), key)
    first = named.groupBy("component_id").agg(F.min(rank)["key"].alias(key)).select(key)
    gone = cut_lineage(worded.join(first, key, "left_anti").select(key))
    left = keyed.join(_small(gone), key, "left_anti")
    if repeats:
        left = once(left, cut_lineage(twice.join(worded, key, "left_semi")))
    return left.select(*docs.columns)


def _keyed(rows: DataFrame, key: str, again: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` without ``again``, different ones under different keys, and the keys that several equal rows have.

    Rows are equal if both hashes are (128 bits). Different rows of one ``key`` are told apart by ``again``."""
    many = cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(again).alias("_lo"), F.max(again).alias("_hi")).filter("_n > 1"))
    clash = many.filter("_lo <> _hi").select(key)
    if not clash.isEmpty():
        hit = _small(clash.withColumn("_hit", F.lit(True)))
        rows = rows.join(hit, key, "left").withColumn(key, F.when(F.col("_hit"), F.xxhash64(again, key)).otherwise(F.col(key))).drop("_hit")
        many = cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    return rows.drop(again), many.select(key)


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs, memo_words=MEMO_WORDS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No SQL: the stages fit a model, tokenize and pack; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{k}-{name}")
            docs = spark.read.parquet(f"{place}/{k}-{name}")
    return docs
