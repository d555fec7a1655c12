"""Operator 4 - boilerplate lines by site-relative frequency.

Within each host, the number of pages that hold a line (spaces at its ends aside, each
page once) is divided by the host's page total; a line whose share exceeds ``percent``
and that at least ``min_pages`` pages hold is boilerplate there and is dropped from the
host's pages. Blank lines always stay.

Lines are counted as 64-bit hashes with map-side aggregation. A host's boilerplate is
short whatever its size: shares sum to the mean number of distinct lines of a page, so
fewer than ``100 / percent`` times that mean can exceed the ratio. The lists (host,
hashes) are broadcast if their number of hashes is at most ``BROADCAST_LINES``; beyond, they
are joined by (host, salt), so a host with a third of all pages is ``SALTS`` keys.

Null text stays null and counts as a page without lines; a null host is a host of its
own. Rows with equal ids are pages of their own. Other columns pass through. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

PERCENT = 10
MIN_PAGES = 5
BROADCAST_LINES = 200_000
SALTS = 64


def free_name(name: str, taken) -> str:
    """``name``, with underscores added until no column of ``taken`` has it (names differ by more than case)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def _hash(line):
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, percent: int, min_pages: int) -> DataFrame:
    """(host, drop array<long>): hashes of each host's boilerplate lines."""
    lines = F.filter(F.split(text_col, "\n", -1), lambda x: F.trim(x) != "")
    hashes = pages.select(F.col(host_col).alias("host"), F.array_distinct(F.transform(lines, _hash)).alias("hs"))
    per_host = pages.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("pages"))
    held = hashes.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    per_host = per_host.withColumnRenamed("host", "site")
    often = held.join(per_host, F.col("host").eqNullSafe(F.col("site"))).filter(F.col("n") * 100 > F.col("pages") * percent)
    return often.groupBy("host").agg(F.sort_array(F.collect_set("h")).alias("drop"))


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", percent: int = PERCENT, min_pages: int = MIN_PAGES,
                     broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text_col``, plus _lines and _dropped (counts; with a further
    underscore where ``pages`` has such a column, see ``free_name``)."""
    host, drop, salt, spread_, kept_ = (free_name(n, pages.columns) for n in ("_host", "_drop", "_salt", "_spread", "_kept"))
    found = cut_lineage(boilerplate(pages, host_col, text_col, percent, min_pages)).toDF(host, drop)
    size = found.agg(F.coalesce(F.sum(F.size(drop) + 4), F.lit(0))).first()[0]
    same = F.col(host_col).eqNullSafe(F.col(host))
    if size <= broadcast_lines:
        joined = pages.join(F.broadcast(found), same, "left")
    else:
        salted = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = pages.withColumn(spread_, F.pmod(F.xxhash64(text_col), F.lit(SALTS)).cast("int"))
        joined = spread.join(salted, same & (F.col(spread_) == F.col(salt)), "left").drop(spread_, salt)
    lines = F.split(text_col, "\n", -1)
    kept = F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(drop, _hash(x))))
    out = joined.withColumn(kept_, kept)
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    return out.select(
        *(F.array_join(kept_, "\n").alias(c) if c == text_col else F.col(c) for c in pages.columns),
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n_lines).cast("long").alias(free_name("_lines", pages.columns)),
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n_lines - F.size(kept_)).cast("long").alias(free_name("_dropped", pages.columns)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "source", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), "text")


ORACLE_SQL = f"""
WITH page AS (SELECT row_number() OVER () AS page_no, doc_id, source, text FROM documents),
line AS (SELECT page_no, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM page),
held AS (SELECT source, trim(line, ' ') AS t, count(DISTINCT page_no) AS n FROM line WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
total AS (SELECT source, count(*) AS pages FROM page GROUP BY 1),
often AS (SELECT held.source, t FROM held JOIN total ON held.source IS NOT DISTINCT FROM total.source
          WHERE n >= {MIN_PAGES} AND n * 100 > pages * {PERCENT}),
marked AS (SELECT line.page_no, line, pos, often.t IS NOT NULL AS gone
           FROM line LEFT JOIN often ON line.source IS NOT DISTINCT FROM often.source AND trim(line.line, ' ') = often.t),
built AS (SELECT page_no, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                 coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY 1)
SELECT doc_id, source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN page.text IS NULL THEN NULL ELSE built.text END AS text
FROM page LEFT JOIN built USING (page_no)
"""
