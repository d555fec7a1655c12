"""Operator 7 - quality rules with robust multivariate outliers [native DataFrame code].

*Base statistics* of every whole text (words ``[^\\x20\\x09-\\x0D]+``): words, characters in
words, marks ``#*$%&|<>``, repeated lines and words inside repeated 8-word windows. The base
rule fails documents of under 20 words or with over 30 % repeated words.

*Outliers.* The others' statistics become the vector (log words, mean word length, square
roots of the shares of marks, repeated lines and repeated words). Per language and source
a minimum-covariance-determinant estimate is made, from three deterministic starts: medians with
median deviations; these with the correlations of squashed scores; mean and covariance of the half
nearest to the medians. From each, concentration steps - the ``SUBSET`` share of the group with the
smallest Mahalanobis distances gives the next mean and covariance - go on until no group's determinant
falls by more than ``TOLERANCE`` (or ``MAX_STEPS``), and every group takes the start that ends with the
smallest determinant. A consistency factor makes it right for normal data. ``FLOOR`` is added to each
standard deviation squared, for most clean texts agree on zero marks and repeats and a covariance of
zero would reject any deviation. Documents whose squared distance exceeds the ``KEEP`` quantile of
the chi-square distribution are rejected.

Distances and medians are taken from counts over bins of fixed width (whole bins go into
the subset), so nothing depends on how rows lie in partitions and a group of any size is
aggregated before the exchange. Group estimates are joined by broadcast up to
``BROADCAST_GROUPS`` groups and by (group, salt) beyond.

Groups under ``MIN_GROUP`` documents are pooled by language; a pool still smaller rejects
nothing. Null text: no words (base rule fails). A null language or source is a group of
its own. Repeated rows count each; extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SUBSET = 0.75
MAX_STEPS = 20
TOLERANCE = 1e-3
KEEP = 0.999
MIN_GROUP = 50
FLOOR = (0.15, 0.2, 0.08, 0.25, 0.25)
BROADCAST_GROUPS = 20_000
SALTS = 64
BIN = 64
#: rows of numbers that a task of a step should have at least, and groups whose bins one task takes
ROWS_A_TASK = 1 << 14
GROUPS_A_TASK = 1 << 8
SPACES = " \t\n\x0b\x0c\r"
MARKS = "#*$%&|<>"
DIM = 5


def _without(text: Column, chars: str, by: str = "") -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=("lang", "source")) -> DataFrame:
    """(doc_id, keep..., n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed)."""
    keep = list(keep)
    d = docs.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    bare = _without(F.col("t"), SPACES)
    d = d.select(
        "doc_id", *keep, bare.alias("bare"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^ \\x09-\\x0D]")).alias("lines"),
        F.transform(F.filter(F.split(_without(F.col("t"), SPACES[1:], " "), " ", -1), lambda x: x != ""), lambda x: F.xxhash64(x)).alias("w"))
    d = d.select(
        "doc_id", *keep, F.size("w").alias("n"), F.length("bare").alias("word_chars"), (F.length("bare") - F.length(_without(F.col("bare"), MARKS))).alias("n_symbols"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("w") >= 8, F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.xxhash64(F.slice(F.col("w"), i, F.lit(8)))))
        .otherwise(F.array().cast("array<bigint>")).alias("win"))
    rest = ["doc_id", *keep, "n", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    # window starts sorted by hash, only where a window repeats
    d = d.select(*rest, F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array(
        F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    same = lambda x, j: F.coalesce(F.get(F.col("s"), j)["h"] == x["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("s", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    d = d.select(*rest, starts.alias("p"))
    covered = F.aggregate(F.transform("p", lambda x, j: F.least(F.lit(8), F.coalesce(F.get(F.col("p"), j + 1) - x, F.lit(8)))), F.lit(0), lambda a, x: a + x)
    d = d.select("doc_id", *keep, F.col("n").cast("long").alias("n_words"), *(F.col(c).cast("long").alias(c) for c in rest[-4:]),
                 F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _vector() -> list[Column]:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [F.log1p(F.col("n_words").cast("double")), F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
            share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]


X = [f"x{i}" for i in range(DIM)]


def _few(rows: DataFrame, n: int, most: int = ROWS_A_TASK) -> DataFrame:
    """The same rows in no more partitions than ``n`` rows need, ``most`` a partition. A step's tables are small however many partitions the
    texts come in, and each partition of a step costs files in every exchange and checkpoint."""
    return rows.coalesce(max(1, -(-n // most)))


def _binned_quantile(rows: DataFrame, value: Column, q: float, by: list[str], name: str, n: int) -> DataFrame:
    """Upper edge of the bin that holds the q-quantile of each of about ``n`` groups."""
    bins = _few(rows.groupBy(*by, F.floor(value * BIN).alias("bin")).count(), n, GROUPS_A_TASK)
    run = Window.partitionBy(*by).orderBy("bin")
    total = Window.partitionBy(*by)
    return bins.withColumn("c", F.sum("count").over(run)).withColumn("m", F.sum("count").over(total)).filter(
        F.col("c") >= F.ceil(F.lit(q) * F.col("m"))).groupBy(*by).agg(((F.min("bin") + 1) / BIN).alias(name))


def _with_groups(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """Left join of group columns, without a task that holds a whole hot group."""
    if n <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), "g", "left")
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", *X), F.lit(SALTS)).cast("int")).join(salted, ["g", "_salt"], "left").drop("_salt")


def _cholesky(groups: DataFrame) -> DataFrame:
    """Adds the lower factor l_i_j of the covariance s_i_j."""
    for j in range(DIM):
        inner = [F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)]
        groups = groups.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(sum((-x for x in inner), F.col(f"s_{j}_{j}")), F.lit(FLOOR[j] ** 2 / 4))))
        for i in range(j + 1, DIM):
            dot = sum((-(F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")) for k in range(j)), F.col(f"s_{i}_{j}"))
            groups = groups.withColumn(f"l_{i}_{j}", dot / F.col(f"l_{j}_{j}"))
    return groups.select("g", *(f"m_{i}" for i in range(DIM)), *(f"l_{i}_{j}" for i in range(DIM) for j in range(i + 1)))


def _distance(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance to the row's group (null without one)."""
    out = _with_groups(rows, _cholesky(groups), n)
    for i in range(DIM):
        e = sum((-(F.col(f"l_{i}_{k}") * F.col(f"y_{k}")) for k in range(i)), F.col(X[i]) - F.col(f"m_{i}"))
        out = out.withColumn(f"y_{i}", e / F.col(f"l_{i}_{i}"))
    return out.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, DIM)), F.col("y_0") * F.col("y_0"))).select(*rows.columns, "d2")


def _chi2_cdf(x: float, odd: int) -> float:
    """Chi-square distribution function, odd degrees of freedom."""
    out = math.erf(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, odd, 2):
        out -= term
        term *= x / (k + 2)
    return out


def chi2_quantile(share: float, odd: int = DIM) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, odd) < share else (lo, mid)
    return lo


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest ``share`` right for normal data."""
    return share / _chi2_cdf(chi2_quantile(share), DIM + 2)


PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def _moments(rows: DataFrame, factor: float = 1.0) -> DataFrame:
    return rows.groupBy("g").agg(*(F.avg(X[i]).alias(f"m_{i}") for i in range(DIM)),
                                 *((factor * F.covar_pop(X[i], X[j]) + F.lit(FLOOR[i] ** 2 if i == j else 0.0)).alias(f"s_{i}_{j}") for i, j in PAIRS))


def starts(held: DataFrame, n: int) -> list[DataFrame]:
    """The three first estimates (g, m_i, s_i_j) of every group."""
    middle = None
    for i in range(DIM):
        part = _binned_quantile(held, F.col(X[i]), 0.5, ["g"], f"m_{i}", n)
        middle = part if middle is None else middle.join(part, "g")
    middle = cut_lineage(_few(middle, n))
    near, spread = _with_groups(held, middle, n), middle
    for i in range(DIM):
        spread = spread.join(_binned_quantile(near, F.abs(F.col(X[i]) - F.col(f"m_{i}")), 0.5, ["g"], f"d_{i}", n), "g")
    spread = cut_lineage(_few(spread, n).select("g", *(f"m_{i}" for i in range(DIM)), *((F.pow(1.4826 * F.col(f"d_{i}"), 2) + FLOOR[i] ** 2).alias(f"v_{i}") for i in range(DIM))))
    centre = [f"m_{i}" for i in range(DIM)]
    scored = _with_groups(held, spread, n).withColumns({f"z_{i}": (F.col(X[i]) - F.col(f"m_{i}")) / F.sqrt(f"v_{i}") for i in range(DIM)})
    zero = F.lit(0.0)
    plain = spread.select("g", *centre, *((F.col(f"v_{i}") if i == j else zero).alias(f"s_{i}_{j}") for i, j in PAIRS))
    squashed = scored.groupBy("g").agg(*(F.avg(F.tanh(f"z_{i}") * F.tanh(f"z_{j}")).alias(f"r_{i}_{j}") for i, j in PAIRS)).join(spread, "g")
    corr = lambda i, j: F.coalesce(F.try_divide(F.col(f"r_{i}_{j}"), F.sqrt(F.col(f"r_{i}_{i}") * F.col(f"r_{j}_{j}"))), zero)
    signed = squashed.select("g", *centre, *((F.col(f"v_{i}") if i == j else corr(i, j) * F.sqrt(F.col(f"v_{i}") * F.col(f"v_{j}"))).alias(f"s_{i}_{j}") for i, j in PAIRS))
    away = scored.withColumn("away", F.sqrt(sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, DIM)), F.col("z_0") * F.col("z_0"))))
    edge = _binned_quantile(away, F.col("away"), 0.5, ["g"], "edge", n)
    inner = _with_groups(away.select("doc_id", *X, "g", "away"), edge, n).filter(F.floor(F.col("away") * BIN) < F.round(F.col("edge") * BIN))
    return [cut_lineage(_few(x, n)) for x in (plain, signed, _moments(inner))]


def log_determinant(groups: DataFrame) -> DataFrame:
    """(g, logdet) of the estimates as they are used."""
    return _cholesky(groups).select("g", (2 * sum((F.log(f"l_{i}_{i}") for i in range(1, DIM)), F.log("l_0_0"))).alias("logdet"))


def concentrate(held: DataFrame, groups: DataFrame, n: int, max_steps: int = MAX_STEPS) -> tuple[DataFrame, int]:
    """Concentration steps until no determinant falls any more: (estimates with logdet, steps taken)."""
    factor = consistency(SUBSET)
    before = None
    for step in range(1, max_steps + 1):
        far = _distance(held, groups, n)
        limit = _binned_quantile(far, F.sqrt("d2"), SUBSET, ["g"], "edge", n)
        subset = _with_groups(far, limit, n).filter(F.floor(F.sqrt("d2") * BIN) < F.round(F.col("edge") * BIN))
        groups = cut_lineage(_few(_moments(subset, factor), n))
        now = cut_lineage(log_determinant(groups))
        if before is not None:
            fall = now.join(before.withColumnRenamed("logdet", "was"), "g").agg(F.max(F.col("was") - F.col("logdet"))).first()[0]  # one number
            if fall is None or fall <= TOLERANCE:
                break
        before = now
    return groups.join(now, "g"), step


def robust_outliers(rows: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """rows (doc_id, lang, source, x0..) -> rows with d2 (null where the group is too small)."""
    counts = rows.groupBy("lang", "source").count().withColumn(
        "g", F.when(F.col("count") >= MIN_GROUP, F.struct("lang", "source", F.lit(1).alias("own"))).otherwise(F.struct("lang", F.lit(None).cast("string").alias("source"), F.lit(0).alias("own"))))
    counts = cut_lineage(counts.withColumn("members", F.sum("count").over(Window.partitionBy("g"))).filter(F.col("members") >= MIN_GROUP)
                         .select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "g"))
    n = counts.count()
    key = counts.hint("broadcast") if n <= BROADCAST_GROUPS else counts
    rows = cut_lineage(rows.join(key, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s"))
    rows = _few(rows, rows.count())
    held = rows.filter("g is not null").select("doc_id", *X, "g")
    first = starts(held, n)
    # a group's starts are groups of their own from here on
    tagged = lambda g, k: F.struct(F.col(g).alias("of"), F.lit(k).alias("start"))
    groups = None
    for k, x in enumerate(first):
        x = x.withColumn("g", tagged("g", k))
        groups = x if groups is None else groups.unionByName(x)
    tries = held.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in range(len(first))]))).withColumn("g", F.struct(F.col("g").alias("of"), F.col("_k").alias("start"))).drop("_k")
    ended, _ = concentrate(tries, groups, n * len(first), max_steps)
    cols = [c for c in ended.columns if c not in ("g", "logdet")]
    best = ended.groupBy(F.col("g.of").alias("g")).agg(F.min_by(F.struct(*cols), F.struct("logdet", "g.start")).alias("b")).select("g", "b.*")
    return _distance(rows, cut_lineage(_few(best, n)), n)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base statistics, base_failed, distance and kept of every document."""
    stats = cut_lineage(base_statistics(docs, id_col, text_col).withColumns(dict(zip(X, _vector()))))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = robust_outliers(stats.filter("not base_failed"))
    out = passed.unionByName(stats.filter("base_failed"), allowMissingColumns=True)
    return out.select(*names, F.sqrt("d2").alias("distance"), (~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= chi2_quantile(KEEP))).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
