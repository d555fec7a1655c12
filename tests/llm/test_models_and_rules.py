"""Operators 1, 2, 4, 6, 7, 8, 9 and the pipeline: library restatements, brute force, held-out accuracy."""

import functools
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.llm import blocks as B
from roadlens.llm import decontamination, line_dedup, packing, quality_classifier, quality_rules, token_count, toxicity

SF = "/root/testdata/sf0.01"


def fuzz(seed, alphabet, n, size=40):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, size))) for _ in range(n)]


# ---- 1 token counts ----

def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_count.vocabulary()
    library = Tokenizer(models.Unigram(vocabulary, 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = fuzz(1, "ab  \n\t▁é<0x>Az日本😀́ ..the ing", 800) + ["", " ", "  ", " a", "a ", "\n", "<s>", "<0x0A>"]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [t for t, _ in token_count.Counter(vocabulary)(texts)] == want


def test_viterbi_is_the_best_segmentation():
    """Against all segmentations, with ties between equal scores."""
    pieces = [("a", -1.0), ("b", -1.5), ("ab", -2.5), ("ba", -2.0), ("aba", -3.5), ("▁", -1.0), ("▁a", -2.0), ("<0xC3>", 0.0), ("<0xA9>", 0.0)]
    score = dict(pieces)
    counter = token_count.Counter(pieces)
    for text in fuzz(2, "abé", 200, 9):
        word, best = "▁" + text, None
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, start = [], 0
            for i, c in enumerate((*cuts, 1)):
                if c:
                    parts.append(word[start:i + 1])
                    start = i + 1
            if all(p in score or len(p) == 1 for p in parts):
                total = sum(score.get(p, counter.unknown) for p in parts)
                best = total if best is None else max(best, total)
        assert counter.solve(word)[1] == pytest.approx(best)


def test_token_counts_odd(odd_docs):
    got = token_count.token_counts(odd_docs)
    assert got.count() == odd_docs.count()
    assert {r.doc_id: r.n_tokens for r in got.filter("doc_id in (1, 2)").collect()} == {1: 0, 2: 0}
    assert token_count.token_counts(odd_docs.limit(0)).count() == 0


# ---- 6 packing ----

def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_word_ids_are_the_text_ids():
    look_up = packing.word_ids(None)
    for t in fuzz(3, "aAß İΣς \n\t\x1c\x85  é́<|endoftext|>'s 12日😀!!..", 1500) + ["a<|endoftext|>b", "don't 's", "Über alles, sagt' er!"]:
        words = t.encode().split()
        memo = look_up(set(words))
        assert np.frombuffer(b"".join(memo[w] for w in words), "<u4").tolist() == ids_of(t)[:-1]


def test_other_tokenizers_read_whole_texts(docs_of):
    """A tokenizer that keeps white space is not taken word by word."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["Two  spaces, a\ttab\nand a line", "", None, "é 日本 x " * 300]
    rows = packing.token_pieces(docs_of(list(enumerate(texts))), 100, path).collect()
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert mine == [(s, len(ids[s:s + 100]), zlib.crc32(ids[s:s + 100].tobytes())) for s in range(0, len(ids), 100)]


def check_packed(rows, capacity):
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_packing_round_trip(odd_docs):
    rows = packing.best_fit_packing(odd_docs, 256).collect()
    check_packed(rows, 256)
    want = Counter()
    for d in odd_docs.select("doc_id", "text").collect():
        ids = ids_of(d.text)
        for k, s in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[s:s + 256], "<u4")
            want[d.doc_id, k, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert packing.best_fit_packing(odd_docs.limit(0)).count() == 0


def best_count(sizes, capacity):
    """Fewest sequences, by trying all placings."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1:]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


def test_lower_bound_never_exceeds_the_optimum():
    r = random.Random(5)
    tight = 0
    for _ in range(150):
        sizes = sorted((r.randint(1, 20) for _ in range(r.randint(1, 8))), reverse=True)
        values, counts = np.unique(sizes, return_counts=True)
        bound, best = packing.lower_bound(values, counts, 20), best_count(sizes, 20)
        assert bound <= best
        assert len(packing.best_fit_decreasing(np.array(sizes), 20)[2]) >= best
        tight += bound == best
    assert tight > 130


def test_packing_exchange_meets_the_bound(spark):
    """Partitions of 40 pieces leave gaps; exchanging their pieces closes nearly all."""
    r = random.Random(6)
    sizes = [r.randint(1, 400) for _ in range(2000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], packing.PIECE_SCHEMA)
    rows = packing.pack(pieces, 1000, 40).collect()
    assert sorted(x.doc_id for x in rows) == list(range(2000))
    values, counts = np.unique(sizes, return_counts=True)
    bound = packing.lower_bound(values, counts, 1000)
    alone = int(packing._pack_once(pieces, 50, 0, 1000).select("part", "bins").distinct().groupBy().sum("bins").first()[0])
    used = check_packed(rows, 1000)
    assert bound <= used < alone and used <= bound * 1.01 + 2


# ---- 4 line dedup ----

def plain_lines(rows, percent, min_pages):
    pages, held = Counter(), Counter()
    for host, text in rows:
        pages[host] += 1
        held.update({(host, x.strip(" ")) for x in (text or "").split("\n") if x.strip(" ")})
    out = []
    for host, text in rows:
        if text is None:
            out.append((host, 0, 0, None))
            continue
        lines = text.split("\n")
        keep = [x for x in lines if not x.strip(" ") or not (held[host, x.strip(" ")] >= min_pages and held[host, x.strip(" ")] * 100 > pages[host] * percent)]
        out.append((host, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_line_dedup(spark, limit):
    """limit 0 takes the salted join."""
    r = random.Random(8)
    rows = []
    for i in range(300):
        host = r.choice([None, "a", "a", "b", "c", ""])
        lines = [r.choice(["menu", " menu", "cookies ", f"line {r.randint(0, 200)}", "", "  ", "tail", "a\ttab"]) for _ in range(r.randint(0, 8))]
        rows.append((host, None if i % 40 == 0 else "\n".join(lines)))
    frame = spark.createDataFrame(rows, "source string, text string")
    got = line_dedup.drop_boilerplate(frame, percent=20, min_pages=5, broadcast_lines=limit)
    assert sorted(((x.source, x._lines, x._dropped, x.text) for x in got.collect()), key=repr) == plain_lines(rows, 20, 5)
    clash = ["_host", "_drop", "_salt", "_spread", "_kept", "_lines", "_dropped", "_Dropped_", "host", "drop", "h", "hs", "n", "pages", "site"]
    odd = frame.withColumns({c: F.lit(f"mine {c}") for c in clash})
    got = line_dedup.drop_boilerplate(odd, percent=20, min_pages=5, broadcast_lines=limit).collect()
    assert sorted(((x.source, x._lines_, x._dropped__, x.text) for x in got), key=repr) == plain_lines(rows, 20, 5)
    assert all(x[c] == f"mine {c}" for x in got for c in clash)
    assert line_dedup.drop_boilerplate(frame.limit(0)).count() == 0


# ---- 7 quality rules ----

def base_of(text):
    text = text or ""
    w = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    count = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = [False] * len(w)
    for i in range(len(w) - 7):
        if count[tuple(w[i:i + 8])] > 1:
            cover[i:i + 8] = [True] * 8
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(cover),
            len(w) < 20 or 100 * sum(cover) > 30 * len(w))


def test_base_statistics(odd_docs, docs_of):
    texts = [" ".join(x) for x in ([f"t{j % 11}" for j in range(n)] for n in (7, 8, 9, 18, 19, 40))] + fuzz(9, "ab|* \n\t\x0b\x0c\r é#", 60, 300)
    for frame in (odd_docs, docs_of(list(enumerate(texts)))):
        rows = quality_rules.base_statistics(frame).collect()
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
        assert got == Counter((r.doc_id, *base_of(r.text)) for r in frame.collect())
    out = quality_rules.quality_rules(odd_docs)
    assert out.count() == odd_docs.count() and out.filter("base_failed and kept").count() == 0
    assert quality_rules.quality_rules(odd_docs.limit(0)).count() == 0


def test_robust_distances(spark):
    """A fifth of gross outliers does not move the estimate; distances agree with numpy's on the clean rows."""
    r = np.random.default_rng(4)
    n, d = 3000, quality_rules.DIM
    mix = np.tril(r.normal(0, 1, (d, d))) + 2 * np.eye(d)
    x = r.normal(0, 1, (n, d)) @ mix.T
    x[: n // 5] = r.normal(40, 3, (n // 5, d))
    rows = spark.createDataFrame([(i, "en", "s", *map(float, v)) for i, v in enumerate(x)],
                                 "doc_id long, lang string, source string, " + ", ".join(f"{c} double" for c in quality_rules.X))
    got = {r.doc_id: r.d2 for r in quality_rules.robust_outliers(rows).collect()}
    clean = x[n // 5:]
    centre, cov = clean.mean(axis=0), np.cov(clean.T) + np.diag(np.square(quality_rules.FLOOR))
    want = np.einsum("ij,jk,ik->i", clean - centre, np.linalg.inv(cov), clean - centre)
    mine = np.array([got[i] for i in range(n // 5, n)])
    assert np.median(mine / want) == pytest.approx(1, abs=0.25)
    assert np.corrcoef(mine, want)[0, 1] > 0.97
    assert min(got[i] for i in range(n // 5)) > 5 * np.quantile(mine, 0.999)


def test_smallest_determinant_of_the_starts_wins(spark):
    """Correlated data with a tilted cloud of outliers: steps fall to an end, and the estimate used is the least of three."""
    from pyspark.sql import functions as F

    q = quality_rules
    r = np.random.default_rng(9)
    x = r.normal(0, 1, (1500, q.DIM)) @ (np.tril(r.normal(0, 1.5, (q.DIM, q.DIM))) + np.eye(q.DIM)).T
    x[:330] = x[:330] * 0.3 + r.normal(0, 1, q.DIM) * 9
    names = "doc_id long, " + ", ".join(f"{c} double" for c in q.X)
    held = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], names).withColumn("g", F.struct(F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("own")))
    ends = []
    for first in q.starts(held, 1):
        groups, steps = q.concentrate(held, first, 1)
        assert 1 < steps < q.MAX_STEPS
        if not ends:
            assert q.concentrate(held, first, 1, 1)[0].first().logdet + 0.05 >= groups.first().logdet  # whole bins: not quite monotone
        ends.append((groups.first().logdet, groups))
    rows = held.select("doc_id", *q.X, F.lit("en").alias("lang"), F.lit("s").alias("source"))
    got = {z.doc_id: z.d2 for z in q.robust_outliers(rows).collect()}
    best = min(ends, key=lambda e: e[0])[1]
    want = {z.doc_id: z.d2 for z in q._distance(held, best.drop("logdet"), 1).collect()}
    assert got == pytest.approx(want)
    assert sum(got[i] > q.chi2_quantile(q.KEEP) for i in range(330)) > 320 and sum(got[i] > q.chi2_quantile(q.KEEP) for i in range(330, 1500)) < 60


def test_chi_square_quantiles():
    r = np.random.default_rng(2).normal(0, 1, (400000, 5))
    d = (r**2).sum(axis=1)
    for share in (0.5, 0.75, 0.99, 0.999):
        assert (d <= quality_rules.chi2_quantile(share)).mean() == pytest.approx(share, abs=0.002)


def test_consistency_factor():
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (200000, quality_rules.DIM))
    d = (x ** 2).sum(axis=1)
    near = x[d <= np.quantile(d, 0.75)]
    assert quality_rules.consistency(0.75) * near.var() == pytest.approx(1, abs=0.02)


def test_quality_rules_keep_clean_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in quality_rules.query(spark, SF).collect()}
    good = [rows[i] for i, q in labels.items() if q == 1 and not rows[i].base_failed]
    bad = [rows[i] for i, q in labels.items() if q == 0]
    assert np.mean([r.kept for r in good]) > 0.97
    assert np.mean([r.kept for r in bad]) < 0.4


# ---- 2 toxicity, 8 quality classifier ----

def test_ordinal_regression_recovers_shared_weights():
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (6000, 3))
    w, cuts = np.array([1.5, -1.0, 0.0]), np.array([-0.5, 1.0, 2.0])
    noise = np.log(1 / r.uniform(1e-9, 1, 6000) - 1)
    grade = ((x @ w + noise)[:, None] >= cuts).sum(axis=1)
    model = toxicity.fit_ordinal(x, grade)
    assert np.allclose(model["w"], w, atol=0.15) and np.allclose(model["c"], cuts, atol=0.2)
    assert (np.diff(model["c"]) > 0).all()
    p = toxicity.probabilities(model, x)
    assert (np.diff(p, axis=1) <= 0).all()


def test_toxicity_on_unseen_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.col("doc_id") % 2 == 0
    model = toxicity.train(docs, labels.filter(~held))
    rows = docs.join(labels.filter(held), "doc_id").select("toxic", toxicity.severity(model)("text").alias("s")).collect()
    hit = [r.s.toxic for r in rows if r.toxic]
    clear = [r.s.toxic for r in rows if not r.toxic]
    assert np.mean(hit) > 0.6 and np.mean(clear) < 0.03
    assert all(0 <= r.s.expected_severity <= 3 for r in rows)


def plain_runs(text, marks):
    """Tokens of a text by regular expression: letters, digits and longer characters; with ``marks`` other visible ones too."""
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+" + (rb"|[!-/:-@\[-`{-~]+" if marks else b""), text)


def test_toxicity_against_plain_python(spark):
    """Severity of every document from the model's numbers by loops over words and stems."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    weight = dict(zip(model["h"].tolist(), model["w"].tolist()))
    assert len(weight) > 20
    of = functools.cache(lambda token: int(B.Runs([token]).h[0]))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    for row in docs.collect():
        tokens = plain_runs((row.text or "").encode().lower(), False)
        count = Counter()
        for t in tokens:
            count[of(t)] += 1
            count[(of(t[:toxicity.HEAD]) + 1) % 2**64] += 1
        z = sum(weight[f] * np.log1p(1000.0 * c / len(tokens)) for f, c in count.items() if f in weight)
        p = [1 / (1 + np.exp(-(z - c))) for c in model["c"].tolist()]
        assert list(p) == sorted(p, reverse=True)
        mass = [1 - p[0], p[0] - p[1], p[1] - p[2], p[2]]
        r = got[row.doc_id]
        assert r.expected_severity == pytest.approx(sum(p), abs=1e-9) and r.toxic == (p[0] > toxicity.TOXIC) and r.grade == int(np.argmax(mass))


def test_quality_scores_against_plain_python(spark):
    """Scores of every document from the model's numbers by loops over tokens."""
    q, small = quality_classifier, "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = q.train(docs, labels)
    got = dict(docs.select("doc_id", q.score(model)("text").alias("s")).collect())
    of, net = {}, model["net"]
    for row in docs.collect():
        total, squares, n = np.zeros(q.DIM), np.zeros(q.DIM), 0
        for t in plain_runs((row.text or "").encode(), True):
            if t not in of:
                h = B.Runs([t], lower=False, marks=True).h
                at = model["own"].tolist().index(h[0]) if h[0] in model["own"] else len(model["own"]) + q.bucket(h)[0]
                of[t] = model["vectors"][at].astype(float)
            total, squares, n = total + of[t], squares + of[t] ** 2, n + 1
        x = np.concatenate([total, squares]) / max(n, 1)
        z = [min(max((v - m) / s, -6), 6) for v, m, s in zip(x, net["mean"], net["scale"])]
        hidden = [np.tanh(sum(a * w for a, w in zip(z, net["p"][0][:, k])) + net["p"][1][k]) for k in range(q.HIDDEN)]
        logit = (sum(a * w for a, w in zip(hidden, net["p"][2])) + net["p"][3][0]) / net["t"]
        assert got[row.doc_id] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-4)


def test_toxicity_odd(spark, odd_docs):
    labels = spark.createDataFrame([(4, 0, None), (6, 0, 1), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for frame in (odd_docs, odd_docs.limit(0)):
        for some in (labels, labels.limit(0)):
            assert toxicity.toxicity(frame, some).count() == frame.count()


def test_temperature_and_network():
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (1500, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # not linear
    net = quality_classifier.fit_network(x[:1000], y[:1000])
    assert np.mean((quality_classifier.logits(net, x[1000:]) > 0) == y[1000:]) > 0.85
    z = r.normal(0, 2, 20000)
    label = (r.uniform(size=20000) < 1 / (1 + np.exp(-z))).astype(float)
    assert quality_classifier.temperature(3 * z, label) == pytest.approx(3, rel=0.1)


def test_context_table_is_the_sum_over_documents(docs_of):
    texts = ["a b c a", "", None, "a!! b | c", "x"]
    got = quality_classifier.context_table(docs_of(list(enumerate(texts))))
    want = np.zeros_like(got)
    place, sign = quality_classifier.index_vectors()
    for t in texts:
        ids = quality_classifier.bucket(quality_classifier._tokens([(t or "").encode()]).h).tolist()
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if 0 < abs(i - j) <= quality_classifier.REACH:
                    np.add.at(want[a], place[b], sign[b])
    assert np.array_equal(got, want)


def test_frequent_tokens_have_vectors_of_their_own(spark, docs_of):
    q = quality_classifier
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = Counter(t for r in docs.collect() for t in plain_runs((r.text or "").encode(), True))
    counts = q.token_counts(docs)
    assert sorted(r.n for r in counts.collect()) == sorted(plain.values())
    own = q.frequent_tokens(counts, 300)
    of = {int(q._tokens([t]).h[0]): n for t, n in plain.items()}
    least = min(of[int(h)] for h in own)
    assert 200 < len(own) <= 300 and {h for h, n in of.items() if n >= least} == set(own.tolist())
    assert q.shared_share(counts, own) == pytest.approx(sum(n for n in plain.values() if n < least) / sum(plain.values()))
    rows = q.rows_of(np.array(list(of), np.uint64), own)
    assert len(set(rows[rows < len(own)].tolist())) == len(own)  # no two of them share a row
    small = [r.text for r in docs.limit(12).collect()]
    got, want = q.context_table(docs_of(list(enumerate(small))), own=own), np.zeros((len(own) + q.VOCAB, q.DIM))
    place, sign = q.index_vectors(own)
    for t in small:
        ids = q.rows_of(q._tokens([(t or "").encode()]).h, own).tolist()
        for i, a in enumerate(ids):
            for j in range(max(0, i - q.REACH), min(len(ids), i + q.REACH + 1)):
                if i != j:
                    np.add.at(want[a], place[ids[j]], sign[ids[j]])
    assert np.array_equal(got, want)
    assert len(q.frequent_tokens(q.token_counts(docs.limit(0)))) == 0 and q.shared_share(counts.limit(0), own) == 0


def test_quality_classifier_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in quality_classifier.query(spark, SF).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == q for p, q in held]) > 0.88


def test_quality_classifier_odd(spark, odd_docs):
    labels = spark.createDataFrame([(4, None, 0), (6, 1, 1), (None, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    for frame in (odd_docs, odd_docs.limit(0)):
        for some in (labels, labels.limit(0)):
            rows = quality_classifier.quality_scores(frame, some).collect()
            assert len(rows) == frame.count() and all(0 <= r.score <= 1 for r in rows)


# ---- 9 decontamination ----

def test_masks_leave_no_gap():
    """Whichever two of 13 words are replaced, a mask fits between."""
    fits = [{o + j for j, b in enumerate(m) if b == "1"} for m in decontamination.MASKS for o in range(decontamination.WINDOW - len(m) + 1)]
    assert all(any(not f & set(e) for f in fits) for e in itertools.combinations(range(decontamination.WINDOW), 2))


def test_short_items_leave_no_gap():
    """Items of 1 to 12 words: every substitution the rule allows is found, at every word."""
    for n in range(1, decontamination.WINDOW):
        item = [f"w{j}" for j in range(n)]
        index = decontamination.Index([(1, " ".join(item))])
        texts = []
        for gone in itertools.combinations(range(n), n - -(-80 * n // 100)):
            texts.append(" ".join(["before", *("sub" if j in gone else w for j, w in enumerate(item)), "after"]).encode())
        assert [row[0] for row in index.overlaps(texts)] == list(range(len(texts))), n


def test_decontamination_short_items(spark, docs_of):
    """Items and documents of any length against the rule itself."""
    r = random.Random(12)
    word = lambda: r.choice("abcd") + r.choice("xyz")
    items = [[word() for _ in range(n)] for n in range(1, 17) for _ in range(3)]
    docs = []
    for i in range(120):
        part = list(r.choice(items))
        for _ in range(r.randint(0, 3)):
            part[r.randrange(len(part))] = "sub"
        docs.append((i, " ".join([word() for _ in range(r.randint(0, 8))] + part + [word() for _ in range(r.randint(0, 8))])))
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    got = {(g.doc_id, g.item_id) for g in decontamination.contamination(docs_of(docs), bench).collect()}
    assert got == {(i, j) for i, t in docs for j, x in enumerate(items) if plain_overlap(t.split(), x)}


def test_decontamination_holds_one_index(spark, docs_of, monkeypatch):
    """With many blocks of items, one index is alive at a time, and the rows are those of a single block."""
    import gc
    import weakref

    items = [[f"w{(7 * j + k) % 211}" for k in range(20)] for j in range(30)]
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    frame = docs_of([(i, "intro " + " ".join(items[i]) if i % 2 else f"clean text {i}") for i in range(30)] + [(None, " ".join(items[3])), (50, None)])
    want = (sorted(map(repr, decontamination.contamination(frame, bench).collect())), sorted(map(repr, decontamination.decontaminate(frame, bench).collect())))
    built, alive = [], []
    plain = decontamination.Index

    def counted(*args):
        gc.collect()
        alive.append(sum(r() is not None for r in built))
        index = plain(*args)
        built.append(weakref.ref(index))
        return index

    monkeypatch.setattr(decontamination, "Index", counted)
    found = decontamination.contamination(frame, bench, block_words=150)
    left = decontamination.decontaminate(frame, bench, block_words=150)
    assert len(built) > 4 and max(alive) == 0
    assert (sorted(map(repr, found.collect())), sorted(map(repr, left.collect()))) == want


def plain_overlap(doc, item):
    n, need = len(item), min(decontamination.WINDOW, len(item))
    for diagonal in range(-n, len(doc)):
        lo, hi = max(diagonal, 0), min(diagonal + n, len(doc))
        equal = [doc[p] == item[p - diagonal] for p in range(lo, hi)]
        if any(100 * sum(equal[s:s + need]) >= 80 * need for s in range(len(equal) - need + 1)):
            return True
    return False


def test_decontamination(spark, docs_of, odd_docs):
    r = random.Random(11)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz")
    items = [[word() for _ in range(r.randint(1, 40))] for _ in range(12)]
    docs = []
    for i in range(80):
        w = [word() for _ in range(r.randint(0, 60))]
        if i % 2:
            part = list(r.choice(items))
            part = part[r.randint(0, 5):]
            for _ in range(r.randint(0, 3)):
                if part:
                    part[r.randrange(len(part))] = "sub"
            at = r.randint(0, len(w))
            w[at:at] = part
        docs.append((i, ", ".join(w).upper() if i % 3 else " ".join(w)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, ""), (None, "!!")], "item_id long, text string")
    frame = docs_of(docs)
    want = {(i, j) for i, t in docs for j, x in enumerate(items) if len(x) >= 13 and plain_overlap(t.lower().replace(",", "").split(), x)}
    long_items = {j for j, x in enumerate(items) if len(x) >= 13}
    got = decontamination.contamination(frame, bench).collect()
    assert {(g.doc_id, g.item_id) for g in got if g.item_id in long_items} == want and want
    blocks = decontamination.contamination(frame, bench, block_words=60).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, got))
    left = {x.doc_id for x in decontamination.decontaminate(frame, bench).collect()}
    assert left == {i for i, _ in docs} - {g.doc_id for g in got}
    assert decontamination.contamination(odd_docs, bench).count() >= 0
    assert decontamination.decontaminate(odd_docs, bench.limit(0)).count() == odd_docs.count()
    assert decontamination.contamination(odd_docs.limit(0), bench).count() == 0


# ---- pipeline ----

def test_pipeline_stages(spark):
    import corpus_pipeline

    source = spark.read.parquet(f"{SF}/documents.parquet").cache()
    docs, kept = source, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == source.columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[0] == kept[1] and kept[1] > kept[2] > kept[3]
    rows = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    check_packed(rows, 2048)
    assert {r.doc_id for r in rows} == kept[3]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    assert len(toxic & kept[0]) < 0.25 * len(toxic)


def test_pipeline_stages_odd(spark, odd_docs, tmp_path):
    import corpus_pipeline

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (plain, plain.limit(0)):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == start.columns
        if start is plain:
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert len(rows) == len(set(rows)) and 5 not in dict(rows) and 4 in dict(rows)
            assert {(6, "one two three"), (6, "other text")} <= set(rows)
        corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count()


def test_rows_of_one_hash_are_told_apart(spark):
    import corpus_pipeline

    rows = spark.createDataFrame([("a", 7, 1), ("b", 7, 2), ("b", 7, 2), ("c", 8, 1), ("c", 8, 1), ("d", 9, 1)], "text string, key long, again long")
    keyed, twice = corpus_pipeline._keyed(rows, "key", "again")
    keys = {r.text: r.key for r in keyed.collect()}
    assert len(set(keys.values())) == 4 and {r.key for r in twice.collect()} == {keys["b"], keys["c"]} and set(keyed.columns) == {"text", "key"}


def test_near_duplicates_by_row(spark, docs_of):
    """Rows that share an id, or have none, go only with a near copy that stays."""
    import corpus_pipeline

    words = lambda n: " ".join(f"t{n}w{i}" for i in range(60))
    near = words(1) + " more"
    pairs = [(None, words(0)), (None, words(1)), (None, words(2)), (5, words(3)), (5, words(4)), (5, near), (6, words(4)),
             (7, words(5)), (7, words(5)), (8, words(6)), (3, words(6)), (9, ""), (9, ""), (None, None)]
    left = corpus_pipeline.near_duplicate_stage(spark, docs_of(pairs), SF).collect()
    want = [(None, words(0)), (None, words(1)), (None, words(2)), (5, words(3)), (5, words(4)), (7, words(5)), (3, words(6)), (9, ""), (9, ""), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in left), key=repr) == sorted(want, key=repr)
    assert left[0].__fields__ == docs_of(pairs).columns
