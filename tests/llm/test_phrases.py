"""Phrase collocations against brute force; tiles against plain counts; odd input."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from roadlens.llm import phrases as P


def brute(rows, min_count, max_words, top):
    """(lang, rank, phrase, a, l, r, n, score) rows from (lang, text) pairs."""
    count, out = {}, []
    for lang, text in rows:
        c = count.setdefault(lang or "und", Counter())
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, max_words + 1):
                c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, c in count.items():
        n = sum(f for p, f in c.items() if len(p) == 1)
        cand = {p: f for p, f in c.items() if len(p) > 1 and f >= min_count}
        best = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * f >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, f in cand.items()):
                continue
            s, _, l, r = min((1000 * a * n // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["the", "The", "of", "a", "\x00x", "é", "日本", "go-to", "new", "york", "city", "b"]
    rows = []
    for k in range(120):
        out = []
        for _ in range(rng.randint(0, 80)):
            out.append(rng.choice(["new york city", "the the the", "of the", rng.choice(words), rng.choice(words)]))
            out.append(rng.choice([" ", " ", "\t", "  ", ". ", "\n", ",", " "]))
        rows.append((rng.choice(["en", "en", "en", "fr", None]), "".join(out)))
    return rows + [("en", None), (None, ""), ("xx", " .\t. "), ("en", rows[0][1]), ("en", rows[0][1])]


def docs(spark, rows):
    return spark.createDataFrame([(k % 7, t, lang, "clash", 1, "clash") for k, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, unit string, id long, words string")


@pytest.mark.parametrize("unit_bytes,fan,hot,dense", [(4 << 20, 128, 1024, 4096), (300, 3, 2, 5)])
def test_against_brute_force(spark, texts, monkeypatch, unit_bytes, fan, hot, dense):
    """Once as it runs, once with many small units, several rounds of merging, salted ranks and dense tiles."""
    for name, value in {"UNIT_BYTES": unit_bytes, "FAN": fan, "HOT_RANK": hot, "DENSE": dense}.items():
        monkeypatch.setattr(P, name, value)
    got = rows_of(P.collocations(docs(spark, texts).repartition(5, "doc_id"), min_count=4, top=40))
    want = brute(texts, 4, 5, 40)
    assert len(want) > 60 and got == want


def test_long_text_and_tables_without_candidates(spark):
    long = "alpha beta gamma " * 60000
    got = rows_of(P.collocations(docs(spark, [("en", long), ("en", "alpha beta")])))
    assert got == brute([("en", long), ("en", "alpha beta")], 100, 5, 2000)
    for rows in ([("en", "too few words")], [("en", None)]):
        assert rows_of(P.collocations(docs(spark, rows))) == []
    assert rows_of(P.collocations(docs(spark, [("en", "x")]).limit(0))) == []


def test_tiles(monkeypatch):
    monkeypatch.setattr(P, "DENSE", 50)
    rng = np.random.default_rng(1)
    i, j = rng.integers(0, 1 << 30, 500), rng.integers(0, 1 << 30, 500)
    i[:300], j[:300] = rng.integers(0, 20, 300), rng.integers(0, 20, 300)
    weights = rng.integers(1, 10**6, 500)
    codes = P.pair_codes(i, j)
    assert all((a == b).all() for a, b in zip(P.pair_ids(codes), (i, j)))
    want = Counter()
    for c, w in zip(codes.tolist(), weights.tolist()):
        want[c] += w
    got = P.count_tiles(codes, weights)
    assert dict(zip(*(x.tolist() for x in got))) == want and (np.diff(got[0]) > 0).all()
    back = P.unpack(P.pack(*got))
    assert (back[0] == got[0]).all() and (back[1] == got[1]).all()
    assert len(P.unpack(P.pack(np.zeros(0, np.int64), np.zeros(0, np.int64)))[0]) == 0


def test_scores_beyond_64_bits(spark):
    big = 10**13
    rows = spark.createDataFrame([("en", 0, 0, 0, big - 1, ["a", "b"], [big], [big + 7])], "lang string, id long, i long, j long, f long, words array<string>, lf array<long>, rf array<long>")
    totals = spark.createDataFrame([("en", 9 * 10**13)], "lang string, n long")
    got = P.scored(rows, totals, 2).first()
    assert got.score == 1000 * (big - 1) * 9 * 10**13 // (big * (big + 7))
