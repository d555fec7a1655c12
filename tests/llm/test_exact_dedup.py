"""Operators 3, 5 and 10 against plain restatements of their contracts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from roadlens.llm import blocks as B
from roadlens.llm import jaccard_join, substring_dedup, suffix_dedup


def texts(seed, n=60):
    """Random words with shared passages, copies, near copies and runs."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(45)]
    base = [word() for _ in range(120)]
    out = []
    for i in range(n):
        w = [word() for _ in range(r.randint(0, 90))]
        kind = i % 6
        if kind == 0:
            at = r.randint(0, len(w))
            w[at:at] = passage[r.randint(0, 10):]
        elif kind == 1:
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
        elif kind == 2:
            w += ["run"] * r.randint(15, 50) + w[:5] + ["run", "stop"] * r.randint(5, 20)
        elif kind == 3 and out:
            w = r.choice(out)[1].split()
        out.append((100 + i, (" " if i % 2 else "\n").join(w)))
    return out


def words_left(pairs, window):
    pairs = sorted(((i, (t or "").encode().split()) for i, t in pairs), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    seen, out = set(), []
    for i, w in pairs:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            if key in seen:
                gone[p:p + window] = [True] * window
            seen.add(key)
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,window", [(1, 20), (2, 20), (3, 27), (4, 8)])
def test_substring_dedup(docs_of, seed, window):
    pairs = texts(seed)
    got = substring_dedup.substring_dedup(docs_of(pairs), window).collect()
    assert sorted(map(tuple, got), key=repr) == words_left(pairs, window)


def test_substring_candidates_come_from_shared_names(docs_of, monkeypatch):
    """Equal passages have equal symbols in any block; with names of the block's own, none is found."""
    r = random.Random(31)
    words = lambda n: [f"u{r.randint(0, 10**9)}" for _ in range(n)]
    passage = words(60)
    pairs = [(i, " ".join(words(r.randint(5, 40)) + (passage if i % 3 == 0 else []) + words(r.randint(5, 40)))) for i in range(60)]
    run = lambda: sorted(map(tuple, substring_dedup.substring_dedup(docs_of(pairs)).collect()), key=repr)
    whole = run()
    assert whole == words_left(pairs, 20) and sum(row[2] for row in whole) > 19 * 59
    real = substring_dedup.recompress

    def own_names(words, rounds):
        levels, in_run = real(words, rounds)
        return [(B.mix(name + np.uint64(len(words.data)) + np.arange(len(name), dtype=np.uint64)), start) for name, start in levels], in_run

    monkeypatch.setattr(substring_dedup, "recompress", own_names)
    assert sum(row[2] for row in run()) == 0


def test_symbols_of_equal_passages():
    """Inside equal passages the parses agree but near their ends, round by round."""
    r = random.Random(5)
    passage = [r.choice("abcdefgh") + str(r.randint(0, 3)) for _ in range(80)]
    texts = [" ".join([f"x{r.randint(0, 99)}" for _ in range(r.randint(0, 9))] + passage + [f"y{r.randint(0, 99)}" for _ in range(5)]).encode() for _ in range(12)]
    for rounds in (1, 2, 3):
        seen = []
        for t in texts:
            words = B.Words([t])
            at = len(t.split()) - 85
            name, start = substring_dedup.recompress(words, rounds)[0][-1]
            edge = 2 * (2**rounds - 1) + 2**rounds
            seen.append([(int(s) - at, int(n)) for n, s in zip(name, start) if at + edge <= s < at + 80 - edge])
        assert all(x == seen[0] for x in seen) and len(seen[0]) > 5


def test_substring_dedup_odd(odd_docs):
    pairs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, substring_dedup.substring_dedup(odd_docs).collect()), key=repr) == words_left(pairs, 20)
    assert substring_dedup.substring_dedup(odd_docs.limit(0)).count() == 0


def bytes_left(pairs, size):
    raw = [(i, (t or "").encode()) for i, t in pairs]
    count = Counter(t[p:p + size] for _, t in raw for p in range(len(t) - size + 1))
    out = []
    for i, t in raw:
        cover = np.zeros(len(t) + 1, int)
        for p in range(len(t) - size + 1):
            if count[t[p:p + size]] > 1:
                cover[p] += 1
                cover[p + size] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        edge = np.diff(gone.astype(int), prepend=0, append=0)
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((i, len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,size,hot", [(5, 60, 1 << 15), (6, 60, 3), (7, 13, 4), (8, 400, 1 << 15)])
def test_suffix_dedup(docs_of, seed, size, hot):
    """hot = 3 or 4 sends most shared strings the way of very frequent interiors."""
    pairs = texts(seed)
    rows = suffix_dedup.suffix_dedup(docs_of(pairs), size, hot).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows), key=repr)
    assert got == bytes_left(pairs, size)


@pytest.mark.parametrize("size,hot,run", [(60, 300, 700), (400, 1 << 15, 34000)])
def test_suffix_dedup_run_in_one_block(docs_of, size, hot, run):
    """Runs that are hot in one block alone, and strings of their interiors once in other blocks."""
    letters = "pqrstuvw"
    pairs = [(1, "".join(c * run + f"end{c}" for c in letters[:8 if size == 60 else 2]))]
    for i, c in enumerate(letters):
        pairs.append((10 + i, f"only {i}{i} here " + c * (size + i) + f"end{c} of row {i}"))
    rows = suffix_dedup.suffix_dedup(docs_of(pairs), size, hot).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows), key=repr)
    assert got == bytes_left(pairs, size)


def test_suffix_dedup_odd(odd_docs):
    rows = suffix_dedup.suffix_dedup(odd_docs, 40).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows), key=repr)
    assert got == bytes_left([(r.doc_id, r.text) for r in odd_docs.collect()], 40)
    assert suffix_dedup.suffix_dedup(odd_docs.limit(0)).count() == 0


def test_collection_order_and_prefixes():
    """Column-wise insertion gives the sorted order and the common prefixes of every round."""
    r = np.random.default_rng(3)
    rows = r.integers(0, 3, (50, 12)).astype(np.uint16)
    group = np.sort(r.integers(0, 4, 50))
    c = suffix_dedup.Collection(group)
    for j in range(11, -1, -1):
        c.insert(rows[:, j])
        suffix = [(g, *row[j:]) for g, row in zip(group.tolist(), rows.tolist())]
        assert [suffix[i] for i in c.order] == sorted(suffix)
        for k in range(1, 50):
            a, b = suffix[c.order[k - 1]], suffix[c.order[k]]
            same = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
            assert c.lcp[k] == same - 1


def components_of(pairs, k=5, percent=80):
    sets = []
    for i, t in pairs:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    low = lambda i: -(1 << 63) if i is None else i
    root = {low(i): low(i) for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(low(sets[a][0])), find(low(sets[b][0]))
                root[max(p, q)] = min(p, q)
    out = [(i, len(s), find(low(i))) for i, s in sets]
    return sorted(((i, n, None if c == -(1 << 63) else c) for i, n, c in out), key=repr)


def near_copies(seed, groups=4, size=14, length=90):
    """Chains: each text differs from the one before in one or two words."""
    r, out = random.Random(seed), []
    for g in range(groups):
        w = [f"g{g}w{r.randint(0, 40)}" for _ in range(length + 15 * g)]
        for _ in range(size):
            out.append(" ".join(w))
            w = list(w)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = f"n{r.randint(0, 10 ** 6)}"
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed,list_size", [(1, 2048), (2, 4)])
def test_jaccard_join(docs_of, monkeypatch, seed, list_size):
    """A list size of 4 deals every list in chunks and pairs of chunks."""
    monkeypatch.setattr(jaccard_join, "LIST", list_size)
    monkeypatch.setattr(jaccard_join, "SKIP", 4)
    pairs = near_copies(seed) + texts(seed + 20, 24)
    got = jaccard_join.jaccard_join(docs_of(pairs)).select("doc_id", "n_shingles", "component_id").collect()
    want = components_of(pairs)
    assert sorted(map(tuple, got), key=repr) == want
    assert 1 < len({c for _, _, c in want}) < len(want) - 20


def twins(size):
    """Two different words of ``size`` bytes whose polynomials modulo a power of two agree from 1,024 bytes on."""
    marks = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[m] for m in marks), "".join("ba"[m] for m in marks)


@pytest.mark.parametrize("size", [256, 1024, 4096])
def test_structured_long_words_stay_apart(docs_of, size):
    a, b = twins(size)
    shared = [f"w{i}" for i in range(19)]
    pairs = [(1, " ".join([*shared, a])), (2, " ".join([*shared, b])), (3, " ".join([a] * 5)), (4, " ".join([b] * 5)), (5, a), (6, b), (7, b)]
    got = substring_dedup.substring_dedup(docs_of(pairs)).collect()
    assert sorted(map(tuple, got), key=repr) == words_left(pairs, 20)
    got = jaccard_join.jaccard_join(docs_of(pairs)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == components_of(pairs)
    runs = B.Runs([a.encode(), b.encode()])
    assert len(set(runs.h.tolist())) == 2


def test_large_group_of_near_copies(docs_of, monkeypatch):
    """Many near copies of one text in chunks of lists, beside texts that share words with them."""
    monkeypatch.setattr(jaccard_join, "LIST", 16)
    monkeypatch.setattr(jaccard_join, "VERIFY_PAIRS", 50)
    r = random.Random(12)
    base = [f"w{r.randint(0, 400)}" for _ in range(80)]
    pairs = []
    for i in range(160):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
        pairs.append((i, " ".join(w)))
    for i in range(160, 220):  # parts of the text: near each other or not, never near the whole
        at = r.randint(0, 30)
        pairs.append((i, " ".join(base[at:at + r.randint(20, 40)])))
    got = jaccard_join.jaccard_join(docs_of(pairs)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == components_of(pairs)


def test_jaccard_join_odd(odd_docs):
    got = jaccard_join.jaccard_join(odd_docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == components_of([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert jaccard_join.jaccard_join(odd_docs.limit(0)).count() == 0


def test_packed_keys_round_trip():
    r = np.random.default_rng(0)
    for width in (4, 5, 8):
        for n in (1, 2, 3, 5000):
            keys = np.unique(B.truncate(r.integers(0, 1 << 64, n, dtype=np.uint64), width))
            keys = np.unique(np.append(keys, keys[0] + np.uint64(1 << (64 - 8 * width)) if n < 5000 else keys[0]))
            blob = B.pack_sorted(keys, width)
            back, read = B.unpack_sorted(blob + b"rest")
            assert read == len(blob) and (back == keys >> np.uint64(64 - 8 * width)).all()
