"""Trie of conversation prefixes against brute force, with long, hot, equal and odd conversations."""

import hashlib
import random
import re
import zlib

import pytest

from roadlens.llm import prefix_trie as P

COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    convs = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    nodes, full = {}, {}
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 4
        seq = convs.get(c - c % 20, [])[:h] + convs[c][h:]
        full[c] = tuple(seq)
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in nodes:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, members in nodes.items():
        w = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in children)
            saved[p[:d]] = saved.get(p[:d], 0) + w
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in m if len(full[c]) == len(p)).encode()).hexdigest()) for p, m in nodes.items())


def trie(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth string, conv long, k1 string")
    return sorted(tuple(r[c] for c in COLS) for r in P.prefix_trie(df.repartition(4)).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for c in range(0, 90):
        if c % 20 == 0 and c in (40, 60):
            continue  # the group has no first conversation
        n = rng.choice([0, 1, 1, 2, 3, 5])
        for t in range(n):
            out.append((c, rng.choice([t, t, None, 7]), rng.choice(["user", "assistant", "system", None]), rng.choice(["hi", "hi there", "", None, "a b  c\td"])))
    out += [(200 + c, t, "user", "same words here") for c in range(40) for t in range(4)]  # many equal ones
    out += [(None, 0, "user", "x"), (3, 1, "user", "twice"), (3, 1, "user", "twice")]
    return out


def test_against_brute_force(spark, rows):
    assert trie(spark, rows) == brute(rows)


def test_long_conversations_and_hot_nodes(spark, rows, monkeypatch):
    """A conversation longer than two blocks, another one equal to its start, and a node over the limit for salts."""
    monkeypatch.setattr(P, "HOT_CHILDREN", 3)
    long = [(300, t, "user", f"w{t % 5} x") for t in range(70000)]
    more = rows + long + [(301, t, "user", f"w{t % 5} x") for t in range(66000)]
    df = spark.createDataFrame(more, "conv_id long, turn long, role string, text string")
    got = P.prefix_trie(df).collect()
    mine = {(r.conv_id, r.depth): r for r in got}
    assert len(mine) == len(got)
    for want in brute(rows):
        if want[1] > 0:  # the root alone gains
            assert tuple(mine[want[:2]][c] for c in COLS) == want
    top = mine[(300, 70000)]
    assert (top.n_convs, top.n_children, top.n_leaves, top.saved_tokens, top.parent_conv_id) == (1, 0, 1, 0, 300)
    # both share turns up to 66,000: each saves two words a turn from there on
    assert mine[(300, 65000)].saved_tokens == 2 * 1001 and mine[(300, 65000)].n_convs == 2 and mine[(300, 65000)].n_leaves == 1


def test_pieces_of_end_lists(spark):
    ends = [5, 9, 70000, 70001, 1 << 40, -3]
    df = spark.createDataFrame([(c, 1, k, 7) for k in (1, 2) for c in ends[k - 1:]], "conv long, depth long, k1 long, k2 long")
    got = {r.k1: r.ends_sha256 for r in P.end_lists(df).collect()}
    for k in (1, 2):
        assert got[k] == hashlib.sha256(",".join(str(c) for c in sorted(ends[k - 1:])).encode()).hexdigest()


def test_empty(spark):
    df = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert P.prefix_trie(df).collect() == [] and P.prefix_trie(df.limit(0)).collect() == []
    turnless = [(1, 0, "user", "x")]  # its one turn would come from conversation 0, which is not there
    assert zlib.crc32(b"1") % 4 > 0 and trie(spark, turnless) == brute(turnless) and len(brute(turnless)) == 1
