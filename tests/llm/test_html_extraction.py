"""Main text of pages: brute-force marginals, given pages against their template, other layouts, odd input."""

import html as H
import itertools
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from roadlens.llm import html_extraction as X

SF = "/root/testdata/sf0.01"


def template_text(page):
    """Main text by the given pages' own template (no tree, no model)."""
    body = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    return " ".join(H.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", body))).split())


@pytest.fixture(scope="module")
def model(spark):
    return X.train(spark.read.parquet(f"{SF}/pages.parquet"))


def test_marginals_against_enumeration():
    rng = np.random.default_rng(5)
    page = X.parse("<body><nav><ul><li>a</ul></nav><div><h1>t</h1><p>x<p>y</div><footer>z</footer>")
    forest = X.Forest([page, X.parse("<p>alone"), X.parse("")])
    theta, edges = rng.normal(size=len(forest.parent)), rng.normal(size=(2, 2, 2))
    got, pair = X.marginals(forest, theta, edges)
    n = len(theta)
    total, one, two = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for x in itertools.product((0, 1), repeat=n):
        score = sum(theta[v] for v in range(n) if x[v]) + sum(edges[forest.leaf[v], x[forest.parent[v]], x[v]] for v in range(n) if forest.parent[v] >= 0)
        weight = np.exp(score)
        total += weight
        one += weight * np.array(x)
        for v in range(n):
            if forest.parent[v] >= 0:
                two[v, x[forest.parent[v]], x[v]] += weight
    assert np.allclose(got, one / total) and np.allclose(pair, two / total)


def test_given_pages(spark, model):
    want = {r.page_id: template_text(r.html) for r in pd.read_parquet(f"{SF}/pages.parquet").itertuples()}
    rows = X.query(spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


WORDS = "The river ran past the old mill, and nobody in the town knew why it had stopped. They asked the miller twice. "
LAYOUTS = [
    # (page, main text)
    (f"<html><body><div id=header><a href=/>Home</a></div><div class='side-bar sidebar'><p>Popular: <a href=1>one</a> <a href=2>two</a></div>"
     f"<div class='post-content'><h2>Mill</h2><p>{WORDS}</p><p>{WORDS * 2}</div><div id='comments'><p>Nice text, thanks for it!</p></div></body>",
     f"Mill {WORDS.strip()} {(WORDS * 2).strip()}"),
    (f"<main><h1>A &amp; B</h1><p>{WORDS}<a href='x'>more</a> here.</p><ul><li>first thing<li>second thing</ul></main><aside>Read also: this</aside>",
     f"A & B {WORDS}more here. first thing second thing"),
    (f"<div class='cookie-notice'>We use cookies. Accept?</div><form class=search><input value=q><button>Go</button></form><article><h1>T</h1><p>{WORDS}</p>"
     f"<section class='comments'><p>{WORDS}</p></section></article><footer>Done.</footer>", f"T {WORDS.strip()}"),
    (f"<article><p>one<br>two&nbsp;&eacute;<script>var a='<p>';</script><style>p{{}}</style><p>{WORDS}</article>", f"one two é {WORDS.strip()}"),
    (f"<body><nav><a href=1>x</a></nav><article><h1>Long</h1><p>{WORDS * 4000}</p></article>", f"Long {(WORDS * 4000).strip()}"),
]


@pytest.mark.parametrize("k", range(len(LAYOUTS)))
def test_other_layouts(model, k):
    page, want = LAYOUTS[k]
    assert X.main_texts([X.parse(page)], model) == [want]


def test_odd_input(spark, model):
    kind = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                         T.StructField("text", T.StringType()), T.StructField("n_chars", T.StringType())])
    good = f"<article><h1>T</h1><p>{WORDS}</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (None, "u", good), (4, "u", good), (4, "u", good), (5, "u", "no markup at all"),
            (6, "u", "<div>" * 3000 + "deep"), (7, "u", "</p></div><li><td>&#0;&bogus;<!-- "), (8, "u", "<head><title>only a title")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], kind)
    got = X.extract_main_text(pages, model).collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.page_id in (1, 2, 8)] == ["", "", ""]
    assert [r.text for r in got if r.page_id is None or r.page_id == 4] == [f"T {WORDS.strip()}"] * 3
    assert all(r.n_chars == len(r.text) for r in got)
    assert X.extract_main_text(pages.limit(0)).collect() == []  # nothing to fit on: the prior alone
    assert X.main_texts([X.parse(good)], X.fit(None)) == [f"T {WORDS.strip()}"]
