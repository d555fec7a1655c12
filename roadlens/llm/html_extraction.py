"""Operator 13 - main text of web pages by a tree-structured graphical model.

A page's block elements are nodes of a tree; inline markup belongs to the block around it. Each
node is content or not: its own evidence (names in tag, class, id and role, text length, links,
sentence marks) is a log-linear potential, and every parent-child edge has a 2x2 potential by the
kind of the child. Sum-product messages go up and then down the tree, level by level for all pages of
a batch at once, and give each node's exact marginal; text of nodes with a marginal of at least
``KEEP`` is the result. Both kinds of potential are fitted by maximum likelihood (expected counts come
from the same messages).

Labelled pages are those that mark their article themselves (``article``, ``main``, role or itemprop);
nodes in it, but not in a part named otherwise, are content. So that other layouts work too, each
labelled page is seen in further forms: without the names of content, without those of the rest, with
parts of the rest moved into the article, and with half of its paragraphs in lists or sections. The fit starts from, and is held near, hand-set prior weights, which
alone decide where no page is labelled. At most ``MAX_PAGES`` pages of at most ``MAX_CHARS`` characters
(distinct ones, smallest hash first) are read for it; extraction reads every page, whole.

White space (and ``br``) becomes one space inside a block, character references are decoded, blocks are
joined in page order. Scripts, styles, head, form fields and the like are never text. Null html is empty; a
page without text gives "". Rows are handled one by one, so repeated rows and ids stay; extra columns are
ignored; an empty table gives an empty result. Extraction is narrow: no shuffle.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP = 0.5
MAX_PAGES = 256
MAX_CHARS = 32768
CHUNK_CHARS = 2 << 20

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD = frozenset("title meta link style script base noscript template".split())
_HIDDEN = frozenset("head title script style template noscript svg iframe object canvas select option button textarea datalist".split())
_INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp
small span strike strong sub sup time tt u var picture center""".split())
#: an element that an opening tag ends, and where the search for it stops
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_CONTENT_NAMES = frozenset("article main content post entry story articlebody body-text maincontent".split())
_REST_NAMES = frozenset("""nav navigation navbar menu header masthead footer sidebar aside notice cookie cookies consent gdpr banner ad ads advert
advertisement adverts promo promotion sponsor sponsored form search login signup subscribe newsletter comment comments reply replies
disqus share sharing social related recommended breadcrumb breadcrumbs widget popup modal overlay toolbar pagination copyright dialog
alert complementary contentinfo""".split())
_LABELS = frozenset(("article", "main", "articlebody"))
_SPLIT = re.compile(r"[^a-z0-9]+")
_MARKS = re.compile(r"[.!?;:,。！？；，]")
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption summary".split())


class _Nodes(HTMLParser):
    """Block elements of a page, in order, and its text segments."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.depth, self.tag, self.names = [-1], [0], [""], [0]  # names: 1 content, 2 rest, 4 labels content
        self.hidden, self.links, self.segments = [False], [0], []
        self.stack, self.link, self.fresh = [0], False, True

    def _pop(self, to: int) -> None:
        del self.stack[to:]
        self.link, self.fresh = False, True

    def _find(self, tags, stops=()) -> int:
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[at]]
            if tag in tags:
                return at
            if tag in stops:
                return 0
        return 0

    def handle_starttag(self, tag, attrs):
        if tag in _INLINE:
            self.link |= tag == "a"
            return
        if tag == "br":
            self.handle_data(" ")
        if tag in _VOID:
            return
        if tag == "body" or tag not in _HEAD and self.tag[self.stack[-1]] == "head":
            if at := self._find({"head"}):
                self._pop(at)
        if tag in _ENDS:
            if at := self._find(*_ENDS[tag]):
                self._pop(at)
        elif tag not in _HIDDEN and (at := self._find({"p"}, {"td", "th", "li", "button", "object"})):
            self._pop(at)
        words = {tag}
        for key, value in attrs if tag not in ("html", "body") else ():  # a name of the whole page says nothing of its parts
            if value and key in ("class", "id", "role", "itemprop"):
                words.update(_SPLIT.split(value.lower()))
        self.names.append((1 if words & _CONTENT_NAMES else 0) | (2 if words & _REST_NAMES else 0) | (4 if words & _LABELS else 0))
        up = self.stack[-1]
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.tag.append(tag)
        self.hidden.append(self.hidden[up] or tag in _HIDDEN)
        self.links.append(0)
        self.stack.append(len(self.parent) - 1)
        self.link, self.fresh = False, True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _INLINE:
            self.link &= tag != "a"
        elif tag == "br":
            self.handle_data(" ")
        elif at := self._find({tag}):
            self._pop(at)

    def handle_data(self, data):
        node = self.stack[-1]
        if self.hidden[node]:
            return
        if self.fresh or not self.segments:
            self.segments.append((node, []))
            self.fresh = False
        self.segments[-1][1].append(data)
        if self.link:
            self.links[node] += len(data)


def parse(html: str | None) -> _Nodes:
    page = _Nodes()
    page.feed(html or "")
    page.close()
    page.segments = [(node, text) for node, parts in page.segments if (text := " ".join("".join(parts).split()))]
    return page


class Forest:
    """The nodes of several pages as arrays, parents before children."""

    def __init__(self, pages: list[_Nodes]):
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.page = np.repeat(np.arange(len(pages)), sizes)
        flat = lambda name, kind: np.array([x for p in pages for x in getattr(p, name)], kind)
        self.parent = flat("parent", np.int64)
        self.parent[self.parent >= 0] += self.first[self.page[self.parent >= 0]]
        self.depth, self.names, self.links = flat("depth", np.int64), flat("names", np.int64), flat("links", np.float64)
        tags = [t for p in pages for t in p.tag]
        self.heading = np.array([len(t) == 2 and t[0] == "h" and t[1] in "123456" for t in tags], float)
        self.item = np.array([t in ("ul", "ol", "li", "menu") for t in tags], float)
        self.leaf = np.array([t in _LEAF for t in tags], np.int64)
        self.text, self.marks = np.zeros(len(tags)), np.zeros(len(tags))
        for start, p in zip(self.first, pages):
            for node, text in p.segments:
                self.text[start + node] += len(text)
                self.marks[start + node] += len(_MARKS.findall(text))

    def take(self, rows: np.ndarray, parent: np.ndarray, page: np.ndarray) -> "Forest":
        """``rows`` (repeats allowed) as a forest of their own."""
        out = object.__new__(Forest)
        out.parent, out.page = parent, page
        for name in ("names", "links", "heading", "item", "leaf", "text", "marks"):
            setattr(out, name, getattr(self, name)[rows])
        out.depth, up = np.zeros(len(rows), np.int64), parent
        while (up >= 0).any():
            out.depth += up >= 0
            up = np.where(up >= 0, parent[up], -1)
        return out

    def levels(self) -> list[np.ndarray]:
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1) if len(order) else []

    def features(self) -> np.ndarray:
        below = np.stack([self.text, self.links, self.marks], 1)
        for level in self.levels()[:0:-1]:
            np.add.at(below, self.parent[level], below[level])
        roots = self.parent < 0
        whole = np.zeros(int(self.page.max(initial=-1)) + 1)
        whole[self.page[roots]] = below[roots, 0]
        text, links, marks = below.T
        share = lambda a, b: np.minimum(a / np.maximum(b, 1.0), 1.0)
        return np.stack([np.ones(len(text)), self.names & 1, (self.names & 2) > 0, self.heading, self.item, np.log1p(self.text) / 5, share(self.links, self.text),
                         np.minimum(share(self.marks, self.text) * 20, 2), share(text, whole[self.page]), share(links, text),
                         np.log1p(text) / 8, np.minimum(share(marks, text) * 20, 2), roots], 1).astype(float)


#: prior weights, one for each column of ``features``; edges by (kind of child, parent, child)
PRIOR = np.array([-1.0, 4.0, -6.0, 0.5, -0.5, 0.2, -1.0, 0.5, 0.5, -1.0, 0.0, 0.5, -4.0])
PRIOR_EDGES = np.array([[[1.0, -1.0], [-0.5, 1.0]], [[1.5, -1.5], [-1.5, 1.5]]])


def marginals(forest: Forest, theta: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(content) of each node, P(parent, child) of each node's edge; zero for roots): sum-product
    upward, then downward. theta: log potential of content (of the rest: 0)."""
    n = len(theta)
    own = np.stack([np.zeros(n), theta], 1)
    psi, parent, levels = edges[forest.leaf], forest.parent, forest.levels()
    sent, down = np.zeros((n, 2)), np.zeros((n, 2))
    for level in levels[:0:-1]:  # own collects the messages of the children
        sent[level] = np.logaddexp(own[level, None, 0] + psi[level, :, 0], own[level, None, 1] + psi[level, :, 1])
        np.add.at(own, parent[level], sent[level])
    pair = np.zeros((n, 2, 2))
    for level in levels[1:]:
        up = parent[level]
        rest = own[up] + down[up] - sent[level]  # the parent without this child
        rest -= rest.max(1, keepdims=True)
        down[level] = np.logaddexp(rest[:, 0, None] + psi[level, 0], rest[:, 1, None] + psi[level, 1])
        joint = rest[:, :, None] + psi[level] + own[level][:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        pair[level] = joint / joint.sum((1, 2), keepdims=True)
    logit = np.diff(own + down, axis=1)[:, 0]
    return 1 / (1 + np.exp(-np.clip(logit, -700, 700))), pair


def labels(forest: Forest) -> np.ndarray:
    """1 for nodes in a marked article and not in a part that is named otherwise."""
    y = np.zeros(len(forest.parent))
    for level in forest.levels()[1:]:
        y[level] = ((y[forest.parent[level]] > 0) | ((forest.names[level] & 4) > 0)) & ((forest.names[level] & 2) == 0)
    return y


def _forms(forest: Forest) -> tuple[Forest, np.ndarray]:
    """The labelled pages in five forms (see the module's text) and their labels."""
    y, n, pages = labels(forest), len(forest.parent), int(forest.page.max(initial=-1)) + 1
    rows, parent, page, truth, names = [], [], [], [], []
    tops = {}  # parts that are named otherwise, by page
    for v in np.flatnonzero((forest.names & 2) > 0):
        tops.setdefault(int(forest.page[v]), []).append(v)
    homes = np.flatnonzero((y > 0) & ((forest.names & 4) > 0))
    home = dict(zip(forest.page[homes[::-1]].tolist(), homes[::-1].tolist()))
    for form in range(5):
        at = form * n
        rows.extend(range(n))
        parent.extend(np.where(forest.parent >= 0, forest.parent + at, -1).tolist())
        page.extend((forest.page + form * pages).tolist())
        truth.extend(y.tolist())
        names.extend((forest.names & (~1 if form in (1, 3) else ~2 if form == 2 else ~0)).tolist())
    at = 3 * n  # the last form: parts of the rest stand in the article too
    children = {}
    for v, up in enumerate(forest.parent):
        children.setdefault(int(up), []).append(v)
    for p, vs in tops.items():
        if p in home:
            todo = [(int(v), home[p] + at) for v in vs]
            while todo:
                v, up = todo.pop()
                todo.extend((w, len(rows)) for w in children.get(v, ()))
                rows.append(v)
                parent.append(up)
                page.append(p + 3 * pages)
                truth.append(0.0)
                names.append(forest.names[v] & ~1)
    at, inner = 4 * n, []  # the fifth form: half of the paragraphs stand in a list or section of their own
    for p, node in home.items():
        leaves = [v for v in children.get(node, ()) if y[v] and forest.leaf[v] and not forest.heading[v]][p % 2::2]
        for v in leaves:
            parent[v + at] = len(rows)
        inner.append((len(rows), p % 3, [v + at for v in leaves]))
        rows.append(int(np.flatnonzero((forest.page == p) & (forest.parent < 0))[0]))
        parent.append(node + at)
        page.append(p + 4 * pages)
        truth.append(1.0 if leaves else 0.0)
        names.append(0)
    out = forest.take(np.array(rows), np.array(parent, np.int64), np.array(page, np.int64))
    out.names = np.array(names, np.int64)
    for box, kind, leaves in inner:
        if kind:
            out.item[[box, *leaves]] = 1.0
    return out, np.array(truth)


def fit(forest: Forest | None, steps: int = 200, rate: float = 0.05, hold: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(node weights, edge potentials) of greatest likelihood on labelled pages, held near the prior."""
    w, edges = PRIOR.copy(), PRIOR_EDGES.copy()
    if forest is None or not len(forest.parent):
        return w, edges
    forest, y = _forms(forest)
    x = forest.features()
    child = forest.parent >= 0
    kind, y0, y1 = forest.leaf[child], y[forest.parent[child]].astype(int), y[child].astype(int)
    seen = np.zeros_like(edges)
    np.add.at(seen, (kind, y0, y1), 1)
    pages = len(np.unique(forest.page))
    flat = lambda a, b: np.concatenate([a, b.ravel()])
    prior, now = flat(w, edges), flat(w, edges)
    m, v = np.zeros_like(now), np.zeros_like(now)
    for t in range(1, steps + 1):  # Adam on the concave log-likelihood
        w, edges = now[:len(w)], now[len(w):].reshape(edges.shape)
        p, pair = marginals(forest, x @ w, edges)
        expected = np.stack([pair[child][kind == k].sum(0) for k in (0, 1)])
        g = (flat(x.T @ (y - p), seen - expected) - hold * (now - prior)) / pages
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        now = now + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return now[:len(w)], now[len(w):].reshape(edges.shape)


def train(pages: DataFrame, html_col: str = "html", max_pages: int = MAX_PAGES, max_chars: int = MAX_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most ``max_pages`` labelled pages of at most ``max_chars`` characters each."""
    html = F.col(html_col)
    marked = html.rlike(r"(?i)<(article|main)[\s>]|=[\"']?(main|articlebody)\b")
    fit_rows = pages.filter((F.length(html) <= max_chars) & marked).select(html.alias("html"), F.xxhash64(html).alias("h"))
    last = fit_rows.select("h").distinct().orderBy("h").limit(max_pages).agg(F.max("h")).first()[0]  # only hashes travel
    rows = [] if last is None else fit_rows.filter(F.col("h") <= last).distinct().orderBy("h", "html").limit(max_pages).collect()
    return fit(Forest([parse(r.html) for r in rows]) if rows else None)


def main_texts(pages: list[_Nodes], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    forest = Forest(pages)
    p, _ = marginals(forest, forest.features() @ model[0], model[1])
    keep = p >= KEEP
    return [" ".join(text for node, text in page.segments if keep[start + node]) for start, page in zip(forest.first, pages)]


def extract_main_text(pages: DataFrame, model: tuple | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page."""
    model = train(pages, html_col) if model is None else model

    def extract(batches):
        for batch in batches:
            texts, held, size = [], [], 0
            for html in batch.column(2):
                held.append(parse(html.as_py()))
                size += len(html.as_py() or "")
                if size >= CHUNK_CHARS:
                    texts += main_texts(held, model)
                    held, size = [], 0
            texts += main_texts(held, model) if held else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string")).mapInArrow(
        extract, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
