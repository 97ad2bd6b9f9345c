"""Main text of web pages: boosted trees over the nodes of a page, decoded over its tree.

Each element gets probabilities that its whole subtree is main text, that none of it is,
or that it is mixed, from features of the node: tag, depth, siblings, subtree text and
link density, punctuation, place in the page, and tokens of class, id and role.  The
decoder picks the likeliest labelling in which "main" and "boilerplate" hold for all
descendants and only "mixed" leaves children free, so no choice contradicts another.

Training pages are a bounded sample of the given pages.  Their marked-up article gives the
labels; each is also used in altered forms (article renamed to plain containers, sidebars,
notices, adverts, comments and forms inserted with text of other pages), so that the trees
do not rest on one tag.  If no page marks an article, the labels come from where the text
is: the innermost element that holds most of a page's unlinked text outside of elements
whose tag or name says boilerplate.  Every whole page is then extracted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmix.llm.boosting import Trees, fit_trees

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template head title svg iframe object canvas annotation "
                   "annotation-xml select option textarea button".split())
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label "
                   "mark q s samp small span strike strong sub sup time tt u var wbr "
                   "math semantics mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mstyle "
                   "mover munder munderover annotation".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form "
                     "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",),
               "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
TAGS = ("article main section div p h1 h2 h3 h4 ul ol li a nav header footer aside form table "
        "tr td blockquote pre figure figcaption span b strong em body html").split()
GOOD = "article content main post entry story text body blog page column hentry".split()
BAD = ("nav menu foot header head side ad ads advert promo banner comment reply discuss share "
       "social related cookie notice consent popup modal form subscribe newsletter login search "
       "widget breadcrumb pager pagination copyright sponsor toolbar alert meta tags").split()
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
IN, OUT, MIXED = 0, 1, 2


class Page(HTMLParser):
    """Elements in page order with parents, and text runs of blocks."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent = ["html"], [{}], [-1]
        self.open = [0]
        self.runs: list[tuple[int, int, list[str]]] = []  # block, innermost node, pieces
        self.fresh, self.unseen = True, 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "html" or (tag == "head" and len(self.tag) > 1):
            return
        if tag == "body" or (tag not in IN_HEAD and self.tag[self.open[-1]] == "head"):
            self._close("head", frozenset())  # its end tag may be left out
        if tag == "br":
            self.handle_data(" ")
            return
        if tag in CLOSES_P:
            self._close("p", CLOSES_P - {"p"})
        if tag in CLOSES_SAME:
            self._close(tag, frozenset(CLOSES_SAME[tag]))
        node = len(self.tag)
        self.tag.append(tag)
        self.attrs.append(dict(attrs))
        self.parent.append(self.open[-1])
        if tag not in INLINE:
            self.fresh = True
        if tag not in VOID:
            self.open.append(node)
            self.unseen += tag in UNSEEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in CLOSES_P and tag != "html":
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("html", "body", "br"):
            return
        self._close(tag, frozenset())

    def _close(self, tag, fence):
        """End the innermost open ``tag``, unless an element of ``fence`` is inside of it."""
        for k in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[k]]
            if name == tag:
                for node in self.open[k:]:
                    self.unseen -= self.tag[node] in UNSEEN
                    self.fresh = self.fresh or self.tag[node] not in INLINE
                del self.open[k:]
                return
            if name in fence:
                return

    def handle_data(self, data):
        if self.unseen and self.tag[self.open[-1]] == "head" and data.strip():
            self._close("head", frozenset())
        if self.unseen or (self.fresh and not data.strip()):
            return
        if self.fresh:
            block = next(n for n in reversed(self.open) if self.tag[n] not in INLINE)
            self.runs.append((block, self.open[-1], []))
            self.fresh = False
        self.runs[-1][2].append(data)
        if "a" in (self.tag[n] for n in self.open[1:]):
            self.linked = getattr(self, "linked", {})
            self.linked[len(self.runs) - 1] = self.linked.get(len(self.runs) - 1, 0) + len(data.strip())


def features(page: Page) -> tuple[np.ndarray, list[str]]:
    """One row of features per element, and the text of each run."""
    n = len(page.tag)
    texts = [_SPACE.sub(" ", "".join(pieces)).strip() for _, _, pieces in page.runs]
    linked = getattr(page, "linked", {})
    chars, links, words, marks, runs = (np.zeros(n) for _ in range(5))
    first, last = np.full(n, np.inf), np.zeros(n)
    done = 0
    for k, ((block, _, _), text) in enumerate(zip(page.runs, texts, strict=True)):
        chars[block] += len(text)
        links[block] += linked.get(k, 0)
        words[block] += text.count(" ") + 1 if text else 0
        marks[block] += sum(map(text.count, ".,;:!?"))
        runs[block] += bool(text)
        first[block] = min(first[block], done)
        done += len(text)
        last[block] = done
    own, tags, depth = chars.copy(), np.ones(n), np.zeros(n)
    kids, place = np.zeros(n), np.zeros(n)
    parent = page.parent
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (chars, links, words, marks, runs, tags):
            a[p] += a[i]
        first[p] = min(first[p], first[i])
        last[p] = max(last[p], last[i])
    good, bad = np.zeros(n), np.zeros(n)
    above_good, above_bad, bad_tag = np.zeros(n), np.zeros(n), np.zeros(n)
    same: dict[tuple[int, str], int] = {}
    for i in range(n):
        a = page.attrs[i]
        found = _WORD.findall(" ".join(str(a.get(k) or "") for k in ("class", "id", "role")).lower()) if a else ()
        good[i] = sum(w in GOOD for w in found)
        bad[i] = sum(w in BAD or w.endswith("s") and w[:-1] in BAD for w in found)
        if i:
            p = parent[i]
            depth[i] = depth[p] + 1
            place[i] = kids[p]
            kids[p] += 1
            above_good[i] = above_good[p] + good[p]
            above_bad[i] = above_bad[p] + bad[p]
            bad_tag[i] = bad_tag[p] or page.tag[i] in ("nav", "footer", "aside", "header", "form")
            same[p, page.tag[i]] = same.get((p, page.tag[i]), 0) + 1
    whole = max(1.0, float(done))
    up = np.array([max(p, 0) for p in parent])
    first = np.where(np.isinf(first), whole, first)
    code = {t: k for k, t in enumerate(TAGS)}
    alike = np.array([same.get((parent[i], page.tag[i]), 1) for i in range(n)], dtype=float)
    paragraphs = np.zeros(n)
    for i in range(n - 1, 0, -1):
        paragraphs[i] += page.tag[i] in ("p", "blockquote", "pre")
        paragraphs[parent[i]] += paragraphs[i]
    x = np.stack([
        np.array([code.get(t, len(TAGS)) for t in page.tag], dtype=float),
        np.array([t in ("nav", "footer", "aside", "header", "form") for t in page.tag], dtype=float),
        np.array([t in ("article", "main") for t in page.tag], dtype=float),
        np.array([t in ("p", "h1", "h2", "h3", "blockquote", "pre") for t in page.tag], dtype=float),
        depth, place, kids[up], alike, alike / np.maximum(kids[up], 1),
        np.log1p(chars), np.log1p(own), links / np.maximum(chars, 1), chars / tags, np.log1p(tags),
        words / np.maximum(runs, 1), marks / np.maximum(words, 1), chars / whole,
        chars / np.maximum(chars[up], 1), (last - first) / whole, first / whole, last / whole,
        paragraphs, paragraphs[up], good, bad, above_good, above_bad, bad_tag,
        good[up], bad[up], links[up] / np.maximum(chars[up], 1)], axis=1)
    return x, texts


@dataclass
class Model:
    main: Trees
    none: Trees
    mixed: Trees

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        p = np.stack([t.probability(x) for t in (self.main, self.none, self.mixed)], axis=1) + 1e-6
        return np.log(p / p.sum(axis=1, keepdims=True))


def decode(parent: list[int], score: np.ndarray) -> np.ndarray:
    """True for elements inside the likeliest set of whole main subtrees."""
    n = len(parent)
    whole = score[:, :2].copy()
    inside = np.zeros(n)  # best of the children when a node is mixed
    leaf = np.ones(n, dtype=bool)
    best, choice = np.zeros(n), np.zeros(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        options = (whole[i, IN], whole[i, OUT], -np.inf if leaf[i] else score[i, MIXED] + inside[i])
        choice[i] = int(np.argmax(options))
        best[i] = options[choice[i]]
        if i:
            p = parent[i]
            whole[p] += whole[i]
            inside[p] += best[i]
            leaf[p] = False
    for i in range(1, n):
        if choice[parent[i]] != MIXED:
            choice[i] = choice[parent[i]]
    return choice == IN


def extract(model: Model, pages: list[str]) -> list[str]:
    parsed = [Page(h) for h in pages]
    both = [features(p) for p in parsed]
    scores = model.log_odds(np.concatenate([x for x, _ in both])) if both else None
    out, at = [], 0
    for page, (x, texts) in zip(parsed, both, strict=True):
        keep = decode(page.parent, scores[at:at + len(x)])
        at += len(x)
        out.append("\n".join(t for (block, _, _), t in zip(page.runs, texts, strict=True)
                             if t and keep[block]))
    return out


# Containers and boilerplate put into altered training pages.
CONTAINERS = ('<div class="content">', '<div id="main-content">', '<section class="post">', "<main>",
              '<div class="entry-content">', '<div class="story-body">', "<div>", "<article>")
INSERTS = (('<aside class="sidebar">', "</aside>"), ('<div class="comments">', "</div>"),
           ('<div class="cookie-notice">', "</div>"), ('<div class="ad">', "</div>"),
           ('<header class="site-header">', "</header>"), ('<div class="related">', "</div>"),
           ('<form class="subscribe">', "</form>"), ('<section id="comments">', "</section>"),
           ('<div class="promo banner">', "</div>"), ('<div class="share-links">', "</div>"))


def altered(html: str, others: list[str], rng: Random) -> str:
    """The page with its article in another container and boilerplate around and inside it."""
    box = rng.choice(CONTAINERS)
    name = re.match(r"<(\w+)", box)[1]
    head, found, rest = html.partition("<article")
    if not found:
        return html
    inner, _, tail = rest.partition(">")[2].rpartition("</article>")

    def insert() -> str:
        a, b = rng.choice(INSERTS)
        some = rng.choice(others)
        kind = rng.randrange(3)
        body = ("".join(f"<p>{s}</p>" for s in some.split("\n")[:rng.randint(1, 3)]) if kind == 0 else
                "<ul>" + "".join(f'<li><a href="/{w[:9]}">{w}</a></li>' for w in some.split()[:8]) + "</ul>"
                if kind == 1 else some[:rng.randint(20, 300)])
        return f'{a[:-1]} data-y="0">{body}{b}'

    parts = re.split(r"(?=<p>)", inner)
    if len(parts) > 2 and rng.random() < 0.5:
        parts.insert(rng.randrange(1, len(parts)), insert())
    main = f'{box[:-1]} data-y="1">{"".join(parts)}</{name}>'
    before = "".join(insert() for _ in range(rng.randint(0, 2)))
    after = "".join(insert() for _ in range(rng.randint(0, 3)))
    whole = before + main + after
    if rng.random() < 0.5:
        whole = f'<div class="wrapper">{whole}</div>'
    return head + whole + tail


def labels_of(page: Page) -> np.ndarray:
    """IN, OUT or MIXED for each element, from the marked article."""
    n = len(page.tag)
    inside = np.zeros(n, dtype=bool)
    for i in range(1, n):
        mark = page.attrs[i].pop("data-y", None)
        inside[i] = (mark == "1" or mark is None
                     and (page.tag[i] == "article" or inside[page.parent[i]]))
    return _labels(page, inside)


def _labels(page: Page, inside: np.ndarray) -> np.ndarray:
    n = len(page.tag)
    yes, no = np.zeros(n), np.zeros(n)
    for block, _, _ in page.runs:
        (yes if inside[block] else no)[block] += 1
    for i in range(n - 1, 0, -1):
        yes[page.parent[i]] += yes[i]
        no[page.parent[i]] += no[i]
    return np.where((yes > 0) & (no > 0), MIXED, np.where(yes > 0, IN, np.where(no > 0, OUT, np.where(inside, IN, OUT))))


MOST = 0.6  # share of an element's text that a child must hold to stand for it


def likely_labels(page: Page) -> np.ndarray:
    """IN, OUT or MIXED for each element of a page without marks, from where its text is."""
    n, parent = len(page.tag), page.parent
    bad = np.zeros(n, dtype=bool)
    for i in range(1, n):
        a = page.attrs[i]
        names = _WORD.findall(" ".join(str(a.get(k) or "") for k in ("class", "id", "role")).lower())
        bad[i] = bad[parent[i]] or page.tag[i] in ("nav", "footer", "aside", "header", "form") or any(
            w in BAD or w.endswith("s") and w[:-1] in BAD for w in names)
    linked, chars = getattr(page, "linked", {}), np.zeros(n)
    for k, (block, _, pieces) in enumerate(page.runs):
        size = len(_SPACE.sub(" ", "".join(pieces)).strip())
        if not bad[block] and 2 * linked.get(k, 0) <= size:
            chars[block] += size
    for i in range(n - 1, 0, -1):
        chars[parent[i]] += chars[i]
    best = 0
    while True:
        below = [i for i in range(best + 1, n) if parent[i] == best and chars[i] > MOST * chars[best]]
        if not below or page.tag[below[0]] in ("p", "li", "td", "pre", "blockquote"):
            break
        best = below[0]
    inside = np.zeros(n, dtype=bool)
    for i in range(n):
        inside[i] = not bad[i] and (i == best or i > 0 and inside[parent[i]])
    return _labels(page, inside)


def fit_pages(pages: list[str], seed: int = 7) -> Model:
    rng = Random(seed)
    marked = [p for p in pages if "<article" in p and "</article>" in p]
    plain = [] if marked else pages
    texts = [t for t in ("\n".join(x for x in features(Page(p))[1]) for p in marked) if t] or ["none"]
    xs, ys = [], []
    for html in marked:
        for version in (html, altered(html, texts, rng), altered(html, texts, rng)):
            page = Page(version)
            ys.append(labels_of(page))
            xs.append(features(page)[0])
    for html in plain:
        page = Page(html)
        ys.append(likely_labels(page))
        xs.append(features(page)[0])
    x = np.concatenate(xs) if xs else np.zeros((0, 31))
    y = np.concatenate(ys) if ys else np.zeros(0)
    if not len(x):  # nothing to learn from: all text is boilerplate
        empty = Trees(1, -9.0)
        return Model(empty, Trees(1, 9.0), empty)
    return Model(*(fit_trees(x, (y == k).astype(float)) for k in (IN, OUT, MIXED)))


def fit(pages: DataFrame, max_pages: int = 300, max_chars: int = 200_000) -> Model:
    """Fit on at most ``max_pages`` rows of fewer than ``max_chars`` characters, smallest hashes first.

    Rows with a marked article, or if there are none, any rows.  Rows are chosen by id, so that
    only the chosen pages reach the driver.
    """
    rows = pages.select("page_id", "html").filter(F.length("html") < max_chars)
    marked = rows.filter(F.col("html").contains("<article"))
    return fit_pages(_some(marked, max_pages) or _some(rows, max_pages))


def _some(pages: DataFrame, most: int) -> list[str]:
    chosen = (pages.select("page_id", F.xxhash64("html").alias("h")).orderBy("h", "page_id")
              .limit(most).select("page_id").distinct())
    return sorted(r.html for r in pages.join(F.broadcast(chosen), "page_id").limit(most).collect())


def main_text(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages without main text, give an empty text.  Other columns
    are ignored; repeated rows are extracted each.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = extract(shared.value, [h or "" for h in b.column("html").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id"), b.column("url"), pa.array(out, pa.string()),
                     pa.array([len(t) for t in out], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")
