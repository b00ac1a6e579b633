"""Main text of web pages: the maximum-scoring subsequence of words and tags, with weights from labelled pages.

A page is cut into tokens. Words stand in blocks, the text between two block-level tags; a block knows the elements around it. Every word scores by a logistic regression over
what its block shows (names, classes, ids and roles of its elements, words, share of links): positive where that speaks for an article. Every tag scores
negative, by how much more of its kind stands outside articles than inside, a little at least, and less where its elements speak for an article. One linear scan finds the contiguous region of highest sum; its blocks are
the text. What is nested in it and speaks against itself (an advert, a form, a list of links) is left out: the weights of the elements that hold less than half of the
region's words decide.

Labelled pages are those that mark their article with exactly one `article` or `main` element, about `train_pages` of them, chosen by a hash; one page counts for all that have the
same set of block features, so that one site's template does not outvote all others; and the layouts below, written for this purpose, which cover
what few pages mark. Scoring is one scan without a shuffle; a model is a few thousand weights at most.

Defined cases: null and empty pages, and pages without an article, have an empty text. A page without any tags is one block, its text. Text outside closed tags, unclosed and misnested
elements and cut-off pages are read as far as they go: an unclosed comment, script or style takes the rest of the page, as in a browser. Equal pages get equal texts.
An empty table gives no rows. Very long pages are scored whole. Other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ondula.llm import logistic
from ondula.llm.common import arrow_map, slices

TRAIN_PAGES = 2_000
MAX_WORD, MAX_TAG, LEAST_TAG = 3.0, 3.0, 0.02
#: Nested elements with a weight below this are no part of the text around them.
NESTED = -1.0

# Elements of HTML by how they are read.
RAW = "script style noscript template iframe textarea select option svg math object canvas audio video title head"
VOID = "area base br col embed hr img input link meta source track wbr"
BLOCKS = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "section summary table tbody tfoot thead tr caption ul"
)
#: Elements that say nothing by themselves.
PLAIN = frozenset("html body div span section table tbody tr td p".split())
_RAW, _VOID, _BLOCK = frozenset(RAW.split()), frozenset(VOID.split()), frozenset(BLOCKS.split())
#: An opening tag ends these, where they are the innermost open block.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SKIP_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in _RAW}
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?|[^<]+|<", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    name: str
    kinds: tuple[str, ...]  # features: the name, and the parts of its class, id and role
    parent: Element | None


@dataclass
class Block:
    words: list[str]
    element: Element | None
    linked: int  # words inside links
    at: int = 0  # place of its first token

    def chain(self) -> Iterator[Element]:
        e = self.element
        while e is not None:
            yield e
            e = e.parent


@dataclass
class Page:
    """Tokens in order: an int is the number of a block whose words stand here, a pair the kind of a tag and the element it stands in."""

    tokens: list = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


_kinds: dict[tuple[str, str], tuple[str, ...]] = {}


def kinds_of(name: str, attributes: str) -> tuple[str, ...]:
    if not attributes.strip():
        return (name,)
    if (found := _kinds.get((name, attributes))) is None:
        parts = {p.lower() for m in _NAMES.finditer(attributes) for p in _PARTS.findall(m[2] or m[3] or m[4] or "")}
        found = (name, *sorted("." + p for p in parts))
        if len(_kinds) > 20_000:
            _kinds.clear()
        _kinds[name, attributes] = found
    return found


def parse(source: str | None) -> Page:
    page, text = Page(), []
    top: Element | None = None
    linked = links = 0
    at, end = 0, len(source or "")

    def close_block() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split()).split(" ") if any(not t.isspace() for t in text) else []
            if words and words != [""]:
                page.tokens.append(len(page.blocks))
                page.blocks.append(Block(words, top, linked))
            text.clear()
        linked = 0

    while at < end:
        m = _TOKEN.match(source, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                text.append(html.unescape(piece))
                if links:
                    linked += len(text[-1].split())
            elif piece.startswith("<![CDATA["):
                text.append(piece[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        opens = not (m[1] or m[4])
        if name in _RAW:
            if opens and not (m[3] or m[6] or "").rstrip().endswith("/"):
                found = _SKIP_END[name].search(source, at)
                at = found.end() if found else end
                if name == "head" and not found:  # an unclosed head ends at the body
                    body = re.compile(r"<body\b|<(?:article|main|div|p|nav|header|h1)\b", re.I).search(source, m.end())
                    at = body.start() if body else end
                close_block()
                page.tokens.append((name, top))
            continue
        if name == "br":
            text.append(" ")
            page.tokens.append(("br", top))
            continue
        block = name in _BLOCK
        if block:
            close_block()
        elif name in ("td", "th"):
            text.append(" ")
        if opens:
            if name in _VOID:
                page.tokens.append((name, top))
                continue
            inner = top
            if block:
                e = top  # an open paragraph ends where a block begins
                while e is not None and (e.name not in _BLOCK or e.name == "p"):
                    e, was = e.parent, e.name
                    if was == "p":
                        inner = e
            if name in _ENDS:
                e = top
                while e is not None and e.name not in ("ul", "ol", "dl", "table", "menu"):
                    was, e = e.name, e.parent
                    if was in _ENDS[name]:
                        inner = e
                        break
            page.tokens.append((name, inner))
            top = Element(name, kinds_of(name, m[3] or m[6] or ""), inner)
        else:
            e = top
            while e is not None and e.name != name:
                e = e.parent
            if e is not None:
                top = e.parent
            page.tokens.append((name, top))
        if name == "a" or block:
            links, e = 0, top
            while e is not None:
                links += e.name == "a"
                e = e.parent
    close_block()
    return page


def size_kind(n: int) -> str:
    return "few words" if n < 4 else "some words" if n < 16 else "many words"


def features(block: Block) -> frozenset[str]:
    share = block.linked / len(block.words)
    return frozenset(k for e in block.chain() for k in e.kinds if k not in PLAIN) | {size_kind(len(block.words)), "links" if share > 0.5 else "some links" if share > 0.1 else "no links"}


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    tags: dict[str, float] = field(default_factory=dict)

    def word(self, block: Block) -> float:
        return max(-MAX_WORD, min(MAX_WORD, self.bias + sum(self.words.get(k, 0.0) for k in features(block))))

    def element(self, e: Element) -> float:
        return sum(self.words.get(k, 0.0) for k in e.kinds)

    def tag(self, kind: str, inside: Element | None) -> float:
        """Negative: the cost of its kind, less of it the more the elements around it speak for an article."""
        around = self.bias
        while inside is not None:
            around += self.element(inside)
            inside = inside.parent
        return -max(LEAST_TAG, self.tags.get(kind, LEAST_TAG) * float(logistic.sigmoid(-around)))


def best_region(scores: list[float]) -> tuple[int, int]:
    """[from, to) of the contiguous run with the highest sum, the first and longest of equals; empty without a positive score."""
    best, total, start = 0.0, 0.0, 0
    region = (0, 0)
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best and region[1] > region[0] and start == region[0]:
            best, region = total, (start, i + 1)
    return region


def extract(source: str | None, model: Model) -> str:
    page = parse(source)
    word = [model.word(b) for b in page.blocks]
    scores = [word[t] * len(page.blocks[t].words) if isinstance(t, int) else model.tag(*t) for t in page.tokens]
    start, end = best_region(scores)
    inside = [t for t in page.tokens[start:end] if isinstance(t, int)]
    held: Counter = Counter()
    for t in inside:
        for e in page.blocks[t].chain():
            held[id(e)] += len(page.blocks[t].words)
    half = sum(len(page.blocks[t].words) for t in inside) / 2
    out = []
    for t in inside:
        own = [model.element(e) for e in page.blocks[t].chain() if held[id(e)] < half]
        if sum(own) >= NESTED and min(own, default=0) >= 2 * NESTED:
            out.append(" ".join(page.blocks[t].words))
    return "\n\n".join(out)


# Labelled layouts. Each is a wrapper of elements around blocks of text.

ARTICLES = ["", "<body>", "<article>", "<main>", "<article class='post'>", "<div class='article-body'>", "<div class='post-content'>", "<div class='entry-content'>", "<div id='content'>", "<section class='story'>", "<div class='main-text'>", "<main id='main' class='content'>", "<div>", "<td class='content'>", "<div class='page-body text'>", "<section>", "<div role='main'>"]
OTHERS = [
    "<nav>", "<nav class='menu'>", "<div class='nav navbar'>", "<div id='menu'>", "<ul class='breadcrumb'>", "<div role='navigation'>", "<header>", "<div id='header'>", "<div class='site-header masthead'>", "<header class='top'>", "<div role='banner'>", "<div class='toolbar'>",
    "<footer>", "<div id='footer'>", "<div class='site-footer copyright'>", "<div role='contentinfo'>", "<footer class='legal'>", "<aside>", "<aside class='sidebar'>", "<div id='sidebar'>", "<div class='widget'>", "<div role='complementary'>", "<div class='related links'>", "<section class='related recommended'>", "<div class='tags'>",
    "<div class='ad'>", "<div class='ads'>", "<div class='advert'>", "<div class='advertisement'>", "<div class='sponsored promo'>", "<aside class='ad banner'>", "<div class='banner'>", "<section class='promotion'>", "<div class='notice'>", "<div class='cookie-notice'>", "<div id='cookie-banner' class='consent'>", "<div role='alert' class='alert'>", "<div role='dialog' class='popup modal'>", "<div class='disclaimer'>", "<div class='paywall subscribe'>",
    "<form>", "<form class='search'>", "<form class='newsletter signup'>", "<div class='login'>", "<div class='share social'>", "<section class='comments'>", "<div id='comments'>", "<section id='comments'><article class='comment'>", "<div class='comment-list'><div class='comment'>", "<ol class='commentlist'><li class='comment'>", "<div class='replies discussion'>", "<div class='reader-comments responses'>", "<div class='skip pagination pager'>", "<dialog>", "<menu>", "<div class='meta hidden'>",
]
_OWN = "<h1>{3}</h1><p>{40}</p><p>{12}</p><h2>{4}</h2><p>{1}</p><p>{20} <a>{2}</a> {25}</p><ul><li>{6}</li><li>{1}</li><li>{9} <b>{2}</b></li></ul><blockquote><p>{15}</p></blockquote><p><b>{1}<br><p>{70}</p><table><tr><td>{3}<td>{8}</tr></table><pre>{10}</pre><figure><figcaption>{7}</figcaption></figure><ol><li><a>{2}</a> {8}</li></ol><div>{30}</div><p>{2}</p><h3>{2}</h3><p>{5}</p>"
_LIST = "<ul><li><a>{1}</a></li><li><a>{2}</a></li><li><a>{1}</a></li></ul>"
_SHORT = "{8}"
_PLAIN = "<p>{14}</p><p>{1}</p><h3>{2}</h3><p>{30} <a>{2}</a></p><div>{5}</div><a>{3}</a><ul><li>{4}</li></ul>"


def _filled(wrapper: str, inner: str) -> str:
    words = re.sub(r"\{(\d+)\}", lambda m: " ".join(["w"] * int(m[1])), inner)
    return wrapper + words + "".join(f"</{n}>" for n in reversed(re.findall(r"<(\w+)", wrapper)))


def layouts() -> list[tuple[str, int]]:
    """Fragments of the labelled layouts: articles in and outside others, others in and outside articles, comments and links."""
    out = [(_filled(a, _OWN), 1) for a in ARTICLES for _ in range(4)]
    out += [(_filled(w + a, _OWN), 1) for a in ARTICLES[:14] for w in ("<div>", "<div class='container wrapper'>", "<main>", "<table><tr>")]
    for i, other in enumerate(OTHERS):
        parts = (_LIST, _SHORT, _PLAIN, _OWN)  # an article's own marks speak neither for it nor against it
        out += [(_filled(other, part), 0) for part in parts]
        out += [(_filled(ARTICLES[(i + j) % len(ARTICLES)] + other, part), 0) for j, part in enumerate(parts)]
    return out


def _marked(page: Page) -> list[int] | None:
    """Labels of the blocks of a page that marks one article; parts of it that are by their element no text of it are 0."""
    roots = {id(e): e for b in page.blocks for e in b.chain() if e.name == "article"} or {id(e): e for b in page.blocks for e in b.chain() if e.name == "main"}
    if len(roots) != 1:
        return None
    out = []
    for b in page.blocks:
        names, inside = [], 0
        for e in b.chain():
            if id(e) in roots:
                inside = 1
                break
            names.append(e.name)
        out.append(int(inside and not {"nav", "aside", "footer", "form", "menu", "dialog"} & set(names)))
    return out


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature sets and tags of labelled pages, as one string for each page."""
    for batch in slices(batches, "html"):
        rows = []
        for source in batch.column("html").to_pylist():
            page = parse(source)
            labels = _marked(page)
            rows.append(None if labels is None else observed(page, labels))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["seen"])


def observed(page: Page, labels: list[int]) -> str:
    lines = {f"{y}\t" + "\t".join(sorted(features(b))) for b, y in zip(page.blocks, labels, strict=True)}
    inside = [i for i, t in enumerate(page.tokens) if isinstance(t, int) and labels[t]]
    low, high = (inside[0], inside[-1]) if inside else (0, -1)
    lines |= {f"{'in' if low <= i <= high else 'out'}\t{t[0]}" for i, t in enumerate(page.tokens) if not isinstance(t, int)}
    return "\n".join(sorted(lines))


def learn(pages: list[str]) -> Model:
    """The model of observed pages, each with another set of features, and of the labelled layouts."""
    pages = pages + [observed(p, [y] * len(p.blocks)) for p, y in ((parse(f), y) for f, y in layouts())]
    sets: Counter = Counter()
    tags: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    sides = [0, 0]  # pages with tags outside and inside articles
    for page in pages:
        lines = [line.split("\t") for line in page.split("\n")]
        for y, *rest in lines:
            if y in ("in", "out"):
                tags[rest[0]][y == "in"] += 1
            elif y:
                sets[int(y), frozenset(rest)] += 1
        for y in {line[0] for line in lines} & {"in", "out"}:
            sides[y == "in"] += 1
    names = {k: i + 1 for i, k in enumerate(sorted({k for _, s in sets for k in s}))}
    rows = np.zeros((len(sets), len(names) + 1))
    rows[:, 0] = 1
    for i, (_, s) in enumerate(sets):
        rows[i, [names[k] for k in s]] = 1
    times = list(sets.values())
    weights = logistic.fit(np.repeat(rows, times, 0), np.repeat([float(y) for y, _ in sets], times), ridge=0.3)
    costs = {t: max(LEAST_TAG, min(MAX_TAG, math.log((out + 0.5) / (sides[0] + 1)) - math.log((inside + 0.5) / (sides[1] + 1)))) for t, (out, inside) in tags.items()}
    return Model({k: float(weights[i]) for k, i in names.items()}, float(weights[0]), costs)


def fit(pages: DataFrame, html_col: str = "html", train_pages: int = TRAIN_PAGES) -> Model:
    """Learns from about `train_pages` of the pages that mark their article, chosen by a hash of the row; one for each set of features."""
    marked = pages.filter(F.lower(html_col).rlike(r"<(article|main)[\s>]"))
    share = min(1.0, train_pages / max(marked.count(), 1))
    chosen = F.pmod(F.xxhash64(*pages.columns), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = marked.filter(chosen).select(F.col(html_col).alias("html"))
    seen = arrow_map(sample, _observe, "seen string").filter("seen is not null").distinct().orderBy("seen")
    return learn([r["seen"] for r in seen.collect()])  # at most train_pages strings of a page's different features


def _extract(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [extract(s, model) for s in batch.column("html").to_pylist()]
            names = [n for n in batch.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return work


def extract_text(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = chosen.schema["page_id"].dataType.simpleString()
    return arrow_map(chosen, _extract(model), f"page_id {kind}, url string, text string, n_chars long")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_text(pages, fit(pages))
