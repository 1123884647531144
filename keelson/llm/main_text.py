"""Main text of web pages by minimum-cut labelling of blocks.

A page becomes a row of text blocks. A naive Bayes classifier over the look of a block (length,
links, marks, words, tag), trained on the table's own pages, gives log-odds; what the nearest
telling element says is one more bounded log-odds. Their sum is each block's capacity to one of
the two terminals. Neighbours, and a block and the one before it in the same element (or its
parent or grandparent), are tied by smoothness edges, which can turn a block of weak evidence.
The minimum cut is the cheapest labelling; blocks on the content side, in page order, are the
main text.

Blocks whose own cost outweighs all their edges keep their label in every minimum cut, so they
are settled first and their edges become capacities of their neighbours; maximum flow then runs
on what is left. Long pages stay cheap and the result is the same.

The classifier is fitted on an expected ``SAMPLE_PAGES`` pages chosen by a hash of the address;
blocks inside elements with a clear meaning are its labels. Its features do not see that meaning.

Defined results: a null or empty page, and one without content, gives an empty text. White
space inside a block, line breaks included, becomes one blank. Nothing is cut short.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 2_000
#: What a neighbour weighs, and a block before it in the same element, in its parent's, in its grandparent's.
NEXT_WEIGHT = 0.75
NEAR_WEIGHTS = (1.5, 1.125, 0.75)
#: Log-odds of content by what the nearest telling element says. Names of furniture are quite sure; wrappers of content hold much else.
SAYS = {-1: -4.0, 0: 0.0, 1: 2.0}
MOST_ODDS = 3.0
LEAST_ROOM = 1e-12
PAGES_AT_ONCE = 200

# Fixed values of the HTML standard and of common page furniture.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg math head title iframe object canvas audio video select textarea button datalist".split())
RAW = frozenset("script style title textarea noscript iframe".split())
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}}
BAD_TAGS = frozenset("nav aside footer form menu dialog search".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
BAD_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus feedback footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination paywall popup promo promoted promotion reader-comments related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
GOOD_TAGS = frozenset(("article", "main"))
#: Names of page furniture that inside an article name its own head.
HEAD_WORDS = frozenset(("header", "masthead"))
GOOD_WORDS = frozenset("article articlebody body content entry main post story text".split())

# A quote opens a value only where one begins, after an equals sign; elsewhere it is a character like any other.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s>\"'][^\s>]*)?)*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Element:
    tag: str
    number: int
    verdict: int = 0  # of all elements down to this one: -1 furniture, 1 content, 0 none
    by_tag: bool = False
    link: bool = False
    unseen: bool = False
    inside: bool = False  # an article
    holder: tuple[str, int] = ("", 0)  # tag and number of the nearest block element
    path: tuple[int, int, int] = (0, 0, 0)  # numbers of the three nearest block elements, this one first


@dataclass
class Block:
    tag: str
    path: tuple[int, int, int]
    verdict: int
    parts: list = field(default_factory=list)
    linked: int = 0
    text: str = ""


def meaning_of(tag: str, attributes: str, inside_article: bool) -> tuple[int, bool]:
    """What an element says of its text, and whether its tag (not a name) says so."""
    if tag in BAD_TAGS or tag == "header" and not inside_article:
        return -1, True
    words: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "itemprop"):
            words.update(_WORDS.findall(value))
        elif key == "role" and value in BAD_ROLES:
            return -1, True
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return -1, True
    if tag in GOOD_TAGS:
        return (-1, False) if words & {"comment", "comments", "reply", "related", "teaser", "promo", "ad", "sponsored"} else (1, True)
    if tag in ("html", "body"):
        return 0, False
    if words & (BAD_WORDS - HEAD_WORDS if inside_article else BAD_WORDS):
        return -1, False
    return (1, False) if words & GOOD_WORDS else (0, False)


def blocks_of(html: str | None) -> list[Block]:
    """The page's text blocks in order, with decoded and collapsed text."""
    html, stack, blocks = html or "", [Element("", 0)], []
    open_: Counter = Counter()
    current: Block | None = None
    made, at = 0, 0

    def close() -> None:
        nonlocal current
        if current is not None:
            current.text = _SPACE.sub(" ", unescape("".join(current.parts))).strip()
            if current.text:
                blocks.append(current)
        current = None

    def add(raw: str) -> None:
        nonlocal current
        top = stack[-1]
        if top.unseen or not raw:
            return
        if current is None:
            if raw.isspace():
                return
            current = Block(top.holder[0], top.path, top.verdict)
        current.parts.append(raw)
        if top.link:
            current.linked += len(raw)

    def pop() -> None:
        tag = stack.pop().tag
        open_[tag] -= 1
        if tag in BLOCKS:
            close()

    while at < len(html):
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if open_[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            elif tag in BLOCKS:
                close()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in EMPTY:
            if tag == "hr":
                close()
            continue
        while len(stack) > 1:
            opened = stack[-1].holder[0]
            if opened not in CLOSED_BY or tag not in CLOSED_BY[opened]:
                break
            while stack[-1].tag != opened:
                pop()
            pop()
        if tag in BLOCKS:
            close()
        made += 1
        up = stack[-1]
        said, by_tag = meaning_of(tag, m[3], up.inside)
        element = Element(tag, made, up.verdict, up.by_tag, up.link or tag == "a", up.unseen or tag in UNSEEN, up.inside or tag in GOOD_TAGS, up.holder, up.path)
        if tag in BLOCKS:
            element.holder, element.path = (tag, made), (made, *up.path[:2])
        if said < 0:
            element.verdict, element.by_tag = -1, by_tag or (up.verdict < 0 and up.by_tag)
        elif said > 0 and (up.verdict >= 0 or by_tag and not up.by_tag):
            # An article inside something merely named like furniture is an article.
            element.verdict, element.by_tag = 1, False
        if m[3].endswith("/") and tag in ("svg", "math"):
            continue
        stack.append(element)
        open_[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = end.start() if end else len(html)
    close()
    return blocks


def features(block: Block) -> tuple[tuple[str, int], ...]:
    """Binned features; none of them looks at the meaning of elements."""
    length = len(block.text)
    words = block.text.count(" ") + 1
    marks = sum(block.text.count(c) for c in ".,;:!?")
    return (
        ("length", min(9, length.bit_length())),
        ("links", min(4, 4 * block.linked // max(1, length))),
        ("marks", min(4, 20 * marks // words)),
        ("word", min(9, length // words)),
        ("tag", 1 if block.tag[:1] == "h" and block.tag[1:].isdigit() else 2 if block.tag == "p" else 3 if block.tag in ("li", "dt", "dd") else 4 if block.tag in ("td", "th") else 5),
    )


#: What is assumed before any page is seen: (feature, bin, content) and its weight in blocks.
PRIOR = {("links", 4, 0): 8.0, ("links", 3, 0): 4.0, ("tag", 2, 1): 4.0, ("tag", 1, 1): 2.0, ("length", 9, 1): 6.0, ("length", 8, 1): 4.0, ("length", 3, 0): 3.0, ("length", 4, 0): 3.0, ("marks", 1, 1): 2.0}


@dataclass(frozen=True)
class Classifier:
    odds: dict[tuple[str, int], float]

    def __call__(self, block: Block) -> float:
        return max(-MOST_ODDS, min(MOST_ODDS, sum(self.odds.get(f, 0.0) for f in features(block))))


def classifier(counts: dict[tuple[str, int, int], float]) -> Classifier:
    """Log-odds of each bin from counts by (feature, bin, is content); both labels weigh the same."""
    held: Counter = Counter(PRIOR)
    held.update(counts)
    totals: Counter = Counter()
    for (name, _, label), n in held.items():
        totals[name, label] += n
    bins = {(name, bin_) for name, bin_, _ in held}
    width = Counter(name for name, _ in bins)
    share = lambda name, bin_, label: (held[name, bin_, label] + 1) / (totals[name, label] + width[name])
    return Classifier({(n, b): math.log(share(n, b, 1) / share(n, b, 0)) for n, b in bins})


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are content. ``costs``: what calling the node furniture costs, if positive, or content, if negative."""
    around: list[dict[int, float]] = [{} for _ in costs]
    for a, b, w in edges:
        around[a][b] = around[a].get(b, 0.0) + w
        around[b][a] = around[b].get(a, 0.0) + w
    costs, label = costs[:], [None] * len(costs)
    settle = deque(range(len(costs)))
    while settle:
        n = settle.popleft()
        if label[n] is None and abs(costs[n]) >= sum(around[n].values()):
            label[n] = costs[n] >= 0
            for other, w in around[n].items():
                del around[other][n]
                costs[other] += w if label[n] else -w
                settle.append(other)
            around[n] = {}
    free = [n for n, x in enumerate(label) if x is None]
    if free:
        for n, content in zip(free, _max_flow(free, costs, around)):
            label[n] = content
    return label


def _max_flow(free: list[int], costs: list[float], around: list[dict[int, float]]) -> list[bool]:
    """Flow from content (source) to furniture (sink) in phases of blocking flows; what the source still reaches is content."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {n: dict(around[n]) for n in free}
    room[source], room[sink] = {}, {}
    for n in free:
        room[source][n], room[n][source] = max(0.0, costs[n]), 0.0
        room[n][sink], room[sink][n] = max(0.0, -costs[n]), 0.0
    while True:
        depth, queue = {source: 0}, deque([source])
        while queue:
            n = queue.popleft()
            for other, w in room[n].items():
                if w > LEAST_ROOM and other not in depth:
                    depth[other] = depth[n] + 1
                    queue.append(other)
        if sink not in depth:
            return [n in depth for n in free]
        # Along a path, each node tries the ways on that it has not found closed in this phase.
        ways = {n: iter(room[n]) for n in depth}
        path = [source]
        while path:
            n = path[-1]
            if n == sink:
                steps = list(zip(path, path[1:]))
                flow = min(room[a][b] for a, b in steps)
                for a, b in steps:
                    room[a][b] -= flow
                    room[b][a] += flow
                full = next(k for k, (a, b) in enumerate(steps) if room[a][b] <= LEAST_ROOM)
                del path[full + 1 :]
                ways[path[-1]] = iter(room[path[-1]])
                continue
            on = next((m for m in ways[n] if room[n][m] > LEAST_ROOM and depth.get(m) == depth[n] + 1), None)
            if on is None:
                path.pop()
                depth[n] = -1
            else:
                path.append(on)


def terminals(blocks: list[Block], judge: Classifier) -> list[float]:
    """Each block's own cost: the classifier's log-odds and what its elements say, both bounded."""
    return [judge(b) + SAYS[b.verdict] for b in blocks]


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours and to the block before in the same element, its parent or its grandparent, the nearest of these alone."""
    edges, last = [(n, n + 1, NEXT_WEIGHT) for n in range(len(blocks) - 1)], {}
    for n, b in enumerate(blocks):
        tied = next(((last[e], w) for e, w in zip(b.path, NEAR_WEIGHTS) if e in last), None)
        if tied:
            edges.append((tied[0], n, tied[1]))
        last.update((e, n) for e in b.path if e)
    return edges


def label_blocks(blocks: list[Block], judge: Classifier) -> list[bool]:
    return minimum_cut(terminals(blocks, judge), smoothness(blocks))


def main_text(html: str | None, judge: Classifier) -> str:
    blocks = blocks_of(html)
    return "\n".join(b.text for b, content in zip(blocks, label_blocks(blocks, judge)) if content)


def _count_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in batches:
        for html in batch.column(0).to_pylist():
            for block in blocks_of(html):
                if block.verdict:
                    held.update((name, bin_, int(block.verdict > 0)) for name, bin_ in features(block))
    names, bins, labels = zip(*held) if held else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bins, pa.int32()), pa.array(labels, pa.int32()), pa.array(held.values(), pa.int64())], ["name", "bin", "label", "n"])


def fit(pages: DataFrame, url_col: str = "url", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Classifier:
    """Counts of binned features on a hash sample; at most one row per feature, bin and label comes back."""
    slots = 1 << 30
    total = pages.count()
    threshold = slots if total <= sample else int(slots * sample / total)
    chosen = pages.where(F.pmod(F.xxhash64(F.lit("page-sample"), F.col(url_col).cast("string")), F.lit(slots)) < threshold)
    counted = chosen.select(F.col(html_col).cast("string")).mapInArrow(_count_features, "name string, bin int, label int, n long").groupBy("name", "bin", "label").agg(F.sum("n").alias("n"))
    return classifier({(r["name"], r["bin"], r["label"]): float(r["n"]) for r in counted.collect()})


def _extract(judge: Classifier):
    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(at, PAGES_AT_ONCE)
                texts = [main_text(html, judge) for html in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return extract


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", judge: Classifier | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    judge = judge or fit(pages, url_col, html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract(judge), "page_id long, url string, text string, n_chars long")
