"""Main text of web pages: maximum-scoring subsequence over words and tags.

A page is a sequence of words and tags, and a linear scan finds the contiguous region with the
greatest sum of scores (Pasternack and Roth, 2009).  Scores come from labelled pages: those that
mark their article.  A word scores by log odds of standing inside an article, given the element it
stands in and the length of its run of text, from -1 to 1; what no labelled page shows scores 1.  A
tag scores below zero, by the log odds of its name, classes and id outside of articles.

Within the region an element is left out if labelled pages show its name, a class or its id outside
of articles (nearly) only, or if fixed lists say so: names of notices, adverts and comments, which an
article's mark covers too, so that labelled pages can't tell.  Scripts, styles, forms and their
like are never content.

Cases: a null or empty page, or one without content, has an empty text.  A page cut off within a
tag, a reference or an element ends there.  An unclosed container ends where an article begins.
Time and memory grow with a page's length, however deep it nests and whatever it leaves open; pages
of any length are read whole, and those too large to learn from are still extracted.
Without labelled pages the fixed lists and uniform scores decide.  Repeated rows get equal
results.  An empty table gives an empty result.  Columns other than the id, url and html are not
read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Largest number of labelled pages that weights are learned from, and code points of one of them.
MAX_LABELLED, LARGEST_LABELLED = 600, 200_000
SEED = 5
#: Score of a word that nothing is known of, of a tag, what a unit of log odds adds to that, and its end.
WORD_SCORE, TAG_SCORE, ODDS_SCORE, LEAST_TAG = 1.0, -0.1, -2.0, -12.0
#: How often the words in elements of a name must stand outside of articles for each inside.
MANY = 20
#: Words on either side that leave a run's score near that of one nothing is known of.
FEW = 50
#: Words from which on a run of text is of the next length.
LENGTHS = (4, 30, 100)
#: Elements whose text is never content.
NEVER = frozenset("head title script style noscript template svg iframe object canvas audio video form button select option textarea label input".split())
#: Elements that commonly hold what is not content.
ASIDE = frozenset("nav footer aside dialog menu".split())
#: Elements that end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of classes and ids that name what is not content.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that may stand beside those in a class or id without changing what it names.
NEUTRAL = frozenset("area bar block box container form global group inner item items list outer panel section site slot unit widget wrap wrapper".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)""", re.S)
_NAME = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


class Node:
    """An open element and, by its parents, those around it; what hangs on all of them is inherited."""

    __slots__ = ("tag", "key", "parent", "never", "main", "article", "names", "out")

    def __init__(self, key: str, parent: Node | None) -> None:
        self.key, self.parent, self.tag = key, parent, key.split(" ", 1)[0]
        self.never = self.tag in NEVER or bool(parent and parent.never)
        self.main = key == "main" or bool(parent and parent.main)
        self.article = self.tag == "article" or bool(parent and parent.article)
        self.names: frozenset | None = None
        self.out: tuple[bool, bool] | None = None

    def all_names(self) -> frozenset:
        """The names of this element and all around it."""
        chain = _missing(self, "names")
        for node in chain:
            held = node.parent.names if node.parent else frozenset()
            own = names_of(node.key)
            node.names = held if held.issuperset(own) else held.union(own)
        return self.names


def _missing(node: Node, what: str) -> list[Node]:
    """The node and those around it whose ``what`` isn't known yet, outermost first."""
    chain = []
    while node and getattr(node, what) is None:
        chain.append(node)
        node = node.parent
    return chain[::-1]


@dataclass(slots=True)
class Token:
    """A tag (``key``) or a run of text, in the open element ``within``."""

    key: str = ""
    text: str = ""
    block: bool = False
    within: Node | None = None

    @property
    def article(self) -> bool:
        return bool(self.within and self.within.article)


def tag_key(tag: str, attributes: str) -> str:
    names = sorted(f"{k.lower()}={v.strip(chr(34) + chr(39)).strip()}" for k, v in _NAME.findall(attributes)) if "=" in attributes else []
    return " ".join([tag, *names])


class _Open:
    """The open elements.  Each is pushed and taken off once, however the page nests or closes them."""

    def __init__(self) -> None:
        self.stack: list[Node] = []
        self.count: dict[str, int] = {}
        self.removable: list[int] = []

    @property
    def top(self) -> Node | None:
        return self.stack[-1] if self.stack else None

    def push(self, key: str) -> None:
        node = Node(key, self.top)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1
        if _gives_way(node):
            self.removable.append(len(self.stack))
        self.stack.append(node)

    def pop(self) -> Node:
        node = self.stack.pop()
        self.count[node.tag] -= 1
        if self.removable and self.removable[-1] == len(self.stack):
            self.removable.pop()
        return node

    def close(self, tag: str) -> Node | None:
        """Take off the elements down to the last one of a tag, if there is one."""
        if not self.count.get(tag):
            return None
        while (node := self.pop()).tag != tag:
            pass
        return node

    def make_way(self) -> None:
        """Take out what holds no article, from between the others."""
        if not self.removable:
            return
        above = []
        while len(self.stack) > self.removable[0]:
            above.append(self.pop())
            if not self.removable:
                break
        for node in reversed(above):
            if not _gives_way(node):
                self.push(node.key)


def _gives_way(node: Node) -> bool:
    return node.tag in NEVER or any(map(listed, names_of(node.key)))


def tokens(page: str) -> Iterator[Token]:
    """The page's tags and text runs in order, each with the element it stands in."""
    at, n, held = 0, len(page), _Open()
    while at < n:
        m = _TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at:
            text = page[at:start]
            yield Token(text=entities.unescape(text) if "&" in text else text, within=held.top)
        if not m:
            return
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            closed = held.close(tag)
            yield Token(key="/" + (closed.key if closed else tag), block=tag in BLOCKS, within=held.top)
            continue
        key = tag_key(tag, attributes)
        within = held.top  # the tag itself stands in what was open before it
        if tag in ("article", "main"):  # no container of another kind holds an article
            held.make_way()
        if tag in ("p", "li", "td", "th", "tr", "option", "dt", "dd") and held.top and held.top.tag == tag:
            held.pop()
        yield Token(key=key, block=tag in BLOCKS, within=within)
        if tag not in _VOID and not attributes.endswith("/"):
            held.push(key)
        if tag in _RAW and tag not in _VOID:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n


def names_of(key: str) -> list[str]:
    """What an element may be known by: an element of the fixed list, and each whole class and id.

    ``has-sidebar`` names no sidebar.  Page and main part are never judged by their names, nor is
    an article, but for one that is a comment or reply.
    """
    tag, _, names = key.partition(" ")
    if tag in ("html", "body", "main"):
        return []
    whole = [x.split("=", 1)[-1].lower() if tag == "article" else x.split("=", 1)[-1] for x in names.split()]
    if tag == "article":
        return [f".{x}" for x in whole if x in ("comment", "comments", "reply", "replies")]
    return [tag] * (tag in ASIDE) + [f".{x}" for x in whole]


def listed(name: str) -> bool:
    return name in ASIDE or name == "header" or name[0] == "." and _boilerplate(name[1:])


def _boilerplate(name: str) -> bool:
    parts = {x.lower() for x in _PARTS.findall(name)} | {name.lower()} & BOILERPLATE
    return not BOILERPLATE.isdisjoint(parts) and (name.lower() in BOILERPLATE or parts <= BOILERPLATE | NEUTRAL)


def run_of(within: Node | None, words: int) -> tuple[str, int]:
    """What the score of a run's words hangs on: the element it stands in and its length."""
    return (within.tag if within else "", sum(words >= x for x in LENGTHS))


@dataclass
class Weights:
    """Scores of words and tags, and words that labelled pages show inside and outside of articles by names of elements."""

    word: dict[tuple, float] = field(default_factory=dict)
    score: dict[str, float] = field(default_factory=dict)
    inside: dict[str, int] = field(default_factory=dict)
    outside: dict[str, int] = field(default_factory=dict)

    def of(self, key: str) -> float:
        return self.score.get(key.removeprefix("/"), TAG_SCORE)

    def strange(self, name: str) -> bool:
        """Whether an element of this name is no content."""
        return listed(name) or self.outside.get(name, 0) > MANY * (1 + self.inside.get(name, 0))

    def dropped(self, node: Node | None) -> bool:
        """Whether what stands in an element is no content."""
        if node is None:
            return False
        for x in _missing(node, "out"):
            always = x.tag in NEVER or any(map(self.strange, names_of(x.key)))
            held = x.parent.out if x.parent else (False, False)
            # a header is one outside of articles and main parts only
            x.out = (always or held[0] or x.tag == "header" and self.strange(x.tag), always or held[1])
        return node.out[node.article or node.main]


def learn(pages: list[str]) -> Weights:
    """Log odds of runs and tags inside and outside the article of pages that mark one, and words by names."""
    tags: tuple[dict, dict] = ({}, {})
    runs: tuple[dict, dict] = ({}, {})
    named: tuple[dict, dict] = ({}, {})

    def add(counts: tuple[dict, dict], key: object, article: bool, n: int) -> None:
        counts[article][key] = counts[article].get(key, 0) + n

    for page in pages:
        for t in tokens(page):
            if t.within and t.within.never:
                continue
            if t.key and not t.key.startswith("/"):
                add(tags, t.key, t.article, 1)
            n = len(t.text.split())
            if n:
                add(runs, run_of(t.within, n), t.article, n)
                for name in t.within.all_names() if t.within else ():
                    add(named, name, t.article, n)
    odds = lambda counts, k, sign: math.log((counts[sign].get(k, 0) + 1) / (counts[1 - sign].get(k, 0) + 1))
    score = {k: max(LEAST_TAG, TAG_SCORE + ODDS_SCORE * max(0.0, odds(tags, k, 0))) for k in tags[0] | tags[1]}
    word = {k: max(-1.0, min(1.0, WORD_SCORE + math.log((runs[1].get(k, 0) + FEW) / (runs[0].get(k, 0) + FEW)))) for k in runs[0] | runs[1]}
    return Weights(word, score, named[1], named[0])


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous region with the greatest sum, in one scan; empty if none is above zero."""
    best, total, start, region = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the page's best region, joined by blank lines."""
    if not page:
        return ""
    sequence = list(tokens(page))
    dropped = [weights.dropped(t.within) for t in sequence]
    bare: dict[tuple[str, bool], bool] = {}

    def score(t: Token, out: bool) -> float:
        """What takes no part scores nothing, nor do the tags that open and close it.

        Within an article the odds are for any word and tag, as labels are drawn by articles.
        """
        if out:
            return 0.0
        if not t.key:
            words = len(t.text.split())
            return words * (WORD_SCORE if t.article else weights.word.get(run_of(t.within, words), WORD_SCORE))
        place = (t.key.removeprefix("/"), t.article)
        if place not in bare:
            own = Node(place[0], None)
            own.article = place[1]
            bare[place] = weights.dropped(own)
        return 0.0 if bare[place] else TAG_SCORE if t.article else weights.of(t.key)

    scores = [score(t, out) for t, out in zip(sequence, dropped)]
    start, stop = best_region(scores)
    blocks, parts = [], []
    for t, out in zip(sequence[start:stop], dropped[start:stop]):
        if t.block and parts:
            blocks.append(" ".join("".join(parts).split()))
            parts = []
        elif t.key in ("br", "/br"):
            parts.append(" ")
        if t.text and not out:
            parts.append(t.text)
    blocks.append(" ".join("".join(parts).split()))
    return "\n\n".join(b for b in blocks if b)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_labelled: int = MAX_LABELLED) -> Weights:
    """Weights from at most ``max_labelled`` pages that mark one article, none too large, chosen by a hash of the page."""
    marked = pages.where(F.col(html_col).cast("string").contains("<article") & (F.length(F.col(html_col).cast("string")) <= LARGEST_LABELLED)).select(F.col(html_col).cast("string").alias("html"), F.xxhash64(F.col(id_col), F.lit(SEED)).alias("place"))
    rate = min(1.0, 0.9 * max_labelled / max(1, marked.count()))
    rows = marked.where(F.pmod("place", F.lit(1 << 20)) < rate * (1 << 20)).orderBy("place", "html").limit(max_labelled)
    return learn([r["html"] for r in rows.collect()])


def extract(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(weights or fit(pages, id_col, html_col))

    def run(batch: pa.RecordBatch) -> list:
        return [batch.column(0), batch.column(1), [main_text(x.as_py(), shared.value) for x in batch.column(2)]]

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_batches(rows, "page_id long, url string, text string", run)
