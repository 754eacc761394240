"""Main text of web pages as a maximum-scoring subsequence (operator 2).

A page is a sequence of tags and runs of words. Tags score below zero, words
above zero or below it by the kind of element they stand in; the weights are log
odds counted on labelled pages, which are those whose authors mark the content
by exactly one article or main element. One linear scan finds the contiguous
region with the greatest sum, and the region's words are the main text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
    r"""|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|select|object|canvas|noframes|xmp)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^<>]*>""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
CELL = frozenset(("td", "th"))
#: Elements that hold no article text, whatever their names.
OUTSIDE = frozenset("nav footer aside form head button menu dialog fieldset label input legend figcaption".split()) - {"figcaption"}
#: Words in class, id or role that tell an advert, a menu, a sidebar, a notice or comments wherever they stand in a name.
OUTSIDE_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising adbox promo promos promotion sponsor sponsored "
    "menu menus nav navbar navigation navi breadcrumb breadcrumbs masthead topbar colophon sidebar widget widgets "
    "cookie cookies gdpr modal paywall newsletter comment comments commentlist commentform disqus "
    "related recommended recommendations pagination pager toolbar complementary contentinfo".split()
)
#: Words that may also be a subject or a style: they tell it only as the whole of a name, or as its last word.
OUTSIDE_ENDS = frozenset(
    "banner header footer copyright aside rail consent notice notices notification popup overlay alert disclaimer subscribe subscription signup login register "
    "share sharing social respond reply replies discussion feedback reader trending popular search searchbox skip".split()
)
#: Words that may stand beside one of these in a name; a name with any other word is about a subject.
BESIDE_NAMES = frozenset(
    "site page main left right top bottom upper lower primary secondary global local mobile desktop user reader list lists box boxes area section wrapper wrap container block bar inner outer holder "
    "panel group row col column columns slot unit space zone region body text content thread count form links link buttons button icons posts articles stories news the all latest more".split()
)
#: A name that follows one of these is about a layout, not about the element.
LAYOUT_NAMES = frozenset("has no with without hide show is page".split())
#: The header of one of these is part of the article.
ARTICLE_NAMES = frozenset("entry post article story content".split())
CONTENT = frozenset(("article", "main"))
#: Elements inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
KINDS = ("outside", "link", "item", "heading", "paragraph", "plain")


@dataclass(frozen=True)
class HtmlParams:
    #: Pages that the weights are counted on, at most (but for ties): those with the smallest hash of their id.
    labelled_pages: int = 5_000
    most_weight: float = 3.0
    #: Bounds of what a tag costs. Tags are seen this often before their own odds outweigh those of all tags.
    least_tag_cost: float = 0.05
    most_tag_cost: float = 0.5
    prior_tags: float = 200.0


#: Where no page is labelled. "outside" is a tag in, or a run of words in, an element that is told to be outside.
DEFAULT_WEIGHTS = {"word outside": -0.5, "word link": -0.5, "word item": 0.3, "word heading": 1.0, "word paragraph": 1.0, "word plain": 0.5, "tag": -0.3, "tag outside": -0.3}
#: A tag inside a line costs less than a hundredth of the most that a word gives.
INLINE_COST = -0.01
#: Inside an article or main element each word outside none of the others gives this at least, and all that lies between two
#: such words costs less; elsewhere what lies in elements that are told to be outside costs so much at most.
CONTENT_WORD, CONTENT_GAP, OUTSIDE_GAP = 0.5, -0.4, -3.0


def tells_outside(value: str) -> bool:
    """Whether a class, id or role has a name of an element outside the article, and nothing else in the name."""
    for word in value.split():
        names = [x.lower() for x in PART.findall(word)]
        if not all(x in BESIDE_NAMES or x in OUTSIDE_NAMES or x in OUTSIDE_ENDS or x in LAYOUT_NAMES or x in ARTICLE_NAMES for x in names):
            continue
        for k, name in enumerate(names):
            before = names[k - 1] if k else ""
            if before in LAYOUT_NAMES or (name == "header" and before in ARTICLE_NAMES):
                continue
            if name in OUTSIDE_NAMES or (name in OUTSIDE_ENDS and k == len(names) - 1):
                return True
    return False


def is_outside(name: str, attributes: str) -> bool:
    """Whether an element is hidden, or told to be outside the article by its kind or its names."""
    if name in CONTENT or name in ("body", "html"):
        return False
    if name in OUTSIDE:
        return True
    if attributes.strip(" /"):
        for m in ATTRIBUTE.finditer(attributes):
            key = m[1].lower()
            if key == "hidden":
                return True
            value = m[2] or m[3] or m[4] or ""
            if key == "aria-hidden" and value.strip().lower() == "true":
                return True
            if key == "style" and UNSEEN.search(value):
                return True
            if key in ("class", "id", "role") and tells_outside(value):
                return True
    return False


#: Names of tags that have weights of their own.
COUNTED = (BLOCK | VOID | CELL | {"outside"}) - INLINE
KIND = {"a": "link", "li": "item", "p": "paragraph", "blockquote": "paragraph", "pre": "paragraph", "td": "paragraph"} | {f"h{k}": "heading" for k in range(1, 7)}
#: Elements that end an open one of the same name before them.
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())


class Open:
    """The open elements: for each its name, whether it is outside, within content, and the kind of words in it.

    Names are counted, so that a tag that closes nothing costs nothing however
    deep the elements stand.
    """

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, str]] = []
        self.count: Counter = Counter()

    def top(self) -> tuple[str, bool, bool, str]:
        return self.stack[-1] if self.stack else ("", False, False, "plain")

    def push(self, name: str, outside: bool, within: bool) -> None:
        above = self.top()[3]
        kind = above if name in INLINE and (name != "a" or above in ("paragraph", "heading")) else KIND.get(name) or ("plain" if name in BLOCK else above)
        self.stack.append((name, outside, within, kind))
        self.count[name] += 1

    def cut(self, k: int) -> None:
        for entry in self.stack[k:]:
            self.count[entry[0]] -= 1
        del self.stack[k:]

    def close(self, name: str, within_block: bool = False) -> None:
        """Closes the last open element of that name and all inside it; with within_block not beyond a block element."""
        if not self.count[name]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            own = self.stack[k][0]
            if own == name:
                self.cut(k)
                return
            if within_block and own in BLOCK and not (name == "li" and own == "p"):
                return


def parse(html: str) -> list[tuple[str, str, bool, str]]:
    """Tokens (feature, text, inside a content element, break before): a tag has no text."""
    out: list[tuple[str, str, bool, str]] = []
    elements = Open()
    gap, at = "", 0

    def words(a: int, b: int) -> None:
        nonlocal gap
        if a >= b:
            return
        raw = html[a:b]
        text = unescape(raw) if "&" in raw else raw
        if not text.strip():
            gap = gap or " "
            return
        _, outside, within, kind = elements.top()
        out.append((f"word {'outside' if outside else kind}", text, within, gap))
        gap = ""

    for m in MARKUP.finditer(html):
        words(at, m.start())
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m["raw"]:
                gap = gap or " "
            continue
        if name in BLOCK:
            gap = "\n"
        elif name in CELL and gap != "\n":
            gap = " "
        _, outside, within, _ = elements.top()
        if m["end"]:
            out.append(("tag outside" if outside else f"tag {name}", "", within, ""))
            elements.close(name)
        elif name in VOID:
            out.append(("tag outside" if outside else f"tag {name}", "", within, ""))
        else:
            if name in CONTENT and not within:  # content does not stand inside what was left open around it
                elements.cut(0)
            elif name in CLOSES_ITSELF:
                elements.close(name, within_block=True)
            _, outside, within, _ = elements.top()
            attributes = m["attributes"] or ""
            own = is_outside(name, attributes) or (name == "header" and not within)
            out.append(("tag outside" if outside or own else f"tag {name}", "", within, ""))
            if not (name == "body" or attributes.rstrip().endswith("/")):
                elements.push(name, outside or own, within or name in CONTENT)
    words(at, len(html))
    return out


def count_weights(pages: DataFrame, params: HtmlParams) -> dict[str, float]:
    """Log odds of each feature to stand inside the content of labelled pages.

    The sample is bounded by labelled_pages; the counts that reach the driver
    are one row a feature: the kinds of words and HTML's element names.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for html in batch.column("html").to_pylist():
                for feature, text, within, _ in parse(html):
                    total[feature if feature[4:] in COUNTED or text else "tag", within] += len(text.split()) if text else 1
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["feature", "inside", "n"])

    marks = F.regexp_count("html", F.lit("(?i)<(article|main)[\\s>]"))
    # the ids are chosen first, so no page travels; then only the chosen pages are read, where they lie
    labelled = pages.where(marks == 1).withColumn("h", F.xxhash64("page_id"))
    last = labelled.select("h").orderBy("h").limit(params.labelled_pages).agg(F.max("h")).first()[0]
    sample = pages.where(F.xxhash64("page_id") <= F.lit(last if last is not None else -(1 << 63))).where(marks == 1).select("html")
    rows = sample.mapInArrow(count, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()
    own = {(r["feature"], r["inside"]): r["n"] for r in rows}
    return learned(own, params)


def learned(own: dict[tuple[str, bool], int], params: HtmlParams) -> dict[str, float]:
    """Weights from how often each feature stands inside and outside of content.

    A tag's odds are drawn towards those of all tags, so that an element that
    the labelled pages' articles hardly use costs as much as most do.
    """
    weights = dict(DEFAULT_WEIGHTS)
    names = {f for f, _ in own}
    words, tags = [f for f in names if f.startswith("word")], [f for f in names if f.startswith("tag") and f != "tag outside"]
    n = lambda f, side: own.get((f, side), 0)
    inside, outside = (sum(n(f, side) for f in words) + 1 for side in (True, False))
    for f in words:
        odds = math.log((n(f, True) + 0.5) / inside * outside / (n(f, False) + 0.5))
        odds = max(-params.most_weight, min(params.most_weight, odds))
        least = {"word paragraph": CONTENT_WORD, "word heading": CONTENT_WORD, "word plain": 0.3, "word item": 0.3}.get(f, -params.most_weight)
        weights[f] = DEFAULT_WEIGHTS[f] if f == "word outside" else max(odds, least)
    inside, outside = (sum(n(f, side) for f in tags) for side in (True, False))
    # a word inside is worth as much as one tag of all: the share of tags among what stands outside, against that inside
    mean = math.log((inside + 1) / (sum(n(f, True) for f in words) + 1) / (outside + 1) * (sum(n(f, False) for f in words) + 1))
    bounded = lambda odds: max(-params.most_tag_cost, min(-params.least_tag_cost, odds))
    weights["tag"] = bounded(mean) if tags else DEFAULT_WEIGHTS["tag"]
    for f in tags:
        k = params.prior_tags
        there = n(f, True) + n(f, False)
        odds = math.log((n(f, True) + 0.5) / (inside + 1) * (outside + 1) / (n(f, False) + 0.5))
        weights[f] = bounded((there * bounded(odds) + k * weights["tag"]) / (there + k)) if n(f, True) else weights["tag"]
    return weights


def region(scores: list[float]) -> tuple[int, int]:
    """Ends of the contiguous run of the greatest positive sum, the first of equals; (0, 0) if none is positive."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best:
            best, best_at = total, (start, k + 1)
    return best_at


def token_scores(tokens: list[tuple[str, str, bool, str]], weights: dict[str, float]) -> list[float]:
    """What each token adds to a region that holds it."""
    tag = weights["tag"]
    scores: list[float] = []
    gap: list[int] = []
    for k, (feature, text, within, _) in enumerate(tokens):
        if text and feature != "word outside":
            weight = weights[feature]
            if gap:
                held = sum(scores[i] for i in gap)
                told = sum(scores[i] for i in gap if tokens[i][0].endswith(" outside"))
                least = max(held, CONTENT_GAP) if all(tokens[i][2] for i in gap) else held - told + max(told, OUTSIDE_GAP)
                if held < least:
                    for i in gap:
                        scores[i] *= least / held
                gap.clear()
            scores.append((max(weight, CONTENT_WORD) if within else weight) * len(text.split()))
        else:
            # what is told to be outside is left out of the text anyway; a run of its words costs like a tag, so content may go on behind it
            scores.append(weights[feature] if text else INLINE_COST if feature[4:] in INLINE else weights.get(feature, tag))
            gap.append(k)
    return scores


def main_text(html: str, weights: dict[str, float]) -> str:
    """Text of the best region: blank runs inside a block are one space, blocks are joined by one line feed."""
    tokens = parse(html)
    a, b = region(token_scores(tokens, weights))
    blocks: list[list[str]] = [[]]
    for feature, text, _, gap in tokens[a:b]:
        if text:
            if gap == "\n":
                blocks.append([])
            if feature != "word outside":
                blocks[-1].append((" " if gap == " " else "") + text)
            elif blocks[-1]:
                blocks[-1].append(" ")
    lines = (" ".join("".join(x).split()) for x in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, params: HtmlParams | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null or empty page, and one without content, has an empty text; null ids
    and urls are kept; repeated rows give a row each. Elements left open, tags
    that do not close and unfinished comments are read to the end of the page.
    """
    params = params or HtmlParams()
    spark = pages.sparkSession
    arrow_rows(spark)
    weights = spark.sparkContext.broadcast(count_weights(pages.select("page_id", "html"), params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, weights.value) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
