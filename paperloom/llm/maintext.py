"""Main text of web pages as the maximum-scoring contiguous run of tokens."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import hash_share

#: Documented bound of the labelled pages that teach the weights, about.
MAX_LABELLED = 4000
TOKEN = re.compile(
    r"<(?:svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|template|noscript|svg|math|iframe|textarea|select|title|xmp|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose end does not break a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that speak against an article.
OUTSIDE = frozenset("head nav aside footer form menu dialog button fieldset object audio video canvas datalist output progress meter".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that say the same.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments reply replies disqus respond form newsletter "
    "subscribe subscription signup login search share sharing social related recommended recommendations widget toolbar pagination pager copyright hidden skip".split()
)
#: Parts of a class or id that turn such a word into layout: ``with-sidebar``, ``no-comments``, ``share-enabled``.
LAYOUT_PARTS = frozenset("no not non without with has have is js on off enabled disabled open closed allowed layout page".split())
#: Outside elements that never hold the article, however many words they have.
HARD = frozenset("head header nav aside footer menu dialog button select datalist".split())
#: Evidence of one listed word, what a learned class may weigh at most, and the sum at which an element is outside.
LISTED, LEARNED, GONE = -4.0, 3.0, -2.0
#: What a word of a marked article gains, what other words and tags of such a page cost, and a block of an article's header.
MARKED, UNMARKED, IN_HEADER = 3.0, 0.25, 5.0
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements, roles and class words that mark the article itself, where a page has them.
MAIN_ROLES = frozenset(("main", "article"))
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
#: Zones of a word: inside the marked article, outside of it, or on a page without one.
IN, OUT, FREE = 0, 1, 2


@dataclass
class Token:
    kind: str  # name of a tag, or "" for text
    zone: int
    linked: bool = False
    text: str = ""
    breaks: bool = True  # a tag that ends a block of text
    names: frozenset[str] = frozenset()  # classes and ids of the elements around a text


@dataclass
class Weights:
    """What a tag costs, a word earns and a class says, learned from pages that mark their article."""

    tags: dict[str, float] = field(default_factory=lambda: dict.fromkeys((*INLINE, *HEADING, "p", "br", "blockquote", "pre"), 1e-3) | dict.fromkeys("ul ol li dl dt dd table tbody tr td th section".split(), 0.3))
    other: float = 1.0
    word: float = 1.0
    link: float = 0.2
    classes: dict[str, float] = field(default_factory=dict)


@dataclass
class Element:
    name: str
    parent: int
    evidence: float = 0.0
    mark: int = 0  # 2 for an article, 1 for another main element
    header: bool = False
    names: tuple[str, ...] = ()
    words: int = 0
    headed: bool = False  # holds a mark or a first-level heading
    out: bool = False


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(text)}


def _parts(name: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())


def _element(name: str, attributes: str, parent: int, weights: Weights) -> Element:
    """An element with what its name, role, classes and id say for or against an article."""
    made = Element(name, parent, LISTED if name in OUTSIDE else 0.0, {"article": 2, "main": 1}.get(name, 0), name == "header")
    if not attributes.strip() or name in ("body", "html"):
        return made
    found = _attributes(attributes)
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    if hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        made.evidence += 2 * LISTED
    role = found.get("role", "").lower()
    if role in OUTSIDE_ROLES:
        made.evidence += LISTED
    if not made.mark and (role in MAIN_ROLES or found.get("itemprop", "").lower() == "articlebody"):
        made.mark = 1
    made.names = tuple(dict.fromkeys(f"{found.get('class', '')} {found.get('id', '')}".split()))
    for whole in made.names:
        parts = _parts(whole)
        if not LAYOUT_PARTS.intersection(parts):
            made.evidence += LISTED * bool(OUTSIDE_WORDS.intersection(parts))
            made.header |= "header" in parts
        made.evidence += weights.classes.get(whole, 0.0)
    return made


def _read(page: str, weights: Weights) -> tuple[list[Element], list[tuple[str, int, str]]]:
    """Elements of a page (the first is the page itself), and its tags and texts in order.

    Open elements are kept on a stack, so that an element that is never closed ends with its parent.
    """
    elements, events = [Element("", -1)], []
    stack = [0]
    opened: dict[str, int] = {}
    at = 0

    def pop() -> str:
        name = elements[stack.pop()].name
        opened[name] -= 1
        return name

    def put_text(piece: str) -> None:
        if piece:
            text = html.unescape(piece)
            elements[stack[-1]].words += len(text.split())
            events.append(("", stack[-1], text))

    for m in TOKEN.finditer(page):
        put_text(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        name = m[3].lower()
        inside = [elements[i].name for i in stack[-8:]]
        if m[2]:
            if opened.get(name):
                while pop() != name:
                    pass
        else:
            attributes = m[4] or ""
            if name in ENDS_P and "p" in inside:
                above = inside[::-1].index("p")  # elements inside of the paragraph
                if all(x in INLINE for x in inside[len(inside) - above :]):
                    for _ in range(above + 1):
                        pop()
            ends = SAME_ENDS.get(name)
            while ends and len(stack) > 1 and (elements[stack[-1]].name in ends or elements[stack[-1]].name in INLINE and any(elements[i].name in ends for i in stack[-4:])):
                pop()
            if name not in VOID and not attributes.rstrip().endswith("/"):
                elements.append(_element(name, attributes, stack[-1], weights))
                stack.append(len(elements) - 1)
                opened[name] = opened.get(name, 0) + 1
        events.append((name, stack[-1], ""))
    put_text(re.sub(r"<[/!?a-zA-Z][^>]*\Z", "", page[at:]))  # without a tag that is cut off
    return elements, events


def _judge(elements: list[Element]) -> list[int]:
    """Sets ``out``; gives for each element the marks it lies in: 2 an article, 1 another main element, 3 both.

    An element is outside where the evidence against it is strong, but not where it holds half the
    words of the page along with its mark or first-level heading (a form around the page), or three quarters where there is none. An article in a
    larger article is a reader's comment.
    """
    for e in reversed(elements[1:]):
        e.headed |= e.mark > 0 or e.name == "h1"
        up = elements[e.parent]
        up.words += e.words
        up.headed |= e.headed
    page = elements[0]
    article, main = [0] * len(elements), [0] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        article[i], main[i] = article[e.parent], main[e.parent]
        against = e.evidence <= GONE or e.header and not (article[i] or main[i])
        whole = e.name not in HARD and (2 * e.words >= page.words if page.headed else 4 * e.words >= 3 * page.words) and e.headed == page.headed
        nested = e.mark == 2 and article[i] and 2 * e.words < elements[article[i]].words
        e.out = elements[e.parent].out or (against and not whole) or bool(nested)
        if e.mark == 2 and not e.out:
            article[i] = article[i] or i
        elif e.mark == 1 and not e.out:
            main[i] = main[i] or i
    return [2 * (article[i] > 0) + (main[i] > 0) for i in range(len(elements))]


def tokens(page: str, weights: Weights | None = None, every: bool = False) -> tuple[list[Token], bool]:
    """Tags and texts of a page in order; whether an article is marked.

    Elements outside leave one tag and no text, or with ``every`` their texts in the zone OUT. In the header
    of an article headings stay, and blocks whose words outweigh IN_HEADER. Articles are the mark where they hold at
    least half the words of the main elements.
    """
    elements, events = _read(page, weights or Weights())
    marks = _judge(elements)
    held = [0, 0, 0, 0]
    header, heading, linked = [0] * len(elements), [False] * len(elements), [False] * len(elements)
    names: list[frozenset[str]] = [frozenset()] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        header[i] = header[e.parent] or (i if e.header and marks[i] else 0)
        heading[i], linked[i] = heading[e.parent] or e.name in HEADING, linked[e.parent] or e.name == "a"
        if every:
            names[i] = names[e.parent] if names[e.parent].issuperset(e.names) else names[e.parent].union(e.names)
    for kind, i, text in events:
        if not kind and not elements[i].out:
            held[marks[i]] += len(text.split())
    articles, mains = held[2] + held[3], held[1] + held[3]
    best = 2 if articles and 2 * articles >= mains else 1 if mains else 0
    found: list[Token] = []
    blocks: dict[int, list[Token]] = {}  # blocks of an article's header, by their beginning
    block = -1
    for kind, i, text in events:
        out = elements[i].out
        zone = FREE if not best else IN if marks[i] & best else OUT
        if kind:
            if out and found and found[-1].kind == kind:
                continue
            if kind not in INLINE:
                block = -1
            found.append(Token(kind, zone, breaks=kind not in INLINE))
        elif not out:
            told = Token("", zone, linked[i], text, False, names[i])
            if header[i] and not heading[i]:
                block = len(found) if block < 0 else block
                blocks.setdefault(block, []).append(told)
            found.append(told)
        elif every:
            found.append(Token("", OUT, linked[i], text, False, names[i]))
    short = {id(t) for told in blocks.values() if sum(len(t.text.split()) for t in told) <= IN_HEADER for t in told}
    return [t for t in found if id(t) not in short], best > 0


def scores(found: list[Token], weights: Weights) -> np.ndarray:
    """Score of every token: words earn, tags cost; both by the evidence of where they lie."""
    out = np.zeros(len(found))
    for i, t in enumerate(found):
        if t.kind:
            cost = weights.tags.get(t.kind, weights.other)
            out[i] = -1e-6 if t.zone == IN else -min(UNMARKED, cost) if t.zone == OUT else -cost
        elif t.text and not t.text.isspace():
            if t.zone == OUT:
                out[i] = -UNMARKED
            else:
                out[i] = len(t.text.split()) * ((weights.link if t.linked else weights.word) + MARKED * (t.zone == IN))
    return out


def best_run(values: np.ndarray) -> tuple[int, int]:
    """Half-open bounds of the contiguous run with the largest sum, one linear scan; the first and shortest on ties."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(values.tolist()):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best + 1e-12:
            best, bounds = total, (start, i + 1)
    return bounds


def main_text(page: str | None, weights: Weights) -> str:
    """Text of the best run: white space inside a block is one blank, blocks are joined by one."""
    if not page:
        return ""
    found, _ = tokens(page, weights)
    first, last = best_run(scores(found, weights))
    pieces = []
    for t in found[first:last]:
        if t.kind:
            if t.breaks:
                pieces.append(" ")
        elif t.zone != OUT:
            pieces.append(t.text)
    return " ".join("".join(pieces).split())


def learn(pages: DataFrame, max_pages: int = MAX_LABELLED) -> Weights:
    """Weights from labelled pages: those that mark their article in the markup.

    About ``max_pages`` pages, chosen by a hash of the id, are read. A tag costs the logarithm of how much
    more common it is outside of the article than inside, from next to nothing to 1.5; a word in a link
    earns the share of such words that lie inside; a class or id weighs the logarithm of how much more
    common words below it are inside, up to LEARNED either way. The counts (one row per name, the 512
    most common) are summed by Spark.
    """
    total = pages.count()
    sample = pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).where(hash_share("page_id", max_pages / max(total, 1)))

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            seen: dict[str, list[int]] = {}
            for page in frame.column("html").to_pylist():
                found, labelled = tokens(page or "", every=True)
                if not labelled:
                    continue
                for t in found:
                    n = 1 if t.kind else len(t.text.split())
                    for key in [f"t:{t.kind}"] if t.kind else ["w:link" if t.linked else "w:plain", *(f"c:{x}" for x in t.names)]:
                        seen.setdefault(key, [0, 0])[t.zone == OUT] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["key", "inside", "outside"])

    counted = sample.mapInArrow(count, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    rows = {r["key"]: (r["inside"], r["outside"]) for r in counted.orderBy(F.desc(F.col("inside") + F.col("outside")), "key").limit(512).collect()}
    weights = Weights()
    for key, (inside, outside) in rows.items():
        odds = float(np.log((inside + 1) / (outside + 1)))
        if key.startswith("t:"):
            weights.tags[key[2:]] = min(1.5, max(1e-3, -odds))
        elif key.startswith("c:"):
            weights.classes[key[2:]] = min(LEARNED, max(-LEARNED, odds))
    if "w:link" in rows:
        inside, outside = rows["w:link"]
        weights.link = min(1.0, (inside + 1) / (inside + outside + 2))
    return weights


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): main text of every row of ``pages(page_id, url, html)``.

    NULL and empty html give an empty text. Rows with NULL or repeated ids come back each.
    Whole pages are read, nothing is cut. Other columns are ignored; no rows give no rows.
    """
    weights = learn(pages)  # at most 512 numbers

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = [main_text(page.as_py(), weights) for page in frame.column("html")]
            yield pa.RecordBatch.from_arrays(
                [frame.column("page_id"), frame.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(batches, "page_id long, url string, text string, n_chars long")
