"""Main text of web pages by tag-path ratios.

A page is read as blocks of text, each under its root-to-leaf path of block tags (inline tags do not count). For every path of a
page the length, punctuation, linked characters and number of its blocks are summed; the ratios per block are smoothed over
the neighbouring blocks and fused into one score with a term for the elements around a block: navigation, footers and asides weigh
little, and so do forms, roles and words in class or id that name something else (menus, adverts, comments ...), unless the element is also named
as content, holds most of the prose of a page that has no article elsewhere, or, for words that may be of the article itself, is prose
within the article. The score of a block is compared with a threshold of the page: what reaches it is content, whatever its tags are
called. The least element that holds all content bounds the result; in it, short blocks such as headings and labels are
kept that are no content by themselves, if no term speaks against them. Only invisible elements are never read.

Rows of a page table: a null or empty html gives an empty text. Each row is extracted by itself, so that null or repeated ids
stay as they are. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split()
)
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table select menu".split())
# Elements, roles and words in class or id that mark something other than the article.
UNSEEN_TAGS = frozenset(
    "script style noscript template select textarea iframe object svg canvas head title noembed noframes audio video map datalist".split()
)
OTHER_TAGS = frozenset("nav footer aside form button dialog menu search".split())
OTHER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promos promotion banner "
    "banners nav navbar navigation menu menus menubar breadcrumb breadcrumbs pagination pager sidebar sidebars footer masthead "
    "topbar toolbar comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended "
    "recommendations widget widgets teaser teasers skip hidden disclaimer copyright legal tags".split()
)
#: Of these words, those that may name a part of an article as well, and words that make another a property of the whole element.
WEAK_WORDS = frozenset("alert copyright disclaimer hidden legal notice notices related recommended sharing skip social tags".split())
MODIFIERS = frozenset("has have no not with without".split())
CONTENT_WORDS = frozenset("article content post entry story main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLES = ("article", "main")
PROSE = 40  # characters of a block that is more than a label
PUNCTUATION = re.compile("[.,;:!?…。，、；：！？؟،]")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


#: The term of the score for elements that are no part of an article by their tag, and for elements left out after a second look.
OTHER_TERM, DOUBT_TERM = 0.02, 0.1


class Block:
    """A run of text between block tags: the number of its path and of its innermost element, its linked characters, whether it stands
    in an article, in an element named as content, or in one that holds no article by its tag."""

    __slots__ = ("article", "content", "element", "leaf", "linked", "other", "path", "text")

    def __init__(self, path: int, leaf: str, element: int, text: str, linked: int, article: bool, content: bool, other: bool):
        self.path, self.leaf, self.element, self.text, self.linked = path, leaf, element, text, linked
        self.article, self.content, self.other = article, content, other

    def prose(self) -> int:
        """Characters without a link, where the text has punctuation."""
        return max(0, len(self.text) - self.linked) if PUNCTUATION.search(self.text) else 0


class Element:
    """An element of a page: its tag, what it stands in, and the first and last of its blocks."""

    __slots__ = ("end", "first", "kind", "named", "parent", "tag", "under_content")

    def __init__(self, tag: str, parent: int, kind: str, first: int, named: bool, under_content: bool):
        self.tag, self.parent, self.kind, self.first, self.end = tag, parent, kind, first, None
        self.named, self.under_content = named, under_content


def _named(value: str) -> tuple[set[str], bool]:
    """The words of a class or id that name something other than the article, and whether a name in it is one of content."""
    value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()
    names = [_WORDS.findall(name) for name in value.split()]
    names = [name for name in names if name and name[0] not in MODIFIERS]
    return {word for name in names for word in name if word in OTHER_WORDS}, any(CONTENT_WORDS.issuperset(name) for name in names)


def _kind(tag: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """``none`` for an invisible element, ``other`` for one that holds no article by its tag, ``strong`` or ``weak`` for a doubtful one, or an
    empty text; and whether its class or id names it as content."""
    if tag in UNSEEN_TAGS:
        return "none", False
    other = (tag in OTHER_TAGS and tag != "form") or (tag == "header" and not in_article)
    kind, content, words = "strong" if tag == "form" else "", False, set()
    for match in _ATTRIBUTE.finditer(attributes):
        name = match[1].lower()
        value = html.unescape(match[2] or match[3] or match[4] or "")
        if name in ("class", "id"):
            found, named = _named(value)
            content |= named
            if not (tag == "article" and "comment" not in value.lower()):
                words |= found
        elif tag in ("html", "body", "main"):
            continue
        elif name == "role" and value.lower() in OTHER_ROLES:
            kind = "strong"
        elif (name == "style" and _HIDDEN.search(value)) or (name == "aria-hidden" and value.lower() == "true"):
            return "none", False
    if tag in ("html", "body", "main"):
        return "", content
    if re.search(r"(?:^|\s)hidden(?:\s|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
        return "none", False
    if other:
        return "other", False
    if words and not content and not kind:
        kind = "weak" if words <= WEAK_WORDS else "strong"
    return kind, content


def parse(page: str) -> tuple[list[Block], list[Element]]:
    """The blocks of a page in order, without those of invisible elements, and its elements in the order in which they open. Time and
    memory grow with the page, however deep it nests: a path is a number, made of its parent's and a tag."""
    blocks: list[Block] = []
    elements: list[Element] = []
    paths: dict[tuple[int, str], int] = {}
    tags: list[str] = []  # open elements, inline ones too
    numbers: list[int] = []  # and their numbers; -1 for inline ones
    above: list[tuple[int, int, str]] = []  # number of the path, innermost element and block tag, up to each open element
    opened: Counter[str] = Counter()
    state = Counter()  # open links, articles, elements named as content, and elements of another kind
    unseen = 0  # open elements from the outermost one that is invisible on; 0: none
    parts: list[str] = []
    linked, at, size = 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                path, element, leaf = above[-1] if above else (0, -1, "")
                blocks.append(Block(path, leaf, element, text, linked, state["article"] > 0, state["content"] > 0, state["other"] > 0))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if not unseen:
            parts.append(text)
            linked += len(text) if state["a"] else 0

    def marks(number: int) -> Iterator[str]:
        element = elements[number]
        if element.tag in ("article", "main"):
            yield "article"
        if element.named:
            yield "content"
        if element.kind == "other":
            yield "other"

    def close(to: int) -> None:
        nonlocal unseen
        if any(n >= 0 for n in numbers[to:]):
            flush()
        for tag, number in zip(tags[to:], numbers[to:], strict=True):
            opened[tag] -= 1
            state["a"] -= tag == "a"
            if number >= 0:
                elements[number].end = len(blocks)
                state.subtract(marks(number))
        del tags[to:], numbers[to:], above[to:]
        if unseen and len(tags) < unseen:
            unseen = 0
            parts.clear()

    def last(wanted: frozenset[str] | set[str], until: frozenset[str] = frozenset()) -> int:
        """The innermost open element of some tags, or -1 if there is none before one of ``until``."""
        for i in range(len(tags) - 1, -1, -1):
            if tags[i] in wanted:
                return i
            if tags[i] in until:
                break
        return -1

    while at < size:
        match = _TOKEN.search(page, at)
        if match is None:
            say(page[at:])
            break
        if match.start() > at:
            say(page[at : match.start()])
        at = match.end()
        if match[2] is None:
            if match[0].startswith("<![CDATA["):
                say(html.escape(match[0][9:].removesuffix("]]>")))
            continue
        tag = match[2].lower()
        if match[1]:
            if opened[tag]:
                close(last({tag}))
            elif tag in ("p", "br"):
                flush()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in CLOSES_P and opened["p"]:
            close(last({"p"}))
        if tag in CLOSED_BY and any(opened[t] for t in CLOSED_BY[tag]):
            ends = last(CLOSED_BY[tag], SCOPES)
            while ends >= 0:  # the outermost of them in its list or table
                close(ends)
                ends = last(CLOSED_BY[tag], SCOPES) if any(opened[t] for t in CLOSED_BY[tag]) else -1
        elif tag in HEADINGS and tags and tags[-1] in HEADINGS:
            close(len(tags) - 1)
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        kind, named = ("", False) if unseen else _kind(tag, match[3], state["article"] > 0)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if match[3].endswith("/") and opened["svg"]:
            continue
        if kind:
            flush()
        path, parent, leaf = above[-1] if above else (0, -1, "")
        if tag in INLINE and not kind:
            numbers.append(-1)
            above.append((path, parent, leaf))
        else:
            if kind == "none":
                unseen = len(tags) + 1
            numbers.append(len(elements))
            elements.append(Element(tag, parent, kind, len(blocks), named or tag in ("article", "main"), state["content"] > 0))
            state.update(marks(numbers[-1]))
            if tag not in INLINE:
                path, leaf = paths.setdefault((path, tag), len(paths) + 1), tag
            above.append((path, numbers[-1], leaf))
        tags.append(tag)
        opened[tag] += 1
        state["a"] += tag == "a"
    if not unseen:
        flush()
    for element in elements:
        element.end = len(blocks) if element.end is None else element.end
    return blocks, elements


def terms(blocks: list[Block], elements: list[Element]) -> np.ndarray:
    """The term of each block for the elements around it: 1, or less where one of them is named or made for something else and does not hold
    content all the same."""
    seen = [not b.other for b in blocks]
    prose = np.cumsum([0, *(b.prose() * s for b, s in zip(blocks, seen, strict=True))])
    long = np.cumsum([0, *(b.prose() * (len(b.text) >= PROSE) * s for b, s in zip(blocks, seen, strict=True))])
    length = np.cumsum([0, *(len(b.text) * s for b, s in zip(blocks, seen, strict=True))])
    content = [s and b.content and bool(b.prose() or len(b.text) - b.linked >= PROSE) for b, s in zip(blocks, seen, strict=True)]
    held = np.cumsum([0, *content])
    against = np.zeros(len(blocks) + 1, np.int64)
    for element in elements:
        first, end = element.first, element.end
        if element.kind not in ("strong", "weak") or end == first:
            continue
        if prose[end] - prose[first] > 0.5 * prose[-1] and held[end] - held[first] == held[-1]:
            continue
        if element.kind == "weak" and element.under_content and 2 * (long[end] - long[first]) > length[end] - length[first]:
            continue
        against[first] += 1
        against[end] -= 1
    doubtful = np.cumsum(against)[:-1] > 0
    return np.where(seen, 1.0, OTHER_TERM) * np.where(doubtful, DOUBT_TERM, 1.0)


def ratios(blocks: list[Block]) -> np.ndarray:
    """Per block, of its path: characters a block, marks a block, and the linked share of its characters."""
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    for block in blocks:
        total = sums[block.path]
        total[0] += len(block.text)
        total[1] += len(PUNCTUATION.findall(block.text))
        total[2] += min(block.linked, len(block.text))
        total[3] += 1
    found = np.array([sums[block.path] for block in blocks])
    return np.stack([found[:, 0] / found[:, 3], found[:, 1] / found[:, 3], found[:, 2] / found[:, 0]], axis=1)


def scores(blocks: list[Block], weights: np.ndarray) -> np.ndarray:
    """The fused score of every block: length and marks of its path, smoothed over the neighbouring blocks, its unlinked share, and its term."""
    found = ratios(blocks)
    kernel = np.array([0.25, 0.5, 0.25])
    padded = np.vstack((found[:1, :2], found[:, :2], found[-1:, :2]))
    smooth = np.stack([np.convolve(padded[:, i], kernel, "valid") for i in range(2)], axis=1)
    top = np.maximum(smooth.max(axis=0), 1e-9)
    return np.sqrt(smooth[:, 0] / top[0] * (smooth[:, 1] + 0.1) / (top[1] + 0.1)) * (1 - found[:, 2]) * weights


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by two line feeds."""
    blocks, elements = parse(page or "")
    if not blocks:
        return ""
    weights = terms(blocks, elements)
    values = scores(blocks, weights)
    plain = values[weights == 1] if (weights == 1).any() else values
    threshold = max(plain.mean() - plain.std(), 0.15 * values.max())
    means = ratios(blocks)  # what only neighbours make a good score of, a label beside prose, is no content of its own
    chosen = (values >= threshold) & ((means[:, 1] > 0) | (means[:, 0] >= PROSE)) & np.array([b.linked < len(b.text) for b in blocks])
    if not chosen.any():
        chosen = weights == weights.max()
    places = np.flatnonzero(chosen)
    first, end = int(places[0]), int(places[-1]) + 1
    bound, around = None, blocks[first].element
    while around >= 0:  # the innermost article that holds all content, or else the innermost element
        element = elements[around]
        if element.first <= first and element.end >= end:
            bound = element if bound is None or (element.tag in ARTICLES and bound.tag not in ARTICLES) else bound
        around = element.parent
    while bound is not None and bound.parent >= 0 and bound.tag not in (*ARTICLES, "div", "section", "td", "body"):
        bound = elements[bound.parent]  # a leaf alone is not an article: what it stands in is
        break
    size = np.array([max(0, len(b.text) - b.linked) for b in blocks]) * chosen
    in_articles = size[[b.article for b in blocks]].sum() >= 0.5 * size.sum()
    kept = []
    for i, block in enumerate(blocks):
        links = block.linked >= 0.9 * len(block.text) and block.leaf in ("li", "ul", "div", "td")
        if bound is not None and not bound.first <= i < bound.end:
            continue
        around = first < i < end - 1 and not links
        whole = block.article if in_articles else not links or (bound is not None and bound.tag not in ("body", "html"))
        if chosen[i] or ((around or whole) and weights[i] == weights[places].max()):
            kept.append(block.text)
    return "\n\n".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = [main_text(page) for page in frame["html"]]
            yield pd.DataFrame(
                {"page_id": frame["page_id"], "url": frame["url"], "text": text, "n_chars": [len(x) for x in text]}
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select(*(F.col(name).alias(name) for name in ("page_id", "url", "html")))
    return rows.mapInPandas(extract, f"page_id {kind}, url string, text string, n_chars long")
