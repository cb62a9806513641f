"""Main text of HTML pages by line-block distribution: strip markup to lines, sum text lengths over sliding windows of
lines, find where the sums surge and dive, keep the text between."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from gneiss.llm.common import by_batch, utf8

WINDOW = 3
#: A window has surged when its lines weigh so much: about as many characters outside links.
SURGE = 80

# Fixed values of HTML: which elements end a line, have no end tag, hold raw text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead title tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg object canvas".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

#: Elements, roles and names of what surrounds an article.
AROUND_TAGS = frozenset("nav header footer aside form button select datalist dialog menu head fieldset".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
AROUND_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar notice notices cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments commentlist "
    "disqus reply replies respond pagination pager copyright legal disclaimer alert toast widget skip form paywall".split()
)
#: Parts of a name that say where a thing is or what it is made of; a name is one of surroundings if it has an AROUND part and
#: none but these beside it (`cookie-bar-top` is, `menu-history` and `form-factor` are not).
NEUTRAL_NAMES = frozenset(
    "site page main global top bottom left right center inner outer upper lower fixed sticky mobile desktop box bar list item items link links button buttons btn icon icons "
    "wrap wrapper container content section area block row col column columns panel group slot unit zone module component region holder inline body title heading text label "
    "primary secondary small large big user users reader readers visitor visitors post posts article articles story stories entry entries more this us latest and js is has "
    "space rail strip header footer thread count tree level current open fluid dark light".split()
)
CONTENT_NAMES = frozenset("article content story post entry".split())

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?=/?[a-zA-Z])[^<>]*(?:\Z|(?=<))", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z][\w:-]*)")
_WORD = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


#: Surroundings that may well hold more text than the article does.
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Shares of the text above which what looks like surroundings is the page itself: if never closed or a form, and else.
OPEN_SHARE, CLOSED_SHARE = 1 / 2, 3 / 4
#: A dive, where no element tells of the article: this share of what surging windows weigh.
DIVE_SHARE = 1 / 4
#: So many times its weight may be beside what tells of an article: on the page, where unmarked surroundings are, and in a
#: main or content element. Share of the text that its container holds where no element tells.
PAGE_BESIDE, PART_BESIDE, CONTAINER_SHARE = 4, 1 / 3, 0.9


@dataclass
class Line:
    """The text of one block; chars in links; number of the innermost element; whether a header around it leaves it out."""

    text: str
    linked: int
    element: int
    left_out: bool


@dataclass
class Element:
    """An element that ends lines or surrounds; number 0 is the page.

    surrounds: by its tag or (named) its attributes; kind: 3 article, 2 main, 1 by name, 0 none; closed: by its own end."""

    tag: str
    parent: int
    surrounds: bool = False
    named: bool = False
    comments: bool = False
    kind: int = 0
    closed: bool = False


@lru_cache(64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I)


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): next((x for x in m.group(2, 3, 4) if x is not None), "") for m in _ATTRIBUTE.finditer(raw)}


def _names(a: dict[str, str]) -> list[set[str]]:
    """The parts of each name in class and id."""
    return [{w.lower() for w in _WORD.split(name) if w} for name in f"{a.get('class', '')} {a.get('id', '')}".split()]


def _around(names: list[set[str]]) -> set[str]:
    """The AROUND parts of those names that mean surroundings: all of their parts do, or say nothing."""
    return {w for parts in names for w in parts & AROUND_NAMES if all(x in AROUND_NAMES or x in NEUTRAL_NAMES or len(x) == 1 or not x.isalpha() for x in parts)}


def _element(tag: str, raw: str, parent: int, in_article: bool) -> Element:
    e = Element(tag, parent)
    a = _attributes(raw) if raw else {}
    names, role = _names(a), a.get("role", "").lower()
    e.surrounds = tag in AROUND_TAGS and not (tag == "header" and in_article)
    if not e.surrounds and raw and tag not in ("html", "body", "main", "header") and tag not in HEADINGS:
        found = _around(names)
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or role in AROUND_ROLES or re.search(r"display\s*:\s*none", a.get("style", ""))
        e.surrounds = e.named = bool(hidden) or bool(found) and not (found <= {"header"} and in_article)
    e.comments = e.surrounds and any(parts & COMMENT_NAMES for parts in names)
    if tag == "article" or role == "article":
        e.kind = 3
    elif tag == "main" or role == "main":
        e.kind = 2
    elif tag in ("div", "section") and any(parts & CONTENT_NAMES for parts in names):
        e.kind = 1
    return e


def lines_of(page: str) -> tuple[list[Line], list[Element]]:
    """The page as lines, one per block, in page order, and its elements; markup, comments and raw elements are gone,
    references decoded."""
    out: list[Line] = []
    elements = [Element("", 0, closed=True)]
    stack: list[tuple[str, int, int]] = []  # tag, its element, articles that are open before it
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a tag in the stack
    blocks: list[int] = []  # of the open elements that end lines
    text: list[tuple[str, bool]] = []
    links = inner = articles = headings = 0
    heading_header = 0  # inside a header element of an article: only headings count

    def end_line() -> None:
        nonlocal text
        if text:
            whole = " ".join(html.unescape("".join(t for t, _ in text)).split())
            linked = sum(len("".join(html.unescape(t).split())) for t, in_link in text if in_link)
            if whole:
                out.append(Line(whole, linked, inner, heading_header > 0 and not headings))
            text = []

    def leave(n: int) -> None:
        nonlocal links, inner, articles, heading_header, headings
        while len(stack) > n:
            tag, own, articles = stack.pop()
            places[tag].pop()
            if tag in BLOCKS:
                blocks.pop()
            links -= tag == "a"
            headings -= tag in HEADINGS
            heading_header -= tag == "header" and not elements[own].surrounds
        inner = stack[-1][1] if stack else 0

    at, size = 0, len(page)
    while at < size:
        m = _PIECE.search(page, at)
        if not m:
            text.append((page[at:], links > 0))
            break
        if m.start() > at:
            text.append((page[at : m.start()], links > 0))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                end_line()
            found = places[tag][-1] if places[tag] else None
            if found is not None and (tag in BLOCKS or not blocks or blocks[-1] < found):
                elements[stack[found][1]].closed = True
                leave(found)
            continue
        if tag in RAW:
            if tag in BLOCKS:
                end_line()
            if not m[3].rstrip().endswith("/"):
                close = _end_of(tag).search(page, at)
                at = close.end() if close else size
            continue
        if tag == "br":
            text.append((" ", False))
        if tag in BLOCKS:
            end_line()
            # A new item or paragraph ends an open one before it.
            closes = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ("p",))
            if blocks and stack[blocks[-1]][0] in closes:
                elements[stack[blocks[-1]][1]].closed = True
                leave(blocks[-1])
        if tag in VOID:
            continue
        e = _element(tag, m[3], inner, articles > 0)
        if tag in BLOCKS or e.surrounds or e.kind:
            elements.append(e)
            inner = len(elements) - 1
        places[tag].append(len(stack))
        if tag in BLOCKS:
            blocks.append(len(stack))
        headings += tag in HEADINGS
        stack.append((tag, inner, articles))
        articles += e.kind > 0
        links += tag == "a"
        heading_header += tag == "header" and not e.surrounds
    end_line()
    return out, elements


def _sums(elements: list[Element], lines: list[Line], apart: set[int]) -> list[int]:
    """Weight of the lines in each element, without those that an inner element in `apart` holds."""
    sums = [0] * len(elements)
    for x, w in zip(lines, _weights(lines)):
        if not x.left_out:
            sums[x.element] += w
    for i in range(len(elements) - 1, 0, -1):
        if i not in apart:
            sums[elements[i].parent] += sums[i]
    return sums


def _inherited(elements: list[Element], own: list[bool]) -> list[bool]:
    """Whether it holds for an element or one that it is in."""
    out = own[:]
    for i in range(1, len(out)):
        out[i] |= out[elements[i].parent]
    return out


def _is_page(e: Element, held: int, free: int, found: int) -> bool:
    """Whether what seems to surround an article holds the page: found is the weight of the heaviest main or article."""
    either = held + free
    if found and e.closed and not e.named and e.tag != "form":
        return False  # its tag says what it is, and there is an article, however short
    return held > OPEN_SHARE * either and (not e.closed or e.tag == "form") or held > CLOSED_SHARE * either and found < SURGE


def surroundings(lines: list[Line], elements: list[Element]) -> list[bool]:
    """Which elements surround the article or are in one that does.

    What encloses the heaviest main or article, or most of the unlinked text, is no surroundings, whatever its name."""
    apart = {i for i, e in enumerate(elements) if e.surrounds}
    around = _inherited(elements, [e.surrounds for e in elements])
    comments = _inherited(elements, [e.comments for e in elements])
    sums = _sums(elements, lines, apart)
    free = sums[0]

    def release(i: int) -> None:
        while i:
            apart.discard(i)
            i = elements[i].parent

    found = max((sums[i] for i, e in enumerate(elements) if e.kind > 1 and not around[i]), default=0)
    # A teaser in what surrounds an article is lighter than that article, or not much heavier than a short one.
    leads = [
        i for i, e in enumerate(elements)
        if around[i] and sums[i] > found and (e.kind == 2 or e.kind == 3 and not comments[i] and 2 * sums[i] >= free and sums[i] > CLOSED_SHARE * (sums[i] + found))
    ]
    if leads:
        lead = max(leads, key=lambda i: (elements[i].kind == 2, sums[i], -i))
        found = max(found, sums[lead])
        release(lead)
    while True:  # each time, what is kept more than doubles
        sums = _sums(elements, lines, apart)
        most = max((i for i in apart if not comments[i] and _is_page(elements[i], sums[i], sums[0], found)), key=lambda i: (sums[i], -i), default=0)
        if not most:
            break
        release(most)
    out = _inherited(elements, [i in apart for i in range(len(elements))])
    if all(out[x.element] or x.left_out for x in lines):  # by elements alone
        out = _inherited(elements, [i in apart and not e.named for i, e in enumerate(elements)])
    return out


def _weights(lines: list[Line]) -> list[int]:
    """Characters outside links; a line mostly of links weighs nothing."""
    sizes = [len(x.text) for x in lines]
    return [0 if 2 * x.linked > n else n - x.linked for x, n in zip(lines, sizes)]


def surges(weights: list[int], threshold: int, window: int = WINDOW, dive: float = 0, homes: list[int] | None = None) -> list[tuple[int, int]]:
    """(start, end) of the stretches where the sum of a window of lines surges, at least threshold, up to where it dives: to
    0, or, in a window all of whose lines weigh something, not above `dive`.

    homes: the element that each line's block is in. A stretch begins with its first window, but not with the last lines of
    a block that began before it and is at home elsewhere than the window's heaviest line. Lines beside a stretch that weigh
    something and are at home with its first or last line belong to it."""
    sums, n = [], len(weights)
    run = sum(weights[:window])
    for i in range(n):
        sums.append(run)
        run += (weights[i + window] if i + window < n else 0) - weights[i]
    same = (lambda a, b: homes[a] == homes[b]) if homes else (lambda a, b: True)
    found, i, done = [], 0, 0
    while i < n:
        if sums[i] >= threshold and sums[i]:
            heavy = max(range(i, min(n, i + window)), key=lambda k: (weights[k], -k))
            start = next(k for k in range(i, n) if weights[k])
            if i > done and weights[i - 1] and same(i - 1, start) and not same(start, heavy):  # the end of another block
                start = next(k for k in range(i, n) if weights[k] and same(k, heavy))
            while i < n and (i <= heavy or sums[i] > dive or sums[i] and not all(weights[i : i + window] + [0] * (i + window - n))):
                i += 1
            while start > done and weights[start - 1] and same(start - 1, start):  # the slope that leads up to the surge
                start -= 1
            while i < n and weights[i] and same(i - 1, i):  # and down to the dive
                i += 1
            found.append((start, i))
            done = i
        else:
            i += 1
    return found


def dive_of(weights: list[int], threshold: int = SURGE, window: int = WINDOW) -> float:
    """What a page's windows dive to: a share of the middle one of the sums that surge."""
    sums = sorted(x for i in range(len(weights)) if (x := sum(weights[i : i + window])) >= threshold)
    return DIVE_SHARE * sums[len(sums) // 2] if sums else 0


def _parts(lines: list[Line], elements: list[Element]) -> set[int]:
    """The elements that are the article: {0}, the page, if none tells.

    From the page inwards, elements give way to those in them that tell more, of the heaviest kind and all of that kind,
    unless much of the text is beside these."""
    sums = _sums(elements, lines, set())
    parts = {0}
    while True:
        kind = min(elements[p].kind for p in parts)
        inner: dict[int, set[int]] = {1: set(), 2: set(), 3: set()}
        state = [0] * len(elements)  # 1: in a part, 2: in an element found in it
        for i, e in enumerate(elements):
            state[i] = state[e.parent]
            if i in parts:
                state[i] = 1
            elif state[i] == 1 and e.kind > kind and sums[i]:
                state[i] = 2
                inner[e.kind].add(i)
        weights = {k: sum(sums[i] for i in v) for k, v in inner.items()}
        best = max(weights, key=lambda k: (weights[k], k))
        beside = sum(sums[p] for p in parts) - weights[best]
        if not weights[best] or beside > (PAGE_BESIDE if parts == {0} else PART_BESIDE) * weights[best]:
            return parts
        parts = inner[best]


def _container(lines: list[Line], elements: list[Element], found: list[tuple[int, int]]) -> int:
    """The innermost element of several lines that holds nearly all that the stretches weigh."""
    weights = _weights(lines)
    held, count = [0] * len(elements), [0] * len(elements)
    for a, b in found:
        for i in range(a, b):
            held[lines[i].element] += weights[i]
            count[lines[i].element] += weights[i] > 0
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i].parent] += held[i]
        count[elements[i].parent] += count[i]
    return max(i for i in range(len(elements)) if not i or count[i] > 1 and held[i] >= CONTAINER_SHARE * held[0])


def weighted_lines(page: str) -> tuple[list[Line], list[int], list[Element], list[int]]:
    """The lines that are not stripped as surroundings, what they weigh, the page's elements, and the element of the article
    that each line is in (0: none; an empty list: elements do not tell).

    A line weighs its characters outside links, and nothing if it is mostly links. Where elements tell of the article, their
    other lines weigh one more, so that no short line parts them, and lines beside them weigh nothing."""
    lines, elements = lines_of(page)
    around = surroundings(lines, elements)
    lines = [x for x in lines if not around[x.element] and not x.left_out]
    parts = _parts(lines, elements)
    if parts == {0}:
        return lines, _weights(lines), elements, []
    part = [0] * len(elements)
    for i in range(1, len(elements)):
        part[i] = i if i in parts else part[elements[i].parent]
    own = [part[x.element] for x in lines]
    return lines, [1 + len(x.text) - x.linked if o and 2 * x.linked <= len(x.text) else 0 for x, o in zip(lines, own)], elements, own


def main_text(page: str) -> str:
    """The article's blocks joined by line ends; empty if there are none.

    The sums over sliding windows of the weighted lines decide on every page: the text between the points where they surge
    and those where they dive stays. A surge is SURGE or, if no window has that, any weight. Where elements lent weight, a
    dive is a window without weight: a list of links as long as a window parts the article and goes, a single line of links
    stays, lines of other elements are no text, and lighter stretches in an element where the text surges stay too. Else a
    dive is a window with less than DIVE_SHARE of what the page's
    surging windows have, so that teasers and the like beside the article go; what is between two stretches of their
    innermost common element stays."""
    lines, weights, elements, own = weighted_lines(page)
    if own:
        some = surges(weights, 1)
        heavy = {own[i] for a, b in surges(weights, SURGE) for i in range(a, b) if weights[i]} or {*own}
        return "\n".join(lines[i].text for a, b in some if any(own[i] in heavy and weights[i] for i in range(a, b)) for i in range(a, b) if own[i])
    homes = [elements[x.element].parent if x.element else 0 for x in lines]
    found = surges(weights, SURGE, dive=dive_of(weights), homes=homes) or surges(weights, 1)
    if not found:
        return ""
    # All from the first to the last stretch in the container; lists of links between them too.
    at = _container(lines, elements, found)
    inside = _inherited(elements, [i == at for i in range(len(elements))])
    kept = [p for p in found if any(inside[x.element] for x in lines[p[0] : p[1]])]
    return "\n".join(x.text for x in lines[kept[0][0] : kept[-1][1]])


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """A row per row of pages: page_id, url, text, n_chars (code points).

    Null or empty html, or a page without an article: text empty. Pages are independent and read whole: repeats, ties,
    cut-off markup and long pages need nothing special; other columns are not read; an empty table gives no rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x.decode("utf-8", "replace")) for x in utf8(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return by_batch(pages.select(page_id, url, markup), run, f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars long")
