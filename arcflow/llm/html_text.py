"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block; headers, footers, asides, forms, adverts,
notices, reader comments and hidden parts go with it. Each line has a length: its characters
outside links and menus. A window sums the lengths of `WINDOW` lines. One rule holds for
every page: lines begin to count at a line with a length; they end at a dive, where the
window's sum falls to zero; what lies between is kept if there is a surge, a sum that reaches
the threshold: `SURGE` characters, or 1 / `MARK` of the page's greatest sum where that is less.
So menus and lists of links go because their sums are zero, and stray lines between them
because they don't surge; a short heading or a line that is only a link stays in its story.

What a page marks as its article (article, main) weighs in the lengths. In it a paragraph that
is a link is prose, a dive doesn't end the story, and only a class, id or role all of whose
words say so takes a part out: not `social-history` or `share-price`. A marked element
whose greatest sum is under 1 / `MARK` of the page's is the card of another story and goes.
Lines outside all marked elements have no length where their greatest sum doesn't exceed that
of every marked element.

Character references are decoded, white space inside a block is one space, blocks are
trimmed and joined by one space.

Defined cases: a null or empty page, or one without such text, gives an empty text;
unclosed elements end with their parent; an unclosed script, style or comment reaches to
the end; a `<` that no `>` follows is text; where a tag's quotes don't close, the next `>`
ends it and all later tags; nothing is cut off at any length; repeated rows each give a
row; other columns don't matter. One map, no shuffle; time is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 60
MARK = 4

# Elements of HTML by their role.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head header footer aside form dialog button select option fieldset label object svg math canvas audio video datalist".split())
MAIN = frozenset("article main".split())
MENU = frozenset("nav menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp".split())
#: Elements whose end tag may be left out, what ends them, and what encloses them.
ENDED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that mark what isn't the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside footer header masthead comment comments disqus respond reply replies cookie cookies consent gdpr notice notices notification popup modal overlay "
    "newsletter subscribe signup share sharing social related recommended recommendations widget pagination pager toolbar login search alert contentinfo complementary".split()
)
#: Words that mark a frame around the whole page rather than the part itself.
FRAME = frozenset("has with no without wrapper wrap layout page container main content body article".split())

#: Of these words, those that also name what an article is about: they count only beside words of place, and beside others only the rest.
WEAK = frozenset("alert search login header banner overlay widget menu reply replies respond promotion social share sharing related recommended recommendations".split())
#: Words of place and kind, which beside a marking word leave it what it is.
PLACE = frozenset(
    "site global top bottom left right upper lower primary secondary js mod module region zone area box block bar list links link button buttons btn icon icons post posts story stories item items "
    "section slot unit group inner outer row strip panel form text message title heading small large sticky fixed inline mobile desktop count thread".split()
)

RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The part of a tag up to its end or to a quote.
UNQUOTED = re.compile(r"[^>\"']*")
#: A name and its value; quoted values are taken whole, so that what they say is no name.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _noise(token: str, inside: bool) -> bool:
    """Whether a word of a class, id or role marks what isn't the article; inside a marked article all its words must say so."""
    words = {w for x in WORD.findall(token) if len(w := x.lower()) > 1}
    if words & FRAME:
        return False
    placed = words <= NOISE | PLACE
    if words & WEAK and not words & NOISE - WEAK:
        return placed and (bool(words & PLACE) or not inside)
    return bool(words & NOISE) and (placed or not inside)


def _marks(tag: str, attributes: str, inside: bool = False) -> tuple[bool, bool]:
    """(not part of the article, the article itself) by an element's name and attributes; `inside` a marked article only what is clearly none of it goes."""
    dropped, main = tag in DROPPED, tag in MAIN
    if "=" not in attributes and "hidden" not in attributes.lower():
        return dropped, main
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            dropped = True
        elif name == "itemprop":
            main |= value.lower() == "articlebody"
        elif name == "role" and value.lower() == "main":
            main = True
        elif name in ("class", "id", "role") and tag not in ("html", "body"):
            for x in value.split():
                words = {w.lower() for w in WORD.findall(x)}
                dropped |= _noise(x, inside) and tag not in MAIN | HEADINGS or bool(words & {"comment", "comments"}) and not words & FRAME and (not inside or words <= NOISE | PLACE)
    return dropped, main


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, lower-case name or empty, whether it is an end tag, attributes) of each piece of markup, raw elements and comments as wholes."""
    at, last, quoted = 0, page.rfind(">"), True

    def tag_end(k: int) -> int:
        """Where the tag whose name ends at k ends."""
        nonlocal quoted
        first = page.find(">", k) + 1
        while quoted:
            k = UNQUOTED.match(page, k).end()
            if k < len(page) and page[k] == ">":
                return k + 1
            k = page.find(page[k], k + 1) + 1 if k < len(page) else 0
            quoted = k > 0
        return first

    while 0 <= (begin := page.find("<", at)):
        mark = page[begin + 1 : begin + 2]
        if page.startswith("<!--", begin):
            at = page.find("-->", begin + 4) + 3
            at = at if at > 2 else len(page)
            yield begin, at, "", False, ""
            continue
        if begin > last:
            return
        end_tag = mark == "/"
        name = NAME.match(page, begin + 1 + end_tag)
        if name:
            at = tag_end(name.end())
            tag, more = name[0].lower(), page[name.end() : at]
            if tag in RAW and not end_tag:
                close = RAW_ENDS[tag].search(page, at)
                at, tag = close.end() if close else len(page), ""
            yield begin, at, tag, end_tag, more
        elif mark in ("!", "?", "/"):
            at = page.find(">", begin) + 1
            yield begin, at, "", False, ""
        else:
            at = begin + 1


class _Stack:
    """Open elements, each (name, dropped, in a menu, number of the outermost marked element), and where those of a name are."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, bool, int]] = []
        self.where: dict[str, list[int]] = {}

    def top(self) -> tuple[str, bool, bool, int]:
        return self.open[-1] if self.open else ("", False, False, 0)

    def push(self, row: tuple[str, bool, bool, int]) -> None:
        self.where.setdefault(row[0], []).append(len(self.open))
        self.open.append(row)

    def cut(self, k: int) -> None:
        while len(self.open) > k:
            self.where[self.open.pop()[0]].pop()

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of these names, or -1."""
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=-1)


def lines(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters outside links and menus, dropped, number of the outermost marked element or 0) of each line in page order.

    A dropped span's text is left out of its line; it ends with its end tag or its block.
    """
    out: list[tuple[str, int, bool, int]] = []
    stack, parts = _Stack(), []
    free = links = at = marked = spans = 0

    def flush() -> None:
        nonlocal free
        text = "".join(parts)
        parts.clear()
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.split())
        if text:
            _, dropped, menu, region = stack.top()
            out.append((text, 0 if menu else min(free, len(text)), dropped, region))
        free = 0

    def take(text: str) -> None:
        nonlocal free
        if text and not spans:
            parts.append(text)
            # A paragraph of a marked article is prose, be it a link; entries of lists that are links are a menu.
            if not links or (stack.top()[0] == "p" and stack.top()[3]):
                free += len(text.strip())

    for begin, end, tag, end_tag, more in _tags(page):
        if begin > at:
            take(page[at:begin])
        at = end
        if not tag:
            continue
        if tag == "a":
            links = 0 if end_tag else 1
        if tag == "span":
            if end_tag:
                spans = max(0, spans - 1)
            elif spans or _marks(tag, more)[0]:
                spans += 1
        if tag in INLINE:
            continue
        if end_tag:
            k = stack.last((tag,))
            if k >= 0 or tag == "p":
                flush()
                spans = 0
            if k >= 0:
                links = 0
                stack.cut(k)
            continue
        flush()
        if tag in VOID:
            continue
        if tag in ENDED:
            ended, within = ENDED[tag]
            k = stack.last(ended)
            if k > stack.last(within):
                stack.cut(k)
        else:
            while stack.open and (stack.top()[0] == "p" or (tag in HEADINGS and stack.top()[0] in HEADINGS)):
                stack.cut(len(stack.open) - 1)
        links = spans = 0
        dropped, main = _marks(tag, more, stack.top()[3] > 0)
        _, up_dropped, up_menu, region = stack.top()
        marked += main
        if not more.endswith("/>") or tag in MAIN:
            stack.push((tag, up_dropped or dropped, up_menu or tag in MENU, region or marked * main))
    take(page[at:])
    flush()
    return out


def sums(lengths: list[int]) -> np.ndarray:
    """For each line the length of the window that it begins."""
    return np.convolve(lengths, np.ones(WINDOW, np.int64))[WINDOW - 1 :]


def runs(lengths: list[int]) -> list[tuple[int, int, bool]]:
    """Begin, end and whether there is a surge of each run of lines; a run begins at a line with a length and ends before a dive."""
    if not len(lengths):
        return []
    blocks = sums(lengths)
    threshold = min(SURGE, blocks.max() / MARK)
    out, begin, surge = [], -1, False
    for k, total in enumerate([*blocks.tolist(), 0]):
        if total == 0:
            if begin >= 0:
                out.append((begin, k, surge))
            begin, surge = -1, False
        else:
            if begin < 0 and lengths[k]:
                begin = k
            surge |= begin >= 0 and total >= threshold
    return out


def between_surge_and_dive(lengths: list[int]) -> np.ndarray:
    """Of each line, whether it is in a run of lines with a surge."""
    kept = np.zeros(len(lengths), bool)
    for begin, end, surge in runs(lengths):
        kept[begin:end] |= surge
    return kept


def continued(kept: np.ndarray, lengths: list[int], regions: list[int]) -> np.ndarray:
    """`kept`, and of a marked element (`regions`, 0: none) with lines that are kept, the lines of all its runs: a dive within the article parts it, but doesn't end it."""
    marks = np.array(regions, np.int64)
    told = np.unique(marks[kept & (marks > 0)])
    out = kept.copy()
    for begin, end, _ in runs(lengths):
        out[begin:end] |= np.isin(marks[begin:end], told)
    return out


def main_text(page: str | None) -> str:
    """The main text of one page."""
    found = [x for x in lines(page or "") if not x[2]]
    regions: dict[int, list[int]] = {}
    for _, free, _, region in found:
        regions.setdefault(region, []).append(free)
    greatest = {r: int(sums(own).max()) for r, own in regions.items()}
    most = max(greatest.values(), default=0)
    outside = greatest.get(0, 0) > max((n for r, n in greatest.items() if r), default=0)
    found = [x for x in found if not x[3] or greatest[x[3]] * MARK >= most]
    lengths = [free if region or outside else 0 for _, free, _, region in found]
    kept = continued(between_surge_and_dive(lengths), lengths, [region for *_, region in found])
    return " ".join(x[0] for x, k in zip(found, kept, strict=True) if k)


def extract_text(pages: DataFrame, html_col: str = "html", id_cols: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page row: its id columns, text and n_chars (code points)."""
    fields = [pages.schema[c] for c in id_cols]
    names = [f"id{k}" for k in range(len(id_cols))]
    rows = pages.select(*[F.col(c).alias(n) for c, n in zip(id_cols, names, strict=True)], F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=True))
    return rows.mapInArrow(run, f"{schema}, text string, n_chars long").toDF(*id_cols, "text", "n_chars")
