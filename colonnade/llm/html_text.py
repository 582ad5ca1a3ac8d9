"""HTML extraction by line-block distribution.

Markup is stripped so that every block element is a line; what stands in menus, forms, notices and the like becomes blank
lines, and so do the borders of sections. The text lengths over a sliding window of lines then surge where the article
begins and dive to nothing where it ends. On a page with ``article`` or ``main`` elements, lines outside of them weigh nothing.
All text between is kept, short lines too, and all text of the container around the largest surge, as a section or an advert
in it does not end the article.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from colonnade.llm.frames import map_rows

#: Lines that a window spans; as many blank lines stand for a border, so that no window sees both sides.
WINDOW = 3
#: A surge counts from this share of the largest text that lies between two dives.
SURGE = 0.3

# Element names of the HTML standard, and usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr "
    "math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup "
    "mtable mtd mtext mtr munder munderover semantics".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg object canvas audio video xmp annotation annotation-xml".split())
APART = frozenset("head nav header footer aside form button select menu dialog fieldset datalist option".split())
SCOPE = frozenset("article main".split())
SECTION = frozenset("article main section body table".split()) | APART
PART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus "
    "footer header menu modal nav navbar navigation newsletter notice pagination popup promo related share sharing sidebar social "
    "sponsor sponsored subscribe toolbar widget".split()
)
#: In an article a heading or paragraph is left out only if one of these is a class of its own.
NOTICES = frozenset("ad ads advert adverts advertisement advertising sponsored promo notice cookie cookies consent".split())
BODY_TEXT = frozenset("h1 h2 h3 h4 h5 h6 hgroup p".split())
NAME_PARTS = re.compile(r"[\s_-]+")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$|/)|aria-hidden\s*=\s*[\"']?true)", re.I)
BLANK = [""] * WINDOW

# Fixed values of the HTML standard: what a start tag ends, up to which elements, and whose end tag may be left out.
P_ENDERS = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
CELLS, ROW_GROUPS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
TABLE_PARTS = CELLS | ROW_GROUPS | {"tr", "caption", "colgroup"}
SCOPES = frozenset("caption html table td th".split())
LISTS = SCOPES | frozenset("article aside blockquote body fieldset footer form header main menu nav ol section ul".split())
ENDED_BY = {
    "li": (frozenset(("li",)), LISTS), "dt": (frozenset(("dt", "dd")), LISTS | {"dl"}), "dd": (frozenset(("dt", "dd")), LISTS | {"dl"}),
    "td": (CELLS, frozenset(("tr", "table"))), "th": (CELLS, frozenset(("tr", "table"))), "tr": (CELLS | {"tr", "caption", "colgroup"}, frozenset(("table",))),
    **dict.fromkeys(ROW_GROUPS, (TABLE_PARTS, frozenset(("table",)))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
}
OPTIONAL_END = TABLE_PARTS | frozenset("p li dt dd option optgroup head".split())
IN_HEAD = RAW | frozenset("base link meta".split())
#: Elements that never are a wrapper of the page, however much of its text they hold.
NEVER_WRAPS = frozenset("head nav footer button select menu datalist option".split())
#: Blocks of text and parts of an article; any other block element is a container.
NO_CONTAINER = INLINE | P_ENDERS - {"div", "center"} | TABLE_PARTS | OPTIONAL_END


def _named_apart(tag: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element's names, role or state say that it is none of the article's business.

    Inside an article a header is the article's own, and names of headings and paragraphs count only if they are notices.
    """
    if not attributes or tag in ("html", "body"):
        return False
    if HIDDEN.search(attributes):
        return True
    for name, *values in NAMES.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            apart = value in ROLES
        elif inside and tag in BODY_TEXT:
            apart = not NOTICES.isdisjoint(value.split())
        else:
            words = PART_NAMES.intersection(NAME_PARTS.split(value))
            apart = bool(words - {"header"} if inside else words)
        if apart:
            return True
    return False


def _apart(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is none of the article's business; ``inside``: it stands in an article."""
    if tag in SCOPE:
        return False
    return tag in APART and not (inside and tag == "header") or _named_apart(tag, attributes, inside)


def _pieces(page: str) -> list[tuple[int, int, str, bool, str]]:
    """Begin, end, name, whether it closes, and attributes of each tag; a raw element is one piece, a comment has no name."""
    pieces, at = [], 0
    while found := PIECE.search(page, at):
        begin, at = found.span()
        tag = (found[2] or "").lower()
        if tag in RAW and not found[1]:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page) if tag in ("script", "style") else at
        pieces.append((begin, at, tag, bool(found[1]), found[3] or ""))
    return pieces


@dataclass(slots=True)
class Element:
    """An element from its start tag to its end, which may be implied; what it holds of text, articles and articles named as parts."""

    tag: str
    begin: int
    apart: bool
    text: int
    articles: int
    parts: int
    parent: int
    named: bool = False
    end: int = 0
    closed: bool = False


def _elements(page: str, pieces: list[tuple[int, int, str, bool, str]]) -> tuple[list[Element], set[int]]:
    """Elements, without inline ones that matter to nobody, and where those begin that are left out.

    A missing end tag is where HTML implies it. What holds an article, or more than half of the page's text, is never left out;
    articles named as parts, as comments are, count as such only if no other stands outside.
    """
    found: list[Element] = []
    stack: list[Element] = []
    opened: Counter[str] = Counter()
    text = articles = parts = at = 0

    def end_from(k: int, where: int, last: int, closed: bool) -> None:
        """Ends the elements from place ``k`` on: inner ones at ``where``, the outermost at ``last``."""
        for i in range(len(stack) - 1, k - 1, -1):
            e = stack.pop()
            opened[e.tag] -= 1
            e.end = last if i == k else where
            e.closed = closed or e.tag in OPTIONAL_END
            e.text, e.articles, e.parts = text - e.text, articles - e.articles, parts - e.parts

    def outermost(tags: frozenset[str], stops: frozenset[str], nearest: bool = False) -> int | None:
        place = None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in tags:
                place = i
                if nearest:
                    break
            elif stack[i].tag in stops:
                break
        return place

    for begin, end, tag, closing, attributes in pieces:
        text += len(page[at:begin].strip())
        at = end
        if not tag or tag in RAW:
            continue
        if closing:
            if opened[tag] > 0:
                table = tag == "table" or tag in TABLE_PARTS
                stops = frozenset(("table",)) if table else frozenset() if tag in ("body", "html") else SCOPES | {"ul", "ol"} if tag == "li" else SCOPES
                k = outermost(frozenset((tag,)), stops, nearest=True)
                if k is not None:
                    end_from(k, begin, end, tag not in ("body", "html"))
            continue
        if opened["head"] and tag not in IN_HEAD:
            end_from(outermost(frozenset(("head",)), frozenset()), begin, begin, True)
        if tag in P_ENDERS and opened["p"]:
            k = outermost(frozenset(("p",)), SCOPES | {"button"}, nearest=True)
            if k is not None:
                end_from(k, begin, begin, True)
        if tag in ENDED_BY and any(opened[t] for t in ENDED_BY[tag][0]):
            k = outermost(*ENDED_BY[tag], nearest=tag in ("li", "dt", "dd"))
            if k is not None:
                end_from(k, begin, begin, True)
        if tag in VOID or re.search(r"(?:^|[\s\"'])/\Z", attributes):
            continue
        apart = _apart(tag, attributes, opened["article"] + opened["main"] > 0)
        if tag in INLINE and not apart and not opened[tag]:
            continue
        e = Element(tag, begin, apart, text, articles, parts, stack[-1].begin if stack else -1)
        found.append(e)
        stack.append(e)
        opened[tag] += 1
        if tag in SCOPE:
            articles += 1
            e.named = _named_apart(tag, attributes)
            parts += e.named
    text += len(page[at:].strip())
    end_from(0, len(page), len(page), False)

    def stays(e: Element) -> bool:
        article = e.articles > e.parts or e.articles > 0 and e.articles == articles
        return article or 2 * e.text > text and e.tag not in NEVER_WRAPS

    return found, {e.begin for e in found if e.apart and e.closed and not stays(e)}


def _scopes(elements: list[Element], left_out: set[int]) -> list[Element]:
    """The outermost articles and mains that stay; ones named as parts, as comments are, only if there are no others."""
    outer: list[Element] = []
    until = hidden = -1
    for e in elements:
        if e.begin < hidden:
            continue
        if e.begin in left_out:
            hidden = e.end
        elif e.tag in SCOPE and e.begin >= until:
            outer.append(e)
            until = e.end
    return [e for e in outer if not e.named] or outer


def _lines(page: str) -> tuple[list[tuple[str, int]], list[Element], list[Element]]:
    """Lines of a page with where they end, elements, articles; blank lines at borders and for what was stripped."""
    pieces = _pieces(page)
    elements, left_out = _elements(page, pieces)
    resume = {e.begin: e.end for e in elements if e.begin in left_out}
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    at = 0

    def end_line() -> None:
        if parts:
            line = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if line:
                lines.append((line, at))

    def border() -> None:
        end_line()
        lines.extend((b, at) for b in BLANK)

    for begin, end, tag, closing, attributes in pieces:
        if begin < at:
            # In a part that is left out.
            continue
        parts.append(page[at:begin])
        at = begin
        if begin in resume:
            border()
            at = resume[begin]
            border()
            continue
        if tag in RAW and not closing or tag == "br":
            parts.append(" ")
        elif tag and tag not in INLINE:
            if tag in SECTION:
                border()
            else:
                end_line()
        at = end
    parts.append(page[at:])
    at = len(page)
    end_line()
    return lines, elements, _scopes(elements, left_out)


def _container(elements: list[Element], inside: list[int], others: list[int]) -> tuple[int, int]:
    """From where to where the container reaches that holds the lines ``inside`` and, if one below the body does, others too."""
    around = [e for e in elements if e.begin < inside[0] and inside[-1] <= e.end and e.tag not in NO_CONTAINER and e.tag != "html"]
    for e, outer in zip(around[::-1], [*around[-2::-1], None]):
        if outer is None or outer.tag == "body" or bisect_right(others, e.begin) < bisect_right(others, e.end):
            return e.begin, e.end
    return 0, max([inside[-1], *others])


def _regions(sizes: list[int]) -> list[tuple[int, int, int]]:
    """Begin, end and text of each run of lines between a surge of the window sums from 0 and the dive to 0."""
    # sums[i]: text in the window that starts at line i.
    sums, total = [], sum(sizes[:WINDOW])
    for i, size in enumerate(sizes):
        sums.append(total)
        total += (sizes[i + WINDOW] if i + WINDOW < len(sizes) else 0) - size
    regions, start = [], None
    for i, total in enumerate([*sums, 0]):
        if total and start is None:
            start = i
        elif not total and start is not None:
            regions.append((start, i, sum(sizes[start:i])))
            start = None
    return regions


def _main_scopes(scopes: list[Element], held: list[int]) -> set[int]:
    """Which articles are the page's: the one that holds most text, and those beside it that hold a like amount."""
    most = max(range(len(scopes)), key=lambda k: held[k])
    first = scopes[most]
    return {k for k, e in enumerate(scopes) if k == most or e.tag == first.tag and e.parent == first.parent and held[k] >= SURGE * held[most]}


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by line breaks; empty if there is no text."""
    lines, elements, scopes = _lines(page or "")
    begins = [e.begin for e in scopes]

    def scope_of(at: int) -> int:
        """The article that a line ending at ``at`` stands in, -1 if none."""
        k = bisect_left(begins, at) - 1
        return k if k >= 0 and at <= scopes[k].end else -1

    within = [scope_of(at) for _, at in lines]
    scoped = any(line and k >= 0 for (line, _), k in zip(lines, within))
    sizes = [len(line) if k >= 0 or not scoped else 0 for (line, _), k in zip(lines, within)]
    regions = _regions(sizes)
    if not regions:
        return ""
    if scoped:
        held = [0] * len(scopes)
        # Borders part the articles, so a region lies in one of them.
        owners = [next(k for k, size in zip(within[a:b], sizes[a:b]) if size) for a, b, _ in regions]
        for k, (_, _, text) in zip(owners, regions):
            held[k] += text
        chosen = _main_scopes(scopes, held)
        kept = [r for k, r in zip(owners, regions) if k in chosen]
    else:
        a, b, most = max(regions, key=lambda r: r[2])
        begin, end = _container(elements, [at for line, at in lines[a:b] if line], [at for line, at in [*lines[:a], *lines[b:]] if line])
        kept = [r for r in regions if r[2] >= SURGE * most or any(line and begin < at <= end for line, at in lines[r[0]:r[1]])]
    return "\n".join(line for a, b, _ in kept for (line, _), size in zip(lines[a:b], sizes[a:b]) if size)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``id``, ``url``, ``text`` and ``n_chars`` of every row; nothing is shuffled.

    A null or empty page has an empty text. Repeated rows give repeated results, nulls in other columns stay, an empty table
    gives no rows.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def rows(found: Iterable[tuple]) -> Iterator[tuple]:
        for page, url, markup in found:
            text = main_text(markup)
            yield page, url, text, len(text)

    return map_rows(source, rows, f"id {source.schema['id'].dataType.simpleString()}, url string, text string, n_chars bigint")
