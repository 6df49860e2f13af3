"""Main text of web pages by line-block distribution: markup is stripped into lines, text lengths are summed over sliding
windows of lines, and the text between a surge and the dive after it is kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Lines of a window, and the summed characters at which text surges.
WINDOW, SURGE = 3, 80
#: Times the text of article and main elements that a run outside of them may have if they are to decide.
OUTSIDE = 2
#: Where nothing else tells, text before a title is the article's from this part of what follows on; signs of a footer's line.
BEFORE, COPYRIGHT = 4, ("©", "(c) ", "(C) ")

#: Elements whose content is no markup, each with what ends it.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template svg iframe textarea select title".split()}
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[\"'>]")
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements and names of what isn't the article, elements that hold it, and elements within a line.
APART = frozenset("nav footer aside form dialog menu button fieldset".split())
APART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer "
    "comment comments discussion disqus replies respond cookie cookies consent notice alert popup modal newsletter subscribe signup login search share sharing social "
    "related recommended complementary contentinfo gdpr disclaimer pagination masthead topbar adbox adslot".split()
)
#: Words beside which such a name still means the thing: share-buttons is for sharing, share-price is not.
BESIDE = APART_NAMES | frozenset(
    "site page main top bottom left right upper lower list item items bar box wrap wrapper section area block container slot unit widget panel global primary secondary header inner outer content "
    "link links button buttons form post article user reader form input icon icons group row col column text title heading body zone module component region overlay toggle tools toolbar sticky fixed mobile desktop google in and the".split()
)
#: Names of page headers, which an article may also use for its own.
HEADER_NAMES = frozenset({"header"})
MAIN = frozenset({"article", "main"})
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _apart(name: str, attributes: str, in_main: bool) -> bool:
    if name in APART or (name == "header" and not in_main):
        return True
    if name in MAIN or name in ("html", "body"):
        return any(_means(m, frozenset({"comment", "comments"})) for m in _NAMED.finditer(attributes)) if name == "article" else False
    names = APART_NAMES if in_main else APART_NAMES | HEADER_NAMES
    return any(_means(m, names) for m in _NAMED.finditer(attributes))


def _means(m: re.Match[str], names: frozenset[str]) -> bool:
    """Whether one of an attribute's names is one of the names, alone or beside words of layout: ad-slot and site-footer are,
    share-price and search-algorithms aren't. has-sidebar or no-ads say what an element has, not what it is."""
    value = next(x for x in m.groups() if x is not None).lower()
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if not re.match(r"(?:has|no|with|without|is|show|hide)[-_]", name) and names.intersection(words) and BESIDE.issuperset(words):
            return True
    return False


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, whether it closes, attributes) of the page's tags, in order, in one pass forward. Comments, other
    declarations and elements without markup inside have the name ''. A `<` that begins no tag is text, as is a tag that
    isn't ended. Quotes count as long as they are paired: from the first that isn't, tags end at the next `>`."""
    at, paired, last = 0, True, html.rfind(">")
    while 0 <= (begin := html.find("<", at)) < last:
        m = _NAME.match(html, begin)
        if not m:
            at = begin + 1
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 4)
                at = end + 3 if end >= 0 else len(html)
            elif html[at : at + 1] in ("!", "?"):
                at = html.find(">", at) + 1
            else:
                continue
            yield begin, at, "", False, ""
            continue
        at = m.end()
        while paired and (stop := _STOP.search(html, at)) and stop[0] != ">":
            at = html.find(stop[0], stop.end()) + 1
            paired = at > 0
        at = html.find(">", at if paired else m.end()) + 1
        if not at:  # all that is left stands in quotes
            paired, at = False, html.find(">", m.end()) + 1
        name, close = m[2].lower(), bool(m[1])
        if name in RAW and not close:
            end = RAW[name].search(html, at)
            at = end.end() if end else len(html)
            yield begin, at, "", False, ""
        else:
            yield begin, at, name, close, html[m.end() : at - 1]
    if last >= 0 and 0 <= (begin := html.find("<!--", max(at, last))):  # a comment that isn't ended
        yield begin, len(html), "", False, ""


def lines(html: str) -> tuple[list[str], list[int], list[bool], list[bool]]:
    """The page's lines in order, the characters that count for each (those outside links), whether it stands in an article
    or main element, and whether it is the page's title in its text (h1). What stands apart (menus, footers, adverts ...)
    is one empty line; it is told by its element, class, id and role."""
    out, lengths, inside, heads = [], [], [], []
    parts: list[str] = []
    plain = 0
    at, main, link, apart, depth, body, head = 0, 0, 0, "", 0, False, False

    def end() -> None:
        nonlocal parts, plain
        text = " ".join("".join(parts).split())
        if text:
            out.append(text)
            lengths.append(min(plain, len(text)))
            inside.append(main > 0)
            heads.append(head)
        parts, plain = [], 0

    def put(text: str) -> None:
        nonlocal plain
        if text and not apart:
            text = unescape(text)
            parts.append(text)
            if not link:
                plain += len(text.strip())

    for begin, end_of_tag, name, close, attributes in tags(html):
        put(html[at:begin])
        at = end_of_tag
        if not name:
            continue
        if apart:
            if name in MAIN and not close and apart not in MAIN:
                apart = ""  # an article begins: what stood apart was never closed
            else:
                if name == apart and name not in VOID:
                    depth += -1 if close else 1
                    if not depth:
                        apart = ""
                continue
        if name in INLINE:
            if name == "a":
                link = 0 if close else 1
            continue
        end()
        link = 0
        head = name == "h1" and not close
        if name in MAIN:
            main = max(0, main + (-1 if close else 1))
        if name == "body" and not close and not body:  # what stands before the body isn't text
            body = True
            out, lengths, inside, heads = [], [], [], []
        if not close and name not in VOID and not attributes.rstrip().endswith("/") and _apart(name, attributes, main > 0):
            apart, depth = name, 1
            main = max(0, main - 1) if name in MAIN else main
            out.append("")
            lengths.append(0)
            inside.append(main > 0)
            heads.append(False)
    put(html[at:])
    end()
    return out, lengths, inside, heads


def runs(size: np.ndarray) -> list[tuple[int, int, int]]:
    """Stretches of lines whose windows have text: (first, end, most characters of a window). A gap shorter than a window
    doesn't end one."""
    total = np.concatenate([[0], np.cumsum(size)])
    ends = np.minimum(np.arange(len(size)) + WINDOW, len(size))
    sums = total[ends] - total[:-1]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (sums > 0).astype(np.int8), [0]])))
    return [(int(a), min(int(b) + WINDOW - 1, len(size)), int(sums[a:b].max())) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def extract(html: str | None) -> str:
    """The article of a page. The distribution of the text outside links decides: a run of windows with text that surges
    somewhere is kept, from its first line with such text to the last before the dive, with lines of links between them
    (menus, whose windows have none, end a run); without any surge, the run with most text, of equal ones the first.
    Element and class names are hints: what stands apart by them is empty, and if article and main elements have a good
    share of the page's text (a run outside them has at most OUTSIDE times as much), only their lines count. A page with
    a small card as its only article is read as one without. Where names don't tell, a few lines before the title, after
    a menu or at the top, and a last line that begins with a copyright sign stand outside the article, too."""
    if not html:
        return ""
    texts, lengths, inside, heads = lines(html)
    if not texts:
        return ""
    plain, within = np.array(lengths), np.array(inside)
    there = np.array([bool(t) for t in texts])
    # lines of links count in an article
    held = np.where(within & there, np.maximum(plain, 1), 0)
    apart = max((int(plain[a:b][~within[a:b]].sum()) for a, b, _ in runs(np.where(within, 0, plain))), default=0)
    main = bool(held.any()) and apart <= OUTSIDE * int(held.sum())
    size = held if main else plain
    found = runs(size)
    if not found:
        return ""
    total = np.concatenate([[0], np.cumsum(size)])
    kept = [r for r in found if r[2] >= SURGE] or [max(found, key=lambda r: total[r[1]] - total[r[0]])]
    out = []
    for a, b, _ in kept:
        counted = np.flatnonzero(size[a:b]) + a
        first, last = counted[0], counted[-1]
        if not main:
            title = next((i for i in range(first, last + 1) if heads[i]), first)
            if total[title] - total[first] <= (total[last + 1] - total[title]) // BEFORE:
                first = title
            while last > first and texts[last].startswith(COPYRIGHT):
                last -= 1
        out += [texts[i] for i in range(first, last + 1) if texts[i] and (size[i] > 0 or not main)]
    return " ".join(out)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [extract(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page.

    Null and empty html give ''. Pages are read whole, in time in proportion to their length, and broken markup is read as
    far as it goes: an element that is never closed ends with the page or where an article begins. Repeated pages each keep their row; an empty table gives
    an empty table; columns other than page_id, url and html are ignored.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op6_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages"))


QUERIES = {"op6_line_block_text": op6_line_block_text}
ORACLES: dict[str, str] = {}
