"""Main text of HTML pages by line-block distribution.

Markup is stripped to one line a block; lines of menus, headers, footers, sidebars, notices, adverts, forms, comments
and the like count no text, and text in links counts against a line. Text lengths are summed over a sliding window of
lines. The sums dive to nothing where no text comes for a while: that cuts a page into stretches. A stretch in which
the sums surge is main text, from the dive before it to the dive after it, so its short first and last lines stay. The
same rule reads every page; being in an article or main element only takes a link's text at its own weight.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import prepare, slices

#: Lines in a window; a surge is a window with so much weight; a dive is so many lines without any.
WINDOW, SURGE, DIVE = 3, 86, 12
#: What a code point of a link takes from its line's weight: outside of an article, and in one.
LINK, LINK_INSIDE = 2, 0
# Elements that begin and end a line, hold no main text, or have no content.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIP = set("aside button canvas dialog fieldset footer form head iframe input label map menu nav noscript object option select svg template textarea title audio video".split())
RAW = set("script style".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MARKS = set("ad ads advert advertisement advertising adsbygoogle banner breadcrumb breadcrumbs byline-ad comment comments commentlist consent cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pagination pager popup promo promoted promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
_OPEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+")
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Za-z]+")


def _boilerplate(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element holds no main text; a header inside the article may."""
    if name in SKIP or name == "header" and not inside:
        return True
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value) or key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            for token in value.split():
                parts = _PART.findall(token)
                if parts and (token in MARKS or parts[0] in MARKS or parts[-1] in MARKS) and not (inside and parts[-1] == "header"):
                    return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each piece of markup; no name for comments and the like.

    A quoted value may hold a >. Markup that doesn't end is text, but for a comment, which takes the rest.
    """
    at, last = 0, page.rfind(">")
    while m := _OPEN.search(page, at):
        start, name = m.start(), m[1]
        if name is None and m[0] in ("<!--", "<![CDATA["):
            close = "-->" if m[0] == "<!--" else "]]>"
            end = page.find(close, m.end())
            at = len(page) if end < 0 else end + len(close)
            yield start, at, "", False, ""
            continue
        if m.end() > last:
            return
        end = _REST.match(page, m.end()).end()  # a value that isn't closed ends with the tag, at the next >
        if end == len(page):
            return
        attrs = page[m.end() : end]
        at = end + 1
        yield start, at, (name or "").lower(), page[start + 1] == "/", attrs


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, code points in links, inside the article) of each line; boilerplate lines are empty."""
    lines: list[tuple[str, int, bool]] = []
    part: list[str] = []
    links = at = depth = article = link = 0
    skipped = ""  # the element whose content is left out
    raw = None

    def end_line() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(part)).split())
        lines.append((text, min(links, len(text)), article > 0))
        part.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if text and not skipped:
            part.append(text)
            if link:
                links += len(text)

    for start, end, name, closing, attrs in tags(page):
        if start < at:
            continue  # inside a script or style
        add(page[at:start])
        at = end
        if not name:
            continue
        if name in RAW and not closing:
            raw = re.compile(rf"</{name}[^>]*>", re.I).search(page, at)
            at = raw.end() if raw else len(page)
            continue
        if skipped:
            if skipped == "p" and name in BLOCKS:
                depth = 0  # any block ends an open paragraph
            elif name == skipped:
                depth += -1 if closing else 1
            if depth > 0:
                continue
            skipped = ""
            if closing and name in BLOCKS:
                end_line()
                continue
        if name in BLOCKS:
            end_line()
        elif name == "br":
            add(" ")
        if name in ("article", "main"):
            article = max(0, article + (-1 if closing else 1))
        if name == "a":
            link = 0 if closing else 1
        if not closing and name not in VOID and not attrs.endswith("/") and _boilerplate(name, attrs, article > 0):
            if name not in BLOCKS:
                part.append(" ")
            skipped, depth = name, 1
    add(page[at:])
    end_line()
    return lines


def stretches(weight: list[int]) -> list[tuple[int, int, int, bool]]:
    """(first, last, weight, surge) of each stretch of lines between dives; first and last have weight."""
    sums = [0]
    for w in weight:
        sums.append(sums[-1] + w)
    out: list[tuple[int, int, int, bool]] = []
    first = last = None
    surge = False
    for k, w in enumerate(weight):
        if not w:
            continue
        if last is not None and k - last > DIVE:
            out.append((first, last, sums[last + 1] - sums[first], surge))
            first = None
        if first is None:
            first, surge = k, False
        surge |= sums[k + 1] - sums[max(first, k + 1 - WINDOW)] >= SURGE
        last = k
    if last is not None:
        out.append((first, last, sums[last + 1] - sums[first], surge))
    return out


def main_text(page: str | None) -> str:
    """The kept lines, joined by two newlines: those with weight in stretches with a surge, or else in the heaviest stretch."""
    if not page:
        return ""
    lines = lines_of(page)
    weight = [max(0, len(t) - (LINK_INSIDE if inside else LINK) * n) for t, n, inside in lines]
    found = stretches(weight)
    kept = [x for x in found if x[3]] or sorted(found, key=lambda x: -x[2])[:1]
    return "\n\n".join(lines[k][0] for first, last, _, _ in kept for k in range(first, last + 1) if weight[k])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, html): the main text of each whole page.

    A null or empty page, or one without text, has an empty text. Broken markup is read as far as it goes. Null and
    repeated page_ids stay rows; other columns are ignored; an empty table gives no rows.
    """
    prepare(pages.sparkSession)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches, 2):
            texts = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(read, "page_id long, url string, text string, n_chars long")
