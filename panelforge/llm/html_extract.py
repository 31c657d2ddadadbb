"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe|select|button)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？।؟]")
# HTML elements by what they are for.
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strong strike sub sup time tt u var wbr br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = set("nav footer aside form menu dialog header head".split())
LIKE_OUTSIDE = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies dialog disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup "
    "promo promotion recommended related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget "
    "alert complementary contentinfo search toc".split()
)
# Words that say where or how a part of a page stands, not what it is; "related-posts" is of the list above, "social-science" is not.
PLACING = set(
    "area bar body bottom box btn button buttons card center col column container content count cta feed field floating footer form global group "
    "header heading holder icon icons inline inner input item items js label large left link links list local main meta mobile module node outer page panel "
    "policy post posts primary right row secondary section site slot small sticky strip tab thread title top unit user view wrap wrapper zone".split()
)
INSIDE = set("article main".split())
_P_ENDS = set("p div article section main ul ol dl table h1 h2 h3 h4 h5 h6 header footer nav aside form blockquote pre figure hr address fieldset details".split())
_SELF_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "p": {"td", "th", "table", "article", "div", "section", "main", "body"}}


def _outside(token: str) -> bool:
    """Whether a class or id names a part outside the article: one such word, and none that says it is of something else."""
    parts = [w.lower() for w in _PARTS.findall(token)]
    return token.lower() in LIKE_OUTSIDE or not LIKE_OUTSIDE.isdisjoint(parts) and all(w in LIKE_OUTSIDE or w in PLACING or w.isdigit() for w in parts)


def _element(tag: str, attributes: str) -> tuple[str, float]:
    """The element's name in a path, and how its purpose weighs on what is in it: 0 outside the article, above 1 inside."""
    names, weight = [], 1.0
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        kind, value = m[1].lower(), html.unescape((m[2] or "").strip("\"'"))
        if kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            weight = 0.0
        elif kind in ("class", "id", "role"):
            if tag not in ("body", "html", *INSIDE) and any(map(_outside, value.split())):
                weight = 0.0
            if kind == "class":
                names += value.lower().split()
    if tag in OUTSIDE:
        weight = 0.0
    elif tag in INSIDE and weight:
        weight = 3.0
    return ".".join([tag, *names]), weight


def blocks(page: str) -> list[tuple[tuple[str, ...], float, str, int]]:
    """(path, weight, text, characters in links) of each block with text, in page order.

    Unclosed paragraphs, list items and cells end where the next begins; what is
    left open ends with its parent.
    """
    out: list[tuple[tuple[str, ...], float, str, int]] = []
    stack: list[tuple[str, str, float]] = []
    parts: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
            if text:
                in_links = len(_SPACE.sub(" ", html.unescape("".join(p for p, a in parts if a))).strip())
                weight = 1.0
                for _, _, w in stack:
                    weight = 0.0 if w == 0 else max(weight, w) if weight else 0.0
                out.append((tuple(n for t, n, _ in stack if t not in INLINE), weight, text, in_links))
            parts.clear()

    def close(names: set[str], until: set[str]) -> None:
        nonlocal links
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                flush()
                links -= sum(t == "a" for t, _, _ in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[1] and m[1].lower() in ("textarea", "select", "button", "iframe"):
                flush()
            continue
        if m[2] or m[5]:
            if tag == "br":
                parts.append((" ", False))
            elif tag == "p" and not any(t == "p" for t, _, _ in stack):
                flush()
            elif any(t == tag for t, _, _ in stack):
                if tag in INLINE:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            links -= tag == "a"
                            del stack[k]
                            break
                else:
                    close({tag}, set())
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            elif tag == "br":
                parts.append((" ", False))
            continue
        if tag not in INLINE:
            flush()
            if tag in _P_ENDS:
                close({"p"}, _SCOPES["p"])
            if tag in _SELF_ENDS:
                close(_SELF_ENDS[tag], _SCOPES[tag])
            # inline elements that were left open do not reach into the next block
            while stack and stack[-1][0] in INLINE:
                links -= stack.pop()[0] == "a"
        name, weight = _element(tag, m[4] or m[7] or "")
        stack.append((tag, name, weight))
        links += tag == "a"
        if weight == 0 and tag in INLINE and len(parts):
            flush()
    if at < len(page):
        parts.append((page[at:], links > 0))
    flush()
    return out


def _container(path: tuple[str, ...]) -> tuple[str, ...]:
    """The innermost article or main that a path is in, else its parent; () where that is the page's body."""
    for k in range(len(path), 0, -1):
        if path[k - 1].split(".")[0] in INSIDE:
            return path[:k]
    parent = path[:-1]
    return parent if parent and parent[-1].split(".")[0] not in ("body", "html") else ()


def extract(page: str | None, share: float = 0.15, smoothing: float = 0.7, linked: float = 0.5) -> str:
    """The main text: blocks of the paths whose fused, smoothed ratio reaches a share of the best path's.

    A path's text ratio is its characters outside links for each of its blocks;
    its punctuation ratio the marks for each block. The two are multiplied, with
    the weight of the path's elements, smoothed with a Gaussian over the paths in
    page order among those of the same parent, and held against `share` of the
    largest. What else is in the container of a path that passes goes with it, such
    as lists, tables, captions and titles, unless its share of characters in links
    is over `linked`. A page without a block of any weight gives an empty text.
    """
    found = [b for b in blocks(page or "") if b[1] > 0]
    if not found:
        return ""
    totals: dict[tuple[str, ...], list[float]] = {}
    for path, weight, text, links in found:
        t = totals.setdefault(path, [0.0, 0.0, 0.0, weight, 0.0])
        t[0] += 1
        t[1] += max(0, len(text) - links)
        t[2] += len(_PUNCTUATION.findall(text))
        t[4] += len(text)
    paths = list(totals)
    ratio = [t[3] * (t[1] / t[0]) * (1 + t[2] / t[0]) for t in totals.values()]
    kernel = [exp(-(d * d) / (2 * smoothing * smoothing)) for d in range(3)]
    smooth = []
    for i, p in enumerate(paths):
        near = [(kernel[abs(j - i)], ratio[j]) for j in range(max(0, i - 2), min(len(paths), i + 3)) if paths[j][:-1] == p[:-1]]
        smooth.append(sum(k * r for k, r in near) / sum(k for k, _ in near))
    limit = share * max(smooth)
    chosen = {p for p, s in zip(paths, smooth) if s >= limit}
    within = {c for p in chosen if (c := _container(p))}
    chosen |= {p for p, t in totals.items() if t[1] >= (1 - linked) * t[4] and any(p[:k] in within for k in range(1, len(p) + 1))}
    return "\n".join(text for path, _, text, _ in found if path in chosen)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html); null html is an empty page, nulls elsewhere stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
