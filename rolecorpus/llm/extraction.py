"""Main text of web pages, by nearest-URL page differencing and by structure.

A page is cut into lines of text, one per block, and compared with the pages of the nearest URLs on the same host: the
lines of both are aligned by longest common subsequence. A line that both share is the site's, not the page's, and goes; the
others stay. Structure overrules that in two cases: lines in elements that are never article text (menus, headers, footers,
asides, forms, scripts, adverts, notices, comments) go though no neighbour has them, and lines inside an article or main
element stay though one has them, as articles are copied too. Pages whose every line falls under one of these two rules
need no neighbour and aren't moved to meet one.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, spare

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s<>\"'][^\s<>]*+)?+|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split()
)
_NEVER = set("nav header footer aside form head menu button select object svg canvas audio video dialog search map applet".split())
_NEVER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "note"}
_NEVER_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended comment comments commentlist respond disqus replies reply pagination pager widget toolbar skip copyright".split()
)
#: Words beside those of a name that say what kind of box it is, not what is in it.
_BOX_WORDS = set("area bar block body bottom box btn button buttons center col column container content end group inner item items left link links list main middle outer panel right row section site slot start top unit wrap wrapper".split())
_CLOSES_P = _BLOCK - {"body", "html", "head", "caption", "tbody", "thead", "tfoot", "tr", "legend", "option"}
#: Elements that end when a sibling of theirs begins.
_SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "option": {"option"}}


def never_name(value: str) -> bool:
    """Whether one of the names in a class or id attribute is that of something that is never article text: all its parts must be known
    ones, or say what kind of box it is, or be numbers. ``ad-slot-2`` is one, ``related-work`` or ``share-price`` isn't."""
    for name in value.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x and not x.isdigit()]
        if any(x in _NEVER_NAMES for x in parts) and all(x in _NEVER_NAMES or x in _BOX_WORDS for x in parts):
            return True
    return False


_LISTS = {"ul", "ol", "dl", "table", "tbody", "select", "menu"}


def _frames(name: str) -> bool:
    return name in _BLOCK and name != "p"


@dataclass(slots=True)
class Line:
    text: str
    main: bool  # inside an article or main element
    never: bool  # inside an element that is never article text


def page_lines(page: str | None) -> list[Line]:
    """The lines of a page in order: text of one block each, references decoded, white space made single."""
    page = page or ""
    lines: list[Line] = []
    buffer: list[str] = []
    open_: list[tuple[str, bool, bool]] = []  # name, never, main of each open element
    opened: Counter[str] = Counter()
    inside: list[Counter[str]] = [Counter()]  # for each open block but paragraphs, the other elements open in it
    never = main = 0

    def flush() -> None:
        if buffer and (text := " ".join("".join(buffer).split())):
            lines.append(Line(text, main > 0, never > 0))
        buffer.clear()

    def push(name: str, bad: bool, good: bool) -> None:
        open_.append((name, bad, good))
        opened[name] += 1
        if _frames(name):
            inside.append(Counter())
        else:
            inside[-1][name] += 1

    def close(names: set[str]) -> None:
        """End the innermost open element of these names and all in it."""
        nonlocal never, main
        while open_:
            name, n, m = open_.pop()
            never, main = never - n, main - m
            opened[name] -= 1
            if _frames(name):
                inside.pop()
            else:
                inside[-1][name] -= 1
            if name in names:
                return

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            buffer.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            buffer.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                buffer.append(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        name = m[2].lower()
        if m[1]:  # an end tag
            if name in _BLOCK:
                flush()
            elif name in ("br", "td", "th"):
                buffer.append(" ")
            # an inline element ends within its block only
            if opened[name] if name in _BLOCK else inside[-1][name]:
                close({name})
            continue
        if name in _RAW:  # skipped with all it holds
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in _BLOCK:
            flush()
            if name in _CLOSES_P and inside[-1]["p"]:
                close({"p"})
            if name in _SIBLINGS and any(opened[x] for x in _SIBLINGS[name]):
                nearest = next(x[0] for x in reversed(open_) if x[0] in _SIBLINGS[name] or x[0] in _LISTS)
                if nearest in _SIBLINGS[name]:
                    close(_SIBLINGS[name])
        elif name in ("br", "td", "th", "img"):
            buffer.append(" ")
        if name in _VOID or m[3].rstrip().endswith("/"):
            continue
        bad, good = name in _NEVER, name in ("article", "main")
        if m[3] and name not in ("html", "body"):
            for a in _ATTRIBUTE.finditer(m[3]):
                key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if key == "role":
                    bad, good = bad or value in _NEVER_ROLES, good or value in ("main", "article")
                elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                    bad = True
                elif key in ("class", "id") and name not in ("main", "article"):
                    bad = bad or never_name(value)
                elif key in ("class", "id"):
                    bad = bad or not {"comment", "comments", "ad", "sponsored"}.isdisjoint(value.split())
        if bad and not never:
            flush()
        push(name, bad, good)
        never, main = never + bad, main + good
    flush()
    return lines


def common_lines(a: list, b: list) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of both (by the increasing-sequence method)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(a) - tail, len(a))}
    places: dict[object, list[int]] = defaultdict(list)
    for j in range(len(b) - tail - 1, head - 1, -1):
        places[b[j]].append(j)
    ends: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def undecided(lines: list[Line]) -> bool:
    """Whether structure leaves a line open, so that the neighbours decide."""
    return any(not x.main and not x.never for x in lines)


def line_hashes(lines: list[Line]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(x.text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for x in lines]


def unshared_text(lines: list[Line], own: list, neighbours: list[list]) -> str:
    """The page's own lines by ``own``, what stands for each line, and the same of the neighbours."""
    shared = set().union(*(common_lines(own, n) for n in neighbours))
    return "\n\n".join(x.text for k, x in enumerate(lines) if not x.never and (x.main or k not in shared))


def main_text(lines: list[Line], neighbours: list[list[Line]]) -> str:
    """The lines that no neighbour shares or an article element holds, but for those in elements that are never article text."""
    return unshared_text(lines, [x.text for x in lines], [[y.text for y in n] for n in neighbours])


def nearest_urls(found: DataFrame) -> DataFrame:
    """(host, path, before, after) for each URL with a page that ``asks``: the line hashes of the URLs next to it in
    the sorted distinct URLs of its host, of each the page of the smallest ``h``; null where the host has none.

    The order is total, so neither partitions nor the number of a URL's pages matter: URLs are numbered through by a
    range sort and the sizes of its partitions, and neighbours join by number.
    """
    urls = settle(found.groupBy("host", "path").agg(F.min(F.struct("h", "lines"))["lines"].alias("lines"), F.bool_or("asks").alias("asks")), "extract-urls")
    ordered = settle(urls.repartitionByRange("host", "path").sortWithinPartitions("host", "path").withColumn("at", F.monotonically_increasing_id()), "extract-ordered")
    part = F.shiftright("at", 33)
    before, rows = 0, []
    for r in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():
        rows.append((r["part"], before))
        before += r["count"]
    first = F.broadcast(found.sparkSession.createDataFrame(rows, "part long, first long"))
    numbered = ordered.withColumn("part", part).join(first, "part").withColumn("n", F.col("first") + F.col("at") - F.shiftleft("part", 33))
    side = lambda step, name: numbered.select("host", (F.col("n") + step).alias("n"), F.col("lines").alias(name))
    asking = numbered.filter("asks").select("host", "path", "n")
    return settle(asking.join(side(1, "before"), ["host", "n"], "left").join(side(-1, "after"), ["host", "n"], "left").select("host", "path", "before", "after"), "extract-near")


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """``pages`` with ``out_col``, the main text of the whole html ('' if there is none).

    A page with lines that structure leaves open is compared with the URL before and the URL after its own among the sorted
    distinct URLs (path and query string) of its host. A null or empty html gives ''; a null url is a host of its own
    without neighbours; pages of one URL, and repeated rows, are each other's copies and not compared; pages of any length
    are worked whole; an empty table stays empty. Other columns of any name pass through; a column of the name
    ``out_col`` is replaced.

    Plan: one pass over the pages writes the hashes of their lines, from which the neighbours are found; pages are
    shuffled once, by URL, to meet them, and not at all where structure decides every line.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^#]*)", 1)
    plain = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c != out_col or c in (url_col, html_col)])
    host_col, path_col, before_col, after_col = (spare(plain, f"extract_{c}") for c in ("host", "path", "before", "after"))
    # pages without a host meet nobody: their key only spreads them
    keyed = plain.withColumn(host_col, host).withColumn(path_col, F.when(F.col(host_col) == "", F.xxhash64(html_col).cast("string")).otherwise(path))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = [page_lines(x) for x in b["html"]]
            yield pd.DataFrame({"host": b["host"], "path": b["path"], "h": b["h"], "asks": [undecided(x) for x in lines], "lines": [line_hashes(x) for x in lines]})

    own = keyed.filter(F.col(host_col) != "").select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.xxhash64(html_col).alias("h"), F.col(html_col).cast("string").alias("html"))
    found = settle(own.mapInPandas(hashed, "host string, path string, h long, asks boolean, lines array<long>"), "extract-lines")
    if found.filter("asks").isEmpty():
        joined = keyed.withColumns({c: F.lit(None).cast("array<long>") for c in (before_col, after_col)})
    else:
        near = nearest_urls(found).toDF(host_col, path_col, before_col, after_col)
        joined = keyed.join(near, [host_col, path_col], "left")

    @F.pandas_udf("string")
    def text(pages: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        out = []
        for page, *near in zip(pages, before, after, strict=True):
            lines, near = page_lines(page), [list(n) for n in near if n is not None]
            out.append(unshared_text(lines, line_hashes(lines) if near else [], near))
        return pd.Series(out, dtype=object)

    return joined.select(*[F.col(f"`{c}`") for c in plain.columns if c != out_col], text(F.col(html_col).cast("string"), before_col, after_col).alias(out_col))
