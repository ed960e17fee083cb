"""Main text of web pages: block structure, and differencing against the page with the nearest URL of the host."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import in_python, written
from tabulon.llm.url_filter import host_of, path_of
from tabulon.operators.ranking import number_in_order

# Fixed values of HTML: elements without an end tag, with raw text, that end a block
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
# What never is article text: elements, and names in class, id or role attributes
AWAY = frozenset("nav footer aside form button select menu dialog svg head object canvas audio video template datalist map".split()) | RAW
AWAY_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner banners promo promotion sponsor sponsored sponsors "
    "cookie cookies consent gdpr notice notices alert alerts disclaimer newsletter subscribe subscription signup paywall popup modal "
    "overlay sidebar sidebars side widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs topbar toolbar pagination pager "
    "footer header masthead comment comments commentlist reply replies respond discussion disqus reactions share sharing social related "
    "recommended recommendations teaser teasers login search searchform form complementary contentinfo skip hidden".split()
)

# words after which a name still means what stands before them (comment-list), and before which it does not (no-sidebar)
TAILS = frozenset("area bar block box buttons container content icons inner item items link links list section wrap wrapper".split())
LAYOUT = frozenset("has hide is no with without".split())

# of these, only ones that authors leave open by mistake end at the next article; teasers in an aside stay out
LEFT_OPEN = frozenset("nav header menu form".split())

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[A-Za-z][^>]*(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_UNSEEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none""", re.I)
# names of containers that hold a page's own text where there is no article or main element
OWN_NAMES = frozenset("article articlebody content maincontent post entry story main".split())
ARTICLE, MAIN, CONTENT, OUTSIDE, DROPPED = 4, 3, 2, 1, 0
# elements of running text: inside an article, lines in them are its text whoever else says the same
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre caption figcaption summary td th".split())


def _names(attrs: str) -> list[str]:
    """Class names, ids and roles, lower case."""
    return [n for m in _NAMED.finditer(attrs) for n in (m.group(1) or m.group(2) or m.group(3) or "").lower().split()]


def _away(words: list[str]) -> str:
    """The word by which a name, split at ``-`` and ``_``, tells a menu, notice or the like: its last one before ``TAILS`` and numbers."""
    for word in reversed(words):
        if word in AWAY_NAMES:
            return "" if words[0] in LAYOUT else word
        if word not in TAILS and not word.isdigit():
            break
    return ""


def _dropped(name: str, attrs: str, zone: int) -> bool:
    """Whether an element in ``zone`` is no part of the text.

    Articles, main elements and containers named as content go by whole names only (``comments``), others also by the
    last word of a name (``reader-comments``).  What is named a header stays in an article, and in a container if it
    is named as a header of the content (``entry-header``).
    """
    if name in AWAY or (name == "header" and zone != ARTICLE):
        return True
    if not attrs or name in ("body", "html"):
        return False
    if _UNSEEN.search(re.sub(r"""=\s*("[^"]*"|'[^']*')""", lambda m: m.group(0) if "display" in m.group(0).lower() else "=", attrs)):
        return True
    names = [re.split(r"[_\-]+", n) for n in _names(attrs)]
    own = [not OWN_NAMES.isdisjoint(words) and not _away(words) for words in names]
    container = name in ("article", "main") or (name in ("div", "section", "td") and any(own))
    for words in names:
        word = _away(words)
        if word in ("header", "masthead") and (zone == ARTICLE or (zone > OUTSIDE and not OWN_NAMES.isdisjoint(words))):
            continue
        if word and not (container and len(words) > 1):
            return True
    return False


def _level(name: str, attrs: str) -> int:
    """How surely an element holds the page's own text."""
    if name == "article":
        return ARTICLE
    if name == "main":
        return MAIN
    if name in ("div", "section", "td") and attrs:
        if any(not OWN_NAMES.isdisjoint(re.split(r"[_\-]+", n)) for n in _names(attrs)):
            return CONTENT
    return OUTSIDE


def page_blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of each block in page order: inside an article, main or content element, outside of one, or dropped."""
    return [(zone, line) for zone, _, line in page_lines(page)]


def page_lines(page: str) -> list[tuple[int, bool, str]]:
    """(zone, whether it stands in an element of running text, text) of each block in page order.

    An end tag closes everything opened since its start tag, and is ignored without one; what is left open at
    the end is closed there, and an element that is left out ends at the next article or main element.
    """
    blocks: list[tuple[int, bool, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # element, zone inside it
    zone = OUTSIDE

    def finish():
        if held:
            line = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if line:
                around = next((name for name, _ in reversed(stack) if name in BLOCK), "")
                blocks.append((zone, around in PROSE, line))

    at, n = 0, len(page)
    while at < n:
        m = _PIECE.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m.group("name")
        if name is None:
            if m.group(0).startswith("<![CDATA["):
                held.append(html.escape(m.group(0)[9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if m.group("close"):
            if name in BLOCK:
                finish()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                if stack[depth:] and stack[-1][1] != (stack[depth - 1][1] if depth else OUTSIDE):
                    finish()
                del stack[depth:]
                zone = stack[-1][1] if stack else OUTSIDE
            continue
        attrs = m.group("attrs") or ""
        if name in BLOCK:
            finish()
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        away = _dropped(name, attrs, zone)
        if name in ("article", "main") and not away and zone == DROPPED and not any(s in ("article", "main", "template") for s, _ in stack):
            named = next((i for i, (s, z) in enumerate(stack) if z == DROPPED), 0)
            if stack[named][0] in LEFT_OPEN:
                del stack[named:]
                zone = stack[-1][1] if stack else OUTSIDE
        inner = DROPPED if away or zone == DROPPED else max(zone, _level(name, attrs))
        if inner != zone:
            finish()
        if attrs.rstrip().endswith("/") and name not in BLOCK:
            continue
        stack.append((name, inner))
        zone = inner
    finish()
    return blocks


def shared_lines(own: list[int], other: list[int]) -> set[int]:
    """Positions in ``own`` of a longest common subsequence with ``other`` (Hunt and Szymanski)."""
    start = 0
    while start < len(own) and start < len(other) and own[start] == other[start]:
        start += 1
    found = set(range(start))
    a, b = len(own), len(other)
    while a > start and b > start and own[a - 1] == other[b - 1]:
        a, b = a - 1, b - 1
        found.add(a)
    places: dict[int, list[int]] = {}
    for j in range(b - 1, start - 1, -1):
        places.setdefault(other[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(start, a):
        for j in places.get(own[i], ()):
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


HASH = 6  # bytes of a line's hash: two pages are compared at a time, so that few are enough
IN_PROSE = 8


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All blocks of each page: a byte for zone and element, hashes for the alignment, and the lines that are not dropped."""
    for batch in batches:
        out = []
        for page in batch.html:
            blocks = page_lines(page) if isinstance(page, str) else []
            zones = bytes(zone + IN_PROSE * prose for zone, prose, _ in blocks)
            hashes = b"".join(xxhash.xxh3_64_digest(line.encode("utf-8", "surrogatepass"))[:HASH] for _, _, line in blocks)
            out.append((zones, hashes, "\n".join(line for zone, _, line in blocks if zone > DROPPED)))
        made = pd.DataFrame(out, columns=["zones", "lines", "body"], index=batch.index)
        yield pd.concat([batch[["page_id", "content", "url"]], made], axis=1)


def _numbers(lines: bytes) -> list[int]:
    return [int.from_bytes(lines[i : i + HASH]) for i in range(0, len(lines), HASH)]


def main_lines(zones: list[int], prose: list[bool], shared: set[int]) -> list[int]:
    """Positions of the lines that are a page's text, given the positions of those it shares with the nearest page.

    Where there is a container (article, main or content element), its lines are the text, but for shared ones at its beginning and
    end that stand in no element of running text; and if the pages share a line outside of their containers, which tells that
    they have one template, so are the lines outside that only this page has.  Without a container, the lines that are not
    shared are the text.  A page or container whose lines are all shared is a copy of the other, and they are its own.
    """
    seen = [i for i, zone in enumerate(zones) if zone > DROPPED]
    own = max((zones[i] for i in seen), default=OUTSIDE)
    if own == OUTSIDE:
        return [i for i in seen if i not in shared] or seen
    inside = [i for i in seen if zones[i] == own]
    edges: set[int] = set()
    for way in (inside, inside[::-1]) if not shared.issuperset(inside) else ():
        for i in way:
            if i not in shared or prose[i]:
                break
            edges.add(i)
    one_template = any(zones[i] != own for i in shared)
    kept = [i for i in seen if i not in edges and (zones[i] == own or (one_template and i not in shared))]
    return kept


def _leading(a: str, b: str) -> Column:
    """One more than the number of characters with which both columns begin."""
    shorter = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), shorter + 1), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)), shorter + 1)


def _difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            shared = shared_lines(_numbers(r.lines), _numbers(r.lines_near)) if r.lines_near is not None else set()
            zones, prose = [z % IN_PROSE for z in r.zones], [z >= IN_PROSE for z in r.zones]
            seen = [i for i, zone in enumerate(zones) if zone > DROPPED]
            line = dict(zip(seen, r.body.split("\n")))
            text = " ".join(line[i] for i in main_lines(zones, prose, shared))
            own = max(zones, default=OUTSIDE)
            outside = sum(zones[i] != own or own <= OUTSIDE for i in shared)
            out.append((r.page_id, r.url, text, len(text), outside))
        yield pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars", "n_shared_lines"])


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_shared_lines`` for every row of ``pages`` (``page_id, url, html``).

    Within each host, pages are ordered by path; a page is paired with the neighbour whose path has the
    longer common beginning (the earlier one at a tie).  All lines (blocks) of both are aligned by a longest common
    subsequence, and ``main_lines`` tells from what they share and from the structure which lines are the text.
    Menus, headers, footers, sidebars, notices, adverts, forms and comments, as told by element, class, id or role, are
    no part of it.  Paragraphs and headings inside an article are never deleted for being shared: pages quote and
    repeat each other.  ``n_shared_lines`` counts the shared lines outside of the page's container.

    Null or empty html gives an empty text; a null url belongs to the empty host; repeated rows are pages
    each; whole pages are parsed, whatever their length; an empty table gives no rows.
    """
    rows = pages.select("page_id", F.xxhash64("page_id", "url", "html").alias("content"), "url", "html")
    parsed = in_python(
        rows, _parse, "page_id long, content long, url string, zones binary, lines binary, body string",
        exact=["page_id"],
    )
    # parsing again is cheaper than keeping the texts, so only the lines' hashes are written; equal rows count once
    keyed = written(
        parsed.select("page_id", "content", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "lines").distinct(), "page_lines"
    )
    order = number_in_order(keyed.select("page_id", "content", "host", "path"), ["host", "path", "page_id", "content"], "at", 0, single_task=-1)
    joined = lined = keyed.select(*[F.col(c).alias(f"_{c}") for c in ("page_id", "content")], "lines").join(
        order, F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.col("content") == F.col("_content"))).drop("_page_id", "_content")
    for shift, name in ((1, "before"), (-1, "after")):
        other = lined.select((F.col("at") + shift).alias("at"), F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("lines").alias(f"lines_{name}"))
        joined = joined.join(other, "at", "left").withColumn(f"path_{name}", F.when(F.col("host") == F.col("_host"), F.col("_path"))).drop("_host", "_path")
    after = F.col("path_after").isNotNull() & (F.col("path_before").isNull() | (_leading("path", "path_after") > _leading("path", "path_before")))
    # the line hashes of one neighbour only travel to the texts
    lines = F.when(after, F.col("lines_after")).when(F.col("path_before").isNotNull(), F.col("lines_before"))
    near = joined.select(F.col("page_id").alias("_page_id"), F.col("content").alias("_content"), lines.alias("lines_near"))
    both = parsed.join(near, F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.col("content") == F.col("_content"))).drop("_page_id", "_content", "content")
    return in_python(both, _difference, "page_id long, url string, text string, n_chars long, n_shared_lines long", exact=["page_id"])
