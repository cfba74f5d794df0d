"""Main text of HTML pages by the container paths that the pages of a host agree on.

First pass: each page is parsed, its containers are scored by the text that they hold outside links, and every
page votes with the shares of its containers' generalised paths (tags with their first class, digits folded; what
is before the last PATH_CHARS characters of a path stands in it as a digest).
Spark sums the votes for each host and path and takes the path with the most. Second pass: each page is parsed again and the text below the elements
on its host's path is the result; a page without such text falls back to its own best container.

Left out wherever they stand: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments and markup comments. An element is left out by its tag, by hidden or aria-hidden, or by a mark: a
class, id or role that is a word of MARKS, or whose first or last word is one while all its words are of MARKS or FRAME
(`site-footer`), but not behind has-, with-, without- or no-. Beside other words (`ad-hoc`, `related-work`) a mark is weak: such a block goes only where most of its text
is links, or outside the winning containers.
Where elements with one mark hold most of a page's text, that mark counts for nothing on this page
(`search-results`), unless it is one of FIRM or stands alone as the whole class. A left-out element ends where the standard ends
it, also without an end tag of its own. Character references are decoded, white space in a block becomes one
space, blocks are joined by a line feed.

Null and empty html give an empty text; an empty table gives an empty result. Pages of any length and depth take time and memory in proportion
to them. Votes are integers, so results don't depend on the order of rows; ties go to the path that sorts first.
Repeated rows vote again and give repeated results. Pages of null URLs share the empty host. Other columns are kept; of
clashing names the operator's wins.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import urls
from .common import settle

#: Hosts whose winning paths are sent to all executors; with more, a shuffle join brings them.
BROADCAST_HOSTS = 20_000

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table caption colgroup tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div td body blockquote center dd details".split())
DROPPED = frozenset("nav header footer aside form script style noscript template iframe svg math canvas object button select option textarea input dialog menu head title audio video noembed noframes xmp".split())
MARKS = frozenset("ad ads adsbygoogle advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu topbar header masthead footer sidebar aside cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments disqus replies respond share sharing social subscribe newsletter signup login related recommended breadcrumb breadcrumbs pagination pager skip toolbar widget contentinfo complementary search".split())
FIRM = frozenset("ad ads adsbygoogle advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu footer sidebar cookie cookies consent gdpr comment comments disqus replies respond hidden".split())
#: Words that say where or how an element stands, and nothing of what it says.
FRAME = frozenset("site page main global top bottom left right upper lower inner outer first last primary secondary sticky fixed float floating mobile desktop wrapper wrap container box block list item items bar strip area zone slot section panel pane column col row group holder root body inner button buttons link links icon icons form field text title heading image img label unit units post entry article content blog user reader wp js ui js fb bs md lg sm xs".split())
KEPT = frozenset("html body article main".split())
#: Longest container path that is written out.
PATH_CHARS = 400

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|["'])*+)>|<[!?/][^>]*+>""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=][^\s=>/]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?""")
_WORD = re.compile(r"[a-z]+|\d+")
_ABOUT = re.compile(r"(?<![^\s_-])(?:has|with|without|no)[_-]\S*")
_DIGITS = re.compile(r"\d+")
_IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
_P_ENDS = BLOCK - {"html", "body"}
#: The elements that a start tag ends, up to what bounds the search; the search ends at the first of the same name.
_SAME = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dd", "dt"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("th", "td"), ("tr", "table")), "option": (("option",), ("select",))}


def _mark(value: str) -> str:
    """The mark of a class, id or role: a word of MARKS, with = before it if it stands alone and ? if its name has other words than FRAME's; empty if there is none."""
    found = ""
    for name in _ABOUT.sub(" ", value).split():
        if name in MARKS:
            return "=" + name
        words = _WORD.findall(name)
        if own := next((w for w in (words[:1] + words[-1:]) if w in MARKS), ""):
            sure = all(w in MARKS or w in FRAME or w.isdigit() for w in words)
            found = own if sure and found[:1] in ("", "?") else found or "?" + own
    return found


def _attributes(raw: str) -> tuple[str, str]:
    """The first class, and the mark of what isn't main text. Of repeated attributes the first counts."""
    own: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        name = m[1].lower()
        if name in _ASKED and name not in own:
            own[name] = unescape(m[2] or m[3] or m[4] or "").lower()
    first = own.get("class", "").split()
    marks = ["hidden"] if "hidden" in own or own.get("aria-hidden") == "true" else []
    marks += [m for k in ("class", "id", "role") if (m := _mark(own.get(k, "")))]
    return _DIGITS.sub("0", first[0]) if first else "", next((m for m in marks if _is_firm(m)), next((m for m in marks if not _is_weak(m)), marks[0] if marks else ""))


_ASKED = frozenset("class id role hidden aria-hidden".split())


def _is_firm(mark: str) -> bool:
    return mark[0] == "=" or mark in FIRM


def _is_weak(mark: str) -> bool:
    return mark[:1] == "?"


class Page:
    """What a page holds: its containers, each with its path and the place of the one around it, and its blocks of text."""

    def __init__(self) -> None:
        self.paths, self.parents = ["body"], [-1]
        self.tags = ["body"]
        self.texts: list[str] = []
        self.linked: list[int] = []  # characters of each block that are in links
        self.homes: list[int] = []  # the innermost container of each block
        self.doubts: list[int] = []  # the number of the weakly marked element that each block is in, 0 for none
        self.held: dict[str, int] = {}  # characters left out for each mark that isn't firm

    def open(self, home: int, tag: str, first: str) -> int:
        above = self.paths[home]
        if len(above) > PATH_CHARS:
            above = "#" + hashlib.blake2b(above.encode(), digest_size=8).hexdigest()
        self.paths.append(f"{above}/{tag}.{first}" if first else f"{above}/{tag}")
        self.parents.append(home)
        self.tags.append(tag)
        return len(self.paths) - 1


def parse(html: str, spared: frozenset[str] = frozenset()) -> Page:
    """The page's blocks of text in order with their containers; `spared` are marks that count for nothing."""
    page = Page()
    names: list[str] = ["body"]  # open elements
    homes: list[int] = [0]  # the container that each is in
    count: Counter[str] = Counter()
    parts: list[str] = []
    linked = links = 0
    weak = doubt = 0  # the place of the outermost weakly marked block that is open, and how many there have been
    at, skip, firm, held = 0, 0, 0, ""  # skip, firm: the places of the outermost left-out elements that are open, 0 for none

    def last(tag: str, least: int) -> int:
        """The place of the innermost open element of that name, or 0."""
        if count[tag]:
            for i in range(len(names) - 1, least - 1, -1):
                if names[i] == tag:
                    return i
        return 0

    def flush() -> None:
        nonlocal linked
        if skip:
            return
        if parts:
            if text := " ".join("".join(parts).split()):
                page.texts.append(text)
                page.linked.append(linked)
                page.homes.append(homes[-1])
                page.doubts.append(doubt if weak else 0)
            parts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal links, skip, firm, weak
        ended = names[depth : skip + 1] if skip else names[depth:]  # what a dropped element holds ends no block
        if depth <= firm:
            firm = 0
        if depth <= skip:
            skip = 0
        if not BLOCK.isdisjoint(ended):
            flush()
        if depth <= weak:
            weak = 0
        gone = names[depth:]
        links -= gone.count("a")
        count.subtract(gone)
        del names[depth:], homes[depth:]

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if links:
                linked += len(raw)

    end = len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if not skip:
            text(html[at : m.start() if m else end])
        elif not firm:
            page.held[held] = page.held.get(held, 0) + sum(map(len, html[at : m.start() if m else end].split()))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1]
        if skip == len(names) - 1 and names[skip] == "head" and not closing and tag not in _IN_HEAD:
            close(skip)
        if closing:
            if tag in ("html", "body"):
                continue
            if tag == "br":
                if not skip:
                    parts.append(" ")
            elif depth := last(tag, 1):
                # inline end tags don't reach out of a dropped block, and none out of a template or object
                if depth >= skip or names[skip] not in ("template", "object") and (tag in _P_ENDS and tag != "p" or names[skip] not in BLOCK | DROPPED):
                    close(depth)
            continue
        if tag in ("html", "body"):
            continue
        if tag == "br" or tag == "wbr":
            if not skip:
                parts.append(" " if tag == "br" else "")
            continue
        raw = m[3]
        if tag in VOID:
            if tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            at = html.find(">", stop.start()) + 1 or end if stop else end
            continue
        if raw.endswith("/") and (tag in ("svg", "math") or skip and names[skip] in ("svg", "math")):
            continue
        # implied ends reach out of a dropped inline element, but not out of other dropped ones
        least = skip if skip and (names[skip] in BLOCK | DROPPED or tag != "p" and tag not in _SAME) else 1
        if tag in _P_ENDS and (depth := last("p", least)):
            close(depth)
        elif tag in BLOCK:
            flush()
        if tag in _SAME:
            same, bound = _SAME[tag]
            if any(count[x] for x in same):
                found = 0
                for i in range(len(names) - 1, least - 1, -1):
                    if names[i] in bound:
                        break
                    if names[i] in same:
                        found = i
                        if names[i] == same[0]:
                            break
                if found:
                    close(found)
        first, mark = _attributes(raw) if raw and not raw.isspace() and not firm else ("", "")
        if mark and (tag in KEPT or mark in spared):
            mark = ""
        if tag in BLOCK:
            flush()
        if _is_weak(mark):
            if tag in BLOCK and tag not in DROPPED and not skip and not weak:
                weak, doubt = len(names), doubt + 1
            mark = ""
        if tag in DROPPED or mark:
            if not firm and (tag in DROPPED or _is_firm(mark)):
                firm = len(names)
            if not skip:
                skip, held = len(names), mark
        names.append(tag)
        count[tag] += 1
        links += tag == "a"
        homes.append(page.open(homes[-1], tag, first) if tag in CONTAINER and not skip else homes[-1])
    flush()
    _settle_doubts(page)
    return page


def _settle_doubts(page: Page) -> None:
    """Takes out the blocks of weakly marked elements of which most is links."""
    size: Counter[int] = Counter()
    for text, linked, d in zip(page.texts, page.linked, page.doubts):
        size[d] += 2 * linked - len(text)
    gone = {d for d, n in size.items() if d and n > 0}
    if gone:
        kept = [i for i, d in enumerate(page.doubts) if d not in gone]
        page.texts, page.linked, page.homes = ([own[i] for i in kept] for own in (page.texts, page.linked, page.homes))


def read(html: str) -> Page:
    """The page parsed, without the marks that most of its text stands under."""
    page, spared = parse(html), frozenset()
    while page.held:
        mark, n = max(page.held.items(), key=lambda x: (x[1], x[0]))
        if not mark or 2 * n <= sum(map(len, page.texts)) + sum(page.held.values()):
            break
        spared |= {mark}
        page = parse(html, spared)
    return page


def scores(page: Page) -> dict[str, float]:
    """The score of each container path: the text outside links, in full for the innermost container, less for those around it."""
    own = [0.0] * len(page.paths)
    for text, linked, home in zip(page.texts, page.linked, page.homes):
        own[home] += max(0.0, len(text) - 1.5 * linked)
    below, whole = own[:], own
    for i in range(len(own) - 1, 0, -1):  # a container comes after the one around it
        below[page.parents[i]] += below[i] / 2
        whole[page.parents[i]] += whole[i]
    out: dict[str, float] = {}
    used = set(page.homes)
    for i in range(len(own) - 1, -1, -1):
        if i in used:
            used.add(page.parents[i])
            path = page.paths[i]
            out[path] = out.get(path, 0.0) + (1.25 * whole[i] if page.tags[i] in ("article", "main") else below[i])
    return out


def _below(page: Page, path: str) -> list[str]:
    """The blocks in the containers on a path."""
    inside = []
    for own, parent in zip(page.paths, page.parents):
        inside.append(own == path or parent >= 0 and inside[parent])
    return [t for t, home in zip(page.texts, page.homes) if inside[home]]


def votes(html: str) -> dict[str, int]:
    """Path -> its share of the page's best score, in thousandths."""
    own = scores(read(html))
    best = max(own.values(), default=0.0)
    return {p: round(1000 * s / best) for p, s in own.items()} if best > 0 else {}


def extract(html: str, path: str | None) -> str:
    """The text below the path; without any, below the page's own best path, or else all that is left."""
    page = read(html)
    kept = _below(page, path) if path else []
    if not kept and page.texts:
        own = scores(page)
        best = min(own, key=lambda p: (-own[p], p))
        kept = _below(page, best) if own[best] > 0 else page.texts
    return "\n".join(kept)


def host_paths(pages: DataFrame) -> DataFrame:
    """host, main_path: the path with the most votes among the pages (host, html) of each host."""

    def run(batches):
        for batch in batches:
            hosts, paths, counts = [], [], []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
                for path, n in votes(html.as_py()).items():
                    hosts.append(host)
                    paths.append(path)
                    counts.append(n)
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "path": pa.array(paths, pa.string()), "votes": pa.array(counts, pa.int64())})

    cast = pages.select("host", "html").mapInArrow(run, "host string, path string, votes long")
    summed = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("main_path"))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """Adds text and n_chars to the pages; html itself doesn't reach the result."""
    kept = [c for c in pages.columns if c.lower() not in ("host", "html", html_col.lower(), "main_path", "text", "n_chars")]
    own = pages.select(*[f"`{c}`" for c in kept], F.coalesce(html_col, F.lit("")).alias("html"), urls.host(F.col(url_col)).alias("host"))
    paths = settle(host_paths(own), "host-paths")
    small = paths.count() <= broadcast_hosts
    joined = own.join(F.broadcast(paths) if small else paths, "host", "left")

    def run(batches):
        for batch in batches:
            texts = [extract(h.as_py(), p) for h, p in zip(batch.column("html"), batch.column("main_path").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*kept, "text", "n_chars"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([pages.schema[c] for c in kept] + [StructField("text", StringType()), StructField("n_chars", LongType())])
    return joined.select(*[f"`{c}`" for c in kept], "html", "main_path").mapInArrow(run, schema)
