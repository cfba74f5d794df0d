"""The extractor against a plain one that builds a tree with the standard library's parser."""

import os
import re
from collections import defaultdict
from html.parser import HTMLParser

import duckdb
import pytest

from textloom.llm import html_text as h

FOLDER = "/root/testdata/sf0.01"
ENDS_P = set("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt tr td th body".split())
BLOCKS = ENDS_P | {"html", "head", "title"}
HOLDERS = {"article", "main", "section", "div", "td", "body", "blockquote"}
GONE = {"nav", "header", "footer", "aside", "form", "script", "style", "head", "title", "button", "noscript"}
EMPTY = {"br", "img", "meta", "link", "hr", "input"}


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, dict(attrs), parent, []


class Tree(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("body", {}, None)
        self.feed(html)
        self.close()

    def _end(self, names, stop):
        x = self.now
        while x is not self.root and x.tag not in names:
            if x.tag in stop:
                return
            x = x.parent
        if x is not self.root:
            self.now = x.parent

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag in ENDS_P:
            self._end({"p"}, set())
        if tag == "li":
            self._end({"li"}, {"ul", "ol"})
        if tag == "td":
            self._end({"td"}, {"tr", "table"})
        if tag == "tr":
            self._end({"tr"}, {"table"})
        node = Node(tag, attrs, self.now)
        self.now.children.append(node)
        if tag not in EMPTY:
            self.now = node

    def handle_endtag(self, tag):
        if tag not in ("html", "body") and tag not in EMPTY:
            self._end({tag}, set())

    def handle_data(self, data):
        self.now.children.append(data)


def gone(node):
    words = " ".join((node.attrs.get(k) or "") for k in ("class", "id", "role")).split()
    return node.tag in GONE or "hidden" in node.attrs or not {"ad", "sidebar", "comments", "menu", "site-menu", "ad-slot", "comments-list"}.isdisjoint(words) or doubted(node)


def doubted(node):
    """Whether a block with a mark beside other words holds more links than half of its text."""
    if node.tag not in ENDS_P or not {"ad-hoc", "menu-engineering", "comments-on-law"} & set((node.attrs.get("class") or "").split()):
        return False
    size = links = 0
    todo = [(node, False)]
    while todo:
        own, inside = todo.pop()
        for x in own.children:
            if isinstance(x, str):
                size += len("".join(x.split()))
                links += len("".join(x.split())) * inside
            else:
                todo.append((x, inside or x.tag == "a"))
    return 2 * links > size


def blocks(root):
    """(text, characters in links, containers around it as nodes) in order."""
    out, parts, linked, home = [], [], [0], [None]

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, linked[0], home[0]))
        parts.clear()
        linked[0] = 0

    def walk(node, around, in_link):
        if gone(node):
            if node.tag in BLOCKS and node.tag not in ("script", "style"):
                flush()
            return
        around = [*around, node] if node.tag in HOLDERS else around
        if node.tag in BLOCKS:
            flush()
        for x in node.children:
            home[0] = around
            if isinstance(x, str):
                parts.append(x)
                linked[0] += len(x) * in_link
            elif x.tag == "br":
                parts.append(" ")
            else:
                walk(x, around, in_link or x.tag == "a")
        home[0] = around
        if node.tag in BLOCKS:
            flush()

    walk(root, [], False)
    return out


def path(node):
    if node.parent is None:
        return "body"
    up = node.parent
    while up.tag not in HOLDERS and up.parent is not None:
        up = up.parent
    first = (node.attrs.get("class") or "").lower().split()
    return path(up) + "/" + node.tag + ("." + re.sub(r"\d+", "0", first[0]) if first else "")


def scores(found):
    out = defaultdict(float)
    for text, linked, around in found:
        for i, node in enumerate(reversed(around)):
            out[path(node)] += max(0, len(text) - 1.5 * linked) * (1.25 if node.tag in ("article", "main") else 0.5**i)
    return out


def texts(pages):
    """The texts of (host, html)."""
    found = [blocks(Tree(html).root) for _, html in pages]
    votes = defaultdict(lambda: defaultdict(int))
    for (host, _), own in zip(pages, found):
        s = scores(own)
        best = max(s.values(), default=0)
        for p in s if best > 0 else ():
            votes[host][p] += round(1000 * s[p] / best)
    out = []
    for (host, _), own in zip(pages, found):
        pick = lambda p: [t for t, _, around in own if p in [path(n) for n in around]]
        kept = pick(min(votes[host], key=lambda p: (-votes[host][p], p))) if votes[host] else []
        if not kept and own:
            s = scores(own)
            best = min(s, key=lambda p: (-s[p], p))
            kept = pick(best) if s[best] > 0 else [t for t, _, _ in own]
        out.append("\n".join(kept))
    return out


def host(url):
    return re.match(r"[^/?#]*", url.partition("://")[2])[0].lower() if url and "://" in url else ""


MADE = [
    ("a", '<div class="c"><p>{0} one<p>{0} two <b>bold</b><br>after<ul><li>x<li>y</ul></div><div class="sidebar"><p>side</div>'),
    ("a", '<div class="c"><div class="c9"><p>{0}</p></div><a href="x">{0} linked {0}</a></div><div class="menu">m<div>n</div></div>tail'),
    ("a", '<div class="d"><p>{0} {0} {0} {0}</div><div class="c"><p>short</div>'),
    ("b", "<table><tr><td>{0}<td class='ad'>no<tr><td>&eacute;&amp;</table><section><p hidden>no<p>{0}{0}</section>"),
    ("b", '<p title="the hidden valley" data-note="class=ad">{0}</p><aside>no<p>no</aside><form><p>no</form><p>{0}'),
    ("c", "<nav><ul><li>no</ul></nav><a>only links</a>"),
    ("c", "<nav>no</nav>"),
    ("e", "<article><p class='ad-hoc'>{0}</p><section class='menu-engineering'><p>{0} two</section><div class='site-menu'>no</div><p>{0}</article>"),
    ("e", "<article><p>{0}<div class='comments-on-law'><p>{0} law</div><div class='comments-list'><p>no</div><ul class='menu-engineering'><li><a href='x'>{0}</a><li><a href='y'>no</a></ul></article>"),
    ("e", "<article><p>{0} {0}</article><div class='ad-hoc'><p>apart</div><div class='ad-slot'>no</div>"),
    ("d", "<main><h1>T</h1><blockquote>{0}</blockquote><p>x <span>y</span>z</main><div id='comments'><p>no {0}</div>"),
]


def test_made_pages(spark):
    rows = [(i, f"http://{host}/{i}", html.format("main text " * (i % 3 + 2))) for i, (host, html) in enumerate(MADE * 3)]
    got = {r.page_id: r.text for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = texts([(host(u), x) for _, u, x in rows])
    assert [got[i] for i in range(len(rows))] == want
    assert any(want) and not all(want)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_all_pages(spark):
    rows = duckdb.sql(f"select page_id, url, html from '{FOLDER}/pages.parquet'").fetchall()
    got = {r.page_id: r.text for r in h.main_text(spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url", "html")).collect()}
    want = texts([(host(u), x or "") for _, u, x in rows])
    assert [got[i] for i, _, _ in rows] == want
    assert len(set(want)) > len(rows) / 2
