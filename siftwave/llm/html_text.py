"""Main text of web pages by site style trees.

The pages of a host are merged: a style node is a path of tags and classes, and for each style node the pages' presentations (the
sequence of child elements) and contents (the words below it) are counted. A node that looks and reads the same on most pages of its host
has low importance, one that differs from page to page has high importance: entropies to the base of the number of pages say which.
A branch's importance is combined from its own presentation and its children's, its leaves' from their contents. Branches of low
importance are removed from each page, in the article too, of which at least half stays, as articles may be copied all over a host. What HTML itself
declares to be menu, footer, advert, form and so on by its tag or role is of no importance whatever its words, as such parts may
change with every page. So is what a class or id calls comments, advert, sidebar or notice by its whole name. A menu, or a list of related pages, is
one only if at least half of its words are links; anything else of that name is text, which the trees judge as they judge the rest.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, table

#: Elements by what HTML has them mean.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br"}
NOISE = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "head", "title", "button", "select", "textarea", "input", "svg", "canvas", "object", "dialog", "menu", "noembed", "noframes", "xmp", "audio", "video"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "sponsor", "sponsored", "promo", "promotion", "promotions", "sidebar", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "banner", "popup", "modal", "newsletter", "subscribe", "subscription", "comment", "comments", "commentlist", "disqus", "respond"}
OF_LINKS = {"menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "share", "sharing", "social", "related", "widget", "widgets", "toolbar", "pagination", "pager"}
OUTSIDE = {"header", "masthead", "topbar"}
BESIDE = {"site", "page", "main", "primary", "secondary", "global", "reader", "readers", "user", "users", "top", "bottom", "left", "right", "box", "block", "area", "list", "section", "container", "wrapper", "wrap", "inner", "bar", "form", "text", "body", "post", "article", "entry", "posts", "links", "link", "message", "google", "js"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}

#: Importance under which a branch goes; pages of a host that a style node must stand on to be judged; importance from which a node needs no row in the tree.
LOW = 0.2
PAGES = 8
HIGH = 0.9
DECAY = 0.9

#: Judged style nodes of all hosts that go to every executor at once, some 40 bytes each. With more, each page gets its own nodes' importances by a join.
TREE_ROWS = 200_000

#: Elements that a class alone makes nothing else.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: Quoted values are taken whole and never looked at again, so a page takes time in proportion to its length.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>""", re.S)
_UNQUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    """An element, or text if tag is empty. named: what its class or id says that it is, one of ``NAMES``, ``OF_LINKS`` or ``OUTSIDE``, or nothing."""

    __slots__ = ("tag", "name", "noise", "named", "main", "children", "text", "holds_main", "words", "links")

    def __init__(self, tag: str, name: str = "", noise: bool = False, main: bool = False, text: str = "", named: set[str] | None = None):
        self.tag, self.name, self.noise, self.named, self.main, self.text = tag, name, noise, named, main, text
        self.words, self.links = len(text.split()), 0
        self.children: list[Node] = []
        self.holds_main = False


def named(name: str, in_main: bool) -> set[str] | None:
    """Which list has a class's or id's name: it is made of a word of that list and of words that stand beside such words, and of no others."""
    parts = [x.lower() for x in _PART.findall(name)] if name.isascii() else []
    for words in (NAMES, OF_LINKS, OUTSIDE):
        if not words.isdisjoint(parts) and all(x in words or x in BESIDE or x.isdigit() or x in NAMES or x in OF_LINKS for x in parts):
            return None if words is OUTSIDE and in_main else words
    return None


def _element(tag: str, source: str, in_main: bool) -> Node:
    name, noise, main, kind = tag, tag in NOISE or (tag == "header" and not in_main), tag in ("article", "main"), None
    if source and source != "/":
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(source)}
        classes = found.get("class", "").split()
        if classes:
            name = f"{tag}.{'.'.join(sorted(x.lower() for x in classes))}"
        role = found.get("role", "").lower()
        main = main or role in ("main", "article")
        noise = noise or role in ROLES
        if tag not in INLINE and tag not in HEADINGS and tag not in ("html", "body", "main"):
            kind = next(filter(None, (named(x, in_main) for x in [*classes, found.get("id", "")])), None)
    return Node(tag, name, noise, main and not noise and kind is not NAMES, named=kind)


def parse(source: str) -> Node:
    """The tree of a page, however broken: open elements end with their parents, paragraphs with the next block."""
    root = Node("", "")
    stack, at, n, mains = [root], 0, len(source), 0
    held: Counter[str] = Counter()  # of each tag, how many elements are open

    def cut(i: int) -> None:
        nonlocal mains
        for x in stack[i:]:
            held[x.tag] -= 1
            mains -= x.main
        del stack[i:]

    text_from, last = 0, source.rfind(">")
    while True:
        start = source.find("<", at)
        if start < 0 or start > last:
            break
        m = _TOKEN.match(source, start) or _UNQUOTED.match(source, start)
        if not m:
            at = start + 1
            continue
        if start > text_from:
            stack[-1].children.append(Node("", text=html.unescape(source[text_from:start])))
        at = text_from = m.end()
        tag = (m[2] or "").lower() if m.re.groups and m.lastindex else ""
        if not tag:
            continue
        if m[1]:
            if held[tag]:
                cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        ends = CLOSES.get(tag)
        if (ends or tag not in INLINE) and (held["p"] or any(held[t] for t in ends or ())):
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i].tag
                if t == "p" or (ends and t in ends):
                    cut(i)
                elif (ends and t in HOLDS[tag]) or (not ends and t not in INLINE):
                    break
        node = _element(tag, m[3], mains > 0)
        stack[-1].children.append(node)
        if node.main:
            for x in reversed(stack):
                if x.holds_main:
                    break
                x.holds_main = True
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            at = text_from = close.start() if close else n
            continue
        held[tag] += 1
        mains += node.main
        stack.append(node)
    if text_from < n:
        stack[-1].children.append(Node("", text=html.unescape(source[text_from:])))
    _settle(root)
    return root


def _settle(root: Node) -> None:
    """Counts the words of each element and those in links, scripts and menus left out, and decides what elements are that have a name."""
    order = [root]
    for x in order:
        order += [c for c in x.children if c.tag]
    for x in reversed(order):
        gone = x.noise and not x.holds_main
        x.words = 0 if gone else sum(c.words for c in x.children)
        x.links = 0 if gone else x.words if x.tag == "a" else sum(c.links for c in x.children)
    for x in order:
        x.noise = x.noise or x.named is NAMES or x.named is OUTSIDE or (x.named is OF_LINKS and 2 * x.links >= x.words)


def _has(root: Node, tag: str) -> bool:
    """Whether such an element stands in the article."""
    work = [(root, False)]
    while work:
        x, inside = work.pop()
        if inside and x.tag == tag:
            return True
        work += [(c, inside or x.main) for c in x.children if c.tag and not (x.noise and not x.holds_main)]
    return False


def _blocks(root: Node, dropped: set[int], out: list[list[str]]) -> None:
    """Appends the pieces of text of each block to out; a block begins and ends with elements that aren't inline. Where HTML declares an article, text outside it is none of it, but for a page's first heading if the article has none."""
    only_main = root.holds_main
    title = only_main and not _has(root, "h1")
    work: list[tuple[Node | None, bool]] = [(root, not only_main)]
    while work:
        x, inside = work.pop()
        if x is None:
            out.append([])
            continue
        if not x.tag and not x.children:
            if inside:
                out[-1].append(x.text)
            continue
        if (x.noise and not x.holds_main) or id(x) in dropped:
            if x.tag not in INLINE:
                out.append([])
            continue
        if x.tag in ("br", "wbr"):
            out[-1].append(" " if x.tag == "br" else "")
            continue
        block = x.tag and x.tag not in INLINE
        if block:
            out.append([])
            work.append((None, inside))
        work += [(c, inside or x.main or (title and x.tag == "h1")) for c in reversed(x.children)]


def text_of(source: str, stats: dict[int, tuple[float, float]] | None = None) -> str:
    """The main text of a page: blocks in page order, one a line. stats: of the host's style nodes, importance of presentation and content."""
    root = parse(source)
    dropped = _unimportant(root, stats) if stats else set()
    out: list[list[str]] = [[]]
    _blocks(root, dropped, out)
    lines = (" ".join("".join(pieces).split()) for pieces in out)
    return "\n".join(x for x in lines if x)


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


@lru_cache(maxsize=1 << 16)
def _below(path: int, name: str) -> int:
    """The path of a child of that name."""
    return _hash(f"{path}/{name}")


def _style_nodes(root: Node) -> Iterator[tuple[Node, int, int, int]]:
    """(element, path, presentation, content) as hashes, children before parents."""
    work: list[tuple[Node, int, bool]] = [(root, 0, False)]
    words: dict[int, int] = {}
    while work:
        x, path, seen = work.pop()
        inner = [c for c in x.children if c.tag]
        if not seen:
            work.append((x, path, True))
            work += [(c, _below(path, c.name), False) for c in inner]
            continue
        words[id(x)] = _hash(" ".join(str(words.pop(id(c), "")) if c.tag else " ".join(c.text.split()) for c in x.children))
        if x.tag:
            look: list[str] = []
            for c in x.children:  # a run of like children looks like one
                if c.tag and look[-1:] != [c.name]:
                    look.append(c.name)
            yield x, path, _hash(">".join(look)), words[id(x)]


def _unimportant(root: Node, stats: dict[int, tuple[float, float]]) -> set[int]:
    """The elements whose branches are of low importance."""
    of: dict[int, float] = {}
    low = set()
    order = [(root, 0)]
    for x, path in order:
        order += [(c, _below(path, c.name)) for c in x.children if c.tag]
    for x, path in reversed(order[1:]):  # children before parents
        node, content = stats.get(path, (1.0, 1.0))
        kids = [of[id(c)] for c in x.children if id(c) in of]
        if kids:
            keep = DECAY ** len(kids)
            of[id(x)] = (1 - keep) * node + keep * max(sum(kids) / len(kids), content)
        else:
            of[id(x)] = content
        if of[id(x)] < LOW and not x.holds_main and not x.main:
            low.add(id(x))
    return low if not low or _words_left(root, low) else {i for i in low if i not in _inside_main(root)}


def _inside_main(root: Node) -> set[int]:
    """The elements below those that HTML declares to be the article."""
    work, out = [(root, False)], set()
    while work:
        x, inside = work.pop()
        if inside:
            out.add(id(x))
        work += [(c, inside or x.main) for c in x.children if c.tag]
    return out


def _words_left(root: Node, low: set[int]) -> bool:
    """Whether the article, if there is one, keeps more than half of its words: one that is copied all over a host has low importance, but is the article."""
    work, all_words, left = [(root, False, False)], 0, 0
    while work:
        x, inside, gone = work.pop()
        if x.tag and x.noise and not x.holds_main:
            continue
        gone = gone or id(x) in low
        if inside and not x.tag:
            all_words += x.words
            left += 0 if gone else x.words
        work += [(c, inside or x.main, gone) for c in x.children]
    return 2 * left > all_words or not all_words


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (host, hash, size, html) to (host, hash, size, path, kind, value) for each style node of a page: one row with how it looks there (kind 0), and one with each of its contents (kind 1)."""
    for b in batches:
        row, out = [], ([], [], [])
        for i, source in enumerate(b.column(3).to_pylist()):
            looks: dict[int, set[int]] = {}
            contents: dict[int, set[int]] = {}
            for _, path, look, content in _style_nodes(parse(source or "")):
                looks.setdefault(path, set()).add(look)
                contents.setdefault(path, set()).add(content)
            for path, of in looks.items():
                for kind, value in ((0, next(iter(of)) if len(of) == 1 else _hash(str(sorted(of)))), *((1, c) for c in contents[path])):
                    row.append(i)
                    for o, v in zip(out, (path, kind, value), strict=True):
                        o.append(v)
        page = pa.array(row, pa.int64())
        found = [pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int32(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(page) for c in range(3)), *found], ["host", "hash", "size", "path", "kind", "value"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (page_id, url, html, stats) to (page_id, url, text)."""
    for b in batches:
        texts = []
        for source, stats in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            texts.append(text_of(source or "", {s["path"]: (s["look"], s["content"]) for s in stats} if stats else None))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _read_all(shared: Any):
    """As _read(), with the trees of all hosts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (page_id, url, html, host) to (page_id, url, text)."""
        trees: dict[str, dict[int, tuple[float, float]]] = {}
        for host, path, look, content in zip(*(c.to_pylist() for c in shared.value.columns), strict=True):
            trees.setdefault(host, {})[path] = look, content
        for b in batches:
            texts = [text_of(source or "", trees.get(host)) for source, host in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return of


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def style_nodes(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, hash, size, path, kind, value) from (host, hash, size, html), see _merge(); hash and size say which page it is, and equal pages are one."""
    return scratch.save(pages.select("host", "hash", "size", "html").mapInArrow(_merge, "host string, hash long, size int, path long, kind int, value long"), "nodes")


def style_trees(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, path, look, content) of style nodes: two importances from 0 to 1 for each that stands on PAGES of the host's pages or more. What is different on nearly every page, as articles are, isn't listed."""
    counts = nodes.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("c"))
    c = F.col("c").cast("double")
    kinds = counts.groupBy("host", "path", "kind").agg(F.sum(c).alias("n"), F.sum(c * F.log(c)).alias("s"))
    entropy = F.greatest(F.lit(0.0), F.log("n") - F.col("s") / F.col("n")) / F.log("n")
    # presentation: the more ways to look, the more important; content: the same words on all pages, and the entropy of the pages given the words is 1
    importance = F.when(F.col("n") <= 1, 1.0).otherwise(entropy)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, importance))
    # a page has one row of presentation for each node, and one of content at least
    both = kinds.groupBy("host", "path").agg(F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"), of(0).alias("look"), of(1).alias("content"))
    both = both.where((F.col("pages") >= PAGES) & (F.least("look", "content") < HIGH))
    return scratch.save(both.select("host", "path", "look", "content"), "trees")


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each row of df: page_id, url, text (empty if none) and n_chars, its code points.

    Null html counts as empty, a null url as a host of its own; neither ids nor repeated rows matter. Other columns are not read. An empty
    table gives an empty table. White space, also that of character references, becomes one space inside a block. Style nodes that stand on
    fewer than PAGES pages of a host aren't judged. A branch goes if its importance is under LOW; where more than half of an article's words would go, as of an article
    that is copied all over a host, the article stays whole. A page brings only the importances of its own nodes with it, however large its host's tree.
    """
    scratch = Scratch(df.sparkSession, "html")
    source = F.coalesce(html_col, F.lit(""))
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"), F.xxhash64(source).alias("hash"), F.length(source).alias("size"))
    nodes = style_nodes(rows, scratch)
    trees = style_trees(nodes, scratch)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string"
    if trees.count() <= TREE_ROWS:
        shared = df.sparkSession.sparkContext.broadcast(trees.toArrow())
        scratch.drop("nodes")
        return rows.select("page_id", "url", "html", "host").mapInArrow(_read_all(shared), schema).withColumn("n_chars", F.length("text").cast("long"))
    page = ["host", "hash", "size"]
    own = nodes.where("kind = 0").select(*page, "path").distinct().join(trees, ["host", "path"])
    own = scratch.save(own.groupBy(*page).agg(F.collect_list(F.struct("path", "look", "content")).alias("stats")), "pages")
    scratch.drop("nodes")
    found = rows.join(own, page, "left").select("page_id", "url", "html", "stats")
    return found.mapInArrow(_read, schema).withColumn("n_chars", F.length("text").cast("long"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
