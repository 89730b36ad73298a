"""Main text of web pages by removing a site's template.

Every element's subtree is hashed; a host's hashes are counted in Spark, and subtrees that recur are deleted from that
host's pages, wherever they stand: beside an article, what does not recur is text of the page like the article itself.
What names itself as a menu, header, footer, sidebar, notice, advert, form or comment goes by its name, also on hosts
with few pages. Inside an article only boxes can be template, counted once for each different article: its paragraphs,
headings and lists stay even if they recur. Beside articles a subtree counts once for each different page, and where a
page has several articles, each can be template as a whole. Names inside an article count only where a box bears one
as its whole name (``comments``, not ``related-work``); anything else there goes by its hash alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.naming import apart
from colloquy.session import cut

# Element names of the HTML standard by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template nav header footer aside form button select textarea iframe svg canvas audio video object embed menu dialog title xmp noembed noframes math".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BOXES = frozenset("div section table ul ol dl figure details fieldset center address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends without an end tag of its own, and how far up to look.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = frozenset("ul ol dl table tr select body html article main".split())
#: Words in class, id or role that name something beside the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside "
    "footer header masthead cookie cookies consent notice notices popup modal newsletter subscribe subscription signup share sharing social related recommended "
    "comment comments reply replies respond disqus pagination pager toolbar search complementary contentinfo".split()
)
#: With these, a name says what an element goes with, not what it is.
_AROUND = frozenset("with has no without".split())
KEPT_WHOLE = frozenset("html body main article".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMING = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "named", "children", "holds", "hash", "dropped")

    def __init__(self, tag: str, named: int):
        self.tag, self.named, self.children = tag, named, []
        self.holds, self.hash, self.dropped = False, 0, False


def _loose(text: str) -> Element:
    e = Element("#text", 0)
    e.children.append(text)
    return e


def _names_itself(tag: str, attributes: str) -> int:
    """2 where a whole name in class, id or role is one of NAMES, 1 where a part of a name is, else 0."""
    found, most = NAMES - ({"header", "banner"} if tag in HEADINGS else set()), 0
    for m in _NAMING.finditer(attributes):
        value = (m[1] or m[2] or m[3] or "").lower()
        parts = set(_PART.findall(value))
        if not parts & _AROUND and parts & found:
            most = max(most, 2 if found & set(value.split()) else 1)
    return most


def parse(html: str) -> Element:
    """The tree of a page. Never fails: unclosed elements end with their parents, stray end tags are skipped, and a tag
    or comment that the end cuts off is dropped."""
    root = Element("#root", 0)
    stack, pos = [root], 0
    while True:
        m = _TOKEN.search(html, pos)
        text = html[pos : m.start() if m else len(html)]
        if text:
            stack[-1].children.append(text)
        if m is None:
            return root
        pos = m.end()
        ending, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if ending:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag == "p" and stack[i].tag in BLOCKS and stack[i].tag != "p":
                    break
            continue
        if tag in BLOCKS:  # a block ends an open paragraph
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in CLOSED_BY:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSED_BY[tag]:
                    del stack[i:]
                    if tag != "tr":
                        break
                elif stack[i].tag in FENCES and not (tag == "tr" and stack[i].tag == "tr"):
                    break
            del i
        element = Element(tag, _names_itself(tag, attributes) if attributes else 0)
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
            element.children.append(html[pos : end.start() if end else len(html)])
            pos = end.end() if end else len(html)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(element)
        elif tag not in VOID and tag not in ("svg", "math", "path"):
            stack.append(element)


def _walk(root: Element) -> Iterator[tuple[Element, Element | None]]:
    """All elements with their parents, outer ones first."""
    todo: list[tuple[Element, Element | None]] = [(root, None)]
    while todo:
        e, parent = todo.pop()
        yield e, parent
        todo.extend((c, e) for c in reversed(e.children) if isinstance(c, Element))


def _squeezed(text: str) -> str:
    return " ".join(unescape(text).split())


class Page:
    """A parsed page: what it drops by name, where its main part is, and what its subtrees hash to."""

    def __init__(self, html: str):
        self.root = parse(html)
        self.order = list(_walk(self.root))
        parent = {id(e): p for e, p in self.order}
        # articles or else the main element; those in a box that names itself only where there are no others
        for tag, strict in (("article", True), ("main", True), ("article", False), ("main", False)):
            self.mains = [e for e, _ in self.order if e.tag == tag and not self._beside(e, parent, strict)]
            if self.mains:
                break
        for e in self.mains:
            up = parent[id(e)]
            while up is not None and not up.holds:
                up.holds = True
                up = parent[id(up)]
        # loose text around a main part is hashed and counted like an element
        for e, _ in self.order:
            if e.holds and e not in self.mains:
                e.children = [c if isinstance(c, Element) or not c.strip() else _loose(c) for c in e.children]
        self.order = list(_walk(self.root))
        inside: set[int] = set()
        for e, p in self.order:
            within = p is not None and id(p) in inside
            if within or e in self.mains:
                inside.add(id(e))
            # inside an article only a box that bears the name itself goes by it: text about comments or search is text
            named = e.named and e.tag not in KEPT_WHOLE and (not within or (e.named == 2 and e.tag in BOXES - {"table"}))
            by_tag = e.tag in DROPPED and not (e.tag == "header" and within)
            e.dropped = (p is not None and p.dropped) or ((named or by_tag) and not e.holds)
        self.inside = inside
        for e, _ in reversed(self.order):
            parts = [e.tag.encode()]
            for c in e.children:
                if isinstance(c, Element):
                    if c.hash:
                        parts.append(c.hash.to_bytes(8, "big"))
                elif e.tag not in RAW and (s := _squeezed(c)):
                    parts.append(b"\x00" + s.encode("utf-8", "surrogatepass"))
            e.hash = int.from_bytes(hashlib.blake2b(b"\x01".join(parts), digest_size=8).digest(), "big") or 1 if len(parts) > 1 else 0

    @staticmethod
    def _beside(e: Element, parent: dict, strict: bool) -> bool:
        own = e
        while e is not None:
            if (e.named and e.tag not in ("html", "body", "main") and (strict or e is own)) or e.tag in DROPPED - {"header"}:
                return True
            e = parent[id(e)]
        return False

    def main_hash(self) -> int:
        whole = self.mains or [self.root]
        return _signed(int.from_bytes(hashlib.blake2b(b"".join(e.hash.to_bytes(8, "big") for e in whole), digest_size=8).digest(), "big"))

    def found(self) -> set[tuple[int, bool, int]]:
        """(hash, whether it is running text, hash of what it counts once for) of what may be template."""
        main, page, tops = self.main_hash(), _signed(self.root.hash), {id(e) for e in self.mains}
        return {(_signed(e.hash), r, main if id(e) in self.inside and id(e) not in tops else page) for e, r in self.deletable()}

    def deletable(self) -> Iterator[tuple[Element, bool]]:
        """(element, whether it is running text) for what may be template: beside a main part anything, inside one
        boxes, and each of several main parts; without a main part anything under the body."""
        cards = {id(e) for e in self.mains} if len(self.mains) > 1 else set()
        for e, _ in self.order:
            if e.hash and not e.holds and (e.tag not in KEPT_WHOLE or id(e) in cards) and e.tag != "#root":
                if id(e) in self.inside:
                    if e.tag in BOXES or id(e) in cards:
                        yield e, False
                else:
                    yield e, not self.mains and e.tag not in BOXES and e.tag not in DROPPED

    def text(self, boxes: frozenset[int], running: frozenset[int]) -> str:
        """The blocks of the page without what is dropped by name or by hash."""
        gone = {id(e) for e, is_text in self.deletable() if _signed(e.hash) in (running if is_text else boxes)}
        blocks: list[list[str]] = [[]]
        todo: list = [self.root]
        while todo:
            x = todo.pop()
            if x is None:
                blocks.append([])
            elif isinstance(x, str):
                blocks[-1].append(unescape(x))
            elif x.tag == "header" and not x.dropped and id(x) in self.inside and x not in self.mains:
                # an article's own header has its title; the rest of it goes
                titles = [e for e, _ in _walk(x) if e.tag in HEADINGS and not e.dropped]
                todo += [None, *[y for e in reversed(titles) for y in (e, None)]]
            elif not x.dropped and id(x) not in gone:
                if x.tag == "br":
                    blocks[-1].append(" ")
                block = x.tag in BLOCKS
                todo += [*([None] if block else []), *reversed(x.children), *([None] if block else [])]
        lines = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def host_of(url: Column) -> Column:
    """Host in lower case without user and port; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def template_subtrees(pages: DataFrame, *, url: str = "url", html: str = "html", min_pages: int = 4, box_ratio: float = 0.005, text_ratio: float = 0.3) -> DataFrame:
    """(host, hash, running, n) of subtrees that recur on a host: on at least ``min_pages`` different pages, or in as many
    different main parts, and on more than ``box_ratio`` of the host's pages, or ``text_ratio`` where running text might be an article's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, whole, hashes = [], [], []
            for host, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = Page(x.as_py() or "")
                hosts.append(host)
                whole.append(_signed(page.root.hash))
                hashes.append([{"hash": h, "running": r, "once": o} for h, r, o in page.found()])
            kind = pa.list_(pa.struct([("hash", pa.int64()), ("running", pa.bool_()), ("once", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(whole, pa.int64()), pa.array(hashes, kind)], names=["host", "page", "found"])

    found = pages.select(host_of(F.col(url)).alias("host"), html).mapInArrow(run, "host string, page bigint, found array<struct<hash: bigint, running: boolean, once: bigint>>")
    no_hash = F.array(F.struct(F.lit(None).cast("bigint").alias("hash"), F.lit(None).cast("boolean").alias("running"), F.col("page").alias("once")))
    each = found.select("host", F.explode(F.concat(no_hash, "found")).alias("f"))
    seen = cut(each.groupBy("host", F.col("f.hash").alias("hash"), F.col("f.running").alias("running"), F.col("f.once").alias("once")).agg(F.count("*").alias("n")))
    totals = seen.filter("hash IS NULL").groupBy("host").agg(F.count("*").alias("pages"))
    counted = seen.filter(F.col("hash").isNotNull()).groupBy("host", "hash", "running").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    ratio = F.when(F.col("running"), F.lit(text_ratio)).otherwise(F.lit(box_ratio))
    return counted.join(totals, "host").filter(F.col("n") > F.col("pages") * ratio).select("host", "hash", "running", "n")


def main_text(pages: DataFrame, *, url: str = "url", html: str = "html", keep: list[str] | None = None, broadcast_subtrees: int = 200_000) -> DataFrame:
    """``pages`` (columns ``keep``, or all but the html) and ``text``: the blocks that are not template in page order, one a
    line, white space inside a block made one space, character references decoded.

    A null or empty html, or a page of template alone, has an empty text. Text beside an article or main element stays
    unless it recurs or names itself. Pages without a host count as of one host. Copies of a page count as one, so that they make no
    template; every row keeps its own result. A column ``text`` of ``pages`` is replaced. The recurring subtrees are
    broadcast up to ``broadcast_subtrees`` and joined on the host by a shuffle beyond.
    """
    names = [c for c in (keep or [c for c in pages.columns if c != html]) if c != "text"]
    found = cut(template_subtrees(pages, url=url, html=html))
    pick = lambda running: F.collect_list(F.when(F.col("running") == running, F.col("hash")))
    key, boxes, running, page, host = apart(pages, "key", "boxes", "running", "html", "host")
    per_host = found.groupBy(F.col("host").alias(key)).agg(pick(False).alias(boxes), pick(True).alias(running))
    if found.count() <= broadcast_subtrees:
        per_host = F.broadcast(per_host)
    rows = pages.select(*[F.col(f"`{c}`") for c in names], F.col(html).alias(page), host_of(F.col(url)).alias(host))
    rows = rows.join(per_host, F.col(host) == F.col(key), "left").select(*[F.col(f"`{c}`") for c in names], page, host, boxes, running)
    schema = T.StructType([*[pages.schema[c] for c in names], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[frozenset, frozenset]] = {}
        for batch in batches:
            html_at, texts = len(names), []
            for i, x in enumerate(batch.column(html_at)):
                host = batch.column(html_at + 1)[i].as_py()
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = tuple(frozenset(batch.column(html_at + k)[i].as_py() or ()) for k in (2, 3))
                texts.append(Page(x.as_py() or "").text(*known[host]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:html_at], pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
