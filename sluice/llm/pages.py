"""HTML extraction: site template removal, then the article's blocks of text.

Every element's subtree is hashed together with its page's host: its content,
and, outside of articles, its shape of tags and classes, as menus and footers
keep that when their words differ.  Spark counts on how many distinct pages of
a host each hash recurs, pages with the same body being one; subtrees on a good
share of them are the site's template and are deleted from each page's tree
before anything else.  Where no article is marked, so that the text may be
anywhere, a shape counts only for lists of links.  The main text is then
looked for in what is left: elements that do not recur, but that their tag,
role or class marks as menus, headers, footers, sidebars, notices, adverts,
forms or reader comments, go too, and the article (where no element is one,
all the rest) is written block by block.  Within an article, text elements
(paragraphs, headings, lists and so on) are template only if nearly all pages
of the host have them: passages that several articles share stay.
"""

from __future__ import annotations

import bisect
import collections
import hashlib
import re
from collections.abc import Container, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.markup import ForgivingParser

from .common import bounded_batches, free_name, table, written
from .urls import url_parts

#: Distinct pages of a host, at least, and share of all of them on which a subtree must recur to be template.
LEAST_PAGES, SHARE = 3, 0.3
#: The same for text elements within an article, which only notices on nearly every page reach.
LEAST_WITHIN, SHARE_WITHIN = 10, 0.8
#: Links of an element without other text, at least, for its shape to tell a menu where no article is marked.
LEAST_LINKS = 3
#: Template subtrees that are broadcast, 8 bytes each; beyond, pages are joined with their host's.
MOST_MARKS = 4_000_000
#: Parts that a host's pages are dealt into for that join.
SALTS = 64

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style".split())
_DROP = frozenset("script style noscript template svg math iframe object embed canvas audio video map form button select option textarea input label fieldset datalist nav footer aside menu dialog head title".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold an article's text; within one, template on nearly all pages only.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption b i em strong a span code".split())
#: Start tags that end an open element: of the same kind, up to the nearest of the second set.
_ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: End tags that end what is open in an article or main element, too.
_OUTER = ("article", "main", "body", "html")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|promo|promotion|banner|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|"
    r"footer|masthead|topbar|cookies?|cookie-?(?:banner|notice|consent)|consent|gdpr|notice|popup|modal|overlay|comments?|commentlist|disqus|respond|"
    r"share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|search|pagination|pager|skip-link|widget)(?:$|[\s_-])",
    re.I,
)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACES = re.compile(r"\s+")


class Node:
    """An element; children are elements and strings. inside: within an article or main element."""

    __slots__ = ("attrs", "children", "gone", "inside", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.gone = tag, attrs, parent, [], False
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))


class _Builder(ForgivingParser):
    """A forgiving tree: open paragraphs, list items and cells end where HTML lets them."""

    def __init__(self) -> None:
        super().__init__()
        root = Node("#root", {}, None)
        self.nodes = [root]  # in page order, so parents stand before their children
        # Open elements from the root down, and where in that stack each tag and the blocks stand, so that no tag walks it.
        self.stack, self.blocks, self.places = [root], [], collections.defaultdict(list)

    def _deepest(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def _cut(self, depth: int) -> None:
        """Ends all open elements from this depth on."""
        for node in self.stack[depth:]:
            self.places[node.tag].pop()
        del self.stack[depth:]
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK and self.blocks and self.stack[self.blocks[-1]].tag == "p":
            self._cut(self.blocks[-1])
        if tag in _ENDS:
            kinds, stop = _ENDS[tag]
            end = self._deepest(stop)
            first = [p[k] for kind in kinds for p in [self.places[kind]] if (k := bisect.bisect_right(p, end)) < len(p)]
            if first:
                self._cut(min(first))
        node = Node(tag, {k: v or "" for k, v in attrs}, self.stack[-1])
        self.nodes.append(node)
        self.stack[-1].children.append(node)
        if tag not in _VOID:
            self.places[tag].append(len(self.stack))
            if tag in _BLOCK:
                self.blocks.append(len(self.stack))
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        depth = self._deepest([tag])
        # The end tag of something outside of an article is ignored.
        if depth and (tag in _OUTER or depth > self._deepest(("article", "main", "body"))):
            self._cut(depth)

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


def parse(html: str) -> list[Node]:
    """The elements of a page in page order, its root first; any text is taken for HTML."""
    builder = _Builder()
    builder.parse(html)
    return builder.nodes


def _boilerplate(node: Node, inside: bool) -> bool:
    """Whether tag, role, class or id mark an element as no part of the text. inside: within an article or main element."""
    tag, attrs = node.tag, node.attrs
    if tag in _DROP or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    if attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
        return True
    return any(_MARKS.search(attrs[k]) for k in ("class", "id") if attrs.get(k))


def _digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=8).digest()


def site_of(host: str) -> int:
    """A number of 63 bits for a host, with a last bit of 0."""
    return int.from_bytes(_digest(b"site " + host.encode("utf-8", "replace")), "little", signed=True) & ~1


class Marks(NamedTuple):
    """What an element may recur by: its content; its shape, null within an article or around one; whether it is a list of links."""

    content: int
    shape: int | None
    links: bool


def subtree_hashes(nodes: list[Node], host: str) -> tuple[dict[int, Marks], int]:
    """The marks of each element that may be template, by place in `nodes`, and the hash of the whole body (of the whole
    page where it has none).

    A mark hashes the host with tag, class and content of the subtree, or with
    its tags and classes alone.  Its last bit is 1 for text elements within an
    article.
    """
    digest: dict[int, bytes] = {}
    # shape, links with text and whether there is text beside them; of elements that are not within or around an article
    outer: dict[int, tuple[bytes, int, bool]] = {}
    out, whole, site = {}, nodes[0], site_of(host)
    for place in range(len(nodes) - 1, -1, -1):  # children before their parents
        node = nodes[place]
        head = node.tag.encode("utf-8", "replace") + b"\x01" + node.attrs.get("class", "").encode("utf-8", "replace")
        parts, shapes = [head], [b"shape", head]
        free, links, beside = not node.inside and node.tag not in ("article", "main"), 0, False
        empty = True
        for c in node.children:
            if isinstance(c, Node):
                inner = digest[id(c)]
                parts += (b"\x02", inner)
                empty = empty and len(inner) < 8
                if free and id(c) in outer:
                    shape, n, text = outer[id(c)]
                    shapes.append(shape)
                    links, beside = links + n, beside or text
                else:
                    free = False
            else:
                text = " ".join(c.split())
                if text:
                    parts += (b"\x03", text.encode("utf-8", "replace"))
                    empty, beside = False, True
        found = _digest(b"".join(parts))
        digest[id(node)] = found[:7] if empty else found  # 7 bytes mark an element without text
        if free:
            shape = _digest(b"".join(shapes))
            outer[id(node)] = (shape, 0 if empty else 1, False) if node.tag == "a" else (shape, links, beside)
        if not empty and node.tag in _BLOCK and node.tag not in ("html", "body", "article", "main"):
            mark = lambda value: (int.from_bytes(value, "little", signed=True) ^ site) & ~1
            out[place] = Marks(mark(found) | (node.inside and node.tag in _TEXT), mark(shape) if free else None, free and links >= LEAST_LINKS and not beside)
        if node.tag == "body":
            whole = node
    return out, int.from_bytes(digest[id(whole)], "little", signed=True)


def remove_template(nodes: list[Node], marks: dict[int, Marks], template: Container[int], shapes: bool) -> int:
    """Deletes the subtrees of a page whose marks are in `template`; how many, those within others not counted.

    Content counts everywhere; a shape where `shapes` says that no text is
    looked for outside of articles, and otherwise for lists of links only.
    """
    removed = 0
    for place, node in enumerate(nodes):
        node.gone = node.parent is not None and node.parent.gone
        own = marks.get(place)
        if not node.gone and own and (own.content in template or (own.shape is not None and (shapes or own.links) and own.shape in template)):
            node.gone = True
            removed += 1
    return removed


def extract(html: str, host: str = "", template: Container[int] = frozenset()) -> str:
    """Text of the article: blocks in page order, joined by newlines; empty if there is none."""
    return _extract(html, host, template)[0]


def _extract(html: str, host: str, template: Container[int]) -> tuple[str, int]:
    """The text, and the number of template subtrees deleted."""
    nodes = parse(html)
    marks = subtree_hashes(nodes, host)[0] if template else {}
    removed = remove_template(nodes, marks, template, shapes=True)

    def mains(tag: str) -> list[Node]:
        found, stack = [], [nodes[0]]
        while stack:
            n = stack.pop()
            if n.gone or _boilerplate(n, n.tag == tag):
                continue
            if n.tag == tag:
                found.append(n)
            else:
                stack += [c for c in reversed(n.children) if isinstance(c, Node)]
        return found

    for tag in ("article", "main"):
        text = _blocks(mains(tag))
        if text:
            return text, removed
    # The text is all the rest, so what only looks like a template stays.
    removed = remove_template(nodes, marks, template, shapes=False)
    return _blocks(nodes[:1]), removed


def _blocks(starts: list[Node]) -> str:
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACES.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            blocks.append(text)

    for start in starts:
        inside = start.tag in ("article", "main")
        stack: list[Node | str | None] = [start]
        while stack:
            node = stack.pop()
            if node is None:
                flush()
            elif isinstance(node, str):
                run.append(node)
            elif node is start or not (node.gone or _boilerplate(node, inside)):
                if node.tag == "br":
                    run.append(" ")
                    continue
                if node.tag in _BLOCK:
                    flush()
                    stack.append(None)
                stack += reversed(node.children)
        flush()
    return "\n".join(blocks)


class _Marks:
    """Sorted hashes, as a container."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def __len__(self) -> int:
        return len(self.values)

    def __contains__(self, value: int) -> bool:
        at = int(np.searchsorted(self.values, value))
        return at < len(self.values) and int(self.values[at]) == value


def templates(df: DataFrame, url: str = "url", html: str = "html", least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """site, mark: the subtrees that are template on their host, written to the shared folder.

    Rows of a host with the same body, under whatever urls, are one page.  A
    host has no more of them than its pages have subtrees on average, over
    `share`, however many its pages are.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple[int, int, int]] = set()
            for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if html:
                    own, body = subtree_hashes(parse(html), host)
                    site = site_of(host)
                    found = {m for marks in own.values() for m in (marks.content, marks.shape) if m is not None}
                    rows |= {(site, body, mark) for mark in {site, *found}}
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["site", "body", "mark"])

    host, _ = url_parts(f"`{url}`")
    # A page's own row, whose mark is its site, counts the site's distinct pages.
    found = df.select(host.alias("host"), F.col(html).alias("html")).mapInArrow(marks, "site bigint, body bigint, mark bigint")
    counted = written(found.distinct().groupBy("site", "mark").agg(F.count("*").alias("pages")).where(F.col("pages") >= least), "pages-recurring")
    own = F.col("mark") == F.col("site")
    sizes = counted.where(own).select("site", F.col("pages").alias("all_pages"))
    within = F.col("mark").bitwiseAND(F.lit(1)) == 1
    enough = F.col("pages") >= F.when(within, F.greatest(F.lit(least), F.lit(LEAST_WITHIN))).otherwise(least)
    often = F.col("pages") >= F.when(within, F.greatest(F.lit(share), F.lit(SHARE_WITHIN))).otherwise(share) * F.col("all_pages")
    return written(counted.where(~own & enough).join(sizes, "site").where(often).select("site", "mark"), "pages-template")


def extract_pages(df: DataFrame, url: str = "url", html: str = "html", least: int = LEAST_PAGES, share: float = SHARE, most_marks: int = MOST_MARKS) -> DataFrame:
    """Every row of `df` with `text`, `n_chars` (its code points) and `n_template` (template subtrees deleted).

    Columns of these names in `df` are replaced; all others stay.  A null or
    empty page has an empty text.  Null urls and urls without a host share one
    nameless host.  Rows of a host with the same body, under whatever urls,
    count as one page, so repeated rows and mirrors make nothing template, and
    each still has its text.  An empty table gives no rows.
    """
    spark, rest = df.sparkSession, df.drop(*{"text", "n_chars", "n_template"} - {url, html})
    bounded_batches(spark)
    host, _ = url_parts(f"`{url}`")
    at = free_name(rest, "extracted")
    template = templates(df, url, html, least, share)
    kinds = [pa.string(), pa.int64()]

    def answer(rows: list[tuple[str, int]]) -> pa.Array:
        columns = list(zip(*rows, strict=True)) or [(), ()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["text", "n_template"])

    if template.count() <= most_marks:
        sent = spark.sparkContext.broadcast(_Marks(np.sort(template.select("mark").toArrow()["mark"].to_numpy())))

        def texts(htmls: pa.Array, hosts: pa.Array) -> pa.Array:
            return answer([_extract(html or "", host, sent.value) for html, host in zip(htmls.to_pylist(), hosts.to_pylist(), strict=True)])

        found = rest.select("*", F.arrow_udf(texts, "text string, n_template bigint")(html, host).alias(at))
    else:

        def texts_of(htmls: pa.Array, hosts: pa.Array, lists: pa.Array) -> pa.Array:
            rows = zip(htmls.to_pylist(), hosts.to_pylist(), lists.to_pylist(), strict=True)
            return answer([_extract(html or "", host, frozenset(marks or ())) for html, host, marks in rows])

        sites = F.arrow_udf(lambda hosts: pa.array(map(site_of, hosts.to_pylist()), pa.int64()), "bigint")
        lists = template.groupBy("site").agg(F.collect_set("mark").alias("marks")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rest.select(F.struct("*").alias("row"), F.col(html).alias("html"), host.alias("host"), F.pmod(F.xxhash64(url, html), F.lit(SALTS)).cast("int").alias("salt"))
        rows = rows.withColumn("site", sites("host")).join(lists, ["site", "salt"], "left")
        found = rows.select("row.*", F.arrow_udf(texts_of, "text string, n_template bigint")("html", "host", "marks").alias(at))
    out = found.withColumn("n_template", F.col(f"{at}.n_template")).withColumn("text", F.col(f"{at}.text")).drop(at)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op5_template_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_template")
