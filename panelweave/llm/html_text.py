"""Main text of web pages, with the recurring parts of each site removed.

Each page becomes an element tree, and each block element a hash of its whole subtree. Spark counts,
per host, the different main texts beside which a subtree occurs: a subtree found beside many is
part of the site's template and is deleted. Copies of one page count once, and paragraphs,
headings and other prose inside the main text are never candidates, so that articles
stay whole where they quote or copy each other. Only pages that hold a template within their main text meet it again,
and pages travel packed, so that what is moved follows what is to be deleted.

The main text is that of the outermost ``article`` elements; without any, of ``main``; without that, of
the body. Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments go by element, role or a word of the class or id.

NULL and empty pages have an empty text; NULL urls share the empty host. Rows are told apart by id, url
and html, so repeated rows each get the text of theirs. Broken markup is read as browsers do: end tags
without a start are left out, what is open at the end closes there, a tag without an end is dropped.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import Stages, ship

#: A subtree is a template part from so many different main texts of its host on, however many the host has.
MIN_PAGES = 10

# Fixed element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("article main body html p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th tr tbody thead figcaption".split())
DROPPED = frozenset("nav footer aside form button select dialog menu search head fieldset".split()) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu modal nav navbar "
    "navigation newsletter notice notices popup promo promoted related share sharing sidebar social sponsor sponsored subscribe widget".split()
)
#: An element of the key closes an open one of these, unless a scope lies between.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"},
}
SCOPE = frozenset("html body article section div main table ul ol dl td th aside nav form header footer figure blockquote".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


class Element:
    """An element with its children: elements and, as strings, texts."""

    __slots__ = ("tag", "attributes", "children", "own")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.own: int | None = None

    def attribute(self, name: str) -> str | None:
        if name not in self.attributes.lower():
            return None
        for found in ATTRIBUTE.finditer(self.attributes):
            if found[1].lower() == name:
                return html.unescape((found[2] or "").strip("\"'"))
        return None


def parse(page: str) -> Element:
    """The element tree of a page."""
    root = Element("html")
    stack, at = [root], 0
    while True:
        found = TOKEN.search(page, at)
        if found is None:
            stack[-1].children.append(page[at:])
            return root
        if found.start() > at:
            stack[-1].children.append(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if not found[0].endswith(">"):
            continue  # the page ends inside this tag
        if found[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        closes = CLOSES.get(tag) or ({"p"} if tag in BLOCK else None)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                elif stack[k].tag in SCOPE:
                    break
        element = Element(tag, found[3])
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not found[3].endswith("/"):
            stack.append(element)


def _dropped(element: Element, inside: bool) -> bool:
    """Whether an element is furniture by its own marks. ``inside``: it lies in the main text, where a header may hold the title."""
    if element.tag in DROPPED or element.tag == "header" and not inside:
        return True
    if not element.attributes:
        return False
    if element.attribute("hidden") is not None or (element.attribute("aria-hidden") or "").lower() == "true":
        return True
    if (element.attribute("role") or "").lower() in DROPPED_ROLES:
        return True
    if re.search(r"display\s*:\s*none", element.attribute("style") or "", re.I):
        return True
    if element.tag in ("html", "body", "article", "main"):
        return False
    # Ids of prose and headings are made of what they say, and one word of a mark may be about the text:
    # inside the main text only marks that say nothing else count.
    words = lambda name: [w for w in re.split(r"[^a-z0-9]+", (element.attribute(name) or "").lower()) if w]
    if not inside:
        return not DROPPED_WORDS.isdisjoint(words("class") + words("id"))
    marks = [words("class"), [] if element.tag in PROSE else words("id")]
    return any(m and DROPPED_WORDS.issuperset(m) for m in marks)


def _walk(element: Element) -> Iterator[Element]:
    """All elements below, in page order; no recursion, as trees may be deep."""
    stack = [element]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))


def hash_subtrees(root: Element) -> None:
    """Give every element a hash of its tag, class and children, white space apart."""
    import xxhash

    for node in reversed(list(_walk(root))):
        digest = xxhash.xxh3_64(f"<{node.tag} {node.attribute('class') or ''}>")
        for child in node.children:
            digest.update(" ".join(child.split()) + "\n" if isinstance(child, str) else child.own.to_bytes(8, "little"))
        node.own = digest.intdigest()


def main_parts(root: Element) -> list[Element]:
    """The outermost articles; else the main elements; else the whole page."""
    for wanted in ("article", "main"):
        parts, stack = [], [(root, False)]
        while stack:
            node, _ = stack.pop()
            if node.tag == wanted or wanted == "main" and (node.attribute("role") or "").lower() == "main":
                parts.append(node)
            else:
                stack.extend((c, False) for c in reversed(node.children) if not isinstance(c, str) and not _dropped(c, False))
        if parts:
            return parts
    return [root]


def blocks(parts: list[Element], templates: frozenset[int] = frozenset(), reached: set[int | None] | None = None) -> list[str]:
    """The text blocks below ``parts``, without furniture and without the subtrees in ``templates``.

    ``reached`` takes the hashes of the subtrees that ``templates`` would delete.
    """
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join(html.unescape("".join(held)).split()):
            out.append(text)
        held.clear()

    for part in parts:
        inside = part.tag != "html"
        stack: list[Element | str | None] = [part]
        while stack:
            node = stack.pop()
            if node is None:
                flush()
            elif isinstance(node, str):
                held.append(node)
            elif node.tag == "br":
                held.append(" ")
            elif node is part or not _dropped(node, inside) and (node.own not in templates or not templates):
                if reached is not None and node is not part:
                    reached.add(node.own)
                if node.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(node.children))
        flush()
    return out


def candidate_hashes(root: Element, parts: list[Element]) -> set[int]:
    """Hashes of block subtrees that may be template parts: outside the main text any, inside it all but prose."""
    within = {id(e) for part in parts if part.tag != "html" for e in _walk(part)}
    return {
        e.own
        for e in _walk(root)
        if e.tag in BLOCK and e.children and e.tag not in ("html", "body", "head", "article", "main") and not (id(e) in within and e.tag in PROSE)
    }


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for batch in batches:
        out = []
        for host, key, page in zip(batch["host"], batch["key"], batch["html"]):
            root = parse(page)
            hash_subtrees(root)
            parts = main_parts(root)
            reached: set[int | None] = set()
            main = xxhash.xxh3_64_intdigest("\n".join(blocks(parts, reached=reached))) - (1 << 63)
            out.extend((host, key, main, h - (1 << 63), h in reached) for h in candidate_hashes(root, parts))
        yield pd.DataFrame(out, columns=["host", "key", "main", "subtree", "reached"])


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.drop(columns="html").assign(packed=[zlib.compress(page.encode("utf-8", "surrogatepass")) for page in batch["html"]])


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for page, found in zip(batch["packed"], batch["templates"]):
            root = parse(zlib.decompress(page).decode("utf-8", "surrogatepass"))
            templates = frozenset() if found is None else frozenset(int(h) + (1 << 63) for h in found)
            if templates:
                hash_subtrees(root)
            out.append("\n\n".join(blocks(main_parts(root), templates)))
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": out})


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url and text of every row of ``pages`` (page_id, url, html); other columns are left out."""
    ship(pages.sparkSession)
    body = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", body.alias("html"), host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url", body).alias("key"))
    stages = Stages(pages.sparkSession, "html-text")
    subtrees = keyed.select("host", "key", "html").mapInPandas(_subtrees, "host string, key long, main long, subtree long, reached boolean")
    seen = stages.write(subtrees, "subtrees")
    beside = seen.select("host", "subtree", "main").distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    templates = beside.where(F.col("n") >= min_pages).select("host", "subtree")
    reached = seen.where("reached").select("host", "key", "subtree")
    # Written out, so that Spark knows its size: pages are shuffled only where many hold templates within their texts.
    found = stages.write(reached.join(templates, ["host", "subtree"]).groupBy("key").agg(F.collect_set("subtree").alias("templates")), "found")
    stages.drop(seen)
    ids = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string"
    packed = keyed.select("page_id", "url", "key", "html").mapInPandas(_packed, f"{ids}, key long, packed binary")
    return packed.join(found, "key", "left").select("page_id", "url", "packed", "templates").mapInPandas(_texts, f"{ids}, text string")
