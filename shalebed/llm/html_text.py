"""HTML extraction by site template removal.

Every page is parsed into elements. The subtrees of the whole page are hashed, those of
navigation, footers and advertisements too; Spark counts, for each host, on how many pages of
different content a subtree occurs. Subtrees that recur on ``MIN_PAGES`` or more are the site's
template and are deleted. Of the rarer ones, those go whose tag or class says that they are no
content. What is left of the article is written as blocks; where an article is itself template,
as a card that many pages show, the host's articles don't mark the content and all that is left
of the page is written.

Copies of one page count once, as a page's text is hashed beside its subtrees, without what the
rules drop; and in an ``article`` or ``main`` only containers can be template, never a heading,
paragraph or list item, so that a sentence that many articles share stays.

Defined results: a null or empty html gives an empty text; an url without a host belongs to
the host ''; repeated rows and equal page ids are treated one by one; other columns are
ignored; an unclosed element ends where its parent ends.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .words import chunks

MIN_PAGES, MOST_BROADCAST = 8, 1_000_000

#: Fixed values of HTML: elements without an end, elements of raw text, elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: An open element of the key ends where one of these begins.
ENDS = {"p": BLOCK - {"html", "body", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
#: An end or a beginning doesn't close anything beyond these.
WALLS = frozenset("html body article main section aside nav header footer div table td th form ul ol dl blockquote".split())
#: Never content, and never content by a word of the class, id or role.
DROP = frozenset("head script style title noscript iframe noembed template svg canvas object nav aside footer form button select option textarea dialog menu map audio video".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search comment comments respond reply replies disqus discussion share sharing social related recommended pagination pager widget toolbar skip complementary contentinfo".split())
#: In a compound name the last word is what the element is, but for these; and it isn't what these negate or merely have.
GENERIC = frozenset("container wrapper wrap inner outer list items item links link box slot bar area block blocks section left right top bottom buttons button unit panel row group".split())
HAVING = frozenset("with without no not non has have is".split())
CONTENT = frozenset(("article", "main"))
#: Around the content or never shown; not a part of the template.
WHOLE = frozenset(("", "html", "body", "head", "title"))
CONTAINERS = frozenset("div section aside nav header footer form ul ol dl table figure details".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PARTS = re.compile(r"[^a-z0-9]+")


class Element:
    __slots__ = ("tag", "inside", "drop", "children", "hash")

    def __init__(self, tag: str, inside: bool, drop: bool):
        self.tag, self.inside, self.drop, self.children, self.hash = tag, inside, drop, [], 0


def unwanted(tag: str, attributes: str, inside: bool) -> bool:
    if tag in DROP or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if HIDDEN.search(attributes):
        return True
    said = " ".join(a or b or c for a, b, c in MARKS.findall(attributes)).lower()
    return bool(said) and tag not in CONTENT and any(map(unwanted_name, said.split()))


def unwanted_name(name: str) -> bool:
    """Whether a class, id or role names what is no content: by its head, as a related-work is a work and an ad-free text isn't an ad."""
    parts = [p for p in PARTS.split(name) if p and not p.isdigit()]
    while len(parts) > 1 and parts[-1] in GENERIC:
        parts.pop()
    return bool(parts) and parts[-1] in WORDS and not HAVING.intersection(parts[:-1])


def parse(html: str) -> Element:
    """The element tree of a page; text nodes are strings."""
    root = Element("", False, False)
    stack, at = [root], 0
    while m := TOKEN.search(html, at):
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in WALLS and tag not in WALLS:
                    break
            continue
        for k in range(len(stack) - 1, 0, -1):
            if tag in ENDS.get(stack[k].tag, ()):
                del stack[k:]
                break
            if stack[k].tag in WALLS:
                break
        inside = stack[-1].inside or tag in CONTENT or bool(m[3]) and bool(re.search(r"role\s*=\s*[\"']?main", m[3]))
        element = Element(tag, inside, unwanted(tag, m[3], stack[-1].inside))
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(html, at)
            element.children.append(html[at : end.start() if end else len(html)])
            at = len(html) if not end else html.find(">", end.start()) + 1 or len(html)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(element)
    if at < len(html):
        stack[-1].children.append(html[at:])
    return root


def hashed(root: Element) -> Element:
    """Gives every element the hash of its subtree, children first and without recursion."""
    todo = [(root, False)]
    while todo:
        e, seen = todo.pop()
        if seen:
            h = xxhash.xxh3_64(e.tag)
            for c in e.children:
                h.update(" ".join(c.split()) if isinstance(c, str) else b"\0" + c.hash.to_bytes(8, "little"))
            e.hash = h.intdigest()
        else:
            todo.append((e, True))
            todo += [(c, False) for c in e.children if not isinstance(c, str)]
    return root


def candidate(e: Element) -> bool:
    """Whether the subtree may be a part of the site's template."""
    return e.tag in CONTENT or e.tag not in WHOLE and e.tag in (CONTAINERS if e.inside else BLOCK)


def contents(root: Element, template: frozenset[int] | set[int] = frozenset()) -> list[Element]:
    """Where the content is: the outermost articles, else the outermost main, else the whole page; also the whole page where one of these is template."""
    tops, todo = [], [root]
    while todo:
        e = todo.pop()
        if e.drop:
            continue
        if e.inside:
            if e.hash in template and candidate(e):
                return [root]
            tops.append(e)
        elif not (e.hash in template and candidate(e)):
            todo += [c for c in reversed(e.children) if not isinstance(c, str)]
    return tops or [root]


def walk(root: Element) -> Iterator[Element]:
    """All elements of the page."""
    todo = [root]
    while todo:
        e = todo.pop()
        yield e
        todo += [c for c in e.children if not isinstance(c, str)]


def own_hashes(root: Element) -> set[int]:
    """The hashes of a hashed page's subtrees that may be template."""
    return {e.hash for e in walk(root) if e.children and candidate(e)}


def blocks(root: Element, template: frozenset[int] | set[int], tops: list[Element] | None = None) -> list[str]:
    """The blocks of the page's content or of the given elements, in order."""
    out, text, todo = [], [], list(reversed(tops or contents(root, template)))

    def flush() -> None:
        if words := " ".join("".join(text).split()):
            out.append(words)
        text.clear()

    while todo:
        e = todo.pop()
        if e is None:
            flush()
        elif isinstance(e, str):
            text.append(entities.unescape(e))
        elif e.drop or template and e.hash in template and candidate(e):
            if e.tag in BLOCK:
                flush()
        elif e.tag == "br":
            text.append(" ")
        else:
            if e.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(e.children)
    flush()
    return out


def host_of(url: Column) -> Column:
    """The lower-case host of an url, '' without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def salted(hashes: set[int], host: str) -> np.ndarray:
    """The hashes as those of this host, as signed numbers."""
    return (np.fromiter(hashes, np.uint64, len(hashes)) ^ np.uint64(xxhash.xxh3_64_intdigest(host))).view(np.int64)


def said(root: Element) -> int:
    """The hash of all text of the page but what the rules drop; of the elements where nothing else is left."""
    text = "\n".join(blocks(root, frozenset(), [root]))
    return (xxhash.xxh3_64_intdigest(text) if text else root.hash) - (1 << 63)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches, "html"):
        page, content, hashes = [], [], []
        for key, of, raw in zip(batch.column("key").to_pylist(), batch.column("host").to_pylist(), texts, strict=True):
            root = hashed(parse(raw.decode("utf-8", "replace")))
            own = own_hashes(root)
            if own:
                page += [key] * len(own)
                content += [said(root)] * len(own)
                hashes.append(salted(own, of))
        yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(content, pa.int64()), pa.array(np.concatenate(hashes) if hashes else [], pa.int64())], ["key", "content", "subtree"])


def _extract(known: np.ndarray | None):
    """Texts without the template that ``known`` (sorted) has, or else the page's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "html"):
            rows = batch.column("template").to_pylist() if known is None else [known] * len(texts)
            out = []
            for raw, of, template in zip(texts, batch.column("host").to_pylist(), rows, strict=True):
                root, own = parse(raw.decode("utf-8", "replace")), set()
                if template is not None and len(template):
                    own = own_hashes(hashed(root))
                    here = salted(own, of)
                    if known is None:
                        hit = np.isin(here, np.array(template, np.int64))
                    else:
                        hit = known[np.minimum(np.searchsorted(known, here), len(known) - 1)] == here
                    own = {h for h, k in zip(own, hit.tolist(), strict=True) if k}
                out.append("\n\n".join(blocks(root, own)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return run


def subtrees(pages: DataFrame) -> DataFrame:
    """(key, content, subtree): the distinct subtrees of each page, by hashes that differ from host to host."""
    return pages.select("key", "host", "html").mapInArrow(_subtrees, "key long, content long, subtree long")


def templates(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """The subtrees that recur on min_pages pages of different content; counted by partial sums, host and all."""
    once = found.select("subtree", "content").distinct()
    return once.groupBy("subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages).select("subtree")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url and main text of every page.

    Templates are counted first. Up to ``MOST_BROADCAST`` hashes go to all workers and the pages
    stay where they are; beyond, a page meets its template through its own subtrees only, so
    that no row ever holds more hashes than its page has elements, and both are dealt by page.
    """
    page_id, url, html = (F.col(c) for c in ("page_id", "url", "html"))
    rows = pages.select(page_id.cast("long").alias("page_id"), url.cast("string").alias("url"), F.coalesce(html.cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"key": F.xxhash64("page_id", "url", "html"), "host": host_of(F.col("url"))})
    schema = "page_id long, url string, text string"
    found = subtrees(rows)
    recurring = stored(templates(found, min_pages), "templates")
    if recurring.count() <= MOST_BROADCAST:
        known = np.sort(np.array(recurring.toArrow().column("subtree"), np.int64))
        return rows.select("page_id", "url", "host", "html").mapInArrow(_extract(known), schema)
    own = found.join(recurring, "subtree", "left_semi").groupBy("key").agg(F.collect_set("subtree").alias("template"))
    return rows.join(own, "key", "left").select("page_id", "url", "host", "html", "template").mapInArrow(_extract(None), schema)
