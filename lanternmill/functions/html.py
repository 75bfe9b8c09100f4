"""HTML as columns: texts, meta tags, links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternmill.functions.text import collapse
from lanternmill.functions.values import coerce_date, is_archive_url, resolved, url_section, without_fragment

MIN_TEXT = 120
# Meta tags that give an author, a section, a date and a title, the first found first; words in the class of
# an element that names a section; elements whose text is not the page's.
AUTHOR_META = (("name", "author"), ("property", "article:author"))
SECTION_META = (("property", "article:section"), ("name", "section"), ("name", "categoria"))
DATE_META = (("property", "article:published_time"), ("name", "date"), ("name", "pubdate"), ("itemprop", "datePublished"))
TITLE_META = (("property", "og:title"), ("name", "twitter:title"))
SECTION_CLASSES = ("section", "seccion", "category", "categoria")
_DROPPED = {"script", "style", "nav", "footer", "aside", "noscript", "header", "form"}


def inner(html: Column, tag: str) -> Column:
    """The text within the first element of a tag, tags taken out, white space collapsed; null without one."""
    found = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.nullif(collapse(F.regexp_replace(found, r"<[^>]*>", " ")), F.lit(""))


def meta(html: Column, name: str) -> Column:
    """The content of the first meta tag of that name or property; null without one."""
    tag = F.regexp_extract(html, rf"(?is)<meta\b[^>]*(?:name|property)\s*=\s*[\"']{name}[\"'][^>]*>", 0)
    return F.nullif(F.trim(F.regexp_extract(tag, r"(?is)content\s*=\s*[\"']([^\"']*)[\"']", 1)), F.lit(""))


def meta_first(html: Column, *selectors: tuple[str, str]) -> Column:
    """The first content that is not empty of meta tags chosen by (attribute, value), in the selectors' order."""

    def one(key: str, value: str) -> Column:
        tag = F.regexp_extract(html, rf"(?is)<meta\b[^>]*\b{key}\s*=\s*[\"']{value}[\"'][^>]*>", 0)
        return F.nullif(collapse(F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)), F.lit(""))

    return F.coalesce(*[one(k, v) for k, v in selectors])


def _own(sidecar: Column | None) -> list[Column]:
    return [F.nullif(sidecar, F.lit(""))] if sidecar is not None else []


def author(html: Column, sidecar: Column | None = None) -> Column:
    return F.coalesce(*_own(sidecar), meta_first(html, *AUTHOR_META))


def section_in_markup(html: Column) -> Column:
    """The text of the first element whose class names a section or category, up to the next end of such a tag."""
    found = F.regexp_extract(html, rf"(?is)<(\w+)\b[^>]*\bclass\s*=\s*[\"'][^\"']*(?:{'|'.join(SECTION_CLASSES)})[^\"']*[\"'][^>]*>(.*?)</\1>", 2)
    return F.nullif(collapse(F.regexp_replace(found, r"<[^>]*>", " ")), F.lit(""))


def section(html: Column, sidecar: Column | None = None) -> Column:
    named = meta_first(html, *SECTION_META)
    return F.coalesce(*_own(sidecar), named, section_in_markup(html))


def published(html: Column, sidecar: Column | None = None) -> Column:
    found = meta_first(html, *DATE_META)
    return coerce_date(F.coalesce(*_own(sidecar), found))


def title(html: Column, sidecar: Column | None = None) -> Column:
    options = [meta_first(html, *TITLE_META), inner(html, "h[12]"), inner(html, "title")]
    return F.coalesce(*([F.nullif(sidecar, F.lit(""))] if sidecar is not None else []), *options)


def plain_text(html: Column) -> Column:
    """The article element's text (the whole page's without one) in expressions: dropped parts, then tags, then the
    five common entities."""
    body = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*)</article>", 1), F.lit("")), html)
    out = F.regexp_replace(body, r"(?is)<(script|style|nav|footer|aside)\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return collapse(out)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.depth, self.article, self.all, self.main = 0, 0, [], []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in _DROPPED
        self.article += tag == "article"

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in _DROPPED))
        self.article = max(0, self.article - (tag == "article"))

    def handle_data(self, data):
        if not self.depth:
            self.all.append(data)
            if self.article:
                self.main.append(data)


#: Pages that are parsed, and characters of what is found, before they leave a task.
PAGES, CHARS = 256, 1 << 22


def _page_text(page: str | None) -> str | None:
    if page is None:
        return None
    p = _Text()
    p.feed(page)
    p.close()
    return " ".join(" ".join(p.main or p.all).split())


def parse_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Pages become Python's some at a time, whatever the size of a batch."""
    for pages in batches:
        parts = [pa.array([_page_text(x) for x in pages.slice(k, PAGES).to_pylist()], pa.string()) for k in range(0, len(pages), PAGES)]
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def parsed_text(html: Column) -> Column:
    """The same by a parser, for markup that patterns misread. A stand-in for a full extractor."""

    @F.arrow_udf("string")
    def extract(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from parse_texts(pages)

    return extract(html)


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, text of each anchor, in page order."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(tags).alias("pos", "tag"))
    return rows.select("page_id", "pos", F.regexp_extract("tag", r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"), collapse(F.regexp_replace("tag", r"<[^>]*>", " ")).alias("text"))


def absolute(href: Column, base: Column) -> Column:
    """href against the base url, fragment cut, . and .. steps taken."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)", 1)
    clean = F.regexp_replace(href, "#.*$", "")
    joined = (
        F.when(clean.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), clean)
        .when(clean.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), clean))
        .when(clean.startswith("/"), F.concat(origin, clean))
        .when(clean == "", F.regexp_replace(base, "#.*$", ""))
        .otherwise(F.concat(F.coalesce(F.nullif(folder, F.lit("")), F.concat(origin, F.lit("/"))), clean))
    )
    start, path, rest = (F.regexp_extract(joined, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)(/[^?#]*)(.*)$", k) for k in (1, 2, 3))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(start, resolved(path), rest)).otherwise(joined)


_STOPS = {"a", "h1", "h2", "h3"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Tree(HTMLParser):
    """Elements as [tag, attributes, parent, children]; texts are children too. An end tag closes up to its own start."""

    def __init__(self):
        super().__init__()
        self.root = self.at = ["", {}, None, []]
        self.anchors: list[list] = []

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), self.at, []]
        self.at[3].append(node)
        if tag == "a" and node[1].get("href") is not None:
            self.anchors.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node[2] is not None and node[0] != tag:
            node = node[2]
        if node[2] is not None:
            self.at = node[2]

    def handle_data(self, data):
        self.at[3].append(data)


def _said(node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += reversed(x[3])
    return " ".join(" ".join(out).split())


def _around(anchor) -> tuple[str, str]:
    """The text of the article, list item or block that an anchor is in; the anchor's and that of the elements after it,
    up to the next anchor or heading."""
    block = anchor[2]
    while block[2] is not None and block[0] not in ("article", "li", "div"):
        block = block[2]
    block = block if block[2] is not None else anchor[2]
    beside = [x for x in anchor[2][3] if not isinstance(x, str)]
    near = [_said(anchor)]
    for x in beside[next(i for i, x in enumerate(beside) if x is anchor) + 1 :]:
        if x[0] in _STOPS:
            break
        near.append(_said(x))
    return _said(block), " ".join(t for t in near if t)


def parse_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of anchors of page_id, url, html. A page's anchors can repeat its text many times, so rows go out as soon
    as they have about CHARS characters."""
    text = pa.string()
    for batch in batches:
        kinds = [batch["page_id"].type, text, pa.int64(), text, text, text, text]
        rows, size = [], 0

        def out() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "url", "pos", "href", "title", "snippet", "nearby"])

        for page_id, url, page in zip(batch["page_id"], batch["url"], batch["html"]):
            tree = _Tree()
            tree.feed(page.as_py() or "")
            tree.close()
            for pos, a in enumerate(tree.anchors):
                snippet, nearby = _around(a)
                rows.append((page_id.as_py(), url.as_py(), pos, a[1]["href"], _said(a) or None, snippet or None, nearby or None))
                size += len(snippet) + len(nearby)
                if size >= CHARS:
                    yield out()
                    rows, size = [], 0
        yield out()


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, href, title, snippet, nearby of every anchor of page_id, url, html, in page order. Python, as
    only a parser knows what is around an anchor."""
    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(parse_anchors, f"page_id {kind}, url string, pos long, href string, title string, snippet string, nearby string")


def edition_links(pages: DataFrame, expected: Column | None = None) -> DataFrame:
    """page_id, pos, link, title, snippet, section of the archive's articles that a page links to, each link once, at its
    first place; snippet is the nearby text, else that of the block."""
    rows = anchors(pages).withColumn("link", without_fragment(absolute(F.col("href"), F.col("url"))))
    rows = rows.where(is_archive_url(F.col("link"), expected))
    first = rows.groupBy("page_id", "link").agg(F.min_by(F.struct("pos", "title", F.coalesce("nearby", "snippet").alias("snippet")), "pos").alias("first"))
    return first.select("page_id", "first.pos", "link", "first.title", "first.snippet", url_section(F.col("link")).alias("section"))
