"""Article extraction from stored HTML pages.

Titles, links, dates, authors and categories have JVM-side column functions. Whole-page extraction (S01,
S03) needs the nesting of elements, so it runs as one Arrow-batched pass over the pages with the standard
library's HTML tokenizer; each source's rules travel with the task as configuration.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions.batches import by_pieces
from broadsheet.functions.dates import check_bound
from broadsheet.functions.text import col, let, resolve_url, strip, strip_boilerplate

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNWANTED = frozenset("nav header footer aside script style".split())


@dataclass(frozen=True)
class PageRules:
    """What to read from the pages of one source. Selectors are ``tag``, ``.class``, ``tag.class`` or
    ``tag~regex`` (regex on the class attribute), tried in order."""

    source: str
    language: str = "English"
    title: tuple = fixed.TITLE_SELECTORS
    body: tuple = fixed.BODY_SELECTORS
    body_items: str | None = "p"
    fallback_items: tuple = ("p", "div")
    min_item: int = 20
    fallback_min_item: int = 30
    joiner: str = "\n\n"
    author: tuple = fixed.AUTHOR_SELECTORS
    category: tuple = fixed.CATEGORY_SELECTORS
    default_category: str = "politics"
    min_content: int = 100
    require_date: bool = False
    boilerplate: tuple = ()  # S10's patterns and markers, applied before the length test
    head_marker: str | None = None
    tail_marker: str | None = None


#: Rules for English-language sites: matching paragraphs, joined by a space, a readable date required.
ENGLISH_RULES = dict(
    title=("h1",), body=("p~content|body|text|paragraph",), body_items=None, fallback_items=("p",), min_item=0,
    fallback_min_item=0, joiner=" ", author=("a~author", "span~author"), default_category="general", min_content=0,
    require_date=True,
)

PAGE_SCHEMA = (
    "title string, content string, author string, category string, published string, html_links array<string>"
)


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator["_Node"]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))

    def text(self, skip=frozenset(("script", "style"))) -> str:
        """Text pieces below the node, each stripped, run together."""
        out, stack = [], list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item.strip())
            elif item.tag not in skip:
                stack.extend(reversed(item.children))
        return "".join(out)


class _Tree(HTMLParser):
    """Element tree that tolerates unclosed tags: an end tag closes back to its latest open partner and
    is ignored without one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse_tree(html: str) -> _Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _matches(node: _Node, selector: str) -> bool:
    if "~" in selector:
        tag, pattern = selector.split("~", 1)
        classes = (node.attrs.get("class") or "").split()
        return (not tag or node.tag == tag) and any(re.search(pattern, c) for c in classes)
    tag, _, cls = selector.partition(".")
    return (not tag or node.tag == tag) and (not cls or cls in (node.attrs.get("class") or "").split())


def _select(root: _Node, selector: str) -> list[_Node]:
    return [n for n in root.walk() if n is not root and _matches(n, selector)]


def _first_text(root: _Node, selectors) -> str:
    for selector in selectors:
        found = _select(root, selector)
        if found:
            return found[0].text()
    return ""


def _inside_unwanted(node: _Node, stop: _Node) -> bool:
    while node is not None and node is not stop:
        if node.tag in UNWANTED:
            return True
        node = node.parent
    return False


def body_text(root: _Node, rules: PageRules) -> str:
    """S03. First selector with text wins; short pieces are dropped; page furniture is left out."""
    for selector in rules.body:
        found = _select(root, selector)
        if not found:
            continue
        items = _select(found[0], rules.body_items) if rules.body_items else found
        pieces = [t for t in (n.text() for n in items) if len(t) > rules.min_item]
        if pieces:
            return rules.joiner.join(pieces)
    main = (_select(root, "main") or _select(root, "body") or [root])[0]
    pieces = []
    for node in main.walk():
        if node is not main and node.tag in rules.fallback_items and not _inside_unwanted(node, main):
            text = node.text(UNWANTED)
            if len(text) > rules.fallback_min_item:
                pieces.append(text)
    return rules.joiner.join(pieces)


def published_text(root: _Node) -> str | None:
    """Raw publication date: meta property, then the time element, then a date block."""
    for node in _select(root, "meta"):
        if node.attrs.get("property") == "article:published_time" and node.attrs.get("content"):
            return node.attrs["content"]
    for node in _select(root, "time")[:1]:
        if node.attrs.get("datetime"):
            return node.attrs["datetime"]
    for node in _select(root, "div.date")[:1]:
        return node.text().split("Last update")[0].strip()
    return None


def _read_page(html: str | None, rules: PageRules) -> tuple:
    if not html:
        return None, None, None, None, None, []
    root = parse_tree(html)
    category = _first_text(root, rules.category) or rules.default_category
    links = [n.attrs["href"] for n in _select(root, "a") if n.attrs.get("href")]
    fields = (
        _first_text(root, rules.title) or None, body_text(root, rules) or None,
        _first_text(root, rules.author) or None, category, published_text(root), links,
    )
    for node in root.walk():  # a tree without cycles is freed at once, not at some later collection
        node.parent = None
    return fields


def parse_published(text) -> Column:
    """S04's formats on raw date text: ISO date-time with or without zone, or ``Thu Nov 20, 2025 01:55 PM``.
    The calendar date as written, zone ignored."""
    t = strip(text)
    iso = F.try_to_date(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})([T ].*)?$", 1), "yyyy-MM-dd")
    worded = F.regexp_extract(t, r"^[A-Za-z]{3}\s+([A-Za-z]{3} \d{1,2}, \d{4})\s+\d{1,2}:\d{2}\s+[AaPp][Mm]$", 1)
    return F.coalesce(iso, F.try_to_date(worded, "MMM d, yyyy"))


def extract_pages(pages: DataFrame, rules: dict[str, PageRules] | PageRules, html: str = "html",
                  source: str | None = None) -> DataFrame:
    """S03 and the fields of S02, S04–S06 for every page, before any row is dropped."""
    single = rules if isinstance(rules, PageRules) else None
    names = ["title", "content", "author", "category", "published", "html_links"]
    kinds = [*[pa.string()] * 5, pa.list_(pa.string())]

    def fields(texts: pa.Array, sources: pa.Array) -> pa.Array:
        chosen = [single] * len(texts) if single else [rules.get(s) for s in sources.to_pylist()]
        rows = [_read_page(h if r else None, r) for h, r in zip(texts.to_pylist(), chosen, strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    # not deterministic to Catalyst: tests on its fields would otherwise be pushed below it and parse every page again
    @F.arrow_udf(PAGE_SCHEMA)
    def read(texts: pa.Array, sources: pa.Array) -> pa.Array:
        return by_pieces(fields, texts, sources)

    # only the HTML and the source go to Python: every other column stays as it is in the JVM
    key = F.lit(single.source) if single else F.col(source)
    kept = [c for c in pages.columns if c != html and c not in names]
    return pages.withColumn("_page", read.asNondeterministic()(F.col(html), key)).select(*kept, *[F.col("_page")[n].alias(n) for n in names])


def extract_articles(
    pages: DataFrame, rules: dict[str, PageRules] | PageRules, html: str = "html", source: str | None = None,
    start=None, end=None,
) -> DataFrame:
    """S01. Pages → article rows. Boilerplate that a source's rules name is taken out of the text first.
    Dropped: pages without a title, with too little text, outside the date range, and (for sources that require
    one) without a readable date."""
    table = {rules.source: rules} if isinstance(rules, PageRules) else rules
    per = lambda f: F.create_map(*[F.lit(x) for k, r in table.items() for x in (k, f(r))])
    key = F.lit(rules.source) if isinstance(rules, PageRules) else F.col(source)
    content = F.col("content")
    for name, r in table.items():
        if r.boilerplate or r.head_marker or r.tail_marker:
            cleaned = F.nullif(strip_boilerplate("content", r.boilerplate, r.head_marker, r.tail_marker), F.lit(""))
            content = F.when(key == name, cleaned).otherwise(content)
    out = (
        extract_pages(pages, rules, html, source)
        .withColumn("content", content)
        .withColumn("date", parse_published("published"))
        .where(F.col("title").isNotNull())
        .where(F.length(F.coalesce("content", F.lit(""))) >= F.try_element_at(per(lambda r: r.min_content), key))
        .where(F.col("date").isNotNull() | ~F.try_element_at(per(lambda r: r.require_date), key))
        .withColumn("language", F.try_element_at(per(lambda r: r.language), key))
    )
    if source != "source":
        out = out.withColumn("source", key)
    lo, hi = check_bound(start), check_bound(end)
    if lo is not None:
        out = out.where(F.col("date").isNull() | (F.col("date") >= F.lit(lo)))
    if hi is not None:
        out = out.where(F.col("date").isNull() | (F.col("date") <= F.lit(hi)))
    return out.drop("published", "html_links")


# --- JVM-side column functions on raw HTML -------------------------------------------------------------

#: The attributes of a start tag: quoted either way or not at all; a quoted ``>`` does not end the tag.
_ATTRS = r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)"""
_PAIR = r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"
#: What a parser does not show: comments, scripts and styles.
_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"


def _windows_1252(code: int) -> str:
    """What browsers read a numeric reference to a C1 control as."""
    return bytes([code]).decode("cp1252", "ignore") or chr(code)


def _named() -> Column:
    """Named references, from the standard library's table: one constant."""
    return F.str_to_map(F.lit("\x02".join(f"{name}\x01{text}" for name, text in html5.items())), F.lit("\x02"), F.lit("\x01"))


def _controls() -> Column:
    return F.str_to_map(F.lit("\x02".join(f"{c}\x01{_windows_1252(c)}" for c in range(0x80, 0xA0))), F.lit("\x02"), F.lit("\x01"))


def _numeric(e: Column) -> Column:
    """The character of a numeric reference such as ``&#8217;`` or ``&#x2019;``."""
    def char(code: Column) -> Column:
        replaced = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        none = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (F.pmod(code, F.lit(0x10000)) >= 0xFFFE)
        text = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(replaced, "\ufffd").when(code.between(0x80, 0x9F), F.try_element_at(_controls(), code.cast("string"))).when(none, "").otherwise(text)

    digits = F.regexp_extract(e, "^&#[xX]?([0-9a-fA-F]+)", 1)
    short = F.when(F.length(digits) < 12, digits)
    return let(F.when(e.rlike("^&#[xX]"), F.conv(short, 16, 10)).otherwise(short).try_cast("bigint"), char)


def _meaning(e: Column) -> Column:
    """What a character reference stands for."""
    out = F.when(F.startswith(e, F.lit("&#")), _numeric(e))
    for name, char in {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\xa0"}.items():
        out = out.when(e == name, char)
    return out.otherwise(F.coalesce(F.try_element_at(_named(), F.substring(e, 2, 40)), e))


def unescape(c) -> Column:
    """Character references, numeric and named, each once: ``&amp;lt;`` becomes ``&lt;``. Unknown names stay."""
    def read(text: Column) -> Column:
        meanings = F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), 0), _meaning)
        joined = F.array_join(F.zip_with(F.split(text, _ENTITY, -1), meanings, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
        return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)

    return let(col(c), read)


def visible(html="html") -> Column:
    """A page without comments, scripts and styles."""
    h = col(html)
    return F.when(h.rlike("(?i)<!--|<script|<style"), F.regexp_replace(h, _HIDDEN, "")).otherwise(h)


def tags(shown: Column, name: str) -> Column:
    """The attribute texts of all start tags of a name in :func:`visible` HTML, in order."""
    return F.regexp_extract_all(shown, F.lit(rf"(?is)<{name}(?=[\s/>]){_ATTRS}>"), 1)


def attribute(attrs: Column, name: str) -> Column:
    """An attribute's value within a start tag's attribute text, with its character references resolved."""
    names = F.transform(F.regexp_extract_all(attrs, F.lit(_PAIR), 1), lambda n: F.lower(n))
    raw = F.get(F.regexp_extract_all(attrs, F.lit(_PAIR), 2), (F.array_position(names, name) - 1).cast("int"))
    bare = lambda r: F.when(F.substring(r, 1, 1).isin('"', "'"), F.substr(r, F.lit(2), F.length(r) - 2)).otherwise(r)
    return F.when(F.contains(F.lower(attrs), F.lit(name)), unescape(let(raw, bare)))


def inner_text(fragment) -> Column:
    """Text of an HTML fragment: tags out, references resolved, trimmed."""
    return strip(unescape(F.regexp_replace(col(fragment), "<[^>]*>", "")))


def _element(shown: Column, tag: str, class_regex: str | None = None) -> Column:
    """Text of the first element of a name, or of those whose class matches; NULL if it has none."""
    pattern = rf"(?is)<{tag}(?=[\s/>]){_ATTRS}>(.*?)</{tag}\s*>"
    if class_regex is None:
        return F.nullif(inner_text(F.regexp_extract(shown, pattern, 2)), F.lit(""))
    classes = F.transform(F.regexp_extract_all(shown, F.lit(pattern), 1), lambda a: F.coalesce(attribute(a, "class"), F.lit("")).rlike(f"(?i){class_regex}"))
    first = let(F.array_position(classes, F.lit(True)), lambda at: F.when(
        at > 0, F.get(F.regexp_extract_all(shown, F.lit(pattern), 2), (at - 1).cast("int"))))
    return F.nullif(inner_text(first), F.lit(""))


def extract_title(html="html") -> Column:
    """S02. The article-title heading, any h1, or an h2 classed as title or headline."""
    return let(visible(html), lambda h: F.coalesce(
        F.when(h.rlike(r"(?i)\barticle-title\b"), _element(h, "h1", r"\barticle-title\b")), _element(h, "h1"), _element(h, "h2", "title|headline")))


def extract_published_date(html="html") -> Column:
    """S04. Calendar date from the meta property, the time element or the date block; NULL when none fits."""
    def read(h: Column) -> Column:
        metas = F.filter(tags(h, "meta"), lambda a: attribute(a, "property") == "article:published_time")
        times = F.filter(F.transform(tags(h, "time"), lambda a: attribute(a, "datetime")), lambda d: d.isNotNull())
        worded = F.regexp_replace(_element(h, "div", r"(?:^|\s)date(?:\s|$)"), "(?s)Last update.*", "")
        found = lambda raw: let(raw, parse_published)
        return F.coalesce(
            F.when(F.contains(h, F.lit("article:published_time")), found(attribute(F.get(metas, F.lit(0)), "content"))),
            F.when(h.rlike("(?i)<time"), found(F.get(times, F.lit(0)))), found(worded))

    return let(visible(html), read)


def extract_author_category(html="html", author=("author", "byline", "writer", "reporter"),
                            default_category: str = "politics") -> Column:
    """S05. struct(author, category) by the first element whose class matches."""
    def any_tag(h: Column, cls: str) -> Column:
        value = rf"""(?:"[^"]*\b{cls}\b[^"]*"|'[^']*\b{cls}\b[^']*'|[^\s"'>]*\b{cls}\b[^\s"'>]*)"""
        text = F.regexp_extract(h, rf"(?is)<(\w+)\b[^>]*\sclass\s*=\s*{value}[^>]*>(.*?)</\1\s*>", 2)
        return F.when(F.contains(F.lower(h), F.lit(cls)), F.nullif(inner_text(text), F.lit("")))

    return let(visible(html), lambda h: F.struct(
        F.coalesce(*[any_tag(h, c) for c in author]).alias("author"),
        F.coalesce(_element(h, "a", "category"), F.lit(default_category)).alias("category"),
    ))


def extract_links(pages: DataFrame, base_url: str, pattern: str | None = None, contains: str | None = None,
                  min_length: int = 0, html: str = "html", key: str = "page_id") -> DataFrame:
    """S06. Links of a page, absolute, matching the filters, distinct and in first-seen order:
    (key, position, link)."""
    hrefs = F.transform(tags(visible(html), "a"), lambda a: attribute(a, "href"))

    def wanted(h: Column) -> Column:
        ok = F.length(h) > min_length
        if pattern is not None:
            ok = ok & h.rlike(pattern)
        if contains is not None:
            ok = ok & F.contains(h, F.lit(contains))
        return ok

    absolute = F.transform(F.filter(hrefs, wanted), lambda h: resolve_url(base_url, h))
    links = F.array_distinct(F.array_compact(absolute))
    return pages.select(key, links.alias("_l")).select(key, F.posexplode("_l").alias("position", "link"))

