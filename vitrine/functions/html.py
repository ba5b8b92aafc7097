"""Extraction from HTML: one parse of a page serves all fields (O-12 to O-19).

Pages are not well-formed XML, so Spark's XPath functions do not apply, and which text belongs
to an element depends on nesting, which regular expressions cannot follow. A page is cut into
tags and texts by one pattern; a stack of open elements tells where each ends, and an
element's text is that of all its descendants. Rules are judged while the page is read, and
only what they ask for is joined and decoded. This runs in Arrow batches; :func:`fields`
takes any number of rules, the other functions one each.

An element without a closing tag ends with the element around it, a closing tag without an open
element is ignored, and scripts, styles, templates and comments hold no text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that never have a closing tag, those whose content is not text, and of
# these the ones whose content is not markup either.
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
OPAQUE_TAGS = frozenset(("script", "style", "template"))
RAW_TAGS = frozenset(("script", "style"))

# The rest of a tag; a quoted attribute value may contain '>'.
_TAG_REST = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
_TOKEN = re.compile(rf"<!--(?s:.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_TAG_REST})>|<[!?][^>]*+>")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++))?""")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*+(?:;|(?!=)))")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s>/])", re.I) for tag in RAW_TAGS}

#: Result types of the kinds of rules.
KINDS = {
    "text": "string", "anchor": "string", "classes": "string", "attr": "string", "block": "string",
    "table": "string", "texts": "array<string>", "lines": "array<string>", "links": "array<string>",
}


def decode_text(text: str) -> str:
    """Character references of a text by the standard's rules."""
    return html.unescape(text) if "&" in text else text


def decode_value(value: str) -> str:
    """Those of an attribute value, where ``&copy=`` is a query parameter."""
    return _REFERENCE.sub(lambda m: html.unescape(m.group()), value) if "&" in value else value


def attributes(rest: str) -> dict[str, str]:
    """Attributes of an opening tag; of a repeated one the last counts."""
    found = {}
    for m in _ATTRIBUTE.finditer(rest):
        value = m.group(2) or ""
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        found[m.group(1).lower()] = decode_value(value)
    return found


def class_fits(attrs: dict[str, str], cls: str | None) -> bool:
    """Class rule: one word matches any token, several words the whole attribute."""
    if cls is None:
        return True
    value = attrs.get("class")
    return value is not None and (value == cls or cls in value.split())


class _Element:
    __slots__ = ("attrs", "heading", "start", "steps", "stop", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], start: int):
        self.tag, self.attrs, self.start, self.stop = tag, attrs, start, None
        self.heading, self.steps = None, ()


class Page:
    """Texts of a page in order, and the elements of the tags that are asked for.

    ``steps`` of an element says how much of each path its ancestors and itself fulfil.
    """

    def __init__(self, page: str, tags: frozenset[str], headings: frozenset[str] = frozenset(), paths: tuple = ()):
        self.texts: list[str] = []
        self.found: list[_Element] = []
        stack: list[_Element] = []
        self._open: Counter[str] = Counter()
        none = (0,) * len(paths)
        opaque = 0
        at, end = 0, page.rfind(">") + 1
        while at < len(page):
            token = _TOKEN.search(page, at) if at < end else None
            stop = token.start() if token else len(page)
            if stop > at and not opaque:
                text = page[at:stop]
                self.texts.append(text if token else text.partition("<!--")[0])
            if token is None:
                break
            at = token.end()
            if token.group(2) is None:
                continue
            tag = token.group(2).lower()
            if token.group(1):
                opaque -= self._close(stack, tag)
                continue
            rest = token.group(3)
            asked = tag in tags
            element = _Element(tag, attributes(rest) if asked else {}, len(self.texts))
            if paths:
                above = stack[-1].steps if stack else none
                element.steps = above if not asked else tuple(
                    n + (n < len(path) and path[n][0] == tag and class_fits(element.attrs, path[n][1]))
                    for n, path in zip(above, paths)
                )
            if tag in headings:
                for outer in reversed(stack):
                    if outer.heading is not None:
                        break
                    outer.heading = element
            if asked:
                self.found.append(element)
            if tag in VOID_TAGS or rest.endswith("/"):
                element.stop = element.start
                continue
            stack.append(element)
            self._open[tag] += 1
            opaque += tag in OPAQUE_TAGS
            if tag in RAW_TAGS:
                close = _RAW_END[tag].search(page, at)
                at = close.start() if close else len(page)
        for element in stack:
            element.stop = len(self.texts)

    def _close(self, stack: list[_Element], tag: str) -> int:
        """Close the innermost open element of a name and all inside it; counts opaque ones."""
        opaque = 0
        if self._open[tag]:
            while True:
                element = stack.pop()
                element.stop = len(self.texts)
                self._open[element.tag] -= 1
                opaque += element.tag in OPAQUE_TAGS
                if element.tag == tag:
                    break
        return opaque

    def text(self, element: _Element, between: str = "") -> str:
        return between.join(map(decode_text, self.texts[element.start : element.stop]))

    def first(self, fits) -> _Element | None:
        return next((e for e in self.found if fits(e)), None)


def _first_text(page: Page, fits) -> str | None:
    element = page.first(fits)
    return None if element is None else page.text(element).strip()


def _lines(page: Page, cls: str) -> list[str] | None:
    table = page.first(lambda e: e.tag == "table" and class_fits(e.attrs, cls))
    if table is None:
        return None
    return [line.strip() for line in page.text(table, "\n").splitlines() if line.strip()]


def _value_after(lines: list[str] | None, key: str) -> str | None:
    below = [b for a, b in zip(lines or [], (lines or [])[1:]) if a == key]
    return below[-1] if below else None


def _block(page: Page, container: tuple[str, str | None], label: str) -> str | None:
    tag, cls = container
    for element in page.found:
        if element.tag == tag and class_fits(element.attrs, cls) and element.heading is not None:
            if label in page.text(element.heading):
                return page.text(element).replace(label, "").strip()
    return None


def _links(page: Page, number: int, length: int, base: str | None) -> list[str]:
    hrefs = (e.attrs.get("href") for e in page.found if e.tag == "a" and e.steps[number] == length)
    return [urljoin(base, href.strip()) if base else href for href in hrefs if href]


def _judge(page: Page, rule: tuple, tables: dict, paths: list):
    kind, *args = rule
    if kind == "text":
        tag, cls = args
        return _first_text(page, lambda e: e.tag == tag and class_fits(e.attrs, cls))
    if kind == "anchor":
        return _first_text(page, lambda e: e.tag == "a" and args[0] in e.attrs.get("href", ""))
    if kind == "classes":
        tag, tokens = args
        return _first_text(page, lambda e: e.tag == tag and set(tokens) <= set(e.attrs.get("class", "").split()))
    if kind == "attr":
        tag, name, cls = args
        element = page.first(lambda e: e.tag == tag and class_fits(e.attrs, cls))
        value = None if element is None else element.attrs.get(name)
        return None if value is None else value.strip()
    if kind == "texts":
        tag, cls = args
        return [page.text(e).strip() for e in page.found if e.tag == tag and class_fits(e.attrs, cls)]
    if kind in ("table", "lines"):
        if args[0] not in tables:
            tables[args[0]] = _lines(page, args[0])
        return tables[args[0]] if kind == "lines" else _value_after(tables[args[0]], args[1])
    if kind == "block":
        return _block(page, args[0], args[2])
    path, base = args
    return _links(page, paths.index(path), len(path), base)


def _tags(rule: tuple) -> set[str]:
    """Tags whose elements a rule looks at."""
    kind, *args = rule
    if kind in ("anchor", "links"):
        return {"a", *(tag for tag, _ in (args[0] if kind == "links" else []))}
    if kind in ("table", "lines"):
        return {"table"}
    return {args[0][0]} if kind == "block" else {args[0]}


def fields(page: Column, rules: dict[str, tuple]) -> Column:
    """A struct with the result of every rule, from one parse of each page; NULL for no page.

    Rules are ``(kind, …)``: ``("text", tag, cls)`` and ``("classes", tag, tokens)`` the stripped
    text of the first such element; ``("anchor", needle)`` that of the first link to ``needle``;
    ``("attr", tag, name, cls)`` an attribute; ``("texts", tag, cls)`` all texts; ``("lines",
    cls)`` the lines of the first such table and ``("table", cls, key)`` the line below the last
    ``key`` there; ``("block", (tag, cls), heading, label)`` the text of the first container whose
    first heading holds the label; ``("links", path, base)`` hrefs below a chain of ancestors.
    """
    unknown = {rule[0] for rule in rules.values()} - set(KINDS)
    if unknown:
        raise ValueError(f"unknown rule {min(unknown)!r}")
    tags = frozenset(set().union(*map(_tags, rules.values())))
    headings = frozenset(rule[2] for rule in rules.values() if rule[0] == "block")
    paths = [rule[1] for rule in rules.values() if rule[0] == "links"]
    kind = {"string": pa.string(), "array<string>": pa.list_(pa.string())}
    types = [kind[KINDS[rule[0]]] for rule in rules.values()]

    @F.arrow_udf(", ".join(f"`{name}` {KINDS[rule[0]]}" for name, rule in rules.items()))
    def extract(pages: pa.Array) -> pa.Array:
        columns = [[] for _ in rules]
        valid = []
        for text in pages.to_pylist():
            valid.append(text is None)
            page, tables = (None if text is None else Page(text, tags, headings, tuple(paths))), {}
            for column, rule in zip(columns, rules.values()):
                column.append(None if page is None else _judge(page, rule, tables, paths))
        arrays = [pa.array(column, t) for column, t in zip(columns, types)]
        return pa.StructArray.from_arrays(arrays, names=list(rules), mask=pa.array(valid, pa.bool_()))

    return extract(page)


def _one(page: Column, *rule) -> Column:
    return fields(page, {"value": rule})["value"]


def first_text(page: Column, tag: str, cls: str | None = None) -> Column:
    """O-12: stripped text of the first matching element; NULL if none, ``''`` if empty."""
    return _one(page, "text", tag, cls)


def first_anchor_text(page: Column, needle: str) -> Column:
    """O-13: text of the first anchor whose href contains ``needle``."""
    return _one(page, "anchor", needle)


def first_by_classes(page: Column, tag: str, tokens: list[str]) -> Column:
    """O-14: text of the first element carrying all class tokens, in any order."""
    return _one(page, "classes", tag, tokens)


def first_attr(page: Column, tag: str, attr: str, cls: str | None = None) -> Column:
    """O-16: stripped attribute of the first matching element."""
    return _one(page, "attr", tag, attr, cls)


def all_texts(page: Column, tag: str, cls: str | None = None) -> Column:
    """O-17: texts of all matching elements in order; ``[]`` when there are none."""
    return _one(page, "texts", tag, cls)


def table_lines(page: Column, cls: str) -> Column:
    """O-15: non-blank text lines of the first table with this class; NULL without one."""
    return _one(page, "lines", cls)


def block_under_heading(page: Column, container: tuple[str, str | None], heading: str, label: str) -> Column:
    """O-18: text of the first container whose first heading contains ``label``, without it.

    All copies of the label are removed. NULL when no container qualifies.
    """
    return _one(page, "block", container, heading, label)


def hrefs_below(page: Column, path: list[tuple[str, str | None]] = (), base: str | None = None) -> Column:
    """O-19: non-empty hrefs of anchors below a chain of ancestors, outermost first.

    With ``base``, the address of the page, hrefs are resolved as a browser does.
    """
    return _one(page, "links", list(path), base)


def line_pairs(lines: Column) -> Column:
    """O-15: every line but the last as ``key`` with the line below it as ``value``."""
    n_pairs = F.greatest(F.size(lines) - 1, F.lit(0))
    return F.zip_with(
        F.slice(lines, 1, n_pairs),
        F.slice(lines, 2, n_pairs),
        lambda line, following: F.struct(line.alias("key"), following.alias("value")),
    )


def value_after(lines: Column, key: str | Column) -> Column:
    """O-15: the line following the last line that equals ``key``.

    A key on the final line has nothing after it and gives NULL, as does no key at all.
    """
    hits = F.filter(line_pairs(lines), lambda p: p["key"] == key)
    return F.try_element_at(hits, F.lit(-1))["value"]
