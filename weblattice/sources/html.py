"""Pages from HTML: title, headings, main text, paragraphs, links with region, path and template.

A page is read once into a flat list of tokens. Elements know where they begin
and end in it, so the text of any subtree, with parts left out, is one walk
along a slice. Regions come down the tree: each element adds its own mark to
what it inherits, so a link's region is known when its tag is met.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblattice.functions.urls import resolve_text

# Elements without an end, without readable text, and that begin a new line of text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template head svg iframe".split())
BLOCKS = frozenset("p div li ul ol dl dt dd h1 h2 h3 h4 h5 h6 br tr td th table section article header footer nav aside main blockquote pre figure figcaption form".split())
#: Open elements that a new one of the key's kind ends, up to the nearest of the second set.
ENDS = {
    "li": ({"li", "p"}, {"ul", "ol"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
CHROME = frozenset({"breadcrumb", "pagination", "nav", "header", "footer", "aside"})
# What roles, tags and the words of class and id say about a region.
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "main": "main"}
TAGS = {"nav": "nav", "aside": "aside", "main": "main", "article": "main", "header": "header", "footer": "footer"}
WORDS = {
    "nav": "nav", "navbar": "nav", "navigation": "nav", "menu": "nav", "menubar": "nav", "topnav": "nav", "mainnav": "nav", "header": "header", "masthead": "header", "topbar": "header",
    "footer": "footer", "colophon": "footer", "sidebar": "aside", "aside": "aside", "main": "main", "content": "main", "maincontent": "main",
}
ORDER = ("nav", "header", "footer", "aside", "main")
SECTIONS = frozenset({"article", "aside", "main", "nav", "section"})
STATE = re.compile(r"(?:active|current|selected|open|opened|show|shown|expanded|focus|hover|visited|is-.+|has-.+|current[-_].+|.+[-_](?:current|active|selected)(?:[-_].+)?|active[-_].+)")
STABLE_ID = re.compile(r"[A-Za-z][\w-]*")


@dataclass
class Element:
    name: str
    attrs: dict[str, str]
    parent: "Element | None"
    begin: int
    end: int = 0
    mark: str | None = None
    region: str = "body"
    outer: str | None = None
    sectioned: bool = False
    nth: int = 1
    kinds: dict[str, int] = field(default_factory=dict)


def _mark(name: str, attrs: dict[str, str], sectioned: bool) -> str | None:
    """What an element by itself says about its region."""
    if name in ("html", "body"):
        return None
    label, names = attrs.get("aria-label", "").lower(), f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
    words = {p for w in names.split() for p in (w, *re.split(r"[-_]+", w))}
    if "breadcrumb" in label or "breadcrumb" in names or "breadcrumblist" in attrs.get("itemtype", "").lower():
        return "breadcrumb"
    rel = attrs.get("rel", "").lower().split()
    if re.search("pagination|pager|page navigation", label) or re.search("pagination|paginate|page-numbers|paging", names) or "pager" in words or (name == "a" and {"next", "prev", "previous"} & set(rel)):
        return "pagination"
    role = ROLES.get(attrs.get("role", "").strip().lower())
    if role:
        return role
    # A header or footer within a section is the section's, not the page's.
    fits = lambda r: not (sectioned and r in ("header", "footer"))
    if name in TAGS and fits(TAGS[name]):
        return TAGS[name]
    said = {WORDS[w] for w in words if w in WORDS}
    return next((r for r in ORDER if r in said and fits(r)), None)


class Page(HTMLParser):
    """The tokens of a page: text, or an element's number where it begins; ``~number`` where it ends."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tokens: list = []
        self.elements: list[Element] = []
        self.open: list[int] = []
        self.feed(html)
        self.close()
        while self.open:
            self._end()

    def _end(self) -> None:
        i = self.open.pop()
        self.elements[i].end = len(self.tokens)
        self.tokens.append(~i)

    def _implied(self, name: str) -> None:
        closes, stop = ENDS.get(name, (None, None))
        if closes is None:
            if name in BLOCKS and name != "br" and self.open and self.elements[self.open[-1]].name == "p":
                self._end()
            return
        names = [self.elements[i].name for i in self.open]
        for k in range(len(names) - 1, -1, -1):
            if names[k] in stop:
                return
            if names[k] in closes and not any(n in stop for n in names[k:]) and (k == 0 or names[k - 1] not in closes):
                while len(self.open) > k:
                    self._end()
                return

    def handle_starttag(self, name: str, attrs) -> None:
        self._implied(name)
        a = {k: v or "" for k, v in reversed(attrs)}
        parent = self.elements[self.open[-1]] if self.open else None
        e = Element(name, a, parent, len(self.tokens))
        if parent is not None:
            e.sectioned = parent.sectioned or parent.name in SECTIONS or parent.attrs.get("role", "").strip().lower() == "main"
            parent.kinds[name] = e.nth = parent.kinds.get(name, 0) + 1
        e.mark = _mark(name, a, e.sectioned)
        above, outer = (parent.region, parent.outer) if parent is not None else ("body", None)
        e.outer = e.mark if e.mark in ("breadcrumb", "pagination", "footer", "aside") else outer
        # A menu within a footer or side block, or within crumbs, belongs to that.
        e.region = above if e.mark is None else (outer or "nav") if e.mark == "nav" else e.mark
        self.elements.append(e)
        self.tokens.append(len(self.elements) - 1)
        self.open.append(len(self.elements) - 1)
        if name in VOID:
            self._end()

    def handle_startendtag(self, name: str, attrs) -> None:
        self.handle_starttag(name, attrs)
        if name not in VOID and self.open and self.elements[self.open[-1]].name == name:
            self._end()

    def handle_endtag(self, name: str) -> None:
        if any(self.elements[i].name == name for i in self.open):
            while self.elements[self.open[-1]].name != name:
                self._end()
            self._end()

    def handle_data(self, data: str) -> None:
        self.tokens.append(data)

    def text(self, e: Element, without: frozenset[str] = frozenset(), chrome: bool = True) -> list[str]:
        """The lines of a subtree, blanks collapsed; without some elements, or those of a chrome region."""
        lines, now, at = [], [], e.begin
        while at < e.end:
            t = self.tokens[at]
            if isinstance(t, str):
                now.append(t)
            else:
                x = self.elements[t if t >= 0 else ~t]
                if t >= 0 and (x.name in SILENT or (x is not e and (x.name in without or (not chrome and x.mark in CHROME)))):
                    at = x.end
                elif t >= 0 and x.name == "img":
                    now.append(f" {x.attrs.get('alt', '')} ")
                elif x.name in BLOCKS:
                    lines.append("".join(now))
                    now = []
            at += 1
        lines.append("".join(now))
        return [s for s in (" ".join(line.split()) for line in lines) if s]

    def paragraphs(self, root: Element) -> Iterator[str]:
        """Texts of p and li elements; a list entry without the lists and paragraphs within it."""
        past = -1
        for e in self.elements:
            if e.begin < max(root.begin, past) or e.begin > root.end:
                continue
            if e is not root and (e.name in SILENT or e.mark in CHROME):
                past = e.end
            elif e.name == "p" or e.name == "li":
                t = " ".join(self.text(e, frozenset() if e.name == "p" else frozenset({"ul", "ol", "p"}), chrome=False))
                if t:
                    yield t
                if e.name == "p":
                    past = e.end


def ancestors(e: Element) -> Iterator[Element]:
    """Parents up to the body."""
    p = e.parent
    while p is not None and p.name not in ("body", "html"):
        yield p
        p = p.parent


def dom_path(e: Element) -> str:
    """Tags from the nearest stable id, or the body, with the place among equal tags."""
    parts = []
    for x in (e, *ancestors(e)):
        if x is not e and STABLE_ID.fullmatch(x.attrs.get("id", "")):
            parts.append(f"{x.name}#{x.attrs['id']}")
            break
        many = x.parent is not None and x.parent.kinds.get(x.name, 1) > 1
        parts.append(f"{x.name}:nth-of-type({x.nth})" if many else x.name)
    return ">".join(reversed(parts))


def structure(e: Element) -> str:
    """A tag with its stable id and classes, numbers and states left out."""
    classes = sorted({re.sub(r"\d+", "#", c) for c in e.attrs.get("class", "").lower().split() if not STATE.fullmatch(c)})
    name = e.attrs.get("id", "")
    return e.name + (f"#{name.lower()}" if STABLE_ID.fullmatch(name) and not re.search(r"\d", name) else "") + "".join(f".{c}" for c in classes)


def template_signature(e: Element) -> str | None:
    """Sixteen digits that name the blocks around a link; none directly under the body."""
    chain = [structure(x) for x in ancestors(e)]
    return hashlib.sha1(">".join(reversed(chain)).encode()).hexdigest()[:16] if chain else None


def _has(value: str | None, *tokens: str) -> bool:
    return bool(set(re.split(r"[\s,]+", (value or "").lower())) & set(tokens))


def extract(html: str | None, url: str | None) -> dict | None:
    """The fields of a page; null for a null page."""
    if html is None:
        return None
    page = Page(html)
    of = lambda *names: [e for e in page.elements if e.name in names]
    one = lambda xs: xs[0] if xs else None
    base_tag = one([e for e in of("base") if "href" in e.attrs])
    base = resolve_text(url, base_tag.attrs["href"]) if base_tag is not None else url
    headings = [{"level": int(e.name[1]), "text": " ".join(page.text(e))} for e in of("h1", "h2", "h3", "h4", "h5", "h6")]
    headings = [h for h in headings if h["text"]]
    robots = one([e.attrs["content"] for e in of("meta") if "content" in e.attrs and e.attrs.get("name", "").strip().lower() == "robots"])
    root = one([e for e in page.elements if e.name == "main" or e.attrs.get("role", "").strip().lower() == "main"]) or one(of("body"))
    title = one(of("title"))
    title_text = " ".join("".join(t for t in page.tokens[title.begin : title.end] if isinstance(t, str)).split()) if title is not None else ""
    root_tag = one(of("html"))
    links = []
    for n, e in enumerate(x for x in of("a") if "href" in x.attrs):
        anchor = " ".join(page.text(e)) or " ".join(e.attrs.get("aria-label", "").split())
        links.append({
            "raw_href": e.attrs["href"], "resolved_url": resolve_text(base, e.attrs["href"]), "anchor_text": anchor or None, "rel": e.attrs.get("rel"), "dom_region": e.region,
            "dom_path": dom_path(e), "template_signature": template_signature(e), "position_index": n,
        })
    return {
        "title": title_text or None, "h1": one([h["text"] for h in headings if h["level"] == 1]), "headings": headings,
        "meta_canonical": one([e.attrs["href"] for e in of("link") if "href" in e.attrs and _has(e.attrs.get("rel"), "canonical")]), "meta_robots": robots,
        "body_text": "\n".join(page.text(root, chrome=False)) or None if root is not None else None, "paragraphs": list(page.paragraphs(root)) if root is not None else [],
        "lang": root_tag.attrs.get("lang") if root_tag is not None else None, "nofollow": _has(robots, "nofollow", "none"), "base_href": base if base_tag is not None else None,
        "schema_types": schema_types(html), "links": links,
    }


# Types whose mainEntity is the page's own, and types that say nothing about a page.
WRAPPERS = frozenset({"WebPage", "ItemPage"})
IGNORED = frozenset({
    "BreadcrumbList", "ListItem", "WebSite", "WebPage", "ItemPage", "Organization", "Person", "ImageObject", "SiteNavigationElement", "WPHeader", "WPFooter", "WPSideBar", "SearchAction",
    "EntryPoint", "PostalAddress", "ContactPoint", "Thing",
})


def schema_types(html: str) -> list[str]:
    """schema.org types the page names as its own, in JSON-LD roots, graphs and main entities, or in microdata that is no property."""
    out: set[str] = set()
    name = lambda t: re.split(r"[/#:]", t.strip().rstrip("/#"))[-1]
    todo: list[tuple[object, int]] = []
    for m in re.finditer(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", html, re.I | re.S):
        try:
            todo.append((json.loads(re.sub(r"^\s*(?:<!--|<!\[CDATA\[)|(?:-->|\]\]>)\s*$", "", m.group(1))), 0))
        except ValueError:
            continue
    while todo:
        x, depth = todo.pop()
        if depth > 5:
            continue
        if isinstance(x, list):
            todo += [(v, depth + 1) for v in x]
        elif isinstance(x, dict):
            types = x.get("@type", [])
            types = {name(t) for t in (types if isinstance(types, list) else [types]) if isinstance(t, str) and t}
            out |= types
            if isinstance(x.get("@graph"), list):
                todo.append((x["@graph"], depth + 1))
            if types & WRAPPERS and "mainEntity" in x:
                todo.append((x["mainEntity"], depth + 1))
    for m in re.finditer(r"<[a-z][^>]*\sitemtype\s*=\s*[\"']?([^\"'>]+)[^>]*>", html, re.I):
        if not re.search(r"\sitemprop\s*=", m.group(), re.I):
            out |= {name(t) for t in m.group(1).split()}
    return sorted(out - IGNORED - {""})


LINK_TYPE = "struct<raw_href:string,resolved_url:string,anchor_text:string,rel:string,dom_region:string,dom_path:string,template_signature:string,position_index:int>"
PAGE_TYPE = (
    "title string, h1 string, headings array<struct<level:int,text:string>>, meta_canonical string, meta_robots string, body_text string, paragraphs array<string>, lang string, "
    f"nofollow boolean, base_href string, schema_types array<string>, links array<{LINK_TYPE}>"
)


def extract_pages(pages: DataFrame, key: str = "id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, the fields of :data:`PAGE_TYPE`) of each page with HTML; further columns are ignored."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    slim = pages.where(F.col(html).isNotNull()).select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    ddl = f"_key {slim.schema['_key'].dataType.simpleString()}, {PAGE_TYPE}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"_key": k, **extract(h, u)} for k, u, h in zip(*[b.column(i).to_pylist() for i in range(3)])]
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    return slim.mapInArrow(run, ddl).withColumnRenamed("_key", key)
