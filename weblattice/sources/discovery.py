"""Documents that list URLs: sitemaps, feeds, llms.txt, robots.txt; and what robots rules allow."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblattice.functions.urls import escapes, path_and_query


def gunzipped(data: bytes, limit: int) -> bytes:
    """The bytes, unpacked if they are gzip; more than ``limit`` unpacked is an error."""
    if data[:2] != b"\x1f\x8b":
        return data
    with gzip.GzipFile(fileobj=__import__("io").BytesIO(data)) as f:
        out = f.read(limit + 1)
    if len(out) > limit:
        raise ValueError("unpacks to more than the limit")
    return out


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""


def _child(e: ET.Element, name: str) -> str | None:
    for c in e:
        if _local(c) == name:
            return (" ".join("".join(c.itertext()).split())) or None
    return None


def _root(xml: str | None) -> ET.Element | None:
    try:
        return ET.fromstring(xml.strip()) if xml and xml.strip() else None
    except ET.ParseError:
        return None


def sitemap_entries(xml: str | None, limit: int = 50_000) -> tuple[str, list[tuple[str, str | None]], bool]:
    """(kind, [(loc, lastmod)], whether more than ``limit`` entries stand there); kind is urlset, sitemapindex or unknown."""
    root = _root(xml)
    kind = _local(root) if root is not None else ""
    item = {"urlset": "url", "sitemapindex": "sitemap"}.get(kind)
    if item is None:
        return "unknown", [], False
    found = [(loc, _child(e, "lastmod")) for e in root if _local(e) == item and (loc := _child(e, "loc"))]
    return kind, found[:limit], len(found) > limit


def feed_entries(xml: str | None) -> tuple[str, list[tuple[str, str | None]]]:
    """(format, [(link, title)]) of RSS, RDF or Atom."""
    root = _root(xml)
    kind = {"feed": "atom", "rss": "rss", "rdf": "rdf"}.get(_local(root) if root is not None else "", "unknown")
    out = []
    for e in root.iter() if kind != "unknown" else ():
        if kind == "atom" and _local(e) == "entry":
            alternate = [c.attrib["href"].strip() for c in e if _local(c) == "link" and c.attrib.get("rel", "alternate").lower() == "alternate" and "href" in c.attrib]
            link = alternate[0] if alternate else None
        elif kind != "atom" and _local(e) == "item":
            link = _child(e, "link")
            if link is None:
                guids = [c for c in e if _local(c) == "guid" and c.attrib.get("isPermaLink", "true") != "false"]
                link = (guids[0].text or "").strip() or None if guids else None
        else:
            continue
        if link:
            out.append((link, _child(e, "title")))
    return kind, out


FEED_TYPE = re.compile(r"application/(?:(?:rss|atom|rdf)\+xml|feed\+json)", re.I)


class _Feeds(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[tuple[str, str, str | None]] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "link" and "href" in a and "alternate" in a.get("rel", "").lower().split() and FEED_TYPE.fullmatch(a.get("type", "").strip()):
            self.found.append((a["href"], a["type"].strip().lower(), a.get("title")))


def feed_links(html: str | None) -> list[tuple[str, str, str | None]]:
    """(href, type, title) of the feeds an HTML page names."""
    p = _Feeds()
    p.feed(html or "")
    return p.found


_MD_LINK = re.compile(r"(!?)\[([^\]]*)\]\(\s*<?([^)\s>]+)>?(?:\s+\"[^\"]*\")?\s*\)")


def llms_links(text: str | None) -> list[tuple[str, str, str | None]]:
    """(href, text, section) of the Markdown links of an llms.txt; images are none."""
    out, section = [], None
    for line in re.split(r"\r\n|\r|\n", text or ""):
        head = re.fullmatch(r"#{2,6}\s+(.*?)\s*#*\s*", line)
        if head:
            section = head.group(1)
            continue
        out += [(m.group(3), m.group(2).strip(), section) for m in _MD_LINK.finditer(line) if not m.group(1)]
    return out


def names_sitemap(anchor: Column, href: Column) -> Column:
    """Whether a link looks like one to an HTML sitemap."""
    return F.coalesce(anchor.rlike(r"(?i)\bsite[\s_-]?map\b"), F.lit(False)) | F.coalesce(href.rlike(r"(?i)(^|/)(html[-_]?)?site[-_]?map(\.html?|/)?($|[?#])"), F.lit(False))


def listed(documents: DataFrame, key: str, text: str, parse: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """(key, columns) of the entries that ``parse`` finds in each document; one row per entry."""
    names = [c.strip().split()[0] for c in columns.split(",")]
    kind = dict(documents.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, *x) for k, t in zip(f[key], f[text]) for x in parse(t)], columns=[key, *names])

    return documents.select(key, text).mapInPandas(run, f"{key} {kind}, {columns}")


# --- robots.txt --------------------------------------------------------------------------------


def robots_rules(text: str | None, agent: str, limit: int = 500 * 1024) -> list[tuple[str, str]]:
    """(allow or disallow, pattern) for an agent: the rules of all groups that name it, else of those for all.

    What stands beyond ``limit`` bytes is not read, as RFC 9309 lets a crawler
    do; the last line begun before it falls out.
    """
    raw = (text or "").encode("utf-8")
    if len(raw) > limit:
        cut = re.match(rb"(?s).*[\r\n]", raw[:limit])
        text = cut.group().decode("utf-8", "ignore") if cut else ""
    groups: list[tuple[list[str], list[tuple[str, str]]]] = []
    naming = False
    for line in re.split(r"\r\n|\r|\n", (text or "").removeprefix("﻿")):
        m = re.fullmatch(r"\s*([^:#]+?)\s*:\s*([^#]*?)\s*(?:#.*)?", line)
        if not m:
            continue
        key, value = m.group(1).lower(), m.group(2)
        if key == "user-agent":
            if not naming:
                groups.append(([], []))
            groups[-1][0].append(value)
            naming = True
        elif key in ("allow", "disallow", "crawl-delay"):
            naming = False
            if groups and value and key != "crawl-delay":
                groups[-1][1].append((key, value))
    token = lambda v: "*" if v.startswith("*") else (re.match(r"[A-Za-z_-]*", v).group().lower())
    wanted = re.match(r"[A-Za-z_-]*", agent).group().lower()
    named = [rules for agents, rules in groups if wanted in map(token, agents)]
    return [r for rules in named or [rules for agents, rules in groups if "*" in map(token, agents)] for r in rules]


def pattern_regex(pattern: str) -> str:
    """A robots pattern as an anchored regular expression: ``*`` any run, ``$`` the end."""
    end = pattern.endswith("$")
    return "^" + ".*".join(re.escape(p) for p in escapes(pattern[:-1] if end else pattern).split("*")) + ("$" if end else "")


def rule_table(spark: SparkSession, texts: list[tuple], agent: str, key: str = "host") -> DataFrame:
    """(key, regex, length, allow) from (key, robots text) pairs of a driver's list; :func:`rules_of` is for tables."""
    rows = [(k, pattern_regex(p), len(escapes(p).encode()), kind == "allow") for k, t in texts for kind, p in robots_rules(t, agent)]
    return spark.createDataFrame(rows, f"{key} string, regex string, length int, allow boolean")


def rules_of(documents: DataFrame, key: str, text: str, agent: str) -> DataFrame:
    """(key, regex, length, allow) of each robots.txt."""
    return listed(documents, key, text, lambda t: [(pattern_regex(p), len(escapes(p).encode()), kind == "allow") for kind, p in robots_rules(t, agent)], "regex string, length int, allow boolean")


def decisions(urls: DataFrame, rules: DataFrame, key: str, url: str = "url") -> DataFrame:
    """``urls`` with ``allowed`` and ``rule``: the longest pattern that matches path and query decides, allow wins ties.

    A host's rules meet each of its URLs as one array, so URLs are not
    multiplied by rules; robots.txt itself is always allowed.
    """
    per = rules.groupBy(key).agg(F.collect_list(F.struct("length", "allow", "regex")).alias("_rules"))
    j = urls.join(per, key, "left")
    target = F.when(path_and_query(F.col(url)) == "", F.lit("/")).otherwise(path_and_query(F.col(url)))
    j = j.withColumn("_t", target)
    best = F.array_max(F.filter("_rules", lambda r: F.regexp_like(F.col("_t"), r["regex"])))
    j = j.withColumn("_b", best)
    always = F.col("_t") == "/robots.txt"
    return j.withColumn("allowed", always | F.col("_b").isNull() | F.col("_b.allow")).withColumn("rule", F.when(~always, F.col("_b.regex"))).drop("_rules", "_t", "_b")
