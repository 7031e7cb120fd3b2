"""Queries of the sources (HTML, sitemaps, feeds, llms.txt, robots.txt), scans and streams.

No table holds HTML or XML. These queries put the pages' fields into such
documents and read them back, over whole tables, so that what comes out can be
compared with what went in.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblattice.functions.urls import host
from weblattice.session import load, shared_folder
from weblattice.sources import artefacts
from weblattice.sources import discovery as ds
from weblattice.sources.html import extract_pages
from weblattice.streaming import events as ev


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.coalesce(c, F.lit(""))


def tag(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), escaped(c), F.lit(f"</{name}>"))


def html_of(pages: DataFrame) -> Column:
    """A page's fields as HTML, with a menu and a footer around them."""
    some = lambda c, left, right: F.when(F.col(c).isNotNull(), F.concat(F.lit(left), escaped(F.col(c)), F.lit(right))).otherwise("")
    heads = F.array_join(F.transform(F.coalesce("headings", F.array()), lambda h: F.concat(F.lit("<h"), h["level"].cast("string"), F.lit(">"), escaped(h["text"]), F.lit("</h"), h["level"].cast("string"), F.lit(">"))), "\n")
    paras = F.array_join(F.transform(F.coalesce("paragraphs", F.array()), lambda p: F.concat(F.lit("<p>"), escaped(p), F.lit("</p>"))), "\n")
    return F.concat(
        F.lit("<!doctype html><html><head>"), some("title", "<title>", "</title>"), some("meta_canonical", '<link rel="canonical" href="', '">'), some("meta_robots", '<meta name="robots" content="', '">'),
        F.lit('</head><body><nav><ul><li><a href="/">Home</a><li><a href="/all">All</a></ul></nav><main>'), heads, paras, F.lit('</main><footer class="colophon"><p>End</p></footer></body></html>'),
    )


def op90_extracted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    out = extract_pages(pages.select("id", "url", html_of(pages).alias("html")))
    return out.select("id", "title", "meta_canonical", "meta_robots", F.size("headings").alias("headings"), F.array_join("paragraphs", "\n").alias("paragraphs"), F.size("links").alias("links"), F.col("links")[0]["dom_region"].alias("first_region"))


#: A wrapping element per region.
WRAPS = {"nav": ("<nav>", "</nav>"), "header": ("<header>", "</header>"), "footer": ("<footer>", "</footer>"), "aside": ("<aside>", "</aside>"), "breadcrumb": ('<ol class="breadcrumb"><li>', "</li></ol>"), "main": ("<main>", "</main>"), "body": ("<div>", "</div>")}


def op91_extracted_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links put into elements of their regions and read back: per page, region and anchor their number."""
    seen = load(spark, sf_dir, "link_observations").distinct()
    region = F.coalesce("dom_region", F.lit("body"))
    wrap = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in WRAPS.items() for x in (k, v[i])]), region)
    one = F.concat(wrap(0), F.lit('<a href="'), escaped(F.col("raw_href")), F.lit('">'), escaped(F.col("anchor_text")), F.lit("</a>"), wrap(1))
    docs = seen.groupBy(F.col("source_fetch_id").alias("id")).agg(F.concat(F.lit("<html><body>"), F.array_join(F.array_sort(F.collect_list(one)), ""), F.lit("</body></html>")).alias("html"))
    links = extract_pages(docs.withColumn("url", F.lit("https://s.test/"))).select("id", F.explode("links").alias("l"))
    return links.groupBy(F.col("id").alias("fetch_id"), F.col("l.dom_region").alias("region"), F.col("l.anchor_text").alias("anchor")).agg(F.count(F.lit(1)).alias("links"))


def _lists(spark: SparkSession, sf_dir: str, item: Column, before: str, after: str) -> DataFrame:
    """(run_id, doc): one document per run and thousand of pages, so that no document grows with the run."""
    rows = load(spark, sf_dir, "pages").where("url is not null").select("run_id", "url", "title").distinct()
    part = F.pmod(F.xxhash64("url"), F.lit(16))
    return rows.groupBy("run_id", part.alias("part")).agg(F.concat(F.lit(before), F.array_join(F.collect_list(item), "\n"), F.lit(after)).alias("doc")).select("run_id", "doc")


def op92_sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _lists(spark, sf_dir, F.concat(F.lit("<url>"), tag("loc", F.col("url")), F.lit("</url>")), '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>")
    return ds.listed(docs, "run_id", "doc", lambda t: [(loc,) for loc, _ in ds.sitemap_entries(t)[1]], "url string").groupBy("run_id", "url").agg(F.count(F.lit(1)).alias("entries"))


def op93_feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _lists(spark, sf_dir, F.concat(F.lit("<item>"), tag("link", F.col("url")), F.when(F.col("title").isNotNull(), tag("title", F.col("title"))).otherwise(""), F.lit("</item>")), '<rss version="2.0"><channel>', "</channel></rss>")
    return ds.listed(docs, "run_id", "doc", lambda t: ds.feed_entries(t)[1], "url string, title string")


def op94_llms_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.trim(F.regexp_replace(F.coalesce("title", F.lit("untitled")), r"[\[\]\s\p{Z}]+", " "))
    docs = _lists(spark, sf_dir, F.concat(F.lit("- ["), clean, F.lit("]("), F.col("url"), F.lit(")")), "# Site\n## Pages\n", "\n![no](https://x.test/i.png)\n")
    return ds.listed(docs, "run_id", "doc", ds.llms_links, "url string, text string, section string")


ROBOTS = "User-agent: *\nDisallow: /\n\nUser-agent: lattice\nUser-agent: other\nDisallow: /shop/\nAllow: /shop/the-*\nDisallow: /*?page=\nDisallow: /docs/*-1$ # one\nAllow: /docs/\nDisallow:\n"


def op95_robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one robots.txt, served by every host, lets an agent fetch of all pages and link targets."""
    urls = load(spark, sf_dir, "pages").select("url").union(load(spark, sf_dir, "link_observations").select("resolved_url")).where("url is not null").distinct().withColumn("host", host(F.col("url")))
    documents = urls.select("host").distinct().withColumn("robots", F.lit(ROBOTS))
    return ds.decisions(urls, ds.rules_of(documents, "host", "robots", "Lattice/2.1"), "host").select("url", "allowed")


def op96_latest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type, as the last attempt of a fetch is found."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return artefacts.latest_by(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def op97_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 newest events of a user, as a URL's history is shown."""
    return artefacts.newest(load(spark, sf_dir, "events").where("user_id = 8").select("event_id", "event_type", "ts"), ["ts", "event_id"], 20).select("event_id", "event_type")


def op98_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ev.stream_of(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = ev.tumbling_counts(events, "ts", "6 hours", ["event_type"], "value")
    out = ev.finish(stream, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 4).alias("total"))


def op99_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sessions(load(spark, sf_dir, "events"), "ts", "12 hours", ["user_id"])


def op100_first_sights(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = ev.first_sights(ev.stream_of(spark, f"{sf_dir}/events.parquet"), ["user_id", "event_type"])
    return ev.finish(stream, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", "append")


def op101_unreachable_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of error events of a user without another event between them, three at least: islands over a history."""
    from pyspark.sql import Window

    rows = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("bad"))
    # A user's history, as a URL's, is ordered in one task.
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    marked = rows.withColumn("island", F.sum(F.when(~F.col("bad"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spells = marked.where("bad").groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("errors"), F.min("event_id").alias("first_event"), F.datediff(F.max("ts"), F.min("ts")).alias("days"))
    return spells.where("errors >= 3").drop("island")


_FUNCTIONS = [
    op90_extracted_pages, op91_extracted_regions, op92_sitemap_urls, op93_feed_entries, op94_llms_links, op95_robots_decisions, op96_latest_attempt, op97_history,
    op98_tumbling_windows, op99_sessions, op100_first_sights, op101_unreachable_spells,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _FUNCTIONS}

_FLAT = r"trim(regexp_replace({}, '[\s\pZ]+', ' ', 'g'))"
ORACLES: dict[str, str] = {
    "op90_extracted_pages": f"""SELECT id, nullif({_FLAT.format('title')}, '') AS title, meta_canonical, meta_robots,
      len(list_filter(coalesce(headings, []), lambda h: {_FLAT.format('h.text')} != ''))::INTEGER AS headings,
      array_to_string(list_filter(list_transform(coalesce(paragraphs, []), lambda p: {_FLAT.format('p')}), lambda p: p != ''), chr(10)) AS paragraphs, 2 AS links, 'nav' AS first_region FROM pages""",
    "op91_extracted_regions": f"""SELECT source_fetch_id AS fetch_id, coalesce(dom_region, 'body') AS region, nullif({_FLAT.format("coalesce(anchor_text, '')")}, '') AS anchor, count(*) AS links FROM (SELECT DISTINCT * FROM link_observations) GROUP BY ALL""",
    "op92_sitemap_urls": "SELECT run_id, url, count(*) AS entries FROM (SELECT DISTINCT run_id, url, title FROM pages WHERE url IS NOT NULL) GROUP BY ALL",
    "op93_feed_entries": f"SELECT DISTINCT run_id, url, title_ AS title FROM (SELECT run_id, url, title, nullif({_FLAT.format('title')}, '') AS title_ FROM pages WHERE url IS NOT NULL)",
    "op94_llms_links": r"SELECT run_id, url, trim(regexp_replace(coalesce(title, 'untitled'), '[\[\]\s\pZ]+', ' ', 'g')) AS text, 'Pages' AS section FROM (SELECT DISTINCT run_id, url, title FROM pages WHERE url IS NOT NULL)",
    "op95_robots_decisions": r"""WITH u AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT resolved_url FROM link_observations WHERE resolved_url IS NOT NULL),
      t AS (SELECT url, regexp_replace(regexp_replace(url, '^[^:/?#]+://[^/?#]*', ''), '#.*$', '') AS p FROM u)
      SELECT url, CASE WHEN p LIKE '/shop/the-%' THEN true WHEN p LIKE '/docs/%-1' THEN false WHEN p LIKE '/%?page=%' AND p NOT LIKE '/docs/%' AND p NOT LIKE '/shop/%' THEN false
        WHEN p LIKE '/docs/%?page=%' THEN false WHEN p LIKE '/shop/%' THEN false ELSE true END AS allowed FROM t""",
    "op96_latest_attempt": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1",
    "op97_history": "SELECT event_id, event_type FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id DESC LIMIT 20",
    "op98_tumbling_windows": "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "op99_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS fresh FROM events),
      s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, n""",
    "op100_first_sights": "SELECT DISTINCT user_id, event_type FROM events",
    "op101_unreachable_spells": """WITH m AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
      SELECT user_id, count(*) AS errors, min(event_id) AS first_event, datediff('day', min(ts), max(ts))::INTEGER AS days FROM m WHERE bad GROUP BY user_id, island HAVING count(*) >= 3""",
}
