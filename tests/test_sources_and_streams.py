"""HTML, lists of URLs, robots rules, artefacts and streams on small inputs."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from weblattice.sources import artefacts, discovery as ds
from weblattice.sources.html import extract, extract_pages, schema_types
from weblattice.streaming import events as ev

HTML = """<!doctype html><html lang="en"><head><base href="/sub/"><title> A  title </title><meta name="Robots" content="noindex, NOFOLLOW"><link rel="x canonical" href="/c">
<script type="application/ld+json">{"@graph": [{"@type": ["Article", "WebPage"], "mainEntity": {"@type": "https://schema.org/Product"}}]}</script><script type="application/ld+json">{bad</script></head>
<body><div class="site-header"><a href="/">Home</a></div><nav class="menu-item-12 current"><ul><li><a href="a">A</a><li class="is-active"><a href="b">B</a></ul></nav>
<a href="#top">top</a><main id="content"><header><h1>Big <b>head</b></h1></header><p>One<br>two <a rel="nofollow" href="x?y=1">link <img alt="pic"></a><p>Three<ul><li>Item<ul><li>Inner</li></ul></ul>
<div class="pagination"><a href="?p=2">2</a></div><script>var x</script></main><footer><nav><a href="/t" aria-label="Terms of use"></a></nav></footer><div itemscope itemtype="https://schema.org/Recipe"></div></body></html>"""


def test_page_fields():
    p = extract(HTML, "https://s.test/dir/page")
    assert (p["title"], p["h1"], p["meta_canonical"], p["meta_robots"], p["lang"], p["nofollow"], p["base_href"]) == ("A title", "Big head", "/c", "noindex, NOFOLLOW", "en", True, "https://s.test/sub/")
    assert p["body_text"] == "Big head\nOne\ntwo link pic\nThree\nItem\nInner" and p["paragraphs"] == ["One two link pic", "Three", "Item", "Inner"]
    assert p["schema_types"] == ["Article", "Product", "Recipe"]
    got = [(x["raw_href"], x["resolved_url"], x["anchor_text"], x["dom_region"]) for x in p["links"]]
    assert got == [
        ("/", "https://s.test/", "Home", "header"), ("a", "https://s.test/sub/a", "A", "nav"), ("b", "https://s.test/sub/b", "B", "nav"), ("#top", "https://s.test/sub/#top", "top", "body"),
        ("x?y=1", "https://s.test/sub/x?y=1", "link pic", "main"), ("?p=2", "https://s.test/sub/?p=2", "2", "pagination"), ("/t", "https://s.test/t", "Terms of use", "footer"),
    ]
    a, b, top = p["links"][1], p["links"][2], p["links"][3]
    assert a["template_signature"] == b["template_signature"] and len(a["template_signature"]) == 16 and top["template_signature"] is None
    assert (a["dom_path"], b["dom_path"], top["dom_path"]) == ("nav>ul>li:nth-of-type(1)>a", "nav>ul>li:nth-of-type(2)>a", "a")
    assert schema_types("<p itemtype='https://schema.org/Offer' itemprop='x'>") == []


@pytest.mark.parametrize("html", ["", "plain", "<p", "</p></div>", "<ul><li>a<li>b", "<table><tr><td>1<td>2<tr><td>3", "<div>" * 3000 + "deep", "<p>" + "w " * 100_000, "\x00<a href>x</a>"])
def test_odd_pages_do_not_fail(html):
    assert extract(html, "https://s.test/") is not None and extract(None, None) is None


def test_pages_as_a_table(spark):
    df = spark.createDataFrame([("k", "https://s.test/", HTML, "t"), ("n", None, None, "t"), ("u", None, "<a href='x'>y</a>", "t")], "id string, url string, html string, title string")
    got = {r.id: r for r in extract_pages(df).collect()}
    assert set(got) == {"k", "u"} and len(got["k"].links) == 7 and got["u"].links[0].resolved_url is None
    assert extract_pages(df.limit(0)).collect() == []


def test_lists_of_urls():
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    assert ds.sitemap_entries(f"<urlset {ns}><url><loc> https://a/?x&amp;y </loc><lastmod>2025</lastmod></url><url><loc/></url><url><loc>b</loc></url></urlset>", 1) == ("urlset", [("https://a/?x&y", "2025")], True)
    assert ds.sitemap_entries(f"<sitemapindex {ns}><sitemap><loc>c</loc></sitemap></sitemapindex>")[0] == "sitemapindex"
    assert ds.sitemap_entries("<html/>")[0] == ds.sitemap_entries("<broken")[0] == ds.sitemap_entries(None)[0] == "unknown"
    assert ds.feed_entries("<rss><channel><item><guid>g</guid></item><item><guid isPermaLink='false'>no</guid></item><item><link>l</link><title>T</title></item></channel></rss>") == ("rss", [("g", None), ("l", "T")])
    assert ds.feed_entries('<feed xmlns="http://www.w3.org/2005/Atom"><entry><link rel="self" href="s"/><link href="a"/><title>T</title></entry><entry/></feed>') == ("atom", [("a", "T")])
    assert ds.llms_links("[a](u)\n## Docs ##\n- [b c](<v> \"t\") ![i](w)\n") == [("u", "a", None), ("v", "b c", "Docs")]
    assert ds.feed_links('<link rel="alternate" type="application/rss+xml" href="/f" title="F"><link rel="alternate" type="text/html" href="/g">') == [("/f", "application/rss+xml", "F")]
    assert ds.gunzipped(gzip.compress(b"abc"), 10) == b"abc" == ds.gunzipped(b"abc", 10)
    with pytest.raises(ValueError):
        ds.gunzipped(gzip.compress(b"a" * 100), 10)


# Cases of RFC 9309: the longest match decides, allow wins ties, * and $ are special.
RULES = "User-Agent: *\nDisallow: /all\n\nuser-agent: ExampleBot # us\nUser-agent: Other\nAllow: /p\nDisallow: /\nDisallow: /x*y$\nAllow: /x*y$\nDisallow: /%7Euser\nCrawl-delay: 3\n\nUser-agent: examplebot/2\nDisallow: /p/q\n"


def test_robots(spark):
    urls = {"https://h/p": True, "https://h/p/q": False, "https://h/other": False, "https://h/x1y": True, "https://h/x1yz": False, "https://h/robots.txt": True, "https://h/~user/a": False, "https://h": False}
    df = spark.createDataFrame([("h", u) for u in urls] + [("free", "https://free/")], "host string, url string")
    rules = ds.rule_table(spark, [("h", RULES)], "ExampleBot/1.0")
    got = {r.url: r.allowed for r in ds.decisions(df, rules, "host").collect()}
    assert got == {**urls, "https://free/": True}
    assert ds.robots_rules(RULES, "nobody") == [("disallow", "/all")] and ds.robots_rules(None, "x") == [] and ds.robots_rules("Allow: /a", "x") == []
    assert ds.robots_rules("User-agent: *\nDisallow: /a\nDisallow: /b", "x", 30) == [("disallow", "/a")]
    r = spark.createDataFrame([("Site map", "/x"), ("x", "/html-sitemap.html"), (None, "/a")], "a string, h string").select(ds.names_sitemap(F.col("a"), F.col("h"))).collect()
    assert [x[0] for x in r] == [True, True, False]


def test_artefacts(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda v, runs: spark.createDataFrame([(r, "P3", v) for r in runs], "run_id long, policy string, x long")
    artefacts.append(rows(1, [1, 2]), root, "graph", 1)
    artefacts.append(rows(2, [2]), root, "graph", 2)
    assert {(r.run_id, r.x) for r in artefacts.latest(spark, root, "graph").collect()} == {(1, 1), (2, 2)}


def test_streams_equal_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.createDataFrame([(f"2025-01-0{1 + i % 3} 0{i % 10}:00:00", f"u{i % 4}", float(i)) for i in range(60)], "t string, u string, v double").select(F.col("t").cast("timestamp").alias("t"), "u", "v")
    rows.repartition(6).write.parquet(path)
    stream = lambda: ev.stream_of(spark, path, 2)
    batch = {tuple(r) for r in ev.tumbling_counts(rows, "t", "6 hours", ["u"], "v").collect()}
    assert {tuple(r) for r in ev.finish(ev.tumbling_counts(stream(), "t", "6 hours", ["u"], "v"), str(tmp_path / "a"), "complete").collect()} == batch
    assert {tuple(r) for r in ev.finish(ev.sliding_counts(stream(), "t", "6 hours", "3 hours", ["u"]), str(tmp_path / "b"), "complete").collect()} == {tuple(r) for r in ev.sliding_counts(rows, "t", "6 hours", "3 hours", ["u"]).collect()}
    assert sorted(r.u for r in ev.finish(ev.first_sights(stream(), ["u"]), str(tmp_path / "c"), "append").collect()) == ["u0", "u1", "u2", "u3"]
    seen: set = set()
    ev.rederive(stream(), str(tmp_path / "d"), "u", lambda keys: seen.update(r.u for r in keys.collect()))
    assert seen == {"u0", "u1", "u2", "u3"}
    assert ev.sessions(rows, "t", "1 hour", ["u"]).agg(F.sum("events")).first()[0] == 60
