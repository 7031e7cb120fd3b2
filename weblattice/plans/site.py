"""The observed sites of all runs as tables, shared by the queries of graphs, links, audits and texts.

The graph is that of policy P3, on whole tables. Nodes of a run are its root,
its crawled pages and the internal targets of their links. Of several pages
that are one node, the earliest fetch represents it: its links and texts
count. A link is internal if it is http(s) and has the root's host and port.
What the crawl saw of a page without a row in ``pages``, or of a run without
one in ``runs``, is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblattice.functions.urls import p0, p1_of, p2_of, p3_of, part
from weblattice.operators.skew import salted_join
from weblattice.session import checkpointed, load


def with_forms(rows: DataFrame, url: str = "url") -> DataFrame:
    """Adds the canonical forms p0 to p3 of a URL column, one after the other, so that none is written out twice."""
    out = rows.withColumn("p0", p0(F.col(url)))
    for name, step, of in (("p1", p1_of, "p0"), ("p2", p2_of, "p1"), ("p3", p3_of, "p2")):
        out = out.withColumn(name, step(F.col(of)))
    return out


def site_of(p0_url: Column) -> Column:
    """Host and port of an http(s) URL in P0, else null."""
    return F.when(part(p0_url, 1).isin("http", "https") & (F.length(part(p0_url, 2)) > 2), F.regexp_replace(part(p0_url, 2), r"^//(?:.*@)?", ""))


@dataclass(frozen=True)
class Site:
    """seeds (run_id, node, site); first (run_id, node, fetch_id, pages, id), a row per crawled node; observed, a row
    per link of a representative page: run_id, id, doc (the page's id), src, dst (null unless internal), url,
    anchor_text, rel, dom_region, template_signature, position_index."""

    seeds: DataFrame
    first: DataFrame
    observed: DataFrame

    def links(self) -> DataFrame:
        """(run_id, src, dst) with parallel links and self-links."""
        return self.observed.where("dst is not null").select("run_id", "src", "dst")

    def nodes(self) -> DataFrame:
        """(run_id, node, crawled)."""
        return (
            self.first.select("run_id", "node", F.lit(True).alias("crawled")).unionByName(self.links().select("run_id", F.col("dst").alias("node"), F.lit(False).alias("crawled")))
            .unionByName(self.seeds.select("run_id", "node", F.lit(False).alias("crawled"))).groupBy("run_id", "node").agg(F.max("crawled").alias("crawled"))
        )


LINK = ("resolved_url", "anchor_text", "rel", "dom_region", "template_signature", "position_index")


def crawled(spark: SparkSession, sf_dir: str, policy: Column | None = None) -> tuple[DataFrame, DataFrame, Column]:
    """(seeds, first, node): those of :class:`Site`, seeds with ``_policy``, and the form that names a node."""
    node = F.col("p3") if policy is None else F.element_at(F.array("p0", "p1", "p2", "p3"), F.col("_policy") + 1)
    runs = load(spark, sf_dir, "runs").where("root_url is not null").select(F.col("id").alias("run_id"), F.col("root_url").alias("url"), (F.lit(3) if policy is None else policy).alias("_policy")).distinct()
    seeds = with_forms(runs).select("run_id", node.alias("node"), site_of(F.col("p0")).alias("site"), "_policy")
    pages = load(spark, sf_dir, "pages").where("url is not null and run_id is not null").select("id", "run_id", "fetch_id", "url")
    # One row per run; joined by shuffle when adaptive execution finds it large.
    pages = with_forms(pages).join(seeds.select("run_id", "_policy"), "run_id").select("id", "run_id", "fetch_id", node.alias("node"))
    return seeds, pages.groupBy("run_id", "node").agg(F.min("fetch_id").alias("fetch_id"), F.count(F.lit(1)).alias("pages"), F.min_by("id", "fetch_id").alias("id")), node


def seen_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, run_id, source_fetch_id, then LINK): the same observation may be delivered twice; if the copies differ, the smaller one counts."""
    return load(spark, sf_dir, "link_observations").groupBy("id").agg(F.min(F.struct("run_id", "source_fetch_id", *LINK)).alias("o")).select("id", "o.*")


def site(spark: SparkSession, sf_dir: str, policy: Column | None = None) -> Site:
    """One pass over pages and links; the links are written once, for many queries read them several times.

    ``policy`` is an expression over ``config_json`` that gives 0 to 3, the
    form that names a run's nodes; without it that is P3 for every run.
    """
    seeds, first, node = crawled(spark, sf_dir, policy)
    seen = with_forms(seen_links(spark, sf_dir), "resolved_url").select("id", "run_id", F.col("source_fetch_id").alias("fetch_id"), F.col("resolved_url").alias("url"), *LINK[1:], "p0", "p1", "p2", "p3", site_of(F.col("p0")).alias("_site"))
    mine = seen.join(first.select("run_id", "fetch_id", F.col("node").alias("src"), F.col("id").alias("doc")), ["run_id", "fetch_id"])
    sizes = load(spark, sf_dir, "link_observations").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    sited = salted_join(mine, seeds.select("run_id", "site", "_policy"), ["run_id"], F.col("id"), sizes, "inner")
    observed = sited.withColumn("dst", F.when(F.col("_site") == F.col("site"), node)).drop("_site", "site", "_policy", "p0", "p1", "p2", "p3", "fetch_id")
    return Site(seeds.drop("_policy"), first, checkpointed(observed))


def merged(s: Site, canonical: DataFrame, where: DataFrame) -> Site:
    """The site with nodes merged by ``canonical`` (run_id, node, canonical) in the runs of ``where`` (run_id): policies P4 and P5."""
    names = checkpointed(canonical.join(where, "run_id", "left_semi").where("node != canonical").select(F.col("run_id").alias("_r"), F.col("node").alias("_n"), "canonical"))

    def renamed(df: DataFrame, column: str) -> DataFrame:
        j = df.join(names, df["run_id"].eqNullSafe(names["_r"]) & (df[column] == names["_n"]), "left")
        return j.withColumn(column, F.coalesce("canonical", column)).drop("_r", "_n", "canonical")

    pages = renamed(s.first, "node")
    first = pages.groupBy("run_id", "node").agg(F.min("fetch_id").alias("fetch_id"), F.sum("pages").alias("pages"), F.min_by("id", "fetch_id").alias("id"))
    links = renamed(renamed(s.observed, "dst"), "src").join(first.select(F.col("id").alias("doc")), "doc", "left_semi")
    return Site(renamed(s.seeds, "node"), first, checkpointed(links))


# --- the same in SQL ---------------------------------------------------------------------------

_PARTS = r"^(?:([^:/?#]+):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
FORMS = rf"""WITH RECURSIVE urls AS (
  SELECT url FROM pages UNION SELECT resolved_url FROM link_observations UNION SELECT root_url FROM runs UNION SELECT meta_canonical FROM pages),
ux AS (SELECT url, CASE WHEN regexp_full_match(url, '[-A-Za-z0-9._~:/?#@!$&()*+,;=%\[\]]*') THEN url
  ELSE array_to_string(list_transform(string_split(url, ''), lambda c: CASE WHEN regexp_full_match(c, '[-A-Za-z0-9._~:/?#@!$&()*+,;=%\[\]]') OR c = chr(39) THEN c ELSE url_encode(c) END), '') END AS e FROM urls WHERE url IS NOT NULL),
u0 AS (SELECT url, lower(regexp_extract(e, '{_PARTS}', 1)) AS s, regexp_replace(lower(regexp_extract(e, '{_PARTS}', 2)), ':$', '') AS a,
  regexp_extract(e, '{_PARTS}', 3) AS p, regexp_extract(e, '{_PARTS}', 4) AS q, regexp_extract(e, '{_PARTS}', 5) AS f FROM ux),
u1 AS (SELECT url, s, CASE s WHEN 'http' THEN regexp_replace(a, ':80$', '') WHEN 'https' THEN regexp_replace(a, ':443$', '') ELSE a END AS a,
  CASE WHEN p = '' AND s IN ('http', 'https') THEN '/' ELSE p END AS p, q, f FROM u0),
u2 AS (SELECT *, CASE WHEN length(p) > 1 THEN coalesce(nullif(regexp_replace(p, '/+$', ''), ''), '/') ELSE p END AS sp,
  array_to_string(list_transform(list_sort(list_filter(list_transform(range(1, len(string_split(q[2:], '&')) + 1),
    lambda i: {{'k': string_split(string_split(q[2:], '&')[i], '=')[1], 'i': i, 'p': string_split(q[2:], '&')[i]}}),
    lambda x: x.p != '' AND NOT regexp_matches(lower(x.k), '^(utm_.*|mc_.*|gclid|fbclid|ref)$'))), lambda x: x.p), '&') AS kept FROM u1),
forms AS (SELECT url, s || ':' || a || p || q || f AS p0, s || ':' || a || sp || q AS p1, s || ':' || a || sp || CASE WHEN kept != '' THEN '?' || kept ELSE '' END AS p2,
  CASE WHEN s IN ('http', 'https') AND a != '' THEN 'https:' || CASE WHEN regexp_matches(a, '^//(.*@)?www\.[^:]*\.') THEN regexp_replace(a, '^//(.*@)?www\.', '//\1') ELSE a END || sp
    ELSE s || ':' || a || sp END AS p3,
  CASE WHEN s IN ('http', 'https') AND length(a) > 2 THEN regexp_replace(a, '^//(.*@)?', '') END AS site FROM u2)
"""
GRAPH = FORMS + """,
seeds AS (SELECT DISTINCT r.id AS run_id, f.p3 AS node, f.site FROM runs r JOIN forms f ON f.url = r.root_url),
pnodes AS (SELECT p.*, f.p3 AS node FROM pages p JOIN forms f ON f.url = p.url WHERE p.run_id IN (SELECT run_id FROM seeds)),
first AS (SELECT run_id, node, min(fetch_id) AS fetch_id, count(*) AS pages, arg_min(id, fetch_id) AS id FROM pnodes GROUP BY run_id, node),
observed AS (SELECT o.id, o.run_id, first.node AS src, o.resolved_url AS url, o.anchor_text, o.rel, o.dom_region, o.template_signature, o.position_index,
    CASE WHEN f.site = s.site THEN f.p3 END AS dst
  FROM (SELECT DISTINCT * FROM link_observations) o JOIN first ON o.run_id = first.run_id AND o.source_fetch_id = first.fetch_id
  JOIN seeds s ON s.run_id = o.run_id LEFT JOIN forms f ON f.url = o.resolved_url),
links AS (SELECT run_id, src, dst FROM observed WHERE dst IS NOT NULL),
edges AS (SELECT run_id, src, dst, count(*) AS weight FROM links WHERE src != dst GROUP BY ALL),
nodes AS (SELECT run_id, node, bool_or(c) AS crawled FROM (SELECT run_id, node, true AS c FROM first UNION ALL SELECT run_id, dst, false FROM links UNION ALL SELECT run_id, node, false FROM seeds) GROUP BY ALL)
"""
DEPTH = """, walk AS (SELECT run_id, node, 0 AS d FROM seeds UNION SELECT e.run_id, e.dst, d + 1 FROM walk JOIN edges e ON e.run_id = walk.run_id AND e.src = walk.node WHERE d < 40),
depths AS (SELECT run_id, node, min(d) AS depth FROM walk GROUP BY ALL)
"""
REACH = """, reach AS (SELECT run_id, src AS a, dst AS b FROM edges UNION SELECT r.run_id, r.a, e.dst FROM reach r JOIN edges e ON e.run_id = r.run_id AND e.src = r.b),
mutual AS (SELECT x.run_id, x.a, x.b FROM reach x JOIN reach y ON x.run_id = y.run_id AND x.a = y.b AND x.b = y.a UNION SELECT run_id, node, node FROM nodes),
scc AS (SELECT run_id, a AS node, min(b) AS component FROM mutual GROUP BY ALL)
"""


def rank_sql(steps: int) -> str:
    """PageRank after so many steps."""
    return f""", sized AS (SELECT run_id, count(*) AS n FROM nodes GROUP BY ALL),
outw AS (SELECT run_id, src, sum(weight) AS total FROM edges GROUP BY ALL),
moves AS (SELECT e.run_id, e.src, e.dst, weight / total::DOUBLE AS share FROM edges e JOIN outw USING (run_id, src)
  UNION ALL SELECT a.run_id, a.node, b.node, 1.0::DOUBLE / n FROM nodes a ANTI JOIN outw ON a.run_id = outw.run_id AND a.node = outw.src JOIN nodes b ON a.run_id = b.run_id JOIN sized s ON s.run_id = a.run_id
  UNION ALL SELECT run_id, node, node, 0.0::DOUBLE FROM nodes),
steps AS (SELECT 0 AS k, run_id, node, 1.0::DOUBLE / n AS x FROM nodes JOIN sized USING (run_id)
  UNION ALL SELECT k + 1, m.run_id, m.dst, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * sum(x * share) FROM steps s JOIN moves m ON m.run_id = s.run_id AND m.src = s.node JOIN sized z ON z.run_id = m.run_id
  WHERE k < {steps} GROUP BY k, m.run_id, m.dst),
ranks AS (SELECT run_id, node, x AS pagerank FROM steps WHERE k = {steps})
"""
