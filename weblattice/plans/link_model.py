"""Queries of the link model: prominence, diagnosis, audits, discovery, candidates, calibration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weblattice.functions.urls import is_utility, section
from weblattice.functions.text import lower_nfc, words
from weblattice.operators import audit, containment, links
from weblattice.operators.canonical import follow_canonicals
from weblattice.operators.graph import bfs_depth, collapse, degrees, pagerank, scc
from weblattice.plans.link_graph import _CANON, STEPS, UTILITY, canonical_edges, with_nodes
from weblattice.plans.oracle_records import RECORDS
from weblattice.plans.site import DEPTH, GRAPH, REACH, Site, merged, rank_sql, site, site_of, with_forms
from weblattice.plans.texts import TERMS, run_texts
from weblattice.session import checkpointed, load
from weblattice.sources.records import parse_records

#: What stands for discovery channels in the tables: links, declared canonicals, analytics exports, another crawler's export.
CHANNELS = ["analytics", "canonical", "crawler"]


def page_counts(s: Site) -> DataFrame:
    return s.first.groupBy("run_id").agg(F.count(F.lit(1)).alias("pages"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(load(spark, sf_dir, "raw_records")).where("reason is null")


def as_nodes(rows: DataFrame, s: Site, url: str, node: str) -> DataFrame:
    """Adds the P3 node of a URL that is in its run's scope, else null, and whether it reads as http(s)."""
    distinct = with_forms(rows.select("run_id", F.col(url).alias("_u")).distinct(), "_u").select("run_id", "_u", F.col("p3").alias("_n"), site_of(F.col("p0")).alias("_site"))
    known = distinct.join(s.seeds.select("run_id", "site"), "run_id", "left")
    known = checkpointed(known.select(F.col("run_id").alias("_r"), "_u", F.when(F.col("_site") == F.col("site"), F.col("_n")).alias(node), F.col("_site").isNotNull().alias(f"{node}_web")))
    return rows.join(known, rows["run_id"].eqNullSafe(known["_r"]) & (rows[url] == known["_u"]), "left").drop("_r", "_u")


def clicks(spark: SparkSession, sf_dir: str, s: Site) -> DataFrame:
    """(run_id, src, dst, clicks, fate) of the analytics records: matched, self-link, no-link, external or invalid-url."""
    rows = records(spark, sf_dir).where("export = 'analytics'").select("run_id", "record_id", "source_url", "target_url", "clicks")
    rows = as_nodes(as_nodes(rows, s, "source_url", "src"), s, "target_url", "dst")
    known = s.links().where("src != dst").distinct().withColumn("_l", F.lit(True))
    j = rows.join(known, ["run_id", "src", "dst"], "left")
    fate = (
        F.when(~(F.coalesce("src_web", F.lit(False)) & F.coalesce("dst_web", F.lit(False))), "invalid-url").when(F.col("src").isNull() | F.col("dst").isNull(), "external")
        .when(F.col("src") == F.col("dst"), "self-link").when(F.col("_l").isNull(), "no-link").otherwise("matched")
    )
    return j.select("run_id", "src", "dst", "clicks", fate.alias("fate"))


def factors(s: Site) -> DataFrame:
    return links.observation_factors(s.observed, page_counts(s))


def graph_facts(s: Site) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with all that audits ask of them; PageRank after a fixed number of steps."""
    edges, nodes = checkpointed(collapse(s.links())), checkpointed(s.nodes())
    ranks = pagerank(edges, nodes.select("run_id", "node"), iterations=STEPS)
    key = ["run_id", "node"]
    facts = (
        nodes.join(bfs_depth(edges, s.seeds.select("run_id", "node")), key, "left").join(ranks, key, "left").join(scc(with_nodes(edges, nodes)), key, "left")
        .join(degrees(edges).select("run_id", "node", "out_degree", "in_degree"), key, "left").na.fill(0, ["out_degree", "in_degree"])
    )
    return checkpointed(facts.withColumn("pagerank", F.round("pagerank", 10))), edges


def op41_observation_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors(site(spark, sf_dir)).select("run_id", "id", "region", "body_rank", "sitewide", F.round("weight", 9).alias("weight"))


def op42_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = links.prominence(factors(site(spark, sf_dir)))
    return out.select("run_id", "src", "dst", F.round("weight", 8).alias("weight"), F.round("omega", 8).alias("omega"), "observations", "body_links")


def op43_click_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the analytics records per run."""
    return clicks(spark, sf_dir, site(spark, sf_dir)).groupBy("run_id", "fate").agg(F.count(F.lit(1)).alias("records"), F.sum("clicks").alias("clicks"))


def op44_analytics_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prominence with clicks: those of the exports, and, as their pages are not the crawl's, one click per link that stands first on its page."""
    s = site(spark, sf_dir)
    matched = clicks(spark, sf_dir, s).where("fate = 'matched'").select("run_id", "src", "dst", "clicks")
    first = s.observed.where("dst is not null and src != dst and position_index = 0").select("run_id", "src", "dst", F.lit(1).cast("bigint").alias("clicks"))
    out = links.prominence(factors(s), matched.unionByName(first))
    return out.select("run_id", "src", "dst", F.round("weight", 8).alias("weight"), F.round("omega", 8).alias("omega"), "origin")


def op45_template_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = site(spark, sf_dir)
    return links.template_reach(s.observed, page_counts(s)).withColumn("share", F.round("share", 9))


def op46_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = site(spark, sf_dir)
    return links.effort(s.observed, s.first, page_counts(s))


def diagnosed(spark: SparkSession, sf_dir: str, s: Site) -> tuple[DataFrame, tuple[DataFrame, DataFrame], DataFrame]:
    """(edges, (names, texts), diagnoses). Of the related pairs only those that a diagnosis may name leave their task."""
    sources = run_texts(spark, sf_dir)
    edges = checkpointed(links.prominence(factors(s)).select("run_id", "src", "dst", "omega", (F.col("body_links") > 0).alias("body")))
    rows = containment.run_rows(*sources, links=edges)
    pairs = containment.over_pairs(rows, containment.diagnosable, "src string, dst string, ref double, rho double, omega double")
    known = pairs.withColumn("_e", F.col("omega") >= 0).withColumn("omega", F.when(F.col("_e"), F.col("omega")))
    return edges, sources, links.cases(known)


def op47_four_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnosed(spark, sf_dir, site(spark, sf_dir))[2]
    return out.select("run_id", "src", "dst", "case", F.round("severity", 6).alias("severity"))


def op48_structural_issues(spark: SparkSession, sf_dir: str, s: Site | None = None) -> DataFrame:
    s = s or site(spark, sf_dir)
    nodes, edges = graph_facts(s)
    robots = load(spark, sf_dir, "pages").select("id", "meta_robots").join(s.first.select("id", "run_id", "node"), "id").select("run_id", "node", audit.robots_tokens(F.col("meta_robots")).alias("tokens"))
    return audit.structural_issues(nodes, edges, robots, canonical_edges(spark, sf_dir), s.observed)


def op49_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by run, type, rule and severity, with all subtotals over type and severity."""
    issues = op48_structural_issues(spark, sf_dir)
    out = issues.groupingSets([["run_id", "type"], ["run_id", "severity"], ["run_id"]], "run_id", "type", "severity").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("node").alias("nodes"))
    return out.select("run_id", F.coalesce("type", F.lit("all")).alias("type"), F.coalesce("severity", F.lit("all")).alias("severity"), "issues", "nodes")


def op50_link_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal link targets against the statuses another crawler recorded, and crawled pages, which were fetched well."""
    s = site(spark, sf_dir)
    crawl = records(spark, sf_dir).where("export = 'internal'").groupBy("run_id", F.col("address").alias("url")).agg(F.max("status_code").alias("status"))
    pages = load(spark, sf_dir, "pages").where("url is not null").select("run_id", "url", F.lit(200).alias("status")).distinct()
    fetched = crawl.unionByName(pages).groupBy("run_id", "url").agg(F.max("status").alias("status"))
    return links.link_health(s.observed.where("dst is not null").select("run_id", "src", "url"), fetched)


def op51_health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op50_link_health(spark, sf_dir).groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("targets"), F.sum("links").alias("links"), F.max("pages").alias("most_pages"))


def found_nodes(spark: SparkSession, sf_dir: str, s: Site) -> DataFrame:
    """(run_id, channel, source, node) of all channels, in scope."""
    graph = s.nodes().select("run_id", F.lit("link_graph").alias("channel"), F.lit(None).cast("string").alias("source"), "node")
    canon = canonical_edges(spark, sf_dir).select("run_id", F.lit("canonical").alias("channel"), F.col("src").alias("source"), F.col("dst").alias("node"))
    r = records(spark, sf_dir)
    urls = r.select("run_id", "source_document", F.explode(F.array(
        F.struct(F.lit("analytics").alias("channel"), F.col("source_url").alias("url")), F.struct(F.lit("analytics").alias("channel"), F.col("target_url").alias("url")),
        F.struct(F.lit("crawler").alias("channel"), F.col("address").alias("url")),
    )).alias("x")).select("run_id", "source_document", "x.*").where("url is not null")
    listed = as_nodes(urls, s, "url", "node").where("node is not null").select("run_id", "channel", F.col("source_document").alias("source"), "node")
    return graph.unionByName(canon).unionByName(listed)


def op52_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir).select("run_id", "node", F.array_join("channels", ",").alias("channels"), "sources", "reachable", "depth", "orphan")


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = site(spark, sf_dir)
    depth = bfs_depth(collapse(s.links()), s.seeds.select("run_id", "node"))
    return audit.inventory(found_nodes(spark, sf_dir, s), depth)


def op53_channel_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.channel_yield(_inventory(spark, sf_dir))


def op54_channel_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.channel_subsets(_inventory(spark, sf_dir), CHANNELS).withColumn("orphan_recall", F.round("orphan_recall", 9))


def op55_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.leave_one_out(audit.channel_subsets(_inventory(spark, sf_dir), CHANNELS), CHANNELS)


def fix_targets(issues: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """(run_id, node, reason) of pages that need links."""
    a = issues.where("type in ('deep-page', 'weak-authority')").select("run_id", "node", F.col("type").alias("reason"))
    b = diagnoses.where("case in ('v4', 'v3')").select("run_id", F.col("dst").alias("node"), F.col("case").alias("reason"))
    return a.unionByName(b).distinct()


def op56_fix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = site(spark, sf_dir)
    t = fix_targets(op48_structural_issues(spark, sf_dir, s), diagnosed(spark, sf_dir, s)[2])
    return t.groupBy("run_id", "node").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the candidates of all runs are made from."""
    s = site(spark, sf_dir)
    edges, sources, diagnoses = diagnosed(spark, sf_dir, s)
    targets = fix_targets(op48_structural_issues(spark, sf_dir, s), diagnoses).select("run_id", "node").distinct()
    return containment.run_rows(*sources, (section(F.col("url")), is_utility(F.col("url"), UTILITY)), edges, checkpointed(targets))


def op57_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 admitted donors of each target with the highest REF."""
    ok = containment.over_pairs(candidate_rows(spark, sf_dir), containment.best, "src string, dst string, outcome string, ref double")
    w = Window.partitionBy("run_id", "dst").orderBy(F.desc("ref"), "src")
    return ok.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 30).select("run_id", "dst", "rank", "src", "outcome", "ref")


def op58_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = containment.over_pairs(candidate_rows(spark, sf_dir), containment.outcomes, "dst string, outcome string, pairs bigint")
    return counts.groupBy("run_id", "outcome").agg(F.sum("pairs").alias("pairs"), F.count_distinct("dst").alias("targets"))


def op59_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = site(spark, sf_dir)
    nodes, _ = graph_facts(s)
    into = s.observed.where("dst is not null and src != dst").where(links.region_class(F.col("dom_region")) == "body").groupBy("run_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("body_links"))
    out = audit.importance(nodes, into)
    return out.select("run_id", "node", *[F.round(c, 7).alias(c) for c in out.columns[2:]])


def op80_crawl_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Our crawl against another crawler's export, by P3 page: common pages, pages of one side only by the first reason that holds."""
    s = site(spark, sf_dir)
    ours = s.nodes().select("run_id", "node", "crawled")
    rows = records(spark, sf_dir).where("export = 'internal'").select("run_id", "address", "status_code")
    theirs = as_nodes(rows, s, "address", "node").groupBy("run_id", F.coalesce("node", F.concat(F.lit("!"), F.col("address"))).alias("node")).agg(F.max("status_code").alias("status"))
    j = ours.join(theirs.withColumn("_t", F.lit(True)), ["run_id", "node"], "full_outer")
    kind = (
        F.when(F.col("_t") & F.col("crawled"), "both").when(F.col("_t").isNull() & F.col("crawled"), "only ours").when(F.col("_t").isNull(), "linked, neither fetched")
        .when(F.startswith("node", F.lit("!")), "theirs out of scope").when(F.col("status") >= 400, "theirs broken").when(F.col("status") >= 300, "theirs redirected")
        .when(F.col("crawled").isNotNull(), "linked, theirs only").otherwise("only theirs")
    )
    return j.groupBy("run_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("pages"))


def op81_page_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages seen more than once in a run: whether content or only the links around it changed between first and last sight."""
    pages = load(spark, sf_dir, "pages").where("url is not null").select("run_id", "fetch_id", "url", F.sha2(F.to_json(F.struct("title", "h1", "body_text", "meta_canonical", "meta_robots"), {"ignoreNullFields": "false"}), 256).alias("content"))
    hrefs = load(spark, sf_dir, "link_observations").where("resolved_url is not null").select("source_fetch_id", "resolved_url").distinct().groupBy(F.col("source_fetch_id").alias("fetch_id")).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("resolved_url"))), 256).alias("links"))
    seen = pages.join(hrefs, "fetch_id", "left")
    ends = seen.groupBy("run_id", "url").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("content", "links"), "fetch_id").alias("a"), F.max_by(F.struct("content", "links"), "fetch_id").alias("b")).where("n > 1")
    kind = F.when(F.col("a.content") != F.col("b.content"), "content").when(~F.col("a.links").eqNullSafe(F.col("b.links")), "links").otherwise("none")
    return ends.select("run_id", "url", F.col("n").alias("sights"), kind.alias("change"))


def op82_depth_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean change of click depth, pages reachable both ways, when links outside the content don't count."""
    s = site(spark, sf_dir)
    seeds = s.seeds.select("run_id", "node")
    full = bfs_depth(collapse(s.links()), seeds)
    body = collapse(s.observed.where("dst is not null").where(links.region_class(F.col("dom_region")) == "body").select("run_id", "src", "dst"))
    j = full.join(bfs_depth(body, seeds).withColumnRenamed("depth", "other"), ["run_id", "node"])
    shift = F.col("other") - F.col("depth")
    return j.groupBy("run_id").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg(shift), 6).alias("mean_shift"), F.round(F.avg(F.abs(shift)), 6).alias("mean_abs_shift"))


def op83_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence per explained fix from its evidence; of rows delivered twice one counts."""
    rows = load(spark, sf_dir, "fix_explanations").select("id", "run_id", "action", "donor", "target", F.col("donor_evidence.ref").alias("ref"), F.col("donor_evidence.matched").alias("m")).dropDuplicates(["id"])
    named = F.filter(F.transform(F.slice("m", 1, 3), lambda x: F.lower(x["term"])), lambda t: t.isNotNull())
    why = F.when(F.coalesce(F.size(named), F.lit(0)) > 0, F.concat(F.lit(", which share "), F.array_join(named, ", "))).otherwise("")
    share = F.when(F.col("ref").isNotNull(), F.concat(F.lit(" ("), F.round(F.col("ref") * 100).cast("int").cast("string"), F.lit("% of its terms)"))).otherwise("")
    verb = F.when(F.col("action") == "raise-link", "Raise the link").otherwise("Add a link")
    return rows.select("id", "run_id", F.concat(verb, F.lit(" from "), F.coalesce("donor", F.lit("?")), F.lit(" to "), F.coalesce("target", F.lit("?")), share, why).alias("text"))


def op84_own_policy_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of each run's graph under the policy its configuration names (P3 without one); no redirects are recorded, so P4 merges what P3 does."""
    number = F.coalesce(F.regexp_extract(F.get_json_object("config_json", "$.policy"), r"^P([0-5])$", 1).try_cast("int"), F.lit(3))
    s = site(spark, sf_dir, F.least(number, F.lit(3)))
    fifth = load(spark, sf_dir, "runs").where(number == 5).select(F.col("id").alias("run_id"))
    s = merged(s, follow_canonicals(s.first.select("run_id", "node"), canonical_edges(spark, sf_dir), s.first.select("run_id", "node")), fifth)
    edges = collapse(s.links()).groupBy("run_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("links"))
    return s.nodes().groupBy("run_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("crawled").alias("crawled")).join(edges, "run_id", "left").na.fill(0)


def op85_anchor_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each explained fix the donor's paragraph that holds most of the matched terms, and the first of them there: where a link may stand."""
    fixes = load(spark, sf_dir, "fix_explanations").select("id", "run_id", F.col("donor").alias("url"), F.array_distinct(F.transform("donor_evidence.matched", lambda m: F.lower(m["term"]))).alias("terms")).dropDuplicates(["id"])
    pages = load(spark, sf_dir, "pages").where("size(paragraphs) > 0").select("run_id", "url", F.col("id").alias("page"), "paragraphs")
    both = fixes.where("size(terms) > 0").join(pages, ["run_id", "url"])
    rows = both.select("id", "page", "terms", F.posexplode("paragraphs").alias("pos", "text")).select("id", "page", "pos", "terms", words(lower_nfc(F.col("text"))).alias("w"))
    hits = rows.withColumn("found", F.filter(F.array_distinct("w"), lambda x: F.array_contains("terms", x))).where("size(found) > 0")
    best = hits.groupBy("id").agg(F.min_by(F.struct("page", (F.col("pos") + 1).alias("paragraph"), F.size("found").alias("terms"), F.col("found")[0].alias("anchor")), F.struct(-F.size("found"), F.col("page"), F.col("pos"))).alias("b"))
    return best.select("id", "b.*")


_FUNCTIONS = [
    op41_observation_factors, op42_prominence, op43_click_fates, op44_analytics_override, op45_template_reach, op46_effort, op47_four_cases, op48_structural_issues,
    op49_issue_counts, op50_link_health, op51_health_summary, op52_inventory, op53_channel_yield, op54_channel_subsets, op55_leave_one_out, op56_fix_targets, op57_candidates,
    op58_rejections, op59_importance, op80_crawl_calibration, op81_page_changes, op82_depth_shift, op83_explanations, op84_own_policy_graphs, op85_anchor_paragraphs,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _FUNCTIONS}

_CLASS = "CASE WHEN dom_region IN ('breadcrumb', 'aside', 'header', 'nav', 'pagination', 'footer') THEN dom_region ELSE 'body' END"
LINKS = f""", pages_n AS (SELECT run_id, count(*) AS n FROM first GROUP BY ALL),
reach_t AS (SELECT o.run_id, template_signature, count(DISTINCT src) AS pages, count(DISTINCT src) / any_value(n)::DOUBLE AS share FROM observed o JOIN pages_n USING (run_id) WHERE template_signature IS NOT NULL GROUP BY ALL),
o1 AS (SELECT *, {_CLASS} AS region FROM observed),
o2 AS (SELECT o1.*, CASE WHEN region = 'body' THEN row_number() OVER (PARTITION BY o1.run_id, src, region ORDER BY position_index, id) - 1 END AS body_rank, coalesce(share > 0.5, false) AS sitewide
  FROM o1 LEFT JOIN reach_t r ON r.run_id = o1.run_id AND r.template_signature = o1.template_signature),
factors AS (SELECT *, CASE region WHEN 'body' THEN 1.0::DOUBLE WHEN 'breadcrumb' THEN 0.5 WHEN 'aside' THEN 0.4 WHEN 'footer' THEN 0.1 WHEN 'pagination' THEN 0.2 ELSE 0.3 END
  * CASE WHEN body_rank IS NULL THEN 1 ELSE 1 / (1 + 0.1::DOUBLE * body_rank) END * CASE WHEN sitewide THEN 0.3::DOUBLE ELSE 1 END AS weight FROM o2),
prom0 AS (SELECT run_id, src, dst, sum(weight) AS weight, count(*) AS observations, count(*) FILTER (region = 'body') AS body_links FROM factors WHERE dst IS NOT NULL AND src != dst GROUP BY ALL),
prom AS (SELECT *, coalesce(weight / nullif(sum(weight) OVER (PARTITION BY run_id, src), 0), 0) AS omega FROM prom0)
"""
_NODE = """
  CASE WHEN f.site = s.site THEN f.p3 END"""
# Forms of the exports' URLs; they are plain, so the same expressions serve.
_WITH_RECORDS = RECORDS + ", "


def _and_records(sql: str) -> str:
    """The graph's tables over the URLs of pages, links and records."""
    head = "WITH RECURSIVE " + _WITH_RECORDS
    body = sql.replace("WITH RECURSIVE ", "", 1).replace("UNION SELECT meta_canonical FROM pages", "UNION SELECT meta_canonical FROM pages UNION SELECT source_url FROM loaded UNION SELECT target_url FROM loaded UNION SELECT address FROM loaded", 1)
    return head + body


_CLICKS = """, ck AS (SELECT l.run_id, l.clicks, a.site IS NOT NULL AND b.site IS NOT NULL AS web, CASE WHEN a.site = s.site THEN a.p3 END AS src, CASE WHEN b.site = s.site THEN b.p3 END AS dst
  FROM loaded l JOIN forms a ON a.url = l.source_url JOIN forms b ON b.url = l.target_url LEFT JOIN seeds s ON s.run_id = l.run_id WHERE export = 'analytics'),
fates AS (SELECT ck.*, CASE WHEN NOT web THEN 'invalid-url' WHEN ck.src IS NULL OR ck.dst IS NULL THEN 'external' WHEN ck.src = ck.dst THEN 'self-link' WHEN e.run_id IS NULL THEN 'no-link' ELSE 'matched' END AS fate
  FROM ck LEFT JOIN edges e ON e.run_id = ck.run_id AND e.src = ck.src AND e.dst = ck.dst)
"""
_DIAG = """, dp AS (SELECT coalesce(r.run_id, e.run_id) AS run_id, coalesce(r.src, e.src) AS src, coalesce(r.dst, e.dst) AS dst, coalesce(r.ref, 0) AS ref, round(coalesce(r.rho, 0), 9) AS rho, round(coalesce(e.omega, 0), 9) AS omega, e.omega IS NOT NULL AS linked
  FROM rhos r FULL JOIN (SELECT p.* FROM prom p WHERE (p.run_id, p.src) IN (SELECT run_id, src FROM donors UNION SELECT run_id, dst FROM totals) AND (p.run_id, p.dst) IN (SELECT run_id, src FROM donors UNION SELECT run_id, dst FROM totals)) e
    ON e.run_id = r.run_id AND e.src = r.src AND e.dst = r.dst),
diag AS (SELECT *, CASE WHEN rho > 0.1 AND NOT linked THEN 'v4' WHEN rho > 0.1 AND omega < 0.1 THEN 'v3' WHEN rho > 0.1 THEN 'v2' WHEN linked AND omega >= 0.1 THEN 'v1' END AS case_ FROM dp)
"""
_FACTS = DEPTH + REACH + rank_sql(STEPS) + """, pr AS (SELECT run_id, node, round(pagerank, 10) AS pagerank FROM ranks),
cuts AS (SELECT run_id, quantile_cont(pagerank, 0.2) AS weak, quantile_cont(pagerank, 0.05) AS high FROM pr JOIN nodes USING (run_id, node) WHERE crawled GROUP BY ALL),
big AS (SELECT run_id, component FROM (SELECT run_id, component, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, component) AS i FROM scc GROUP BY run_id, component) WHERE i = 1),
robots AS (SELECT f.run_id, f.node, regexp_extract_all(lower(coalesce(meta_robots, '')), '[^\\s,]+') AS t FROM first f JOIN pages p ON p.id = f.id),
""".replace("\\\\", "\\") + _CANON.lstrip(", ") + """,
alone AS (SELECT run_id, dst, min(src) AS src FROM edges GROUP BY ALL HAVING count(*) = 1),
facts AS (SELECT n.run_id, n.node, depth, pagerank, weak, high, s.component, b.component AS largest FROM nodes n LEFT JOIN depths USING (run_id, node) JOIN pr USING (run_id, node) JOIN scc s USING (run_id, node)
  JOIN cuts c ON c.run_id = n.run_id JOIN big b ON b.run_id = n.run_id WHERE crawled),
issues AS (SELECT run_id, 'deep-page' AS type, '' AS rule, CASE WHEN depth > 6 THEN 'high' ELSE 'medium' END AS severity, node FROM facts WHERE depth > 3
  UNION ALL SELECT run_id, 'weak-authority', '', CASE WHEN pagerank < high THEN 'high' ELSE 'medium' END, node FROM facts WHERE pagerank < weak
  UNION ALL SELECT run_id, 'outside-largest-scc', '', 'low', node FROM facts WHERE depth IS NOT NULL AND component != largest
  UNION ALL SELECT run_id, 'dead-end', '', 'medium', node FROM facts ANTI JOIN edges e ON e.run_id = facts.run_id AND e.src = facts.node
  UNION ALL SELECT * FROM (SELECT DISTINCT c.run_id, 'noindex-nofollow-conflict', 'canonical-to-noindex', 'high', c.src FROM ce c JOIN robots r ON r.run_id = c.run_id AND r.node = c.dst WHERE c.src != c.dst AND list_has_any(t, ['noindex', 'none']))
  UNION ALL SELECT * FROM (SELECT DISTINCT a.run_id, 'noindex-nofollow-conflict', 'nofollow-sole-path', 'medium', a.src FROM alone a JOIN robots r ON r.run_id = a.run_id AND r.node = a.src WHERE list_has_any(t, ['nofollow', 'none']))
  UNION ALL SELECT * FROM (SELECT DISTINCT run_id, 'noindex-nofollow-conflict', 'internal-nofollow', 'low', dst FROM observed WHERE dst IS NOT NULL AND src != dst AND list_contains(string_split_regex(lower(rel), '[\\s,]+'), 'nofollow')))
""".replace("\\\\", "\\")
_FOUND = DEPTH + _CANON + """, found AS (SELECT run_id, 'link_graph' AS channel, NULL::VARCHAR AS source, node FROM nodes
  UNION ALL SELECT run_id, 'canonical', src, dst FROM ce
  UNION ALL SELECT x.run_id, x.channel, x.source_document, f.p3 FROM (SELECT run_id, 'analytics' AS channel, source_document, source_url AS url FROM loaded UNION ALL SELECT run_id, 'analytics', source_document, target_url FROM loaded
    UNION ALL SELECT run_id, 'crawler', source_document, address FROM loaded) x JOIN forms f ON f.url = x.url JOIN seeds s ON s.run_id = x.run_id AND s.site = f.site),
inv AS (SELECT g.run_id, g.node, channels, sources, depth IS NOT NULL AS reachable, depth, depth IS NULL AND len(list_filter(channels, lambda c: c != 'link_graph')) > 0 AS orphan
  FROM (SELECT run_id, node, list_sort(list(DISTINCT channel)) AS channels, count(DISTINCT source) AS sources FROM found GROUP BY ALL) g LEFT JOIN depths d ON d.run_id = g.run_id AND d.node = g.node)
"""
_SUBSETS = """, b AS (SELECT *, (CASE WHEN list_contains(channels, 'analytics') THEN 1 ELSE 0 END + CASE WHEN list_contains(channels, 'canonical') THEN 2 ELSE 0 END + CASE WHEN list_contains(channels, 'crawler') THEN 4 ELSE 0 END) AS m FROM inv),
sub AS (SELECT run_id, mask::INTEGER AS mask, bit_count(mask::INTEGER)::INTEGER AS size, count(*) FILTER (orphan AND m & mask != 0) AS orphans_found, count(*) FILTER (list_contains(channels, 'link_graph') OR m & mask != 0) AS pages_known,
  round(CASE WHEN count(*) FILTER (orphan) > 0 THEN count(*) FILTER (orphan AND m & mask != 0) / count(*) FILTER (orphan)::DOUBLE ELSE 1 END, 9) AS orphan_recall FROM b, (SELECT unnest(range(0, 8)) AS mask) GROUP BY run_id, mask)
"""
_HEALTH = """, got AS (SELECT run_id, url, max(status) AS status FROM (SELECT run_id, address AS url, status_code AS status FROM loaded WHERE export = 'internal' UNION ALL SELECT run_id, url, 200 FROM pages WHERE url IS NOT NULL) GROUP BY ALL),
per AS (SELECT run_id, regexp_replace(url, '#.*$', '') AS url, count(*) AS links, count(DISTINCT src) AS pages FROM observed WHERE dst IS NOT NULL GROUP BY ALL),
health AS (SELECT p.run_id, p.url, CASE WHEN g.run_id IS NULL THEN 'unchecked' WHEN status IS NULL THEN 'failed' WHEN status >= 400 THEN 'broken' WHEN status >= 300 THEN 'redirect' ELSE 'fine' END AS outcome, status, links, pages
  FROM per p LEFT JOIN got g ON g.run_id = p.run_id AND g.url = p.url)
"""
_SECTION = r"regexp_extract({}, '^[^:/?#]+://[^/?#]*/([^/?#]+)/', 1)"
_PQ = r"regexp_replace(regexp_replace({}, '^[^:/?#]+://[^/?#]*', ''), '#.*$', '')"
_CAND = f""", tg AS (SELECT run_id, node, type AS reason FROM issues WHERE type IN ('deep-page', 'weak-authority') UNION SELECT run_id, dst, case_ FROM diag WHERE case_ IN ('v4', 'v3')),
cd AS (SELECT r.run_id, r.src, r.dst, round(r.ref, 7) AS ref, CASE WHEN regexp_matches({_PQ.format('r.src')}, '(?i){"|".join(f"(?:{p})" for p in UTILITY)}') THEN 'utility'
    WHEN {_SECTION.format('r.src')} != {_SECTION.format('r.dst')} AND {_SECTION.format('r.src')} != '' AND {_SECTION.format('r.dst')} != '' THEN 'section'
    WHEN coalesce(body_links, 0) > 0 AND omega >= 0.1 THEN 'prominent-link' WHEN coalesce(body_links, 0) > 0 THEN 'make-visible' ELSE 'add-link' END AS outcome
  FROM rhos r LEFT JOIN prom p ON p.run_id = r.run_id AND p.src = r.src AND p.dst = r.dst WHERE (r.run_id, r.dst) IN (SELECT run_id, node FROM tg))
"""
_OWN = GRAPH.replace("WITH RECURSIVE urls", "WITH RECURSIVE pol AS (SELECT id AS run_id, coalesce(TRY_CAST(regexp_extract(json_extract_string(config_json, '$.policy'), '^P([0-5])$', 1) AS INTEGER), 3) AS p FROM runs),\nurls", 1)
_OWN = _OWN.replace("f.p3 AS node, f.site FROM runs r JOIN forms f ON f.url = r.root_url", "[f.p0, f.p1, f.p2, f.p3][least(p, 3) + 1] AS node, f.site FROM runs r JOIN forms f ON f.url = r.root_url JOIN pol ON pol.run_id = r.id")
_OWN = _OWN.replace("SELECT p.*, f.p3 AS node FROM pages p JOIN forms f ON f.url = p.url", "SELECT p.*, [f.p0, f.p1, f.p2, f.p3][least(pol.p, 3) + 1] AS node FROM pages p JOIN forms f ON f.url = p.url JOIN pol ON pol.run_id = p.run_id")
_OWN = _OWN.replace("THEN f.p3 END AS dst", "THEN [f.p0, f.p1, f.p2, f.p3][least(pol.p, 3) + 1] END AS dst").replace("JOIN seeds s ON s.run_id = o.run_id", "JOIN seeds s ON s.run_id = o.run_id JOIN pol ON pol.run_id = o.run_id")
ORACLES: dict[str, str] = {
    # No page of the tables declares another node than its own, so P5 merges nothing more; a test merges some.
    "op84_own_policy_graphs": _OWN + """, e AS (SELECT run_id, count(*) AS edges, sum(weight)::BIGINT AS links FROM edges GROUP BY ALL)
      SELECT run_id, count(*) AS nodes, count(*) FILTER (crawled) AS crawled, coalesce(any_value(edges), 0) AS edges, coalesce(any_value(links), 0) AS links FROM nodes LEFT JOIN e USING (run_id) GROUP BY run_id""",
    "op85_anchor_paragraphs": """WITH f AS (SELECT DISTINCT ON (id) id, run_id, donor AS url, list_distinct(list_transform(donor_evidence.matched, lambda m: lower(m.term))) AS terms FROM fix_explanations),
      p AS (SELECT f.id, q.id AS page, terms, unnest(q.paragraphs) AS t, generate_subscripts(q.paragraphs, 1) AS pos FROM f JOIN pages q ON q.run_id = f.run_id AND q.url = f.url WHERE len(q.paragraphs) > 0),
      w AS (SELECT id, page, pos, terms, regexp_extract_all(lower(nfc_normalize(t)), '\\pL+') AS w FROM p WHERE t IS NOT NULL),
      h AS (SELECT id, page, pos, len(list_distinct(list_filter(w, lambda x: list_contains(terms, x)))) AS n, list_filter(w, lambda x: list_contains(terms, x))[1] AS anchor FROM w),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, page, pos) AS i FROM h WHERE n > 0)
      SELECT id, page, pos::INTEGER AS paragraph, n::INTEGER AS terms, anchor FROM r WHERE i = 1""".replace("\\\\", "\\"),
    "op41_observation_factors": GRAPH + LINKS + "SELECT run_id, id, region, body_rank::INTEGER AS body_rank, sitewide, round(weight, 9) AS weight FROM factors",
    "op42_prominence": GRAPH + LINKS + "SELECT run_id, src, dst, round(weight, 8) AS weight, round(omega, 8) AS omega, observations, body_links FROM prom",
    "op43_click_fates": _and_records(GRAPH) + _CLICKS + "SELECT run_id, fate, count(*) AS records, sum(clicks)::BIGINT AS clicks FROM fates GROUP BY ALL",
    "op44_analytics_override": _and_records(GRAPH) + LINKS + _CLICKS + """, cl AS (SELECT run_id, src, dst, clicks FROM fates WHERE fate = 'matched' UNION ALL SELECT run_id, src, dst, 1 FROM observed WHERE dst IS NOT NULL AND src != dst AND position_index = 0),
      cs AS (SELECT run_id, src, dst, sum(clicks)::DOUBLE AS c FROM cl GROUP BY ALL), ov AS (SELECT DISTINCT run_id, src FROM cs WHERE c > 0),
      x AS (SELECT p.run_id, p.src, p.dst, CASE WHEN ov.src IS NULL THEN p.weight ELSE coalesce(c, 0) END AS w, CASE WHEN ov.src IS NULL THEN 'structural' ELSE 'analytics' END AS origin
        FROM prom p LEFT JOIN ov ON ov.run_id = p.run_id AND ov.src = p.src LEFT JOIN cs ON cs.run_id = p.run_id AND cs.src = p.src AND cs.dst = p.dst)
      SELECT run_id, src, dst, round(w, 8) AS weight, round(coalesce(w / nullif(sum(w) OVER (PARTITION BY run_id, src), 0), 0), 8) AS omega, origin FROM x""",
    "op45_template_reach": GRAPH + LINKS + "SELECT run_id, template_signature, pages, round(share, 9) AS share FROM reach_t",
    "op46_effort": GRAPH + LINKS + """, b AS (SELECT o.run_id, o.src, count(DISTINCT o.template_signature) AS k, max(pages) AS r, count(*) AS n FROM o1 o LEFT JOIN reach_t t ON t.run_id = o.run_id AND t.template_signature = o.template_signature WHERE region = 'body' GROUP BY ALL)
      SELECT f.run_id, f.node, greatest(coalesce(k, 1), 1) AS kappa, coalesce(r, 1) AS reach, coalesce(b.n, 0) AS body_links FROM first f LEFT JOIN b ON b.run_id = f.run_id AND b.src = f.node""",
    "op47_four_cases": TERMS + LINKS + _DIAG + """SELECT run_id, src, dst, case_ AS "case", round(abs(omega - rho), 6) AS severity FROM diag WHERE case_ IS NOT NULL""",
    "op48_structural_issues": GRAPH + _FACTS + "SELECT run_id, type, rule, severity, node FROM issues",
    "op49_issue_counts": GRAPH + _FACTS + """SELECT run_id, coalesce(type, 'all') AS type, coalesce(severity, 'all') AS severity, count(*) AS issues, count(DISTINCT node) AS nodes FROM issues
      GROUP BY GROUPING SETS ((run_id, type), (run_id, severity), (run_id))""",
    "op50_link_health": _and_records(GRAPH) + _HEALTH + "SELECT run_id, url, outcome, status::INTEGER AS status, links, pages FROM health",
    "op51_health_summary": _and_records(GRAPH) + _HEALTH + "SELECT run_id, outcome, count(*) AS targets, sum(links)::BIGINT AS links, max(pages) AS most_pages FROM health GROUP BY ALL",
    "op52_inventory": _and_records(GRAPH) + _FOUND + "SELECT run_id, node, array_to_string(channels, ',') AS channels, sources, reachable, depth, orphan FROM inv",
    "op53_channel_yield": _and_records(GRAPH) + _FOUND + """, c AS (SELECT run_id, unnest(channels) AS channel, len(channels) = 1 AS alone, orphan FROM inv)
      SELECT run_id, channel, count(*) AS total, count(*) FILTER (alone) AS exclusive, count(*) FILTER (orphan) AS orphans FROM c GROUP BY ALL""",
    "op54_channel_subsets": _and_records(GRAPH) + _FOUND + _SUBSETS + "SELECT * FROM sub",
    "op55_leave_one_out": _and_records(GRAPH) + _FOUND + _SUBSETS + """, a AS (SELECT run_id, orphans_found FROM sub WHERE mask = 7)
      SELECT s.run_id, CASE mask WHEN 6 THEN 'analytics' WHEN 5 THEN 'canonical' ELSE 'crawler' END AS removed, a.orphans_found - s.orphans_found AS orphans_lost FROM sub s JOIN a USING (run_id) WHERE mask IN (6, 5, 3)""",
    "op56_fix_targets": TERMS + LINKS + _DIAG + _FACTS + _CAND + "SELECT run_id, node, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM tg GROUP BY ALL",
    "op57_candidates": TERMS + LINKS + _DIAG + _FACTS + _CAND + """SELECT run_id, dst, rank::INTEGER AS rank, src, outcome, ref FROM (SELECT *, row_number() OVER (PARTITION BY run_id, dst ORDER BY ref DESC, src) AS rank FROM cd WHERE outcome IN ('add-link', 'make-visible')) WHERE rank <= 30""",
    "op58_rejections": TERMS + LINKS + _DIAG + _FACTS + _CAND + "SELECT run_id, outcome, count(*) AS pairs, count(DISTINCT dst) AS targets FROM cd GROUP BY ALL",
    "op59_importance": GRAPH + LINKS + DEPTH + rank_sql(STEPS) + """, i AS (SELECT run_id, dst AS node, count(*) AS l FROM factors WHERE dst IS NOT NULL AND src != dst AND region = 'body' GROUP BY ALL),
      n AS (SELECT n.run_id, n.node, round(pagerank, 10) AS pr, depth, coalesce(l, 0) AS l FROM nodes n JOIN ranks USING (run_id, node) LEFT JOIN depths USING (run_id, node) LEFT JOIN i USING (run_id, node)),
      s AS (SELECT *, (rank() OVER (PARTITION BY run_id ORDER BY pr) - 1 + count(*) OVER (PARTITION BY run_id, pr) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY run_id) AS p, coalesce(1 / (1 + depth)::DOUBLE, 0) AS d,
        coalesce(ln(1 + l) / nullif(ln(1 + max(l) OVER (PARTITION BY run_id)), 0), 0) AS k FROM n)
      SELECT run_id, node, round(p, 7) AS pagerank_share, round(d, 7) AS depth_share, round(k, 7) AS links_share, round((0.25::DOUBLE * p + 0.2::DOUBLE * d + 0.15::DOUBLE * k) / (0.25::DOUBLE + 0.2::DOUBLE + 0.15::DOUBLE), 7) AS importance FROM s""",
    "op80_crawl_calibration": _and_records(GRAPH) + """, th AS (SELECT l.run_id, coalesce(CASE WHEN f.site = s.site THEN f.p3 END, '!' || l.address) AS node, max(status_code) AS status FROM loaded l JOIN forms f ON f.url = l.address LEFT JOIN seeds s ON s.run_id = l.run_id WHERE export = 'internal' GROUP BY 1, 2),
      j AS (SELECT coalesce(n.run_id, th.run_id) AS run_id, coalesce(n.node, th.node) AS node, crawled, th.node IS NOT NULL AS t, status FROM nodes n FULL JOIN th ON th.run_id = n.run_id AND th.node = n.node)
      SELECT run_id, CASE WHEN t AND crawled THEN 'both' WHEN NOT t AND crawled THEN 'only ours' WHEN NOT t THEN 'linked, neither fetched' WHEN node LIKE '!%' THEN 'theirs out of scope' WHEN status >= 400 THEN 'theirs broken'
        WHEN status >= 300 THEN 'theirs redirected' WHEN crawled IS NOT NULL THEN 'linked, theirs only' ELSE 'only theirs' END AS kind, count(*) AS pages FROM j GROUP BY ALL""",
    "op81_page_changes": """WITH h AS (SELECT source_fetch_id AS fetch_id, string_agg(resolved_url, chr(10) ORDER BY resolved_url) AS links FROM (SELECT DISTINCT source_fetch_id, resolved_url FROM link_observations WHERE resolved_url IS NOT NULL) GROUP BY ALL),
      s AS (SELECT p.run_id, p.url, p.fetch_id, {'a': title, 'b': h1, 'c': body_text, 'd': meta_canonical, 'e': meta_robots}::VARCHAR AS content, coalesce(links, '') AS links FROM pages p LEFT JOIN h USING (fetch_id) WHERE p.url IS NOT NULL),
      e AS (SELECT run_id, url, count(*) AS n, arg_min(content, fetch_id) AS a, arg_max(content, fetch_id) AS b, arg_min(links, fetch_id) AS la, arg_max(links, fetch_id) AS lb FROM s GROUP BY ALL HAVING count(*) > 1)
      SELECT run_id, url, n AS sights, CASE WHEN a != b THEN 'content' WHEN la != lb THEN 'links' ELSE 'none' END AS change FROM e""",
    "op82_depth_shift": GRAPH + DEPTH + f""", be AS (SELECT DISTINCT run_id, src, dst FROM observed WHERE dst IS NOT NULL AND src != dst AND {_CLASS} = 'body'),
      walk2 AS (SELECT run_id, node, 0 AS d FROM seeds UNION SELECT e.run_id, e.dst, d + 1 FROM walk2 JOIN be e ON e.run_id = walk2.run_id AND e.src = walk2.node WHERE d < 60),
      d2 AS (SELECT run_id, node, min(d) AS other FROM walk2 GROUP BY ALL)
      SELECT run_id, count(*) AS pages, round(avg(other - depth), 6) AS mean_shift, round(avg(abs(other - depth)), 6) AS mean_abs_shift FROM depths JOIN d2 USING (run_id, node) GROUP BY ALL""",
    "op83_explanations": """WITH r AS (SELECT DISTINCT ON (id) id, run_id, action, donor, target, donor_evidence.ref AS ref, list_filter(list_transform(donor_evidence.matched[1:3], lambda x: lower(x.term)), lambda t: t IS NOT NULL) AS m FROM fix_explanations)
      SELECT id, run_id, CASE action WHEN 'raise-link' THEN 'Raise the link' ELSE 'Add a link' END || ' from ' || coalesce(donor, '?') || ' to ' || coalesce(target, '?')
        || CASE WHEN ref IS NOT NULL THEN ' (' || CAST(round(ref * 100) AS INTEGER) || '% of its terms)' ELSE '' END || CASE WHEN coalesce(len(m), 0) > 0 THEN ', which share ' || array_to_string(m, ', ') ELSE '' END AS text FROM r""",
}
