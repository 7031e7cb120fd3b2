"""Queries of canonical URLs and link graphs of all runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblattice.functions.urls import in_scope, is_utility, resolve, section, short_url
from weblattice.operators.canonical import chosen_edges, follow_canonicals, follow_redirects
from weblattice.operators.graph import betweenness, bfs_depth, collapse, degrees, pagerank, pagerank_per_run, scc, shared_neighbours, simulate
from weblattice.plans.site import DEPTH, FORMS, GRAPH, REACH, rank_sql, site, with_forms
from weblattice.session import checkpointed, load

#: Paths and queries of pages that no one should be sent to.
UTILITY = (
    r"(^|/)(log-?in|sign-?in|log-?out|sign-?out|register|sign-?up)([/.?]|$)", r"(^|/)(cart|basket|checkout)([/.?]|$)", r"(^|/)(my-?)?(account|profile)s?([/.?]|$)",
    r"(^|/)search([/.?]|$)", r"[?&](q|s|query|search)=", r"(^|/)tags?/",
)
#: PageRank steps where a query needs equal figures in both engines.
STEPS = 20


def link_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, seeds): (run_id, node, crawled), (run_id, src, dst) with parallel links and self-links, (run_id, node)."""
    s = site(spark, sf_dir)
    return s.nodes(), s.links(), s.seeds.select("run_id", "node")


def with_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges, and each node as a self-link without weight, so that nodes without links are there too."""
    return edges.select("run_id", "src", "dst", "weight").unionByName(nodes.select("run_id", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("bigint").alias("weight")))


def op1_canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, links = load(spark, sf_dir, "pages").select("url"), load(spark, sf_dir, "link_observations").select(F.col("resolved_url").alias("url"))
    return with_forms(pages.unionByName(links).where("url is not null").distinct())


def op2_collapsed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(link_graph(spark, sf_dir)[1])


def op3_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links, _ = link_graph(spark, sf_dir)
    return nodes.join(degrees(collapse(links)), ["run_id", "node"], "left").na.fill(0)


def op4_click_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null where no path leads from the root."""
    nodes, links, seeds = link_graph(spark, sf_dir)
    return nodes.join(bfs_depth(collapse(links), seeds), ["run_id", "node"], "left")


def op5_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links, _ = link_graph(spark, sf_dir)
    return scc(with_nodes(collapse(links), nodes))


def op6_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links, _ = link_graph(spark, sf_dir)
    return pagerank_per_run(with_nodes(collapse(links), nodes)).select("run_id", "node", F.round("pagerank", 8).alias("pagerank"))


def op7_pagerank_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank after a fixed number of steps, as joins and aggregates without a bound on a run's size."""
    nodes, links, _ = link_graph(spark, sf_dir)
    return pagerank(collapse(links), nodes.select("run_id", "node"), iterations=STEPS).withColumn("pagerank", F.round("pagerank", 8))


def op8_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links, _ = link_graph(spark, sf_dir)
    return betweenness(with_nodes(collapse(links), nodes))


def fix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, src, dst): the explained fixes' donors and targets as P3 nodes."""
    rows = load(spark, sf_dir, "fix_explanations").where("donor is not null and target is not null").select("run_id", "donor", "target").distinct()
    src = checkpointed(with_forms(rows, "donor").select("run_id", "target", F.col("p3").alias("src")))
    pairs = checkpointed(with_forms(src, "target").select("run_id", "src", F.col("p3").alias("dst")))
    return pairs.where("src != dst").distinct()


def op9_shared_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links, _ = link_graph(spark, sf_dir)
    return shared_neighbours(collapse(links), fix_pairs(spark, sf_dir)).withColumn("adamic_adar", F.round("adamic_adar", 8))


def op10_simulated_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links, seeds = link_graph(spark, sf_dir)
    return simulate(with_nodes(collapse(links), nodes), fix_pairs(spark, sf_dir), seeds)


def op11_joint_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links, seeds = link_graph(spark, sf_dir)
    return simulate(with_nodes(collapse(links), nodes), fix_pairs(spark, sf_dir), seeds, joint=True)


def op12_graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per run: nodes, edges, self-links, links merged into parallel ones, links out of the site, links that don't resolve."""
    s = site(spark, sf_dir)
    o = s.observed
    by_pair = o.groupBy("run_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"), F.count("url").alias("urls"))
    inside, loop = F.col("dst").isNotNull(), F.col("src") == F.col("dst")
    counts = by_pair.groupBy("run_id").agg(
        F.count_if(inside & ~loop).alias("edges"), F.sum(F.when(inside & loop, F.col("n")).otherwise(0)).alias("self_links"),
        F.sum(F.when(inside & ~loop, F.col("n") - 1).otherwise(0)).alias("parallel_links"), F.sum(F.when(~inside, F.col("urls")).otherwise(0)).alias("external_links"),
        F.sum(F.when(~inside, F.col("n") - F.col("urls")).otherwise(0)).alias("unresolved_links"),
    )
    sizes = s.nodes().groupBy("run_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("crawled").alias("crawled"))
    return sizes.join(counts, "run_id", "left").na.fill(0)


def op13_representative_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site(spark, sf_dir).first


def canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, src, dst): what pages declare as their canonical, resolved, as P3 nodes."""
    rows = load(spark, sf_dir, "pages").where("url is not null and meta_canonical is not null").select("run_id", "url", resolve(F.coalesce("base_href", "url"), F.col("meta_canonical")).alias("canonical"))
    # Written between the steps: else each canonical form would spell out the resolution again.
    src = checkpointed(with_forms(rows).select("run_id", "canonical", F.col("p3").alias("src")))
    return checkpointed(with_forms(src, "canonical").select("run_id", "src", F.col("p3").alias("dst")))


def op14_canonical_p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each crawled node under the canonicals its run's pages declare; the pages are what was fetched."""
    s = site(spark, sf_dir)
    crawled = s.first.select("run_id", "node")
    return follow_canonicals(crawled, canonical_edges(spark, sf_dir), crawled)


def op15_majority_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_edges(canonical_edges(spark, sf_dir))


#: Redirects and canonicals that no table holds: a chain, loops of two and three nodes, a way into a loop, two votes, a foreign host.
REDIRECTS = (("a", "b"), ("b", "c"), ("c", "d"), ("k", "m"), ("m", "k"), ("r", "s"), ("s", "t"), ("t", "r"), ("z", "t"), ("v", "w"), ("v", "u"), ("v", "u"), ("x", "x"))
CANONICALS = (("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("f", "g"), ("g", "f"), ("h", "f"), ("i", "/o.test/i"), ("j", "gone"), ("l", "c"))


def _fixture(spark: SparkSession, pairs: tuple) -> DataFrame:
    name = lambda x: f"https:/{x}" if x.startswith("/") else f"https://s.test/{x}"
    return spark.createDataFrame([(1, name(a), name(b)) for a, b in pairs], "run_id long, src string, dst string")


def op16_canonical_p4_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return follow_redirects(_fixture(spark, REDIRECTS))


def op17_canonical_p5_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _fixture(spark, CANONICALS)
    nodes = edges.select("run_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return follow_canonicals(nodes, edges, nodes.where("not endswith(node, 'gone')"))


def op18_scope_and_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different link targets per run and section of the path, how many are in scope, and how many are utility pages."""
    runs = load(spark, sf_dir, "runs").where("root_url is not null").select(F.col("id").alias("run_id"), "root_url").distinct()
    urls = load(spark, sf_dir, "link_observations").where("resolved_url is not null").select("run_id", F.col("resolved_url").alias("url")).distinct()
    rows = urls.join(runs, "run_id").withColumn("section", section(F.col("url")))
    return rows.groupBy("run_id", "section").agg(
        F.count(F.lit(1)).alias("urls"), F.count_if(in_scope(F.col("url"), F.col("root_url"))).alias("in_scope"),
        F.count_if(is_utility(F.col("url"), UTILITY)).alias("utility"), F.max(F.length(short_url(F.col("url")))).alias("longest"),
    )


def op19_policy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes each pair of policies P0 to P3 gives a run's pages, and how many pages both tell apart from others or merge alike."""
    pages = load(spark, sf_dir, "pages").where("url is not null").select("run_id", "url").distinct()
    forms = with_forms(pages)
    long = forms.select("run_id", "url", F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), F.col(f"p{k}").alias("node")) for k in range(4)])).alias("f")).select("run_id", "url", "f.*")
    sizes = long.groupBy("run_id", "policy", "node").agg(F.count(F.lit(1)).alias("n"))
    merged = sizes.groupBy("run_id", "policy").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("merged_urls"))
    # Four rows per run on either side: six pairs.
    b = merged.select("run_id", *[F.col(c).alias(f"{c}_b") for c in ("policy", "nodes", "merged_urls")])
    pairs = merged.select("run_id", *[F.col(c).alias(f"{c}_a") for c in ("policy", "nodes", "merged_urls")]).join(b, "run_id").where("policy_a < policy_b")
    return pairs.withColumn("lost_nodes", F.col("nodes_a") - F.col("nodes_b"))


_FUNCTIONS = [
    op1_canonical_urls, op2_collapsed_edges, op3_degrees, op4_click_depth, op5_strong_components, op6_pagerank, op7_pagerank_steps, op8_betweenness, op9_shared_neighbours,
    op10_simulated_fixes, op11_joint_fixes, op12_graph_summary, op13_representative_pages, op14_canonical_p5, op15_majority_canonical, op16_canonical_p4_fixture,
    op17_canonical_p5_fixture, op18_scope_and_sections, op19_policy_pairs,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _FUNCTIONS}

_CANON = """, ce AS (SELECT p.run_id, f.p3 AS src, g.p3 AS dst FROM pages p JOIN forms f ON f.url = p.url JOIN forms g ON g.url = p.meta_canonical),
cv AS (SELECT run_id, src, dst, count(*) AS n FROM ce WHERE src != dst GROUP BY ALL),
chosen AS (SELECT run_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY run_id, src ORDER BY n DESC, dst) AS i FROM cv) WHERE i = 1)
"""
_WALK = """, hop AS (SELECT run_id, src, dst FROM chosen c WHERE string_split(src, '/')[1:3] = string_split(dst, '/')[1:3] AND (run_id, dst) IN (SELECT run_id, node FROM ok)),
w AS (SELECT run_id, node AS start, node AS cur, [node] AS path, NULL::VARCHAR AS e FROM start_nodes
  UNION ALL SELECT w.run_id, start, coalesce(h.dst, cur), CASE WHEN h.dst IS NULL THEN path ELSE list_append(path, h.dst) END,
    CASE WHEN h.dst IS NULL THEN cur WHEN list_contains(path, h.dst) THEN h.dst WHEN len(path) > 3 THEN start END
  FROM w LEFT JOIN hop h ON h.run_id = w.run_id AND h.src = w.cur WHERE e IS NULL)
SELECT run_id, start AS node, e AS canonical FROM w WHERE e IS NOT NULL"""


def _values(pairs: tuple) -> str:
    name = lambda x: f"https:/{x}" if x.startswith("/") else f"https://s.test/{x}"
    return "(VALUES " + ", ".join(f"(1::BIGINT, '{name(a)}', '{name(b)}')" for a, b in pairs) + ") v(run_id, src, dst)"


_CHOSEN = """cv AS (SELECT run_id, src, dst, count(*) AS n FROM fixture WHERE src != dst GROUP BY ALL),
chosen AS (SELECT run_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY run_id, src ORDER BY n DESC, dst) AS i FROM cv) WHERE i = 1)
"""
_UTILITY_SQL = "|".join(f"(?:{p})" for p in UTILITY)
ORACLES: dict[str, str] = {
    "op1_canonical_urls": FORMS + "SELECT url, p0, p1, p2, p3 FROM forms WHERE url IN (SELECT url FROM pages UNION SELECT resolved_url FROM link_observations)",
    "op2_collapsed_edges": GRAPH + "SELECT * FROM edges",
    "op3_degrees": GRAPH + """, o AS (SELECT run_id, src AS node, count(*) AS out_degree, sum(weight)::BIGINT AS out_weight FROM edges GROUP BY ALL),
      i AS (SELECT run_id, dst AS node, count(*) AS in_degree, sum(weight)::BIGINT AS in_weight FROM edges GROUP BY ALL)
      SELECT run_id, node, crawled, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree, coalesce(out_weight, 0) AS out_weight, coalesce(in_weight, 0) AS in_weight
      FROM nodes LEFT JOIN o USING (run_id, node) LEFT JOIN i USING (run_id, node)""",
    "op4_click_depth": GRAPH + DEPTH + "SELECT run_id, node, crawled, depth FROM nodes LEFT JOIN depths USING (run_id, node)",
    "op5_strong_components": GRAPH + REACH + "SELECT * FROM scc",
    "op6_pagerank": GRAPH + rank_sql(150) + "SELECT run_id, node, round(pagerank, 8) AS pagerank FROM ranks",
    "op7_pagerank_steps": GRAPH + rank_sql(STEPS) + "SELECT run_id, node, round(pagerank, 8) AS pagerank FROM ranks",
    "op9_shared_neighbours": GRAPH.replace("UNION SELECT meta_canonical FROM pages", "UNION SELECT meta_canonical FROM pages UNION SELECT donor FROM fix_explanations UNION SELECT target FROM fix_explanations") + """,
      pairs AS (SELECT DISTINCT x.run_id, a.p3 AS src, b.p3 AS dst FROM fix_explanations x JOIN forms a ON a.url = x.donor JOIN forms b ON b.url = x.target WHERE a.p3 != b.p3),
      u AS (SELECT run_id, src AS a, dst AS b FROM edges UNION SELECT run_id, dst, src FROM edges), d AS (SELECT run_id, a, count(*) AS deg FROM u GROUP BY ALL)
      SELECT p.run_id, p.src, p.dst, count(*) AS common, round(sum(CASE WHEN deg > 1 THEN 1 / ln(deg) ELSE 0 END), 8) AS adamic_adar
      FROM pairs p JOIN u x ON x.run_id = p.run_id AND x.a = p.src JOIN u y ON y.run_id = p.run_id AND y.a = p.dst AND y.b = x.b JOIN d ON d.run_id = p.run_id AND d.a = x.b GROUP BY ALL""",
    "op12_graph_summary": GRAPH + """, n AS (SELECT run_id, count(*) AS nodes, count(*) FILTER (crawled) AS crawled FROM nodes GROUP BY ALL),
      e AS (SELECT run_id, count(*) AS edges, sum(weight - 1)::BIGINT AS parallel_links FROM edges GROUP BY ALL),
      o AS (SELECT run_id, count(*) FILTER (src = dst) AS self_links, count(*) FILTER (dst IS NULL AND url IS NOT NULL) AS external_links, count(*) FILTER (url IS NULL) AS unresolved_links FROM observed GROUP BY ALL)
      SELECT run_id, nodes, crawled, coalesce(edges, 0) AS edges, coalesce(self_links, 0) AS self_links, coalesce(parallel_links, 0) AS parallel_links,
        coalesce(external_links, 0) AS external_links, coalesce(unresolved_links, 0) AS unresolved_links FROM n LEFT JOIN e USING (run_id) LEFT JOIN o USING (run_id)""",
    "op13_representative_pages": GRAPH + "SELECT * FROM first",
    "op14_canonical_p5": GRAPH + _CANON + ", ok AS (SELECT run_id, node FROM first), start_nodes AS (SELECT run_id, node FROM first)" + _WALK,
    "op15_majority_canonical": FORMS + _CANON + "SELECT * FROM chosen",
    "op16_canonical_p4_fixture": f"WITH RECURSIVE fixture AS (SELECT * FROM {_values(REDIRECTS)}), " + _CHOSEN + """,
      w AS (SELECT run_id, src AS start, src AS cur, [src] AS path, NULL::VARCHAR AS e FROM chosen
        UNION ALL SELECT w.run_id, start, coalesce(c.dst, cur), list_append(path, c.dst),
          CASE WHEN c.dst IS NULL THEN cur WHEN list_contains(path, c.dst) THEN list_min(path[list_position(path, c.dst):]) END
        FROM w LEFT JOIN chosen c ON c.run_id = w.run_id AND c.src = w.cur WHERE e IS NULL)
      SELECT run_id, start AS src, e AS dst FROM w WHERE e IS NOT NULL""",
    "op17_canonical_p5_fixture": f"WITH RECURSIVE fixture AS (SELECT * FROM {_values(CANONICALS)}), " + _CHOSEN + """,
      start_nodes AS (SELECT run_id, src AS node FROM fixture UNION SELECT run_id, dst FROM fixture), ok AS (SELECT * FROM start_nodes WHERE node NOT LIKE '%gone')""" + _WALK,
    "op18_scope_and_sections": rf"""WITH u AS (SELECT DISTINCT l.run_id, l.resolved_url AS url, r.root_url FROM link_observations l JOIN runs r ON r.id = l.run_id WHERE l.resolved_url IS NOT NULL AND r.root_url IS NOT NULL),
      p AS (SELECT *, regexp_extract(url, '^[^:/?#]+://[^/?#]*/([^/?#]+)/', 1) AS section, regexp_extract(lower(url), '^https?://([^/?#]*)', 1) AS h, regexp_extract(lower(root_url), '^https?://([^/?#]*)', 1) AS rh,
        regexp_replace(regexp_replace(url, '^[^:/?#]+://[^/?#]*', ''), '#.*$', '') AS pq FROM u)
      SELECT run_id, section, count(*) AS urls, count(*) FILTER (h = rh AND h != '') AS in_scope, count(*) FILTER (regexp_matches(pq, '(?i){_UTILITY_SQL}')) AS utility,
        max(greatest(length(pq), 1))::INTEGER AS longest FROM p GROUP BY ALL""",
    "op19_policy_pairs": FORMS + """, l AS (SELECT DISTINCT run_id, url FROM pages WHERE url IS NOT NULL), x AS (SELECT run_id, unnest([{'policy': 0, 'node': p0}, {'policy': 1, 'node': p1}, {'policy': 2, 'node': p2}, {'policy': 3, 'node': p3}]) AS f FROM l JOIN forms USING (url)),
      n AS (SELECT run_id, f.policy AS policy, f.node AS node, count(*) AS n FROM x GROUP BY ALL),
      m AS (SELECT run_id, policy, count(*) AS nodes, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS merged_urls FROM n GROUP BY ALL)
      SELECT a.run_id, a.policy AS policy_a, a.nodes AS nodes_a, a.merged_urls AS merged_urls_a, b.policy AS policy_b, b.nodes AS nodes_b, b.merged_urls AS merged_urls_b, a.nodes - b.nodes AS lost_nodes
      FROM m a JOIN m b ON a.run_id = b.run_id AND a.policy < b.policy""",
}
