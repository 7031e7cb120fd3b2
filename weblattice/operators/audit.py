"""Structural audits, discovery channels, fix candidates and importance, per run.

``nodes`` is (run_id, node, crawled, depth, pagerank, component, out_degree,
in_degree); ``edges`` (run_id, src, dst, weight). Every rule is a query over
all runs; results are unions of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblattice.operators.ranking import with_ranks

# The audit's thresholds.
DEEP, DEEP_HIGH, WEAK, WEAK_HIGH = 3, 6, 20, 5


def robots_tokens(*sources: Column) -> Column:
    """The directives of robots values, in lower case."""
    return F.filter(F.split(F.lower(F.concat_ws(",", *sources)), r"[\s,]+"), lambda t: t != "")


def says(tokens: Column, *directives: str) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(d) for d in (*directives, "none")]))


def largest_component(nodes: DataFrame) -> DataFrame:
    """(run_id, component, size) of each run's largest; of equals the one with the smallest name."""
    sizes = nodes.groupBy("run_id", "component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("run_id").agg(F.min_by(F.struct("component", "size"), F.struct((-F.col("size")).alias("s"), F.col("component"))).alias("_c")).select("run_id", "_c.*")


def structural_issues(nodes: DataFrame, edges: DataFrame, robots: DataFrame, canonicals: DataFrame, observed: DataFrame) -> DataFrame:
    """(run_id, type, rule, severity, node): one row per issue of crawled pages.

    deep-page: more than 3 clicks from the root, high above 6. weak-authority:
    PageRank below the run's 20th percentile, high below the 5th.
    outside-largest-scc: reachable, not in the largest component. dead-end: no
    way out. conflicts: a canonical that is noindex; a nofollow page that alone
    links to others; internal links with nofollow. ``robots`` is (run_id, node,
    tokens), ``canonicals`` (run_id, src, dst).
    """
    crawled = nodes.where("crawled")
    cuts = crawled.groupBy("run_id").agg(F.percentile("pagerank", F.lit(WEAK / 100)).alias("_weak"), F.percentile("pagerank", F.lit(WEAK_HIGH / 100)).alias("_high"))
    largest = largest_component(nodes).select("run_id", F.col("component").alias("_largest"))
    # One row per run on the right; adaptive execution broadcasts it where it is small.
    facts = crawled.join(cuts, "run_id").join(largest, "run_id")

    def issue(kind: str, when: Column, severity: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit("").alias("rule"), severity.alias("severity")))

    found = F.array_compact(F.array(
        issue("deep-page", F.col("depth") > DEEP, F.when(F.col("depth") > DEEP_HIGH, "high").otherwise("medium")),
        issue("weak-authority", F.col("pagerank") < F.col("_weak"), F.when(F.col("pagerank") < F.col("_high"), "high").otherwise("medium")),
        issue("outside-largest-scc", F.col("depth").isNotNull() & (F.col("component") != F.col("_largest")), F.lit("low")),
        issue("dead-end", F.col("out_degree") == 0, F.lit("medium")),
    ))
    plain = facts.select("run_id", "node", F.inline(found))

    def conflict(rows: DataFrame, rule: str, severity: str) -> DataFrame:
        return rows.select("run_id", "node", F.lit("noindex-nofollow-conflict").alias("type"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))

    noindex = robots.where(says(F.col("tokens"), "noindex")).select("run_id", F.col("node").alias("dst"))
    to_noindex = canonicals.where("src != dst").join(noindex, ["run_id", "dst"], "left_semi").select("run_id", F.col("src").alias("node")).distinct()
    nofollow = robots.where(says(F.col("tokens"), "nofollow")).select("run_id", F.col("node").alias("src"))
    alone = edges.groupBy("run_id", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("src")).where("n = 1")
    sole = alone.join(nofollow, ["run_id", "src"], "left_semi").select("run_id", F.col("src").alias("node")).distinct()
    marked = observed.where("dst is not null and src != dst").where(F.array_contains(robots_tokens(F.col("rel")), "nofollow")).select("run_id", F.col("dst").alias("node")).distinct()
    parts = [plain.select("run_id", "node", "type", "rule", "severity"), conflict(to_noindex, "canonical-to-noindex", "high"), conflict(sole, "nofollow-sole-path", "medium"), conflict(marked, "internal-nofollow", "low")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("run_id", "type", "rule", "severity", "node")


def inventory(found: DataFrame, nodes: DataFrame, link_channel: str = "link_graph") -> DataFrame:
    """(run_id, node, channels, sources, reachable, depth, orphan) of what any channel found.

    ``found`` is (run_id, channel, source, node). An orphan is found by a
    channel other than links and not reachable by links from the root.
    """
    per = found.groupBy("run_id", "node").agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.count_distinct("source").alias("sources"))
    j = per.join(nodes.select("run_id", "node", "depth"), ["run_id", "node"], "left")
    reachable = F.col("depth").isNotNull()
    other = F.exists("channels", lambda c: c != link_channel)
    return j.select("run_id", "node", "channels", "sources", reachable.alias("reachable"), "depth", (~reachable & other).alias("orphan"))


def channel_yield(inv: DataFrame) -> DataFrame:
    """(run_id, channel, total, exclusive, orphans) per channel."""
    rows = inv.select("run_id", F.explode("channels").alias("channel"), (F.size("channels") == 1).alias("_only"), "orphan")
    return rows.groupBy("run_id", "channel").agg(F.count(F.lit(1)).alias("total"), F.count_if("_only").alias("exclusive"), F.count_if("orphan").alias("orphans"))


def channel_subsets(inv: DataFrame, channels: list[str], link_channel: str = "link_graph") -> DataFrame:
    """(run_id, mask, size, orphans_found, pages_known, orphan_recall) for every subset of ``channels``.

    A node's channels become a bit mask, and nodes with equal masks are counted
    first; the subsets then meet at most 2^channels rows a run.
    """
    bits = sum((F.when(F.array_contains("channels", c), 1 << i).otherwise(0) for i, c in enumerate(channels)), F.lit(0))
    masks = inv.groupBy("run_id", bits.alias("_m"), F.array_contains("channels", link_channel).alias("_link"), "orphan").agg(F.count(F.lit(1)).alias("n"))
    all_masks = F.explode(F.sequence(F.lit(0), F.lit((1 << len(channels)) - 1))).alias("mask")
    grid = masks.select("run_id", "_m", "_link", "orphan", "n", all_masks)
    hit = F.col("_m").bitwiseAND(F.col("mask")) != 0
    out = grid.groupBy("run_id", "mask").agg(
        F.sum(F.when(F.col("orphan") & hit, F.col("n")).otherwise(0)).alias("orphans_found"), F.sum(F.when(F.col("_link") | hit, F.col("n")).otherwise(0)).alias("pages_known"),
        F.sum(F.when(F.col("orphan"), F.col("n")).otherwise(0)).alias("_all"),
    )
    recall = F.when(F.col("_all") > 0, F.col("orphans_found") / F.col("_all")).otherwise(1.0)
    return out.select("run_id", "mask", F.bit_count("mask").alias("size"), "orphans_found", "pages_known", recall.alias("orphan_recall"))


def leave_one_out(subsets: DataFrame, channels: list[str]) -> DataFrame:
    """(run_id, removed, orphans_lost): what only the removed channel finds."""
    full = (1 << len(channels)) - 1
    rows = subsets.where(F.col("mask").isin(full, *[full ^ (1 << i) for i in range(len(channels))]))
    sums = rows.groupBy("run_id").agg(
        F.max(F.when(F.col("mask") == full, F.col("orphans_found"))).alias("_all"),
        *[F.max(F.when(F.col("mask") == full ^ (1 << i), F.col("orphans_found"))).alias(f"_{i}") for i in range(len(channels))],
    )
    return sums.select("run_id", F.inline(F.array(*[F.struct(F.lit(c).alias("removed"), (F.col("_all") - F.col(f"_{i}")).alias("orphans_lost")) for i, c in enumerate(channels)])))


def candidates(targets: DataFrame, pairs: DataFrame, edges: DataFrame, section: Column, utility: Column, alpha: float = 0.1) -> DataFrame:
    """(run_id, src, dst, ref, rho, omega, body_links, outcome): related pairs into the targets under the admission rules.

    outcome is add-link or make-visible, or the first rule that rejects the
    pair: utility, section, prominent-link. REF above the threshold is what
    makes a pair (``pairs``), so the join starts from related pairs and no
    product of targets and donors arises; :func:`rejections` counts the rest.
    ``section`` and ``utility`` are expressions over the column ``url``.
    """
    def of(end: str, e: Column) -> DataFrame:
        ends = pairs.select("run_id", F.col(end).alias("url")).distinct()
        return ends.select("run_id", F.col("url").alias(end), e.alias(f"_{end}"))

    p = pairs.join(targets.select("run_id", F.col("node").alias("dst")).distinct(), ["run_id", "dst"], "left_semi")
    p = p.join(of("src", F.struct(section.alias("s"), utility.alias("u"))), ["run_id", "src"]).join(of("dst", F.struct(section.alias("s"))), ["run_id", "dst"])
    p = p.join(edges.select("run_id", "src", "dst", "omega", "body_links"), ["run_id", "src", "dst"], "left")
    s, t = F.col("_src.s"), F.col("_dst.s")
    body = F.coalesce(F.col("body_links") > 0, F.lit(False))
    outcome = (
        F.when(F.col("_src.u"), "utility").when((s != t) & (s != "") & (t != ""), "section").when(body & (F.col("omega") >= alpha), "prominent-link")
        .when(body, "make-visible").otherwise("add-link")
    )
    return p.select("run_id", "src", "dst", "ref", "rho", "omega", "body_links", outcome.alias("outcome"))


def importance(nodes: DataFrame, body_links: DataFrame, weights: tuple[float, float, float] = (0.25, 0.2, 0.15)) -> DataFrame:
    """(run_id, node, pagerank_share, depth_share, links_share, importance).

    The mid-rank percentile of PageRank, 1 / (1 + depth), and the logarithm of
    body links in, over the run's highest; weighed and divided by the weights'
    sum. A prior by the kind of page is left to the caller.
    """
    rows = with_ranks(nodes.select("run_id", "node", "depth", F.round("pagerank", 10).alias("pagerank")), ["run_id"], "pagerank")
    rows = rows.join(body_links, ["run_id", "node"], "left").withColumn("_l", F.coalesce("body_links", F.lit(0)))
    most = rows.groupBy("run_id").agg(F.max("_l").alias("_most"))
    j = rows.join(most, "run_id")
    depth = F.when(F.col("depth").isNotNull(), 1 / (1 + F.col("depth"))).otherwise(0.0)
    links = F.when(F.col("_most") > 0, F.log1p("_l") / F.log1p("_most")).otherwise(0.0)
    a, b, c = weights
    return j.select("run_id", "node", F.col("percentile").alias("pagerank_share"), depth.alias("depth_share"), links.alias("links_share"), ((a * F.col("percentile") + b * depth + c * links) / (a + b + c)).alias("importance"))
