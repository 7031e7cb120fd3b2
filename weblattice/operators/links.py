"""Links as readers meet them: prominence, clicks, effort, health, and the four-case diagnosis of pairs.

``observed`` is a row per link of a representative page: run_id, id, src, dst
(null where it is no link to another page of the site), dom_region,
template_signature, position_index. All results are keyed by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblattice.operators.skew import salted_join

# How much a region's links count, the decay by position, and the discount of blocks on most pages.
REGION_WEIGHTS = {"body": 1.0, "breadcrumb": 0.5, "aside": 0.4, "header": 0.3, "nav": 0.3, "pagination": 0.2, "footer": 0.1}
POSITION_DECAY, SITEWIDE_SHARE, SITEWIDE_DISCOUNT = 0.1, 0.5, 0.3


def region_class(region: Column) -> Column:
    """The region that weighs a link; main, unknown and missing regions are body."""
    return F.when(region.isin(*[r for r in REGION_WEIGHTS if r != "body"]), region).otherwise("body")


def template_reach(observed: DataFrame, pages: DataFrame) -> DataFrame:
    """(run_id, template_signature, pages, share) of each template; ``pages`` is (run_id, pages) of the runs."""
    reach = observed.where("template_signature is not null").select("run_id", "template_signature", "src").distinct().groupBy("run_id", "template_signature").agg(F.count(F.lit(1)).alias("pages"))
    return reach.join(pages.select("run_id", F.col("pages").alias("_all")), "run_id").select("run_id", "template_signature", "pages", (F.col("pages") / F.col("_all")).alias("share"))


def observation_factors(observed: DataFrame, pages: DataFrame) -> DataFrame:
    """``observed`` with region, body_rank, sitewide and weight.

    body_rank counts a page's body links in document order from 0, links out
    of the site included; other regions have none. A template on more than
    half of a run's pages is site-wide.
    """
    reach = template_reach(observed, pages).where(F.col("share") > SITEWIDE_SHARE)
    # Fewer than links per page over the share: a template is site-wide only if most pages pay for it.
    keyed = observed.withColumn("region", region_class(F.col("dom_region")))
    sizes = observed.groupBy("run_id", "template_signature").agg(F.count(F.lit(1)).alias("n"))
    wide = reach.select("run_id", "template_signature", F.lit(True).alias("_wide"))
    joined = salted_join(keyed, wide, ["run_id", "template_signature"], F.col("id"), sizes)
    order = Window.partitionBy("run_id", "src", "region").orderBy("position_index", "id")
    rank = F.when(F.col("region") == "body", F.row_number().over(order) - 1)
    weights = F.element_at(F.create_map(*[F.lit(x) for kv in REGION_WEIGHTS.items() for x in kv]), F.col("region"))
    ranked = joined.withColumn("body_rank", rank).withColumn("sitewide", F.coalesce("_wide", F.lit(False))).drop("_wide")
    factor = F.when(F.col("body_rank").isNull(), 1.0).otherwise(1.0 / (1.0 + POSITION_DECAY * F.col("body_rank")))
    return ranked.withColumn("weight", weights * factor * F.when(F.col("sitewide"), SITEWIDE_DISCOUNT).otherwise(1.0))


def prominence(factors: DataFrame, clicks: DataFrame | None = None) -> DataFrame:
    """(run_id, src, dst, weight, omega, origin, structural, observations, body_links) per pair of pages.

    The weight is the sum over the pair's links. With ``clicks`` (run_id, src,
    dst, clicks), a source with clicks on any of its links takes clicks as the
    weight of all its links. omega is the share of the source's weight, 0 where
    that is 0.
    """
    edges = factors.where("dst is not null and src != dst").groupBy("run_id", "src", "dst").agg(
        F.sum("weight").alias("structural"), F.count(F.lit(1)).alias("observations"), F.count_if(F.col("region") == "body").alias("body_links")
    )
    if clicks is None:
        edges = edges.withColumn("weight", F.col("structural")).withColumn("origin", F.lit("structural"))
    else:
        sums = clicks.groupBy("run_id", "src", "dst").agg(F.sum("clicks").cast("double").alias("_c"))
        edges = edges.join(sums, ["run_id", "src", "dst"], "left")
        clicked = edges.where(F.col("_c") > 0).select("run_id", "src", F.lit(True).alias("_o")).distinct()
        edges = edges.join(clicked, ["run_id", "src"], "left")
        edges = edges.withColumn("weight", F.when(F.col("_o"), F.coalesce("_c", F.lit(0.0))).otherwise(F.col("structural")))
        edges = edges.withColumn("origin", F.when(F.col("_o"), "analytics").otherwise("structural"))
    totals = edges.groupBy("run_id", "src").agg(F.sum("weight").alias("_t"))
    out = edges.join(totals, ["run_id", "src"])
    omega = F.when(F.col("_t") > 0, F.col("weight") / F.col("_t")).otherwise(0.0)
    return out.select("run_id", "src", "dst", "weight", omega.alias("omega"), "origin", "structural", "observations", "body_links")


def effort(observed: DataFrame, first: DataFrame, pages: DataFrame) -> DataFrame:
    """(run_id, node, kappa, reach, body_links): on how many templates a page's body links stand, and on how many pages the widest is."""
    body = observed.where(region_class(F.col("dom_region")) == "body")
    reach = template_reach(observed, pages).select("run_id", "template_signature", "pages")
    per = body.groupBy("run_id", "src", "template_signature").agg(F.count(F.lit(1)).alias("n")).join(reach, ["run_id", "template_signature"], "left")
    sums = per.groupBy("run_id", F.col("src").alias("node")).agg(F.count("template_signature").alias("_k"), F.max("pages").alias("_p"), F.sum("n").alias("_b"))
    out = first.select("run_id", "node").join(sums, ["run_id", "node"], "left")
    one = F.lit(1).cast("bigint")
    return out.select("run_id", "node", F.greatest(F.coalesce("_k", one), one).alias("kappa"), F.coalesce("_p", one).alias("reach"), F.coalesce("_b", one - 1).alias("body_links"))


def diagnose(pairs: DataFrame, edges: DataFrame, texts: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(run_id, src, dst, case, ref, rho, omega, severity): v4 missing, v3 buried, v2 good, v1 misleading.

    ``pairs`` has ref and rho, ``edges`` omega; links between pages without
    text (``texts``: run_id, node) are left out. Pairs neither related nor
    prominent have no case and no row.
    """
    e = edges.select("run_id", "src", "dst", "omega").where("src != dst")
    for end in ("src", "dst"):
        e = e.join(texts.select("run_id", F.col("node").alias(end)), ["run_id", end], "left_semi")
    return cases(pairs.select("run_id", "src", "dst", "ref", "rho").join(e.withColumn("_e", F.lit(True)), ["run_id", "src", "dst"], "full_outer"), alpha)


def cases(j: DataFrame, alpha: float = 0.1) -> DataFrame:
    """The diagnosis of joined pairs: (run_id, src, dst, ref, rho, omega, _e), ref and rho null where not related, omega and _e where there is no link."""
    # Sums of doubles depend on their order; rounded, a weight that is just alpha stays so.
    rho, omega, linked = F.round(F.coalesce("rho", F.lit(0.0)), 9), F.round(F.coalesce("omega", F.lit(0.0)), 9), F.coalesce("_e", F.lit(False))
    case = (
        F.when((rho > alpha) & ~linked, "v4").when((rho > alpha) & (omega < alpha), "v3").when(rho > alpha, "v2").when(linked & (omega >= alpha), "v1")
    )
    return j.select("run_id", "src", "dst", case.alias("case"), F.coalesce("ref", F.lit(0.0)).alias("ref"), rho.alias("rho"), omega.alias("omega"), F.abs(omega - rho).alias("severity")).where("case is not null")


def link_health(links: DataFrame, fetched: DataFrame) -> DataFrame:
    """(run_id, url, outcome, status, links, pages): internal link targets, fragments off, with what fetching them gave.

    ``links`` is (run_id, src, url); ``fetched`` is (run_id, url, status), one
    row per URL. outcome: unchecked where the URL was never fetched, failed
    without a status, broken from 400 on, redirect below that from 300 on, else
    fine.
    """
    per = links.groupBy("run_id", F.regexp_replace("url", "#.*$", "").alias("url"), "src").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("run_id", "url").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("pages"))
    j = per.join(fetched.select("run_id", "url", "status", F.lit(True).alias("_f")), ["run_id", "url"], "left")
    outcome = (
        F.when(F.col("_f").isNull(), "unchecked").when(F.col("status").isNull(), "failed").when(F.col("status") >= 400, "broken").when(F.col("status") >= 300, "redirect").otherwise("fine")
    )
    return j.select("run_id", "url", outcome.alias("outcome"), "status", "links", "pages")
