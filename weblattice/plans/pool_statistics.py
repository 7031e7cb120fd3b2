"""Statistics over the pools of admissible fixes, per run, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weblattice.operators import statistics as st
from weblattice.operators.ranking import with_ranks
from weblattice.operators.text import set_jaccard, sigma
from weblattice.session import load

VALUES = ("s_score", "delta_pr", "ref", "cosine")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run, donor and target: the highest of each score (NaN is none), the lowest effort and depth."""
    rows = load(spark, sf_dir, "pool_rows").where("donor is not null and target is not null")
    clean = rows.select("run_id", "donor", "target", "kind", "kappa", "donor_depth", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in VALUES])
    return clean.groupBy("run_id", "donor", "target").agg(*[F.max(c).alias(c) for c in VALUES], F.min("kappa").alias("kappa"), F.min("donor_depth").alias("donor_depth"), F.min("kind").alias("kind"))


def _r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def op20_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.percentiles(pool(spark, sf_dir), ["run_id"], "delta_pr", (5, 20, 50, 95))
    return out.select("run_id", *[_r(c, 9).alias(c) for c in out.columns[1:]])


def op21_midrank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_ranks(pool(spark, sf_dir).select("run_id", "donor", "target", "ref"), ["run_id"], "ref")
    return out.select("run_id", "donor", "target", _r("rank").alias("rank"), _r("percentile", 9).alias("percentile"))


def op22_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.gini(pool(spark, sf_dir), ["run_id"], "delta_pr").select("run_id", _r("gini").alias("gini"))


def op23_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.spearman(pool(spark, sf_dir), ["run_id"], "ref", "cosine").select("run_id", "n", _r("spearman").alias("spearman"))


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of each pair as quarters of its scores, standing in for two raters."""
    quarter = lambda c: F.least(F.floor(F.col(c) * 4), F.lit(3)).cast("int")
    return pool(spark, sf_dir).where("ref between 0 and 1 and cosine between 0 and 1").select("run_id", "donor", "target", "s_score", quarter("ref").alias("a"), quarter("cosine").alias("b"))


def op24_cohens_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.cohens_kappa(_rated(spark, sf_dir), ["run_id"], "a", "b")
    return out.select("run_id", "items", _r("observed").alias("observed"), _r("kappa").alias("kappa"))


def op25_weighted_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.weighted_kappa(_rated(spark, sf_dir), ["run_id"], "a", "b", 4).select("run_id", "items", _r("weighted_kappa").alias("weighted_kappa"))


def op26_precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of the score's order within targets, a pair counting as relevant from REF 0.5 on."""
    ranked = top_of_target(pool(spark, sf_dir), F.desc_nulls_last("s_score"), 20).withColumn("relevant", F.col("ref") >= 0.5)
    out = st.precision_at(ranked, ["run_id"], "rank", "relevant", (1, 5, 10, 20))
    return out.select("run_id", "k", "rated", "relevant", _r("precision").alias("precision"))


def top_of_target(rows: DataFrame, order: Column, k: int) -> DataFrame:
    """The first ``k`` rows of each run and target; partial top lists leave each partition before the shuffle."""
    w = Window.partitionBy("run_id", "target").orderBy(order, "donor")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def op27_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each method ranks a target's best pair by REF among its pool, in expectation over ties; means per run."""
    p = pool(spark, sf_dir)
    best = p.groupBy("run_id", "target").agg(F.min_by("donor", F.struct(-F.coalesce("ref", F.lit(-1.0)), F.col("donor"))).alias("best"))
    marked = p.join(best, ["run_id", "target"]).withColumn("hit", F.col("donor") == F.col("best"))
    long = marked.select("run_id", "target", "hit", F.explode(F.create_map(*[x for c in ("s_score", "delta_pr", "cosine") for x in (F.lit(c), F.col(c))])).alias("method", "score"))
    found = st.recovery(long, ["run_id", "method", "target"], "score", "hit", (10,))
    return found.groupBy("run_id", "method").agg(
        F.count(F.lit(1)).alias("queries"), _r(F.avg("recall_10")).alias("recall_10"), _r(F.avg("reciprocal_rank")).alias("mrr"), _r(F.avg("auc")).alias("auc")
    )


def op28_signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pool(spark, sf_dir).withColumn("d", F.round(F.col("ref") - F.col("cosine"), 6))
    out = st.signed_ranks(d, ["run_id"], "d")
    return out.select("run_id", "n", _r("w_plus", 3).alias("w_plus"), _r("w_minus", 3).alias("w_minus"), _r("rank_biserial").alias("rank_biserial"))


def op29_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-test p-values per run (normal approximation), adjusted over all runs: one report's list of tests."""
    d = pool(spark, sf_dir).where("ref != cosine")
    per = d.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ref") > F.col("cosine")).alias("k"))
    z = F.abs(2 * F.col("k") - F.col("n")) / F.sqrt(F.col("n").cast("double"))
    # An upper bound of the normal tail that both engines can spell: exp(-z²/2).
    p = per.select(F.lit(1).alias("family"), "run_id", F.round(F.exp(-z * z / 2), 9).alias("p"))
    return st.holm(p, ["family"], "p").select("run_id", "p", _r("holm", 9).alias("holm"))


def op30_wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.wilcoxon(pool(spark, sf_dir).withColumn("d", F.round(F.col("ref") - F.col("cosine"), 6)), ["run_id"], "d")


def op31_kruskal_wallis(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.kruskal_wallis(pool(spark, sf_dir), ["run_id"], "kind", "ref")
    return out.select("run_id", "n", "levels", _r("h", 4).alias("h"), _r("epsilon_squared").alias("epsilon_squared"))


def op32_friedman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether kinds of targets differ in REF, each run being a block."""
    kinds = load(spark, sf_dir, "pool_rows").where("kind is not null").select("kind").distinct().count()
    return st.friedman(pool(spark, sf_dir), ["run_id"], "kind", "ref", kinds)


def op33_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.bootstrap_ci(pool(spark, sf_dir), ["run_id"], "target", "ref")


def op34_set_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The donors of a target among REF's and cosine's upper halves, as sets: empty ones agree."""
    p = pool(spark, sf_dir)
    return st.set_similarity(p, ["run_id", "target"], "donor", F.coalesce(F.col("ref") >= 0.5, F.lit(False)), F.coalesce(F.col("cosine") >= 0.5, F.lit(False))).withColumn("jaccard", _r("jaccard", 9))


def op35_sigma_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """σ and S = ΔPR · σ / κ of each pair under the four variants; a missing cosine is 0, rows without REF, ΔPR or κ have none."""
    p = pool(spark, sf_dir).where("ref is not null and delta_pr is not null and kappa > 0")
    variants = sigma(F.col("ref"), F.col("cosine"))
    pairs = F.create_map(*[x for k, v in variants.items() for x in (F.lit(k), v)])
    long = p.select("run_id", "donor", "target", "delta_pr", "kappa", F.explode(pairs).alias("variant", "sigma"))
    return long.select("run_id", "donor", "target", "variant", "sigma", (F.col("delta_pr") * F.col("sigma") / F.col("kappa")).alias("score"))


def op36_fix_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fixes of a run and of each target by S under the gated variant: score, ΔPR, donor, target."""
    s = op35_sigma_scores(spark, sf_dir).where("variant = 'ref_gate_cosine'").select("run_id", "donor", "target", "score")
    p = s.join(pool(spark, sf_dir).select("run_id", "donor", "target", "delta_pr"), ["run_id", "donor", "target"])
    order = [F.desc("score"), F.desc("delta_pr"), F.asc("donor"), F.asc("target")]
    of_run = p.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(*order))).where(F.col("rank") <= 10).withColumn("scope", F.lit("run"))
    of_target = p.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "target").orderBy(*order))).where(F.col("rank") <= 3).withColumn("scope", F.lit("target"))
    return of_run.unionByName(of_target).select("scope", "run_id", "rank", "donor", "target", "score")


def op37_baseline_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten pairs of each run by four methods; a missing cosine ranks last."""
    p = pool(spark, sf_dir)
    orders = {
        "score": [F.desc_nulls_last("s_score"), F.desc_nulls_last("delta_pr")], "cosine": [F.desc_nulls_last("cosine")],
        "containment": [F.desc_nulls_last("ref")], "gain": [F.desc_nulls_last("delta_pr")],
    }
    parts = [
        p.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(*o, "donor", "target"))).where(F.col("rank") <= 10).select(F.lit(m).alias("method"), "run_id", "rank", "donor", "target")
        for m, o in orders.items()
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def op38_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes kept and mean score per setting of ε and the gate's variant: settings join the pairs, one aggregate serves all."""
    p = pool(spark, sf_dir).where("ref is not null and delta_pr is not null and kappa > 0")
    c = F.coalesce("cosine", F.lit(0.0))
    settings = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(e).alias("epsilon")) for v in ("gate", "blend") for e in (0.1, 0.2, 0.3, 0.5)])
    long = p.select("run_id", "ref", c.alias("c"), "delta_pr", "kappa", F.explode(settings).alias("s")).where(F.col("ref") > F.col("s.epsilon"))
    s = F.when(F.col("s.variant") == "gate", F.col("c")).otherwise(0.5 * F.col("ref") + 0.5 * F.col("c"))
    return long.groupBy("run_id", F.col("s.variant").alias("variant"), F.col("s.epsilon").alias("epsilon")).agg(F.count(F.lit(1)).alias("fixes"), _r(F.avg(F.col("delta_pr") * s / F.col("kappa")), 9).alias("mean_score"))


def op39_rescue_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each orphan target its five donors with the highest ΔPR, then REF, then by name."""
    p = pool(spark, sf_dir).where("kind = 'orphan' and delta_pr is not null")
    w = Window.partitionBy("run_id", "target").orderBy(F.desc("delta_pr"), F.desc_nulls_last("ref"), "donor")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 5).select("run_id", "target", "rank", "donor", F.round("delta_pr", 9).alias("delta_pr"))


def op40_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric features of each pair for a learned reorder: its scores, gaps, effort, depth, and its standing within target and donor."""
    p = pool(spark, sf_dir)
    by_target = p.groupBy("run_id", "target").agg(F.count(F.lit(1)).alias("target_pairs"), F.max("ref").alias("target_ref"), F.max("cosine").alias("target_cosine"))
    by_donor = p.groupBy("run_id", "donor").agg(F.count(F.lit(1)).alias("donor_pairs"), F.max("delta_pr").alias("donor_gain"))
    j = p.join(by_target, ["run_id", "target"]).join(by_donor, ["run_id", "donor"])
    return j.select(
        "run_id", "donor", "target", "target_pairs", "donor_pairs", "kappa", F.col("donor_depth").isNull().cast("int").alias("depth_missing"),
        _r(F.try_divide("ref", "target_ref")).alias("ref_of_best"), _r(F.col("cosine") - F.col("target_cosine")).alias("cosine_gap"),
        _r(F.try_divide("delta_pr", "donor_gain")).alias("gain_of_best"), _r(F.when(F.col("donor_depth") > -1, 1 / (1 + F.col("donor_depth")))).alias("depth_decay"),
    )


_FUNCTIONS = [
    op20_percentiles, op21_midrank_percentile, op22_gini, op23_spearman, op24_cohens_kappa, op25_weighted_kappa, op26_precision_at_k, op27_recovery, op28_signed_ranks,
    op29_holm, op30_wilcoxon, op31_kruskal_wallis, op32_friedman, op33_bootstrap_ci, op34_set_jaccard, op35_sigma_scores, op36_fix_ranking, op37_baseline_ranks, op38_sweep,
    op39_rescue_shortlist, op40_pair_features,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _FUNCTIONS}

_POOL = """WITH clean AS (
  SELECT run_id, donor, target, kind, kappa, donor_depth,
    CASE WHEN NOT isnan(s_score) THEN s_score END AS s_score, CASE WHEN NOT isnan(delta_pr) THEN delta_pr END AS delta_pr,
    CASE WHEN NOT isnan(ref) THEN ref END AS ref, CASE WHEN NOT isnan(cosine) THEN cosine END AS cosine
  FROM pool_rows WHERE donor IS NOT NULL AND target IS NOT NULL),
pool AS (
  SELECT run_id, donor, target, max(s_score) AS s_score, max(delta_pr) AS delta_pr, max(ref) AS ref, max(cosine) AS cosine,
    min(kappa) AS kappa, min(donor_depth) AS donor_depth, min(kind) AS kind
  FROM clean GROUP BY run_id, donor, target)
"""
_RATED = _POOL + """, rated AS (
  SELECT run_id, least(CAST(floor(ref * 4) AS INT), 3) AS a, least(CAST(floor(cosine * 4) AS INT), 3) AS b
  FROM pool WHERE ref BETWEEN 0 AND 1 AND cosine BETWEEN 0 AND 1)
"""
_SIGMA = _POOL + """, v AS (
  SELECT run_id, donor, target, delta_pr, kappa, unnest([
    {'k': 'cosine_only', 'x': coalesce(cosine, 0)}, {'k': 'ref_only', 'x': ref},
    {'k': 'ref_gate_cosine', 'x': CASE WHEN ref > 0.2 THEN coalesce(cosine, 0) ELSE 0 END}, {'k': 'blended', 'x': 0.5 * ref + 0.5 * coalesce(cosine, 0)}]) AS s
  FROM pool WHERE ref IS NOT NULL AND delta_pr IS NOT NULL AND kappa > 0),
scores AS (SELECT run_id, donor, target, s.k AS variant, s.x AS sigma, delta_pr * s.x / kappa AS score, delta_pr FROM v)
"""

ORACLES: dict[str, str] = {
    "op20_percentiles": _POOL + """SELECT run_id, round(quantile_cont(delta_pr, 0.05), 9) AS p5, round(quantile_cont(delta_pr, 0.2), 9) AS p20,
      round(quantile_cont(delta_pr, 0.5), 9) AS p50, round(quantile_cont(delta_pr, 0.95), 9) AS p95 FROM pool GROUP BY run_id""",
    "op21_midrank_percentile": _POOL + """, k AS (SELECT *, rank() OVER (PARTITION BY run_id ORDER BY ref) AS lo, count(*) OVER (PARTITION BY run_id, ref) AS n,
      count(*) OVER (PARTITION BY run_id) AS total FROM pool WHERE ref IS NOT NULL)
      SELECT p.run_id, p.donor, p.target, round(lo + (n - 1) / 2.0::DOUBLE, 6) AS rank, round((lo - 1 + n / 2.0::DOUBLE) / total, 9) AS percentile
      FROM pool p LEFT JOIN k ON p.run_id IS NOT DISTINCT FROM k.run_id AND p.donor = k.donor AND p.target = k.target""",
    "op22_gini": _POOL + """, k AS (SELECT run_id, delta_pr AS x, row_number() OVER (PARTITION BY run_id ORDER BY delta_pr) AS i, count(*) OVER (PARTITION BY run_id) AS n
      FROM pool WHERE delta_pr IS NOT NULL)
      SELECT run_id, round(CASE WHEN sum(x) > 0 THEN 2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n)::DOUBLE END, 6) AS gini FROM k GROUP BY run_id""",
    "op23_spearman": _POOL + """, b AS (SELECT run_id, ref, cosine FROM pool WHERE ref IS NOT NULL AND cosine IS NOT NULL),
      r AS (SELECT run_id, rank() OVER (PARTITION BY run_id ORDER BY ref) + (count(*) OVER (PARTITION BY run_id, ref) - 1) / 2.0::DOUBLE AS x,
        rank() OVER (PARTITION BY run_id ORDER BY cosine) + (count(*) OVER (PARTITION BY run_id, cosine) - 1) / 2.0::DOUBLE AS y FROM b)
      SELECT run_id, count(*) AS n, round(CASE WHEN count(*) >= 2 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END, 6) AS spearman FROM r GROUP BY run_id""",
    "op24_cohens_kappa": _RATED + """, n AS (SELECT run_id, count(*) AS items, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) AS po FROM rated GROUP BY run_id),
      m AS (SELECT run_id, l, count(*) FILTER (a = l) AS na, count(*) FILTER (b = l) AS nb FROM rated, (SELECT unnest([0, 1, 2, 3]) AS l) GROUP BY run_id, l),
      e AS (SELECT run_id, sum(na * nb)::DOUBLE AS pe FROM m GROUP BY run_id)
      SELECT run_id, items, round(po, 6) AS observed, round(CASE WHEN pe < items * items THEN (po - pe / (items * items)) / (1 - pe / (items * items)) END, 6) AS kappa FROM n JOIN e USING (run_id)""",
    "op25_weighted_kappa": _RATED + """, n AS (SELECT run_id, count(*) AS items, sum(abs(a - b))::DOUBLE AS o FROM rated GROUP BY run_id),
      e AS (SELECT x.run_id, sum(abs(x.a - y.b))::DOUBLE AS e FROM rated x JOIN rated y ON x.run_id = y.run_id GROUP BY x.run_id)
      SELECT run_id, items, round(CASE WHEN e > 0 THEN 1 - o / (e / items) END, 6) AS weighted_kappa FROM n JOIN e USING (run_id)""",
    "op26_precision_at_k": _POOL + """, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, target ORDER BY s_score DESC NULLS LAST, donor) AS rank FROM pool)
      SELECT run_id, k, count(*) FILTER (rank <= k) AS rated, count(*) FILTER (rank <= k AND ref >= 0.5) AS relevant,
        round(count(*) FILTER (rank <= k AND ref >= 0.5) / nullif(count(*) FILTER (rank <= k), 0)::DOUBLE, 6) AS precision
      FROM r, (SELECT unnest([1, 5, 10, 20]) AS k) WHERE ref IS NOT NULL GROUP BY run_id, k""",
    "op27_recovery": _POOL + """, b AS (SELECT run_id, target, donor AS best FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id, target ORDER BY coalesce(ref, -1) DESC, donor) AS i FROM pool) WHERE i = 1),
      l AS (SELECT run_id, target, donor, unnest([{'m': 's_score', 's': s_score}, {'m': 'delta_pr', 's': delta_pr}, {'m': 'cosine', 's': cosine}]) AS v FROM pool),
      s AS (SELECT run_id, target, donor, v.m AS method, coalesce(v.s, '-inf'::DOUBLE) AS x FROM l),
      h AS (SELECT s.* FROM s JOIN b ON s.run_id = b.run_id AND s.target = b.target AND s.donor = b.best),
      q AS (SELECT h.run_id, h.method, h.target, count(*) FILTER (s.x > h.x) AS above, count(*) FILTER (s.x = h.x) AS tied, count(*) AS n
        FROM h JOIN s ON s.run_id = h.run_id AND s.target = h.target AND s.method = h.method GROUP BY ALL)
      SELECT run_id, method, count(*) AS queries, round(avg(least(1, greatest(0, (10 - above) / tied::DOUBLE))), 6) AS recall_10,
        round(avg(list_sum(list_transform(range(above + 1, above + tied + 1), lambda r: 1.0::DOUBLE / r)) / tied), 6) AS mrr,
        round(avg(CASE WHEN n > 1 THEN (n - above - tied + 0.5::DOUBLE * (tied - 1)) / (n - 1) END), 6) AS auc
      FROM q GROUP BY run_id, method""",
    "op28_signed_ranks": _POOL + """, d AS (SELECT run_id, round(ref - cosine, 6) AS d FROM pool),
      r AS (SELECT run_id, d, rank() OVER (PARTITION BY run_id ORDER BY abs(d)) + (count(*) OVER (PARTITION BY run_id, abs(d)) - 1) / 2.0::DOUBLE AS r FROM d WHERE d != 0),
      s AS (SELECT run_id, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM r GROUP BY run_id)
      SELECT run_id, n, round(w_plus, 3) AS w_plus, round(w_minus, 3) AS w_minus, round((w_plus - w_minus) / (w_plus + w_minus), 6) AS rank_biserial FROM s""",
    "op29_holm": _POOL + """, s AS (SELECT run_id, count(*) AS n, count(*) FILTER (ref > cosine) AS k FROM pool WHERE ref != cosine GROUP BY run_id),
      p AS (SELECT run_id, round(exp(-power(abs(2 * k - n) / sqrt(n), 2) / 2), 9) AS p FROM s),
      h AS (SELECT *, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p) + 1)) AS x FROM p)
      SELECT run_id, p, round(max(x) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS holm FROM h""",
    "op31_kruskal_wallis": _POOL + """, u AS (SELECT run_id, kind, ref FROM pool WHERE kind IS NOT NULL AND ref IS NOT NULL),
      r AS (SELECT *, rank() OVER (PARTITION BY run_id ORDER BY ref) + (count(*) OVER (PARTITION BY run_id, ref) - 1) / 2.0::DOUBLE AS r FROM u),
      q AS (SELECT run_id, sum(c) AS n, count(*) AS levels, sum(s * s / c) AS q FROM (SELECT run_id, kind, count(*)::DOUBLE AS c, sum(r) AS s FROM r GROUP BY run_id, kind) GROUP BY run_id),
      t AS (SELECT run_id, sum(c * c * c - c) AS t FROM (SELECT run_id, ref, count(*)::DOUBLE AS c FROM u GROUP BY run_id, ref) GROUP BY run_id),
      h AS (SELECT run_id, n, levels, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / CASE WHEN n * n * n - n > t THEN 1 - t / (n * n * n - n) END AS h FROM q JOIN t USING (run_id))
      SELECT run_id, CAST(n AS BIGINT) AS n, levels, round(h, 4) AS h, round(h / CASE WHEN n > 1 THEN n - 1 END, 6) AS epsilon_squared FROM h""",
    "op34_set_jaccard": _POOL + """, f AS (SELECT run_id, target, coalesce(ref >= 0.5, false) AS a, coalesce(cosine >= 0.5, false) AS b FROM pool)
      SELECT run_id, target, count(*) FILTER (a) AS size_a, count(*) FILTER (b) AS size_b, count(*) FILTER (a AND b) AS common,
        round(CASE WHEN count(*) FILTER (a OR b) > 0 THEN count(*) FILTER (a AND b) / count(*) FILTER (a OR b)::DOUBLE ELSE 1 END, 9) AS jaccard FROM f GROUP BY run_id, target""",
    "op35_sigma_scores": _SIGMA + "SELECT run_id, donor, target, variant, sigma, score FROM scores",
    "op36_fix_ranking": _SIGMA + """, g AS (SELECT * FROM scores WHERE variant = 'ref_gate_cosine'),
      r AS (SELECT 'run' AS scope, run_id, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, delta_pr DESC, donor, target) AS rank, donor, target, score FROM g
        UNION ALL SELECT 'target', run_id, row_number() OVER (PARTITION BY run_id, target ORDER BY score DESC, delta_pr DESC, donor), donor, target, score FROM g)
      SELECT scope, run_id, rank::INTEGER AS rank, donor, target, score FROM r WHERE rank <= CASE scope WHEN 'run' THEN 10 ELSE 3 END""",
    "op37_baseline_ranks": _POOL + """, r AS (
        SELECT 'score' AS method, run_id, row_number() OVER (PARTITION BY run_id ORDER BY s_score DESC NULLS LAST, delta_pr DESC NULLS LAST, donor, target) AS rank, donor, target FROM pool
        UNION ALL SELECT 'cosine', run_id, row_number() OVER (PARTITION BY run_id ORDER BY cosine DESC NULLS LAST, donor, target), donor, target FROM pool
        UNION ALL SELECT 'containment', run_id, row_number() OVER (PARTITION BY run_id ORDER BY ref DESC NULLS LAST, donor, target), donor, target FROM pool
        UNION ALL SELECT 'gain', run_id, row_number() OVER (PARTITION BY run_id ORDER BY delta_pr DESC NULLS LAST, donor, target), donor, target FROM pool)
      SELECT method, run_id, rank::INTEGER AS rank, donor, target FROM r WHERE rank <= 10""",
    "op38_sweep": _POOL + """, p AS (SELECT *, coalesce(cosine, 0) AS c FROM pool WHERE ref IS NOT NULL AND delta_pr IS NOT NULL AND kappa > 0)
      SELECT run_id, variant, epsilon, count(*) AS fixes, round(avg(delta_pr * (CASE variant WHEN 'gate' THEN c ELSE 0.5 * ref + 0.5 * c END) / kappa), 9) AS mean_score
      FROM p, (SELECT unnest(['gate', 'blend']) AS variant), (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE]) AS epsilon) WHERE ref > epsilon GROUP BY ALL""",
    "op39_rescue_shortlist": _POOL + """, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, target ORDER BY delta_pr DESC, ref DESC NULLS LAST, donor) AS rank FROM pool WHERE kind = 'orphan' AND delta_pr IS NOT NULL)
      SELECT run_id, target, rank::INTEGER AS rank, donor, round(delta_pr, 9) AS delta_pr FROM r WHERE rank <= 5""",
    "op40_pair_features": _POOL + """, t AS (SELECT run_id, target, count(*) AS target_pairs, max(ref) AS target_ref, max(cosine) AS target_cosine FROM pool GROUP BY 1, 2),
      d AS (SELECT run_id, donor, count(*) AS donor_pairs, max(delta_pr) AS donor_gain FROM pool GROUP BY 1, 2)
      SELECT run_id, donor, target, target_pairs, donor_pairs, kappa, (donor_depth IS NULL)::INTEGER AS depth_missing, round(ref / nullif(target_ref, 0), 6) AS ref_of_best,
        round(cosine - target_cosine, 6) AS cosine_gap, round(delta_pr / nullif(donor_gain, 0), 6) AS gain_of_best, round(1 / (1 + donor_depth)::DOUBLE, 6) AS depth_decay
      FROM pool JOIN t USING (run_id, target) JOIN d USING (run_id, donor)""",
}
