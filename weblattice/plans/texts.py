"""Queries of texts: terms, weights, directional containment, similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weblattice.functions.text import lower_nfc, words
from weblattice.operators import containment, text as tx
from weblattice.plans.site import GRAPH, crawled, seen_links, site
from weblattice.session import checkpointed, load

RUN = ["run_id"]


def field_terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(terms, names): (run_id, doc, field, term, tf) of representative pages, by page id, and (run_id, doc, node).

    The fields are title with h1, anchors of links in the content, and body.
    """
    s = site(spark, sf_dir)
    names = checkpointed(s.first.select("run_id", F.col("id").alias("doc"), "node"))
    pages = load(spark, sf_dir, "pages").select(F.col("id").alias("doc"), "title", "h1", "body_text").join(names.select("run_id", "doc"), "doc")
    anchors = s.observed.where("dom_region in ('main', 'body') and anchor_text is not null").select("run_id", "doc", F.lit("links").alias("field"), F.col("anchor_text").alias("t"))
    fields = pages.select("run_id", "doc", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("t")) for f, c in (("title", "title"), ("title", "h1"), ("body", "body_text"))])).alias("x"))
    rows = fields.select("run_id", "doc", "x.field", "x.t").where("t is not null").unionByName(anchors)
    cut = rows.select("run_id", "doc", "field", F.explode(words(lower_nfc(F.col("t")))).alias("term")).where(F.length("term") >= 2)
    return checkpointed(cut.groupBy("run_id", "doc", "field", "term").agg(F.count(F.lit(1)).alias("tf"))), names


def text_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(weights, donors, targets, names): (run_id, doc, field, term, tf, weight) without boilerplate, (run_id, src, term), (run_id, dst, term, w)."""
    terms, names = field_terms(spark, sf_dir)
    df = frequencies(terms)
    sizes = tx.collection_size(terms, "run_id", "doc")
    kept = df.join(tx.boilerplate_terms(df, sizes, "run_id").select("run_id", "term"), ["run_id", "term"], "left_anti")
    weights = checkpointed(tx.tfidf(terms, kept, sizes, "run_id"))
    donors = weights.where("field in ('links', 'body')").select("run_id", F.col("doc").alias("src"), "term").distinct()
    targets = weights.where("field in ('title', 'body')").groupBy("run_id", F.col("doc").alias("dst"), "term").agg(F.sum("weight").alias("w"))
    return weights, checkpointed(donors), checkpointed(targets), names


def frequencies(terms: DataFrame) -> DataFrame:
    """(run_id, term, df, cf): a page counts once, in whichever field the term stands."""
    return terms.groupBy("run_id", "term", "doc").agg(F.sum("tf").alias("tf")).groupBy("run_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def run_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(names, texts): (run_id, doc, node), and (run_id, doc, field, words) as :func:`field_terms` cuts them; where links lead isn't asked."""
    first = checkpointed(crawled(spark, sf_dir)[1].select("run_id", "fetch_id", F.col("id").alias("doc"), "node"))
    cut = lambda c: F.coalesce(words(lower_nfc(F.col(c))), F.array().cast("array<string>"))
    pages = load(spark, sf_dir, "pages").where("url is not null and run_id is not null")
    fields = pages.select("run_id", F.col("id").alias("doc"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), w.alias("words")) for f, w in (("title", F.concat(cut("title"), cut("h1"))), ("body", cut("body_text")))])).alias("x"))
    seen = seen_links(spark, sf_dir).where("dom_region in ('main', 'body') and anchor_text is not null").select("run_id", F.col("source_fetch_id").alias("fetch_id"), "anchor_text")
    anchors = seen.join(first, ["run_id", "fetch_id"]).select("run_id", "doc", F.lit("links").alias("field"), cut("anchor_text").alias("words"))
    return first.select("run_id", "doc", "node"), fields.select("run_id", "doc", "x.*").unionByName(anchors)


def related_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the related pairs of all runs are made from."""
    return containment.run_rows(*run_texts(spark, sf_dir))


def op61_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies(field_terms(spark, sf_dir)[0])


def op62_boilerplate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, _ = field_terms(spark, sf_dir)
    return tx.boilerplate_terms(frequencies(terms), tx.collection_size(terms, "run_id", "doc"), "run_id")


def op63_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, _, _, names = text_model(spark, sf_dir)
    return weights.join(names, ["run_id", "doc"]).select("run_id", "node", "field", "term", "tf", F.round("weight", 8).alias("weight"))


def op64_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.over_pairs(related_rows(spark, sf_dir), containment.related, "src string, dst string, ref double, rho double, matched_count bigint")


def op65_ref_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.over_pairs(related_rows(spark, sf_dir), containment.heaviest, "src string, dst string, rank int, term string, contribution double")


def op66_term_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each related pair: common terms over all of the donor's and the target's."""
    return containment.over_pairs(related_rows(spark, sf_dir), containment.jaccard, "src string, dst string, jaccard double")


def op67_item_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a test item's different words that a document holds, above 0.6: unweighted containment, documents as donors."""
    def sets(table: str, key: str, name: str) -> DataFrame:
        rows = load(spark, sf_dir, table).where("text is not null").select(F.lit(1).alias("g"), F.col(key).alias(name), F.explode(F.array_distinct(words(lower_nfc(F.col("text"))))).alias("term"))
        return rows.where(F.length("term") >= 2).distinct()

    donors = checkpointed(sets("documents", "doc_id", "src"))
    targets = sets("benchmark", "item_id", "dst").withColumn("w", F.lit(1.0))
    # Items and documents are numbered apart: no pair of the two is a text with itself.
    out = tx.ref(donors.withColumn("src", -1 - F.col("src")), targets, ["g"], 0.6)
    return out.select((-1 - F.col("src")).alias("doc_id"), F.col("dst").alias("item_id"), F.round("ref", 9).alias("containment"), "matched_count")


def op68_cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries, rows whose id is divisible by 50, against all rows."""
    rows = load(spark, sf_dir, "embeddings")
    return tx.cosine_neighbours(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding").select("query", "neighbour", "rank", "cosine")


def op69_lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of pages with similar term sets."""
    return tx.lsh_candidates(_classes(spark, sf_dir), "run_id")


def op70_lsh_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's class of equal signatures, for the pairs of op69."""
    return _classes(spark, sf_dir).select("run_id", "doc", "class")


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = field_terms(spark, sf_dir)[0].groupBy("run_id", "doc").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return tx.signature_classes(sets, "run_id", "doc", "terms")


def op71_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, bigram, df): pairs of neighbouring words of titles on at least two pages."""
    rows = load(spark, sf_dir, "pages").where("title is not null").select("id", "run_id", words(lower_nfc(F.col("title"))).alias("w"))
    grams = rows.select("id", "run_id", F.explode(F.array_distinct(tx.ngrams(F.col("w"), 2))).alias("bigram"))
    return grams.groupBy("run_id", "bigram").agg(F.count(F.lit(1)).alias("df")).where("df >= 2")


def op72_surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run and stem the spelling met most often; shorter, then smaller ones win ties."""
    rows = load(spark, sf_dir, "pages").where("title is not null").select("run_id", F.explode(words(lower_nfc(F.col("title")))).alias("word"))
    return tx.surface_forms(rows.groupBy("run_id", "word").agg(F.count(F.lit(1)).alias("n")), "run_id")


def op73_equi_depth_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per run in eight parts of equal depth by their number of terms: size bounds per part."""
    terms, names = field_terms(spark, sf_dir)
    sizes = terms.select("run_id", "doc", "term").distinct().groupBy("run_id", "doc").agg(F.count(F.lit(1)).alias("size")).join(names, ["run_id", "doc"])
    at = F.row_number().over(Window.partitionBy("run_id").orderBy("size", "node")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("run_id"))
    # Part p holds the places from floor(p·n/k) on; its number is the largest p whose start is not past the place.
    return sizes.withColumn("part", F.floor(((at + 1) * 8 - 1) / n).cast("int")).groupBy("run_id", "part").agg(F.count(F.lit(1)).alias("pages"), F.min("size").alias("least"), F.max("size").alias("most"))


_FUNCTIONS = [
    op61_document_frequency, op62_boilerplate_terms, op63_tfidf, op64_ref, op65_ref_top_terms, op66_term_jaccard, op67_item_containment, op68_cosine_neighbours,
    op69_lsh_candidates, op70_lsh_classes, op71_bigrams, op72_surface_forms, op73_equi_depth_parts,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _FUNCTIONS}

_W = r"regexp_extract_all(lower(nfc_normalize({})), '\pL+')"
TERMS = GRAPH + f""", texts AS (
  SELECT f.run_id, f.node, unnest([{{'field': 'title', 't': p.title}}, {{'field': 'title', 't': p.h1}}, {{'field': 'body', 't': p.body_text}}]) AS x FROM first f JOIN pages p ON p.id = f.id),
raw_terms AS (SELECT run_id, node, x.field AS field, unnest({_W.format('x.t')}) AS term FROM texts WHERE x.t IS NOT NULL
  UNION ALL SELECT run_id, src, 'links', unnest({_W.format('anchor_text')}) FROM observed WHERE dom_region IN ('main', 'body') AND anchor_text IS NOT NULL),
terms AS (SELECT run_id, node, field, term, count(*) AS tf FROM raw_terms WHERE length(term) >= 2 GROUP BY ALL),
dfs AS (SELECT run_id, term, count(DISTINCT node) AS df, sum(tf)::BIGINT AS cf FROM terms GROUP BY ALL),
docs AS (SELECT run_id, count(DISTINCT node) AS n FROM terms GROUP BY ALL),
boiler AS (SELECT run_id, term, df, cf, rank FROM (
  SELECT d.*, row_number() OVER (PARTITION BY d.run_id ORDER BY df DESC, cf DESC, term) AS rank, v.v FROM dfs d JOIN docs USING (run_id)
  JOIN (SELECT run_id, count(*) AS v FROM dfs GROUP BY ALL) v USING (run_id) WHERE df >= greatest(2, ceil(0.5 * n))) WHERE rank <= floor(v * 0.07)),
weights AS (SELECT t.run_id, t.node, t.field, t.term, tf, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS weight FROM terms t JOIN dfs USING (run_id, term) JOIN docs USING (run_id)
  WHERE (t.run_id, t.term) NOT IN (SELECT run_id, term FROM boiler)),
donors AS (SELECT DISTINCT run_id, node AS src, term FROM weights WHERE field IN ('links', 'body')),
targets AS (SELECT run_id, node AS dst, term, sum(weight) AS w FROM weights WHERE field IN ('title', 'body') GROUP BY ALL),
totals AS (SELECT run_id, dst, sum(w) AS total, count(*) AS nb FROM targets GROUP BY ALL),
refs AS (SELECT d.run_id, d.src, t.dst, sum(w) / any_value(total) AS ref, count(*) AS matched_count FROM donors d JOIN targets t USING (run_id, term) JOIN totals USING (run_id, dst) WHERE d.src != t.dst
  GROUP BY d.run_id, d.src, t.dst HAVING sum(w) / any_value(total) > 0.2),
rhos AS (SELECT *, ref / sum(ref) OVER (PARTITION BY run_id, src) AS rho FROM refs)
"""
_COSINE = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS c FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id != b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, neighbour) AS rank FROM p)
SELECT query, neighbour, rank::INTEGER AS rank, c AS cosine FROM r WHERE rank <= 10"""
ORACLES: dict[str, str] = {
    "op61_document_frequency": TERMS + "SELECT * FROM dfs",
    "op62_boilerplate_terms": TERMS + "SELECT run_id, term, df, cf, rank::INTEGER AS rank FROM boiler",
    "op63_tfidf": TERMS + "SELECT run_id, node, field, term, tf, round(weight, 8) AS weight FROM weights",
    "op64_ref": TERMS + "SELECT run_id, src, dst, round(ref, 7) AS ref, round(rho, 7) AS rho, matched_count FROM rhos",
    "op65_ref_top_terms": TERMS + """, m AS (SELECT r.run_id, r.src, r.dst, t.term, w, total, row_number() OVER (PARTITION BY r.run_id, r.src, r.dst ORDER BY round(w, 9) DESC, t.term) AS rank
      FROM refs r JOIN targets t USING (run_id, dst) JOIN donors d ON d.run_id = r.run_id AND d.src = r.src AND d.term = t.term JOIN totals o ON o.run_id = r.run_id AND o.dst = r.dst)
      SELECT run_id, src, dst, rank::INTEGER AS rank, term, round(w / total, 7) AS contribution FROM m WHERE rank <= 3""",
    "op66_term_jaccard": TERMS + """, a AS (SELECT run_id, src, count(*) AS na FROM donors GROUP BY ALL)
      SELECT r.run_id, r.src, r.dst, round(matched_count / (na + nb - matched_count)::DOUBLE, 9) AS jaccard FROM refs r JOIN a USING (run_id, src) JOIN totals t ON t.run_id = r.run_id AND t.dst = r.dst""",
    "op67_item_containment": f"""WITH d AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({_W.format('text')}) AS term FROM documents WHERE text IS NOT NULL) WHERE length(term) >= 2),
      b AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_W.format('text')}) AS term FROM benchmark WHERE text IS NOT NULL) WHERE length(term) >= 2), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY ALL)
      SELECT doc_id, item_id, round(count(*) / any_value(n)::DOUBLE, 9) AS containment, count(*) AS matched_count FROM d JOIN b USING (term) JOIN n USING (item_id) GROUP BY ALL HAVING count(*) / any_value(n)::DOUBLE > 0.6""",
    "op68_cosine_neighbours": _COSINE,
    "op71_bigrams": f"""WITH w AS (SELECT id, run_id, {_W.format('title')} AS w FROM pages WHERE title IS NOT NULL),
      g AS (SELECT DISTINCT id, run_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM w)
      SELECT run_id, bigram, count(*) AS df FROM g GROUP BY ALL HAVING count(*) >= 2""",
    "op73_equi_depth_parts": TERMS + """, s AS (SELECT run_id, node, count(DISTINCT term) AS size FROM terms GROUP BY ALL),
      o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY size, node) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM s),
      p AS (SELECT o.*, q.p FROM o JOIN (SELECT unnest(range(0, 8)) AS p) q ON i >= q.p * n // 8 AND i < (q.p + 1) * n // 8)
      SELECT run_id, p::INTEGER AS part, count(*) AS pages, min(size) AS least, max(size) AS most FROM p GROUP BY ALL""",
}
