"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblattice.llm.distinctive import distinctive_terms
from weblattice.llm.furniture import furniture_lines, main_text
from weblattice.llm.language import language_cases, page_languages
from weblattice.llm.leakage import leaked_items
from weblattice.llm.packing import pack_documents
from weblattice.llm.repeats import repeated_blocks, repeated_lines, without_repeats
from weblattice.llm.residue import residue, without_residue
from weblattice.llm.topn import top_n
from weblattice.session import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(load(spark, sf_dir, "pool_rows"), 10).select("target", "donor")


def p1_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(load(spark, sf_dir, "pool_rows"), 10)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = distinctive_terms(load(spark, sf_dir, "pages"), min_tf=4, min_df=2, max_df=12)
    return terms.select(F.col("id").alias("page_id"), "term")


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = distinctive_terms(load(spark, sf_dir, "pages"), min_tf=2)
    return terms.select(F.col("id").alias("page_id"), "term", "tf", "df", "cf", F.round("score", 9).alias("score"))


def p3_all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of each page, also those that stand once or on one page only."""
    terms = distinctive_terms(load(spark, sf_dir, "pages"), min_df=1)
    return terms.select(F.col("id").alias("page_id"), "term", "tf", "df", "cf", F.round("score", 9).alias("score"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture_lines(load(spark, sf_dir, "pages"), load(spark, sf_dir, "link_observations"))


def p5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(load(spark, sf_dir, "pages"), load(spark, sf_dir, "link_observations"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_cases(load(spark, sf_dir, "pages"), load(spark, sf_dir, "link_observations"))


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_languages(load(spark, sf_dir, "pages"), load(spark, sf_dir, "link_observations"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(load(spark, sf_dir, "pages"))


def p7_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_blocks(load(spark, sf_dir, "pages"))


def p7_block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many closed blocks there are per run, length and number of documents."""
    blocks = repeated_blocks(load(spark, sf_dir, "pages"))
    return blocks.groupBy("run_id", F.size("block").alias("lines"), "docs").agg(F.count(F.lit(1)).alias("blocks"))


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(load(spark, sf_dir, "pages"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(load(spark, sf_dir, "documents")).select("doc_id")


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_residue(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_ranked": p1_ranked, "p3_found": p3_found, "p3_scores": p3_scores, "p3_all_scores": p3_all_scores,
    "p5_found": p5_found, "p5_main_text": p5_main_text, "p6_found": p6_found, "p6_languages": p6_languages,
    "p7_found": p7_found, "p7_blocks": p7_blocks, "p7_block_sizes": p7_block_sizes, "p7_cleaned": p7_cleaned, "p8_packed": p8_packed, "p9_found": p9_found,
    "p10_found": p10_found, "p10_kept": p10_kept,
}

_TOP = """
WITH best AS (
  SELECT target, donor, max(s_score) AS s_score FROM pool_rows
  WHERE donor IS NOT NULL AND s_score IS NOT NULL AND NOT isnan(s_score) GROUP BY target, donor),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY s_score DESC, donor) AS rank FROM best)
SELECT {columns} FROM ranked WHERE rank <= 10
"""

_TERMS = r"""
WITH w AS (
  SELECT id, unnest(regexp_extract_all(lower(nfc_normalize(body_text)), '\pL+')) AS term FROM pages WHERE body_text IS NOT NULL),
c AS (SELECT id, term, count(*) AS tf FROM w GROUP BY id, term),
s AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM c GROUP BY term),
l AS (SELECT id, sum(tf) AS len FROM c GROUP BY id),
t AS (SELECT sum(cf) AS total FROM s)
"""

_LINES = r"""
WITH l AS (
  SELECT id, run_id, 'body_text' AS field, generate_subscripts(string_split(body_text, chr(10)), 1) AS pos, unnest(string_split(body_text, chr(10))) AS line
  FROM pages WHERE body_text IS NOT NULL
  UNION ALL
  SELECT id, run_id, 'paragraphs', generate_subscripts(paragraphs, 1), unnest(paragraphs) FROM pages WHERE len(paragraphs) > 0),
k AS (SELECT id, run_id, field, pos, regexp_replace(lower(upper(nfc_normalize(line))), '[^\pL]', '', 'g') AS key FROM l WHERE line IS NOT NULL),
often AS (SELECT run_id, key FROM k WHERE key != '' GROUP BY run_id, key HAVING count(DISTINCT id) >= 8)
SELECT id AS page_id, field, pos::INTEGER AS pos FROM k SEMI JOIN often USING (run_id, key)
"""

_BLOCKS = _LINES.split("often AS")[0] + """s AS (SELECT *, row_number() OVER (PARTITION BY id, field ORDER BY pos) AS seq FROM k WHERE key != ''),
often AS (SELECT run_id, key FROM s GROUP BY run_id, key HAVING count(DISTINCT id) >= 8),
g AS (SELECT *, seq - row_number() OVER (PARTITION BY id, field ORDER BY seq) AS run FROM s SEMI JOIN often USING (run_id, key)),
r AS (SELECT id, run_id, field, run, list(key ORDER BY seq) AS ks FROM g GROUP BY id, run_id, field, run),
w AS (SELECT DISTINCT id, run_id, ks[i : j] AS b FROM r, unnest(range(1, len(ks) + 1)) a(i), unnest(range(i, len(ks) + 1)) c(j)),
f AS (SELECT run_id, b, count(*) AS docs FROM w GROUP BY run_id, b HAVING count(*) >= 8),
longer AS (SELECT run_id, docs, b[2:] AS part FROM f WHERE len(b) > 1 UNION SELECT run_id, docs, b[1 : len(b) - 1] FROM f WHERE len(b) > 1)
SELECT f.run_id, len(b)::INTEGER AS lines, f.docs, count(*) AS blocks FROM f ANTI JOIN longer ON longer.run_id = f.run_id AND longer.docs = f.docs AND longer.part = f.b GROUP BY ALL
"""

_LEAKS = r"""
WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(nfc_normalize(text)), '[\pL\pN]+'), ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\pL\pN]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS s FROM b WHERE len(w) >= 12),
g AS (SELECT item_id, ' ' || array_to_string(w[s:s+11], ' ') || ' ' AS passage FROM p)
SELECT DISTINCT doc_id, item_id FROM d JOIN g ON contains(d.t, g.passage)
"""

ORACLES: dict[str, str] = {
    "p7_found": _LINES,
    "p7_block_sizes": _BLOCKS,
    "p9_found": _LEAKS,
    "p1_found": _TOP.format(columns="target, donor"),
    "p1_ranked": _TOP.format(columns="target, donor, s_score, rank::INTEGER AS rank"),
    "p3_found": _TERMS + "SELECT c.id AS page_id, c.term FROM c JOIN s USING (term) WHERE tf >= 4 AND df BETWEEN 2 AND 12",
    "p3_scores": _TERMS
    + """SELECT c.id AS page_id, c.term, tf, df, cf,
  round((tf + 300.0::DOUBLE * (cf::DOUBLE / total)) / (len + 300.0::DOUBLE)
    * ln(((tf + 300.0::DOUBLE * (cf::DOUBLE / total)) / (len + 300.0::DOUBLE)) / (cf::DOUBLE / total)), 9) AS score
FROM c JOIN s USING (term) JOIN l USING (id) CROSS JOIN t WHERE tf >= 2 AND df >= 2""",
}
ORACLES["p3_all_scores"] = ORACLES["p3_scores"].split(" WHERE tf >= 2")[0]
