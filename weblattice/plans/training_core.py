"""Queries of the general problems: wide tables and unparsable records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblattice.operators.pivot import attributes_of, filled_cells, wide_table
from weblattice.plans.oracle_records import RECORDS
from weblattice.session import load
from weblattice.sources.records import parse_records, recovered_records


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = load(spark, sf_dir, "metric_types")
    parts = []
    for export in ("e5", "metrics"):
        attributes = attributes_of(types, export)
        wide = wide_table(load(spark, sf_dir, export), attributes)
        parts.append(filled_cells(wide, attributes).select(F.lit(export).alias("export_name"), "run_id", "policy", "metric", "value_e6"))
    return parts[0].unionByName(parts[1])


def p2_wide_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_table(load(spark, sf_dir, "metrics"), attributes_of(load(spark, sf_dir, "metric_types"), "metrics"))


def p2_wide_e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_table(load(spark, sf_dir, "e5"), attributes_of(load(spark, sf_dir, "metric_types"), "e5"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_records(load(spark, sf_dir, "raw_records"))
    return parsed.where("reason in ('quoting', 'columns', 'value')").select("record_id", "reason")


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(load(spark, sf_dir, "raw_records")).where("reason is null").drop("reason", "detail", "error_offset", "error_line", "raw")


def p4_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file, what the recovering grammar reads in its reassembled text."""
    found = recovered_records(load(spark, sf_dir, "raw_records"))
    return found.groupBy("run_id", "export", "source_document").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("reason") == "quoting").alias("quoting"), F.count_if(F.col("reason") == "columns").alias("columns"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found, "p2_wide_metrics": p2_wide_metrics, "p2_wide_e5": p2_wide_e5, "p4_found": p4_found, "p4_loaded": p4_loaded, "p4_recovered": p4_recovered,
}

_P2 = r"""
WITH src AS (
  SELECT 'e5' AS export_name, run_id, policy, metric, value, exported_at, row_id FROM e5
  UNION ALL SELECT 'metrics', run_id, policy, metric, value, exported_at, row_id FROM metrics),
typed AS (
  SELECT s.*, t.metric AS name, t.value_type,
    regexp_replace(s.value, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS v
  FROM src s JOIN metric_types t ON t.export_name = s.export_name
   AND lower(regexp_replace(s.metric, '[^\pL\pN]', '', 'g')) = lower(regexp_replace(t.metric, '[^\pL\pN]', '', 'g'))),
shaped AS (
  SELECT *, CASE
    WHEN value_type = 'count' AND regexp_matches(v, '^[+-]?\d{1,3}(,\d{3})+(\.0*)?$') THEN replace(v, ',', '')
    WHEN value_type = 'count' THEN v
    WHEN regexp_matches(v, '^[^.,]*,[^.,]*$') THEN replace(v, ',', '.') ELSE v END AS n
  FROM typed),
cast_ AS (
  SELECT *, CASE value_type
    WHEN 'flag' THEN CASE WHEN lower(v) IN ('1','1.0','t','true','yes') THEN 1.0 WHEN lower(v) IN ('0','0.0','f','false','no') THEN 0.0 END
    WHEN 'ratio' THEN CASE WHEN regexp_matches(n, '%$') THEN
        CASE WHEN regexp_matches(regexp_replace(n, '[\s\pZ]*%$', ''), '^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?$') THEN
          CASE WHEN TRY_CAST(regexp_replace(n, '[\s\pZ]*%$', '') AS DOUBLE) BETWEEN 0 AND 100
          THEN TRY_CAST(regexp_replace(n, '[\s\pZ]*%$', '') AS DOUBLE) / 100 END END
      WHEN regexp_matches(n, '^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?$') AND TRY_CAST(n AS DOUBLE) BETWEEN 0 AND 1 THEN TRY_CAST(n AS DOUBLE) END
    ELSE CASE WHEN regexp_matches(n, '^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?$')
      AND (value_type = 'real' OR (TRY_CAST(n AS DOUBLE) >= 0 AND TRY_CAST(n AS DOUBLE) = floor(TRY_CAST(n AS DOUBLE)))) THEN TRY_CAST(n AS DOUBLE) END
    END AS x
  FROM shaped),
best AS (
  SELECT export_name, run_id, policy, name, x,
    row_number() OVER (PARTITION BY export_name, run_id, policy, name ORDER BY exported_at DESC NULLS LAST, row_id DESC) AS rn
  FROM cast_ WHERE x IS NOT NULL)
SELECT export_name, run_id, policy, name AS metric, CAST(round(x * 1000000) AS BIGINT) AS value_e6 FROM best WHERE rn = 1
"""

ORACLES: dict[str, str] = {
    "p2_found": _P2,
    "p4_found": "WITH " + RECORDS + "SELECT record_id, reason FROM judged WHERE reason IN ('quoting', 'columns', 'value')",
    "p4_loaded": "WITH " + RECORDS + "SELECT * FROM loaded",
}
