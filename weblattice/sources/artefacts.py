"""Derived tables as artefacts: append-only, one folder per kind, the latest wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblattice.operators.skew import salted_join

KEYS = ["run_id", "policy"]


def append(df: DataFrame, root: str, kind: str, version: int) -> None:
    """Adds a version of a kind; ``df`` has run_id and policy, by which the table is parted."""
    df.withColumn("version", F.lit(version).cast("bigint")).write.mode("append").partitionBy(*KEYS).parquet(f"{root}/{kind}")


def latest(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The rows of the highest version per run and policy."""
    rows = spark.read.parquet(f"{root}/{kind}")
    top = rows.groupBy(*KEYS).agg(F.max("version").alias("_v"), F.count(F.lit(1)).alias("n"))
    return salted_join(rows, top.select(*KEYS, "_v"), KEYS, F.struct(*[c for c in rows.columns if c not in KEYS]), top, "inner").where("version = _v").drop("_v")


def latest_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, that with the greatest ``order``; whole rows combine before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def newest(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The ``n`` newest rows, as a history report shows them."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)
