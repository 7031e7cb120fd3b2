"""Top N items within every group by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(
    rows: DataFrame, n: int = 10, group: str = "target", item: str = "donor", score: str = "s_score",
    subgroups: int | None = None,
) -> DataFrame:
    """The ``n`` items with the highest score of each group: group, item, score, rank.

    An item counts once per group, with its highest score. Rows with a null
    item, or a null or NaN score, do not count; rows with a null group form a
    group. Equal scores: the smaller item (byte order) comes first. An empty
    table gives an empty result; further columns are ignored.

    Stage 1 hashes a group's items into ``subgroups`` and shuffles once by
    (group, subgroup): repeats of an item meet there, are merged, ranked, and
    ``n`` are kept. Any member of the final list is among the first ``n`` of
    its subgroup, so nothing is lost. Stage 2 ranks the survivors, at most
    ``n * subgroups`` per group, however large the group was. Without
    ``subgroups`` there are as many as shuffle partitions, 32 at least, so a
    hot group fills the cluster at any size.
    """
    subgroups = subgroups or max(32, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    s = F.col(score).cast("double")
    slim = rows.where(F.col(item).isNotNull() & s.isNotNull() & ~F.isnan(s)).select(
        F.col(group).alias("_g"), F.col(item).alias("_i"), (s + F.lit(0.0)).alias("_s")
    )
    salted = slim.withColumn("_salt", F.pmod(F.xxhash64("_i"), F.lit(subgroups)).cast("int"))
    # One exchange serves the merge of repeats and the first ranking: both
    # cluster by a superset of (group, subgroup).
    best = salted.repartition("_g", "_salt").groupBy("_g", "_salt", "_i").agg(F.max("_s").alias("_s"))
    kept = _ranked(best, ["_g", "_salt"]).where(F.col("_r") <= n)
    last = _ranked(kept.drop("_r", "_salt"), ["_g"]).where(F.col("_r") <= n)
    return last.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score), F.col("_r").alias("rank"))


def _ranked(df: DataFrame, by: list[str]) -> DataFrame:
    order: list[Column] = [F.col("_s").desc(), F.col("_i").asc()]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
