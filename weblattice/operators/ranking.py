"""Ranks and running totals within groups of any size.

A window over a group sorts the group in one task. These operators sort by
range instead: equal values are counted first, the counts are parted by
(group, value) ranges, each partition adds up its own, and the sums of the
partitions before it are added from a table with one row per partition and
group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblattice.operators.skew import salted_join
from weblattice.session import checkpointed


def value_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n, below, total) per different value: rows with it, rows of the group below it, rows of the group.

    Null and NaN values do not count; null groups form groups.
    """
    v = F.col(value)
    usable = v.isNotNull() & (~F.isnan(v) if dict(df.dtypes)[value] in ("double", "float") else F.lit(True))
    counts = df.where(usable).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    parted = counts.repartitionByRange(*group, value).withColumn("_p", F.spark_partition_id())
    # Written once: a second evaluation may draw other range bounds.
    parted = checkpointed(parted)
    inner = Window.partitionBy("_p", *group).orderBy(value)
    local = parted.withColumn("_in", F.sum("n").over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    # One row per partition and group: at most partitions plus groups.
    sums = parted.groupBy("_p", *group).agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_p")
    offsets = sums.select(
        F.col("_p").alias("_p2"), *[F.col(g).alias(f"_g_{g}") for g in group],
        F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("total"),
    )
    same: list[Column] = [local["_p"] == offsets["_p2"], *[local[g].eqNullSafe(offsets[f"_g_{g}"]) for g in group]]
    joined = local.join(offsets, reduce(lambda a, b: a & b, same))
    return joined.select(*group, value, "n", (F.coalesce(F.col("_in"), F.lit(0)) + F.col("_off")).alias("below"), "total")


def with_ranks(df: DataFrame, group: list[str], value: str, prefix: str = "") -> DataFrame:
    """Adds ``{prefix}rank`` (average rank, from 1), ``{prefix}percentile`` (mid-rank) to each row; null where the value is null or NaN."""
    ranks = value_ranks(df, group, value)
    out = ranks.select(
        *group, value, (F.col("below") + (F.col("n") + 1) / 2).alias(f"{prefix}rank"), ((F.col("below") + F.col("n") / 2) / F.col("total")).alias(f"{prefix}percentile")
    )
    # A value that a third of all rows share is a hot key.
    return salted_join(df, out, [*group, value], F.struct(*df.columns), ranks.select(*group, value, "n"))
