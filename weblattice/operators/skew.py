"""Joins whose keys may be hot: one key may hold a third of all rows.

Keys that hold more than a ``share``-th of all rows are hot; there are at most
``share`` of them, so the list is broadcast at any size of data. Only their rows
spread over ``salts`` sub-keys, and only their partner rows are copied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE, LEAST, SALTS = 1000, 4096, 64


def hot_keys(counts: DataFrame, on: list[str], n: str = "n", share: int = SHARE, least: int = LEAST) -> DataFrame:
    """The keys of ``counts`` with at least ``least`` rows and a ``share``-th of all: at most ``share`` rows."""
    total = counts.agg(F.sum(n).alias("_total"))  # an ungrouped aggregate: one row
    return counts.join(F.broadcast(total)).where(F.col(n) >= F.greatest(F.lit(least), F.col("_total") / share)).select(*on)


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_k_{c}"]) for c in on])


def _renamed(keys: DataFrame, on: list[str]) -> DataFrame:
    return keys.withColumnsRenamed({c: f"_k_{c}" for c in on})


def salted_join(rows: DataFrame, keys: DataFrame, on: list[str], by: Column, counts: DataFrame, how: str = "left", n: str = "n", salts: int = SALTS) -> DataFrame:
    """``rows`` joined to ``keys`` on ``on`` (nulls agree), hot keys spread by a hash of ``by``.

    ``counts`` has the number of rows of each key in ``n``. Columns of ``keys``
    other than ``on`` must not clash with those of ``rows``.
    """
    hot = _renamed(hot_keys(counts, on, n), on).withColumn("_hot", F.lit(True))
    spread = rows.withColumn("_by", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    spread = spread.join(F.broadcast(hot), _same(spread, hot, on), "left")
    spread = spread.withColumn("_z", F.when(F.col("_hot"), F.col("_by")).otherwise(0)).drop("_hot", "_by", *[f"_k_{c}" for c in on])
    copied = keys.join(F.broadcast(hot), _same(keys, hot, on), "left").drop(*[f"_k_{c}" for c in on])
    copied = copied.withColumn("_zk", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    copied = _renamed(copied, on)
    joined = spread.join(copied, _same(spread, copied, on) & (F.col("_z") == F.col("_zk")), how)
    return joined.drop("_z", "_zk", *[f"_k_{c}" for c in on])
