"""Statistics of grouped observations: agreement, correlation, concentration, recovery, tests.

Everything up to the test statistics is distributed; p-values and bootstrap
draws work on one row, or one bounded sample, per group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weblattice.operators.ranking import value_ranks, with_ranks


def percentiles(df: DataFrame, group: list[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Group and one column ``p{share}`` each, interpolated linearly between closest ranks; nulls and NaN don't count."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*group).agg(*[F.percentile(v, F.lit(p / 100)).alias(f"p{p:g}".replace(".", "_")) for p in shares])


def gini(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, gini) of values not negative; null where they add up to nothing."""
    r = value_ranks(df, group, value)
    # A value's n rows have the ranks below + 1 to below + n.
    ranks = F.col("n") * F.col("below") + F.col("n") * (F.col("n") + 1) / 2
    sums = r.groupBy(*group).agg(F.sum(ranks * F.col(value)).alias("_w"), F.sum(F.col("n") * F.col(value)).alias("_s"), F.max("total").alias("_n"))
    n = F.col("_n")
    return sums.select(*group, F.when(F.col("_s") > 0, 2 * F.col("_w") / (n * F.col("_s")) - (n + 1) / n).alias("gini"))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: the correlation of rows that have both, null below two of them or without variation."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.count(a)
    cov = F.sum(a * b) - F.sum(a) * F.sum(b) / n
    va, vb = F.sum(a * a) - F.sum(a) * F.sum(a) / n, F.sum(b * b) - F.sum(b) * F.sum(b) / n
    return F.when((n >= 2) & (va > 1e-9) & (vb > 1e-9), cov / F.sqrt(va * vb))


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, n, spearman) over rows that have both values: Pearson on average ranks."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(*group, x, y)
    ranked = with_ranks(with_ranks(both, group, x, "_x_"), group, y, "_y_")
    return ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("_x_rank"), F.col("_y_rank")).alias("spearman"))


def confusion(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """(group, a, b, n) of rows with both labels."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*group, a, b).agg(F.count(F.lit(1)).alias("n"))


def cohens_kappa(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """(group, items, observed, kappa); kappa is null where chance alone agrees always."""
    cells = confusion(df, group, a, b)
    ends = cells.select(*group, "n", F.explode(F.array(F.struct(F.col(a).alias("label"), F.lit(0).alias("side")), F.struct(F.col(b).alias("label"), F.lit(1).alias("side")))).alias("e"))
    margins = ends.groupBy(*group, F.col("e.label").alias("label")).agg(F.sum(F.col("n") * (1 - F.col("e.side"))).alias("na"), F.sum(F.col("n") * F.col("e.side")).alias("nb"))
    chance = margins.groupBy(*group).agg(F.sum(F.col("na") * F.col("nb")).alias("_pe"))
    seen = cells.groupBy(*group).agg(F.sum("n").alias("items"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("_po"))
    pe, po = F.col("_pe") / (F.col("items") * F.col("items")), F.col("_po") / F.col("items")
    return seen.join(chance, group).select(*group, "items", po.alias("observed"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def weighted_kappa(df: DataFrame, group: list[str], a: str, b: str, levels: int) -> DataFrame:
    """(group, items, weighted_kappa) of labels 0 to ``levels`` - 1, weights growing with the distance."""
    cells = confusion(df, group, a, b)
    # The margins are ``levels`` counts per side in one row per group.
    margin = lambda c: [F.sum(F.when(F.col(c) == i, F.col("n")).otherwise(0)) for i in range(levels)]
    sums = cells.groupBy(*group).agg(F.sum("n").alias("items"), F.sum(F.abs(F.col(a) - F.col(b)) * F.col("n")).alias("_o"), F.array(*margin(a)).alias("_ra"), F.array(*margin(b)).alias("_rb"))
    expected = sum((abs(i - j) * F.col("_ra")[i] * F.col("_rb")[j] for i in range(levels) for j in range(levels) if i != j), F.lit(0)) / F.col("items")
    return sums.withColumn("_e", expected).select(*group, "items", F.when(F.col("_e") > 0, 1 - F.col("_o") / F.col("_e")).alias("weighted_kappa"))


def precision_at(df: DataFrame, group: list[str], rank: str, relevant: str, ks: Sequence[int]) -> DataFrame:
    """(group, k, rated, relevant, precision) over rated rows (``relevant`` not null) of rank up to k."""
    cut = df.where(F.col(relevant).isNotNull() & (F.col(rank) <= max(ks))).select(*group, F.col(rank).alias("_r"), F.col(relevant).cast("boolean").alias("_y"))
    per_k = cut.groupBy(*group).agg(F.array(*[
        F.struct(F.lit(k).alias("k"), F.count_if(F.col("_r") <= k).alias("rated"), F.count_if((F.col("_r") <= k) & F.col("_y")).alias("relevant")) for k in ks
    ]).alias("_k"))
    return per_k.select(*group, F.inline("_k")).withColumn("precision", F.try_divide("relevant", "rated"))


def recovery(df: DataFrame, query: list[str], score: str, relevant: str, ks: Sequence[int] = (10,)) -> DataFrame:
    """Per query with one relevant row: its above, tied, candidates, recall@k, reciprocal rank and AUC, in expectation over ties.

    A missing score ranks last. Queries without a relevant row have no result;
    with several, each is a query of its own against all rows.
    """
    s = F.coalesce(F.when(~F.isnan(score), F.col(score)), F.lit(float("-inf")))
    ranks = value_ranks(df.select(*query, s.alias("_s")), query, "_s")
    hits = df.where(F.col(relevant)).select(*query, s.alias("_s")).join(ranks, [*query, "_s"])
    above, tied, n = F.col("total") - F.col("below") - F.col("n"), F.col("n"), F.col("total")
    # The sum of 1 / rank over the tied ranks, from partial sums at most as long as the ties.
    reciprocal = F.aggregate(F.sequence(above + 1, above + tied), F.lit(0.0), lambda t, r: t + 1.0 / r) / tied
    recall = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), (k - above) / tied)).alias(f"recall_{k}") for k in ks]
    auc = F.when(n > 1, (n - above - tied + 0.5 * (tied - 1)) / (n - 1))
    return hits.select(*query, above.alias("above"), tied.alias("tied"), n.alias("candidates"), *recall, reciprocal.alias("reciprocal_rank"), auc.alias("auc"))


def signed_ranks(df: DataFrame, group: list[str], difference: str) -> DataFrame:
    """(group, n, w_plus, w_minus, rank_biserial): Wilcoxon's sums over differences other than 0."""
    d = df.where(F.col(difference).isNotNull() & ~F.isnan(difference) & (F.col(difference) != 0)).select(*group, F.col(difference).alias("_d"), F.abs(difference).alias("_a"))
    r = with_ranks(d, group, "_a", "_")
    sums = r.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("_d") < 0, F.col("_rank")).otherwise(0.0)).alias("w_minus"))
    return sums.withColumn("rank_biserial", (F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus")))


def holm(df: DataFrame, family: list[str], p: str) -> DataFrame:
    """Adds ``holm``: p-values adjusted step-down within a family of tests; a family is a report's list of tests."""
    order = Window.partitionBy(*family).orderBy(p)
    m = F.count(p).over(Window.partitionBy(*family))
    scaled = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(order) + 1))
    return df.withColumn("_h", scaled).withColumn("holm", F.max("_h").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_h")


def kruskal_wallis(df: DataFrame, group: list[str], level: str, value: str) -> DataFrame:
    """(group, n, levels, h, epsilon_squared, p): rank sums per level, corrected for ties."""
    r = with_ranks(df.where(F.col(level).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value)).select(*group, level, value), group, value, "_")
    per = r.groupBy(*group, level).agg(F.count(F.lit(1)).alias("_c"), F.sum("_rank").alias("_r"))
    sums = per.groupBy(*group).agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("levels"), F.sum(F.col("_r") * F.col("_r") / F.col("_c")).alias("_q"))
    ties = value_ranks(r, group, value).groupBy(*group).agg(F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("_t"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)) / F.when(n**3 - n > F.col("_t"), 1 - F.col("_t") / (n**3 - n))
    out = sums.join(ties, group).withColumn("h", h).withColumn("epsilon_squared", F.col("h") / F.when(n > 1, n - 1))
    return out.select(*group, "n", "levels", "h", "epsilon_squared", chi_square_p(F.col("h"), F.col("levels") - 1).alias("p"))


def friedman(df: DataFrame, block: list[str], treatment: str, value: str, treatments: int) -> DataFrame:
    """(blocks, statistic, p) over blocks that have all treatments; ranks within blocks of so many rows, corrected for ties."""
    one = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*block, treatment).agg(F.avg(value).alias("_v"))
    whole = Window.partitionBy(*block)
    order = whole.orderBy("_v")
    rank = F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*block, "_v")) - 1) / 2
    ranked = one.withColumn("_k", F.count(F.lit(1)).over(whole)).withColumn("_r", rank).withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy(*block, "_v"))).where(F.col("_k") == treatments)
    sums = ranked.groupBy(treatment).agg(F.sum("_r").alias("_s"), F.count(F.lit(1)).alias("_b"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_c"))
    k = float(treatments)
    total = sums.agg(F.max("_b").alias("blocks"), F.sum(F.col("_s") * F.col("_s")).alias("_q"), F.sum("_c").alias("_c"))
    b = F.col("blocks").cast("double")
    plain = 12 / (b * k * (k + 1)) * F.col("_q") - 3 * b * (k + 1)
    correction = 1 - F.col("_c") / (b * (k**3 - k))
    out = total.withColumn("statistic", plain / F.when(correction > 0, correction))
    return out.select("blocks", "statistic", chi_square_p(F.col("statistic"), F.lit(treatments - 1)).alias("p"))


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * front
    tiny, b = 1e-300, x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * h


@F.pandas_udf(DoubleType())
def _chi_square_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(k) or k <= 0 else gamma_q(k / 2, a / 2) for a, k in zip(x, df)], dtype="float64")


def chi_square_p(x: Column, degrees: Column) -> Column:
    """P(chi-square of so many degrees > x); one row per test."""
    return _chi_square_udf(x.cast("double"), degrees.cast("double"))


def wilcoxon_p(w: float, n: int) -> float:
    """Two-sided p of the smaller signed-rank sum, exact by counting subsets up to 50 untied ranks, normal beyond or with ties."""
    if n == 0:
        return 1.0
    if n <= 50 and float(w).is_integer():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    mean, sd = n * (n + 1) / 4, math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return float(min(1.0, math.erfc(abs(w - mean) / sd / math.sqrt(2))))


@F.pandas_udf(DoubleType())
def _wilcoxon_udf(plus: pd.Series, minus: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([wilcoxon_p(min(a, b), int(k)) for a, b, k in zip(plus, minus, n)], dtype="float64")


def wilcoxon(df: DataFrame, group: list[str], difference: str) -> DataFrame:
    """:func:`signed_ranks` with ``p``."""
    return signed_ranks(df, group, difference).withColumn("p", _wilcoxon_udf("w_plus", "w_minus", "n"))


def cluster_means(df: DataFrame, group: list[str], cluster: str, value: str) -> DataFrame:
    """(group, cluster, n, total): the sums a cluster bootstrap draws from, one row per cluster."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*group, cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def bootstrap_ci(df: DataFrame, group: list[str], cluster: str, value: str, draws: int = 1000, level: float = 0.95, seed: int = 42, blocks: int = 32) -> DataFrame:
    """(group, estimate, low, high): the mean's interval under resampling of clusters.

    Each cluster gets a Poisson(1) weight per draw, derived from its name, so
    draws add up on the map side: one partial sum of ``draws`` values per group
    and partition, never a group's rows in one task.
    """
    sums = cluster_means(df, group, cluster, value)
    keys = F.concat_ws("\u0001", *[F.col(g).cast("string") for g in group], F.col(cluster).cast("string"))
    schema = ", ".join([*[f"{g} {dict(df.dtypes)[g]}" for g in group], "ns array<double>", "totals array<double>"])

    def weigh(frames):
        for f in frames:
            if not len(f):
                continue
            w = np.array([np.random.default_rng([seed, int(h) & 0xFFFFFFFF, int(h) >> 32 & 0xFFFFFFFF]).poisson(1.0, draws) for h in f["_h"]], dtype=float)
            f = f.assign(_g=f.groupby(group, dropna=False, sort=False).ngroup())
            out = []
            for _, at in f.groupby("_g").indices.items():
                first = f.iloc[at[0]]
                out.append([*[first[g] for g in group], (w[at] * f["n"].to_numpy()[at][:, None]).sum(0), (w[at] * f["total"].to_numpy()[at][:, None]).sum(0)])
            yield pd.DataFrame(out, columns=[*group, "ns", "totals"])

    partial = sums.select(*group, "n", "total", F.xxhash64(keys).alias("_h")).mapInPandas(weigh, schema)
    cells = partial.select(*group, F.posexplode(F.arrays_zip("ns", "totals")).alias("draw", "x")).groupBy(*group, "draw").agg(F.sum("x.ns").alias("n"), F.sum("x.totals").alias("t"))
    tail = (1 - level) / 2
    mean = F.when(F.col("n") > 0, F.col("t") / F.col("n"))
    spread = cells.groupBy(*group).agg(F.percentile(mean, F.lit(tail)).alias("low"), F.percentile(mean, F.lit(1 - tail)).alias("high"))
    return sums.groupBy(*group).agg((F.sum("total") / F.sum("n")).alias("estimate")).join(spread, group)


def set_similarity(df: DataFrame, group: list[str], member: str, a: Column, b: Column) -> DataFrame:
    """(group, size_a, size_b, common, jaccard) of two sets of members, given by conditions on rows; 1 where both are empty."""
    flags = df.groupBy(*group, member).agg(F.max(a).alias("_a"), F.max(b).alias("_b"))
    out = flags.groupBy(*group).agg(F.count_if("_a").alias("size_a"), F.count_if("_b").alias("size_b"), F.count_if(F.col("_a") & F.col("_b")).alias("common"))
    union = F.col("size_a") + F.col("size_b") - F.col("common")
    return out.withColumn("jaccard", F.when(union > 0, F.col("common") / union).otherwise(1.0))


Statistic = Callable[[pd.DataFrame], float]


def grouped_statistic(df: DataFrame, group: list[str], statistic: Statistic, columns: list[str], rows: int = 100_000) -> DataFrame:
    """(group, value): a caller's own statistic, on groups of at most ``rows`` rows; a larger group is an error, not cut."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > rows:
            raise ValueError(f"a group has {len(pdf)} rows, more than {rows}")
        return pd.DataFrame([[*[pdf[g].iloc[0] for g in group], float(statistic(pdf))]], columns=[*group, "value"])

    schema = ", ".join([*[f"{g} {dict(df.dtypes)[g]}" for g in group], "value double"])
    return df.select(*group, *columns).groupBy(*group).applyInPandas(run, schema)
