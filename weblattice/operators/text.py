"""Field texts to terms, weights, directional containment (REF) and similarity."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weblattice.functions.stemming import stem
from weblattice.functions.text import lower_nfc, words
from weblattice.session import checkpointed


def term_table(rows: DataFrame, group: str, key: str, text: str, min_length: int = 2) -> DataFrame:
    """(group, key, term, tf) with words of at least ``min_length`` letters."""
    return (
        rows.select(F.col(group), F.col(key), F.explode(words(lower_nfc(F.col(text)))).alias("term")).where(F.length("term") >= min_length)
        .groupBy(group, key, "term").agg(F.count(F.lit(1)).alias("tf"))
    )


def document_frequency(terms: DataFrame, group: str) -> DataFrame:
    """(group, term, df, cf)."""
    return terms.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def collection_size(terms: DataFrame, group: str, key: str) -> DataFrame:
    return terms.select(group, key).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n_docs"))


def boilerplate_terms(df: DataFrame, sizes: DataFrame, group: str, share: float = 0.5, quota: float = 0.07) -> DataFrame:
    """Terms to drop: on at least ``share`` of the documents (two at least), the most frequent first,
    up to ``quota`` of the group's vocabulary."""
    vocabulary = df.groupBy(group).agg(F.floor(F.count(F.lit(1)) * F.lit(quota)).alias("quota"))
    often = df.join(sizes, group).where(F.col("df") >= F.greatest(F.lit(2), F.ceil(F.lit(share) * F.col("n_docs"))))
    ranked = often.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("df"), F.desc("cf"), "term")))
    return ranked.join(vocabulary, group).where("rank <= quota").select(group, "term", "df", "cf", "rank")


def idf(n: Column, df: Column) -> Column:
    """Smoothed: ln((1 + n) / (1 + df)) + 1."""
    return F.log((1 + n) / (1 + df)) + 1


def tfidf(terms: DataFrame, df: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """The term table with ``weight`` = tf · idf."""
    weights = df.join(sizes, group).select(group, "term", idf(F.col("n_docs"), F.col("df")).alias("idf"))
    return terms.join(weights, [group, "term"]).withColumn("weight", F.col("tf") * F.col("idf")).drop("idf")


#: A share of a target's weight that must certainly stay below the threshold, sums of doubles being inexact.
_SAFE = 1 - 1e-9


def _walked(donors: DataFrame, targets: DataFrame, group: list[str], epsilon: float) -> tuple[DataFrame, DataFrame]:
    """(near, marked): pairs that may exceed ``epsilon`` with what their rarer terms give, and the targets' terms, the common ones marked ``skip``."""
    held = donors.groupBy(*group, "term").agg(F.count(F.lit(1)).alias("held"))
    known = targets.join(held, [*group, "term"], "left")
    commonest = Window.partitionBy(*group, "dst").orderBy(F.desc_nulls_last("held"), "term")
    whole = Window.partitionBy(*group, "dst")
    marked = known.withColumn("total", F.sum("w").over(whole)).withColumn("skip", F.sum("w").over(commonest.rowsBetween(Window.unboundedPreceding, 0)) <= epsilon * _SAFE * F.col("total"))
    marked = marked.withColumn("slack", F.sum(F.when(F.col("skip"), F.col("w")).otherwise(0.0)).over(whole)).where("total > 0 and held is not null").drop("held")
    marked = checkpointed(marked)
    rare = donors.join(marked.where("not skip"), [*group, "term"]).where("src != dst")
    near = rare.groupBy(*group, "src", "dst").agg(F.sum("w").alias("m"), F.count(F.lit(1)).alias("n"), F.max("slack").alias("slack"), F.max("total").alias("total"))
    return near.where((F.col("m") + F.col("slack")) > epsilon * _SAFE * F.col("total")), marked


def ref(donors: DataFrame, targets: DataFrame, group: list[str], epsilon: float = 0.2) -> DataFrame:
    """(group, src, dst, ref, rho, matched_count) of pairs above ``epsilon``.

    REF is the share of dst's weight on terms that src holds; rho is REF over
    the sum of the source's. ``donors`` is (group, src, term), a set of terms
    per donor; ``targets`` is (group, dst, term, w), one row per term; src and
    dst should be numbers, for they travel with every common term of a pair.

    A target's most common terms that together weigh at most ``epsilon`` of its
    total can't lift a pair over the threshold by themselves, so only the
    others, rarer ones are joined to find pairs; what a pair gains from the
    common ones is bounded by their weight, and they are joined for the pairs
    that remain. Posting lists of the commonest terms, which would pair nearly
    all pages, are thus never walked.
    """
    near, marked = _walked(donors, targets, group, epsilon)
    key = [*group, "src", "dst"]
    common = marked.where("skip").select(*group, "dst", "term", "w")
    # Pairs already beyond doubt gain from the common terms too: REF is exact.
    gained = near.select(*key).join(common, [*group, "dst"]).join(donors.select(*group, "src", "term"), [*group, "src", "term"], "left_semi").groupBy(*key).agg(F.sum("w").alias("m2"), F.count(F.lit(1)).alias("n2"))
    j = near.join(gained, key, "left")
    kept = j.withColumn("ref", (F.col("m") + F.coalesce("m2", F.lit(0.0))) / F.col("total")).where(F.col("ref") > epsilon)
    kept = kept.select(*key, "ref", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("matched_count"))
    per = Window.partitionBy(*group, "src")
    return kept.withColumn("rho", F.col("ref") / F.sum("ref").over(per)).select(*key, "ref", "rho", "matched_count")


def matched_terms(pairs: DataFrame, donors: DataFrame, targets: DataFrame, group: list[str]) -> DataFrame:
    """(group, src, dst, term, w) of given pairs: the terms of dst that src holds."""
    asked = pairs.select(*group, "src", "dst").join(targets.select(*group, "dst", "term", "w"), [*group, "dst"])
    return asked.join(donors.select(*group, "src", "term"), [*group, "src", "term"], "left_semi")


def top_terms(matched: DataFrame, totals: DataFrame, group: list[str], k: int = 10) -> DataFrame:
    """(group, src, dst, rank, term, contribution): the terms that carry a pair, the heaviest first."""
    entry = F.struct((-F.round("w", 9)).alias("o"), F.col("term"), F.col("w"))
    lists = matched.groupBy(*group, "src", "dst").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("_t")).join(totals, [*group, "dst"])
    rows = lists.select(*group, "src", "dst", "total", F.posexplode("_t").alias("rank", "t"))
    return rows.select(*group, "src", "dst", (F.col("rank") + 1).alias("rank"), F.col("t.term").alias("term"), (F.col("t.w") / F.col("total")).alias("contribution"))


def set_jaccard(a: Column, b: Column, empty: float) -> Column:
    """Jaccard of two arrays taken as sets; ``empty`` where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine_neighbours(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, blocks: int = 32) -> DataFrame:
    """(query, neighbour, cosine, rank): exact nearest rows of a stated query set, by blocks of rows.

    Queries (few) meet each block; a block keeps its ``k`` best per query, and
    the survivors are ranked again, so no task holds a query's whole list.
    """
    unit = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("neighbour"), F.col(vector).alias("_v"), unit(F.col(vector)).alias("_n"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_b"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(vector).alias("_q"), unit(F.col(vector)).alias("_m"))
    asked = asked.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    dot = F.aggregate(F.zip_with("_q", "_v", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    pairs = rows.join(asked, "_b").where("query != neighbour and _n > 0 and _m > 0").select("query", "neighbour", "_b", F.round(dot / (F.col("_n") * F.col("_m")), 6).alias("cosine"))
    order = [F.desc("cosine"), F.asc("neighbour")]
    near = pairs.withColumn("r", F.row_number().over(Window.partitionBy("query", "_b").orderBy(*order))).where(F.col("r") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select("query", "neighbour", "cosine", "rank")


def sigma(ref_: Column, cosine: Column, epsilon: float = 0.2, blend: float = 0.5) -> dict[str, Column]:
    """The four relatedness variants; a missing cosine is 0."""
    c = F.coalesce(cosine, F.lit(0.0))
    return {
        "cosine_only": c, "ref_only": ref_, "ref_gate_cosine": F.when(ref_ > epsilon, c).otherwise(F.lit(0.0)),
        "blended": F.lit(blend) * ref_ + F.lit(1 - blend) * c,
    }


def minhash(terms: Column, permutations: int = 64) -> Column:
    """Signature of a set of terms: per seed the smallest hash."""
    def smallest(seed: int) -> Column:
        return F.array_min(F.transform(terms, lambda t: F.xxhash64(t, F.lit(seed))))  # a second parameter would be the place in the array

    return F.array(*[smallest(s) for s in range(permutations)])


def signature_classes(sets: DataFrame, group: str, key: str, terms: str, permutations: int = 64) -> DataFrame:
    """(group, key, class, signature): equal sets, given in order, are one class, named by its smallest key; the signature is of the class."""
    digest = F.sha2(F.array_join(terms, "\u0001"), 256)
    coded = sets.select(group, F.col(key).alias("_k"), F.col(terms).alias("_t"), digest.alias("_d"))
    classes = coded.groupBy(group, "_d").agg(F.min("_k").alias("class"), F.first("_t").alias("_t"))
    signed = classes.select(group, "_d", "class", minhash(F.col("_t"), permutations).alias("signature"))
    return coded.select(group, "_k", "_d").join(signed, [group, "_d"]).select(group, F.col("_k").alias(key), "class", "signature")


def lsh_candidates(classes: DataFrame, group: str, rows: int = 4, permutations: int = 64) -> DataFrame:
    """(group, a, b) pairs of classes that agree on at least one band of their signatures.

    ``classes`` comes from :func:`signature_classes`, which gives the members;
    groups of copies meet once, as their class.
    """
    classes = classes.select(group, F.col("class").alias("_k"), F.col("signature").alias("_s")).distinct()
    bands = classes.select(group, "_k", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(permutations // rows - 1)), lambda b: F.xxhash64(F.slice("_s", b * rows + 1, rows)))).alias("band", "code"))
    a, b = bands.withColumnRenamed("_k", "a"), bands.withColumnRenamed("_k", "b")
    return a.join(b, [group, "band", "code"]).where("a < b").select(group, "a", "b").distinct()


def ngrams(terms: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring terms of an array, parted by blanks; none where it is shorter."""
    grams = F.transform(F.sequence(F.lit(1), F.size(terms) - n + 1), lambda i: F.array_join(F.slice(terms, i, n), " "))
    return F.when(F.size(terms) >= n, grams).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(StringType())
def _stem_udf(words_: pd.Series) -> pd.Series:
    seen: dict = {}
    return words_.map(lambda w: None if w is None else seen[w] if w in seen else seen.setdefault(w, stem(w)))


def surface_forms(counts: DataFrame, group: str) -> DataFrame:
    """(group, stem, word, n): per stem the word met most often, then the shorter, then the smaller; ``counts`` is (group, word, n)."""
    stemmed = counts.withColumn("stem", _stem_udf("word"))
    best = F.min_by(F.struct("word", "n"), F.struct((-F.col("n")).alias("a"), F.length("word").alias("b"), F.col("word").alias("c")))
    return stemmed.groupBy(group, "stem").agg(best.alias("_b")).select(group, "stem", "_b.word", "_b.n")


def word_phrases(text: str | None, least: int = 2, stop: frozenset[str] = frozenset()) -> list[list[tuple[str, str]]]:
    """Phrases of (stem, word): NFKC, lower case, inner apostrophes gone, parted at punctuation; numbers, stop and short words drop out."""
    if not text:
        return []
    folded = re.sub(r"(?<=\w)['’](?=\w)", "", unicodedata.normalize("NFKC", text).lower())
    out = []
    for phrase in re.split(r"[^\w\s\-]+|\n", folded):
        found = [w for w in re.findall(r"[^\W_]+", phrase) if not w.isnumeric() and len(w) >= least and w not in stop]
        if found:
            out.append([(stem(w), w) for w in found])
    return out
