"""How distinctive a term is per record: smoothed language-model divergence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblattice.functions.text import lower_nfc, words
from weblattice.session import checkpointed

#: A term counts as common on a 20,000th of all (record, term) pairs, so there are at most as many common terms.
COMMON, LEAST = 20_000, 1000


def term_arrays(records: DataFrame, key: str = "id", text: str = "body_text") -> DataFrame:
    """(``_id``, ``_w``): the words of each row in their order.

    A word is an unbroken run of letters, in NFC and lower case.
    """
    return records.select(F.col(key).alias("_id"), words(lower_nfc(F.col(text))).alias("_w")).where(F.size("_w") > 0)


def collection_terms(tokens: DataFrame) -> DataFrame:
    """(term, df, cf) over all rows: each row's words, and once more each different one, in one aggregate that combines before the shuffle."""
    both = tokens.select(F.size("_w").alias("len"), F.posexplode(F.concat("_w", F.array_distinct("_w"))).alias("at", "term"))
    return both.groupBy("term").agg(F.count_if(F.col("at") >= F.col("len")).alias("df"), F.count_if(F.col("at") < F.col("len")).alias("cf"))


def term_counts(tokens: DataFrame, min_tf: int = 1) -> DataFrame:
    """(``_id``, ``len``, ``term``, ``tf``) of words with at least ``min_tf`` occurrences in their row.

    Counted inside the row, from its sorted words and the places where a new
    word begins; nothing is shuffled.
    """
    ordered = tokens.select("_id", F.sort_array("_w").alias("_s"))
    fresh = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    starts = ordered.select("_id", "_s", fresh.alias("_at"))
    counts = F.transform("_at", lambda i, j: F.struct(F.get("_s", i).alias("term"), (F.coalesce(F.get("_at", j + 1), F.size("_s")) - i).cast("long").alias("tf")))
    return starts.select("_id", F.size("_s").cast("long").alias("len"), F.inline(F.filter(counts, lambda c: c["tf"] >= min_tf)))


def distinctive_terms(
    records: DataFrame, key: str = "id", text: str = "body_text", mu: float = 300.0, min_tf: int = 1, min_df: int = 2,
    max_df: int | None = None,
) -> DataFrame:
    """Each term of each record with its contribution to the record's divergence.

    With p(t|d) = (tf + mu·p(t|C)) / (|d| + mu), the contribution of a term is
    p(t|d) · ln(p(t|d) / p(t|C)), its part of the relative entropy between the
    record and the collection. Terms on fewer than ``min_df`` (or more than
    ``max_df``) records, or with fewer than ``min_tf`` occurrences, are left
    out of the result but counted in the statistics, which cover all records.

    Result: key, term, tf, df, cf, score. Null and empty texts have no terms.
    Each row is a record of its own, also where rows or keys repeat. Further
    columns are ignored.

    The commonest terms stand on nearly every record and would each be one hot
    key of the join: those on at least a :data:`COMMON`-th of all pairs, at
    most so many terms, are broadcast; the others meet by shuffle.
    """
    tokens = term_arrays(records, key, text)
    # As long as the vocabulary; read three times below.
    stats = checkpointed(collection_terms(tokens))
    # An ungrouped aggregate: one row.
    total = F.broadcast(stats.agg(F.sum("cf").alias("total"), F.sum("df").alias("_pairs")))
    keep = F.col("df") >= min_df
    if max_df is not None:
        keep = keep & (F.col("df") <= max_df)
    known = stats.join(total).withColumn("_common", F.col("df") >= F.greatest(F.lit(LEAST), F.col("_pairs") / COMMON))
    asked = term_counts(tokens, min_tf)
    # Of the common terms those asked for bring their figures; the others are told to fall out before the shuffle.
    common = F.broadcast(known.where("_common").select("term", F.when(keep, F.struct("df", "cf", "total")).alias("_k"), F.lit(True).alias("_hot")))
    marked = asked.join(common, "term", "left")
    rare = marked.where("_hot is null").drop("_k", "_hot").join(known.where(~F.col("_common") & keep).select("term", "df", "cf", "total"), "term")
    if max_df is not None and max_df < LEAST:
        found = rare
    else:
        found = rare.unionByName(marked.where("_k is not null").select("term", "_id", "len", "tf", "_k.*"))
    pc = F.col("cf") / F.col("total")
    pd = (F.col("tf") + F.lit(mu) * pc) / (F.col("len") + F.lit(mu))
    return found.select(F.col("_id").alias(key), "term", "tf", "df", "cf", (pd * F.log(pd / pc)).alias("score"))
