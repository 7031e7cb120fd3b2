"""Evaluation passages inside training documents: a prefix-filtered set join.

A leak is a window of ``width`` consecutive words of a test item inside a
document. As a set a window is its ``width - k + 1`` shingles of ``k`` words,
all of which the document must hold; so a prefix of one shingle suffices, the
rarest. Documents are read and cut into words once: a shingle that some item
holds leaves its document as a hit, with the words around it. Counting the
hits' documents gives the order by rarity; the hits on each window's rarest
shingle are bounded by the document's ends, and exact containment is verified
on the words a hit carries. Texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblattice.functions.text import lower_nfc, words
from weblattice.session import checkpointed

TOKEN = r"[\p{L}\p{N}]+"
#: Up to so many windows of all items, what is derived from them (at most width - k + 1 shingles of 8 bytes, one
#: passage of some 100 bytes a window) is broadcast; more are joined by shuffle.
BROADCAST_WINDOWS = 400_000


def tokens(c: Column) -> Column:
    return words(lower_nfc(c), TOKEN)


def _hash(w: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(w, at + j) for j in range(k)])


def _spelt(w: Column) -> Column:
    return F.array_join(w, " ")


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", doc_text: str = "text", item_text: str = "text",
    width: int = 12, k: int = 5,
) -> DataFrame:
    """(doc_key, item_key) of each document with at least ``width`` consecutive words of an item.

    Words are unbroken runs of letters and digits in composed form, ignoring
    case; what stands between them doesn't matter. Null, empty and shorter
    texts hold no window. A pair comes out once, however often rows repeat.
    Further columns are ignored.

    The items are the stated query set. Their windows are counted before the
    plan is chosen: a few are broadcast, many are joined by shuffle, where
    adaptive execution splits a shingle that many documents hold. The hits are
    written once to the shared folder; they grow with what documents and items
    have in common, not with the texts.
    """
    it = items.select(F.col(item_key).alias("_i"), tokens(F.col(item_text)).alias("_iw")).where(F.size("_iw") >= width)
    spread = width - k
    cut = it.select("_i", F.explode(F.transform(F.sequence(F.lit(1), F.size("_iw") - width + 1), lambda at: F.slice("_iw", at, width))).alias("w"))
    owners = cut.select("_i", _spelt(F.col("w")).alias("passage")).distinct()
    # Equal passages, of one item or several, are one window.
    windows = cut.select("w").distinct().select(
        _spelt(F.col("w")).alias("passage"), F.posexplode(F.array(*[_hash(F.col("w"), F.lit(j), k) for j in range(spread + 1)])).alias("offset", "h")
    )
    total = it.agg(F.sum(F.size("_iw") - width + 1)).first()[0] or 0

    def sized(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if total <= BROADCAST_WINDOWS else df

    d = docs.select(F.col(doc_key).alias("_d"), tokens(F.col(doc_text)).alias("_w")).where(F.size("_w") >= width)
    starts = F.transform(F.sequence(F.lit(0), F.size("_w") - k), lambda i: F.struct(i.alias("pos"), _hash(F.col("_w"), i, k).alias("h")))
    found = d.select("_d", "_w", F.inline(starts)).join(sized(windows.select("h").distinct()), "h", "left_semi")
    # The words that windows holding this shingle reach over, and how many of them stand before it.
    before = F.least(F.col("pos"), F.lit(spread))
    hits = checkpointed(found.select("_d", "h", before.alias("before"), F.slice("_w", F.col("pos") - before + 1, before + k + spread).alias("near")))

    rarity = hits.groupBy("h", "_d").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    by_window = Window.partitionBy("passage")
    # A shingle of no document drops out of the join, and its windows with it: they can't leak.
    prefix = (
        windows.join(sized(rarity), "h").withColumn("whole", F.count(F.lit(1)).over(by_window))
        .withColumn("rank", F.row_number().over(by_window.orderBy("df", "h", "offset")))
        .where((F.col("rank") == 1) & (F.col("whole") == spread + 1)).select("offset", "h", "passage")
    )
    bounded = hits.join(sized(prefix), "h").where((F.col("before") >= F.col("offset")) & (F.size("near") - F.col("before") + F.col("offset") >= width))
    exact = bounded.where(_spelt(F.slice("near", F.col("before") - F.col("offset") + 1, width)) == F.col("passage"))
    leaks = exact.select("_d", "passage").distinct().join(sized(owners), "passage")
    return leaks.select(F.col("_d").alias(doc_key), F.col("_i").alias(item_key)).distinct()
