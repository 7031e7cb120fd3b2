"""Lines and blocks of lines repeated across the documents of one source.

Each line becomes an identifier (a hash of its letters). A generalised suffix
array over the sources' identifier sequences is built in Spark:

1. Bucket pass. Suffixes are bucketed by their first identifier, counting
   documents with map-side combining. No block of ``min_docs`` documents can
   touch an identifier on fewer, so sequences are cut there, without loss.
2. Identical suffixes of what remains are merged with their counts, then
   sorted by range over (source, suffix): a hot source spreads over partitions.
3. One pass along each sorted partition keeps the common prefix with the
   previous suffix and closes the repeated blocks that end there. Counts of
   blocks at partition edges are added up afterwards.

A page counts once for a block however often it holds it: of a page's own
suffixes, the prefix shared with its previous one is already counted.

A block is reported if it is closed: no longer block that begins or ends with
it stands on as many documents. That depends on the documents alone, not on how
the sorted suffixes are parted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblattice.functions.text import nfc
from weblattice.operators.skew import salted_join
from weblattice.session import checkpointed

#: Suffixes are cut to so many identifiers at first; where blocks reach that length, their documents
#: are read again with twice as many, until none does.
MAX_BLOCK = 32
MARK = "￿"


def _identifiers(parts: Column) -> Column:
    """Hash of each part's letters, ignoring case; null for parts without letters."""
    def one(p: Column) -> Column:
        key = F.regexp_replace(p, r"[^\p{L}]", "")
        return F.when(key != "", F.xxhash64(key))

    return F.transform(parts, one)


def _folded(c: Column) -> Column:
    return F.lower(F.upper(nfc(c)))


def page_sequences(pages: DataFrame, key: str, source: str, text: str, parts: str) -> DataFrame:
    """(_id, _source, items) with items an array of (seq, field, pos, h) for each line with letters, in order."""
    joined = F.array_join(F.transform(F.col(parts), lambda x: F.coalesce(F.translate(x, MARK, " "), F.lit(""))), MARK)
    folded = pages.select(
        F.col(key).alias("_id"), F.col(source).alias("_source"), _folded(F.col(text)).alias("_b"), F.when(F.size(parts) > 0, _folded(joined)).alias("_p")
    )
    lines = folded.select(
        "_id", "_source", _identifiers(F.split("_b", "\n", -1)).alias("_b"), _identifiers(F.split("_p", MARK, -1)).alias("_p")
    )

    def numbered(c: str, field: int) -> Column:
        rows = F.transform(F.col(c), lambda h, i: F.struct(F.lit(field).alias("field"), (i + 1).cast("int").alias("pos"), h.alias("h")))
        return F.coalesce(F.filter(rows, lambda r: r["h"].isNotNull()), F.array().cast("array<struct<field:int,pos:int,h:bigint>>"))

    return lines.select("_id", "_source", numbered("_b", 0).alias("_b"), numbered("_p", 1).alias("_p"))


def _repeated_items(seqs: DataFrame, min_docs: int) -> DataFrame:
    """Occurrences of identifiers on at least ``min_docs`` documents of their source."""
    once = seqs.select("_source", F.explode(F.array_distinct(F.concat(F.transform("_b", lambda r: r["h"]), F.transform("_p", lambda r: r["h"])))).alias("h"))
    often = once.groupBy("_source", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    # One gap in the numbering keeps the two fields apart.
    both = F.concat("_b", F.array(F.struct(F.lit(-1).alias("field"), F.lit(0).alias("pos"), F.lit(None).cast("bigint").alias("h"))), "_p")
    rows = seqs.select("_id", "_source", F.posexplode(both).alias("seq", "r")).select("_id", "_source", "seq", "r.field", "r.pos", "r.h")
    # A source's commonest line may stand on a third of all documents.
    return salted_join(rows.where("h is not null"), often.select("_source", "h"), ["_source", "h"], F.col("_id"), often, "left_semi")


def _suffixes(cap: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of each document's runs, with the length already counted through the document's previous one."""
    schema = pa.schema([("_source", pa.int64()), ("suffix", pa.list_(pa.int64())), ("counted", pa.int32())])
    for b in batches:
        out: list[list] = [[], [], []]
        for source, items in zip(b.column("_source").to_pylist(), b.column("items").to_pylist()):
            runs, last = [], None
            for it in items:
                if last is None or it["seq"] != last + 1:
                    runs.append([])
                runs[-1].append(it["h"])
                last = it["seq"]
            found = sorted(r[i : i + cap] for r in runs for i in range(len(r)))
            before: list[int] = []
            for s in found:
                c = common(before, s)
                before = s
                if c < len(s):
                    for col, v in zip(out, (source, s, c)):
                        col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def common(a: list, b: list) -> int:
    """Length of the common prefix."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def closing_blocks(rows: Iterator[tuple], min_docs: int) -> Iterator[tuple]:
    """(source, block, documents) from sorted (source, suffix, counted, n) rows of a partition.

    Blocks that are no longer than needed for their count, and all those that
    touch the partition's first or last suffix, whose counts may be partial.
    """
    source, path, counts, edge, first = None, [], [], 0, True

    def close(to: int, all_of: bool) -> Iterator[tuple]:
        deeper = 0
        for k in range(len(path), to, -1):
            if all_of or k <= edge or (counts[k - 1] >= min_docs and counts[k - 1] != deeper):
                yield source, path[:k], counts[k - 1]
            deeper = counts[k - 1]

    for src, suffix, counted, n in rows:
        c = common(path, suffix) if not first and src == source else 0
        yield from close(c, False)
        edge = min(edge, c) if not first else len(suffix)
        source, path, counts, first = src, suffix, counts[:c] + [0] * (len(suffix) - c), False
        for k in range(counted, len(suffix)):
            counts[k] += n
    yield from close(0, True)


def repeated_blocks(
    pages: DataFrame, key: str = "id", source: str = "run_id", text: str = "body_text", parts: str = "paragraphs", min_docs: int = 8,
) -> DataFrame:
    """(source, block, docs): the closed blocks of line identifiers on at least ``min_docs`` documents of a source.

    Blocks may have any length. Those that reach :data:`MAX_BLOCK` identifiers
    are followed further in the documents that hold them: a run of r repeated
    lines then costs up to r²/2 identifiers.
    """
    documents = checkpointed(_documents(pages, key, source, text, parts, min_docs))
    cap, blocks = MAX_BLOCK, checkpointed(_blocks(documents, min_docs))
    while True:
        open_at = blocks.where(F.size("block") >= cap).select(F.col("_source").alias("_s2"), F.col("block")[0].alias("_h2")).distinct()
        if open_at.isEmpty():
            break
        starts = documents.select("_id", "_source", F.explode("items.h").alias("h"))
        within = starts.join(open_at, (F.col("h") == F.col("_h2")) & F.col("_source").eqNullSafe(F.col("_s2")), "left_semi").select("_id").distinct()
        documents = documents.join(within, "_id", "left_semi")
        longer = _blocks(documents, min_docs, 2 * cap).where(F.size("block") >= cap)
        blocks, cap = checkpointed(blocks.where(F.size("block") < cap).unionByName(longer)), 2 * cap
    return closed(blocks).withColumnRenamed("_source", source)


def closed(blocks: DataFrame) -> DataFrame:
    """The (``_source``, ``block``, ``docs``) that no longer one with as many documents begins or ends with.

    Each block names its proper beginnings and its end less one line; what is
    named with its own number of documents falls out. If a longer block ends
    with this one, so does some block that is one line longer.
    """
    code = lambda c: F.xxhash64(c)
    size = F.size("block")
    begins = F.when(size > 1, F.transform(F.sequence(F.lit(1), size - 1), lambda n: code(F.slice("block", F.lit(1), n))))
    ends = F.when(size > 1, F.array(code(F.slice("block", F.lit(2), size - 1))))
    named = blocks.select(F.col("_source").alias("_s2"), F.col("docs").alias("_d2"), F.explode(F.concat(begins, ends)).alias("_c2")).distinct()
    coded = blocks.withColumn("_c", code("block"))
    return coded.join(named, (F.col("_c") == F.col("_c2")) & (F.col("docs") == F.col("_d2")) & F.col("_source").eqNullSafe(F.col("_s2")), "left_anti").drop("_c")


def _documents(pages, key, source, text, parts, min_docs) -> DataFrame:
    items = _repeated_items(page_sequences(pages, key, source, text, parts), min_docs)
    return items.groupBy("_id", "_source").agg(F.array_sort(F.collect_list(F.struct("seq", "field", "pos", "h"))).alias("items"))


def _blocks(documents: DataFrame, min_docs: int, cap: int = MAX_BLOCK) -> DataFrame:
    """(_source, block, docs) of all closed blocks up to ``cap`` identifiers, and of some that aren't closed."""
    merged = (
        documents.select("_source", "items").mapInArrow(partial(_suffixes, cap), "_source long, suffix array<bigint>, counted int")
        .groupBy("_source", "suffix", "counted").agg(F.count(F.lit(1)).alias("n"))
    )
    ordered = merged.repartitionByRange("_source", "suffix").sortWithinPartitions("_source", "suffix", "counted")
    schema = pa.schema([("_source", pa.int64()), ("block", pa.list_(pa.int64())), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*[b.column(c).to_pylist() for c in ("_source", "suffix", "counted", "n")])

        def flush(part):
            cols = list(zip(*part)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

        part = []
        for x in closing_blocks(rows(), min_docs):
            part.append(x)
            if len(part) >= 10_000:
                yield flush(part)
                part = []
        yield flush(part)

    return (
        ordered.mapInArrow(run, "_source long, block array<bigint>, docs long").groupBy("_source", "block").agg(F.sum("docs").alias("docs"))
        .where(F.col("docs") >= min_docs)
    )


def repeated_lines(
    pages: DataFrame, key: str = "id", source: str = "run_id", text: str = "body_text", parts: str = "paragraphs", min_docs: int = 8,
) -> DataFrame:
    """(page_id, field, pos) of each line covered by a repeated block.

    Lines agree if their letters agree in order, in composed form and ignoring
    case; lines without letters never count and don't part a block. ``field``
    is the column's name, ``pos`` counts from 1, blank lines included. Null
    texts and arrays have no lines, a null entry keeps its place; pages with a
    null source form a source. Empty tables give empty results.
    """
    documents = _documents(pages, key, source, text, parts, min_docs)
    covered = _blocks(documents, min_docs).select("_source", "docs", F.explode("block").alias("h")).groupBy("_source", "h").agg(F.max("docs").alias("n"))
    rows = documents.select("_id", "_source", F.explode("items").alias("r")).select("_id", "_source", "r.field", "r.pos", "r.h")
    hit = salted_join(rows, covered.select("_source", "h"), ["_source", "h"], F.col("_id"), covered, "left_semi")
    return hit.select(
        F.col("_id").alias("page_id"), F.when(F.col("field") == 0, text).otherwise(parts).alias("field"), "pos"
    )


def without_repeats(pages: DataFrame, key: str = "id", text: str = "body_text", parts: str = "paragraphs", **kwargs) -> DataFrame:
    """(page_id, text, parts) without the repeated lines."""
    lines = repeated_lines(pages, key=key, text=text, parts=parts, **kwargs)
    gone = lines.groupBy("page_id").agg(
        F.collect_set(F.when(F.col("field") == text, F.col("pos"))).alias("_t"), F.collect_set(F.when(F.col("field") == parts, F.col("pos"))).alias("_p")
    )
    none = F.array().cast("array<int>")
    base = pages.select(F.col(key).alias("page_id"), F.col(text).alias("_text"), F.col(parts).alias("_parts")).join(gone, "page_id", "left")

    def keep(a: Column, bad: str) -> Column:
        pairs = F.transform(a, lambda x, i: F.struct(x.alias("x"), (i + 1).cast("int").alias("i")))
        return F.transform(F.filter(pairs, lambda r: ~F.array_contains(F.coalesce(F.col(bad), none), r["i"])), lambda r: r["x"])

    return base.select(
        "page_id", F.array_join(keep(F.split("_text", "\n", -1), "_t"), "\n").alias(text), keep(F.col("_parts"), "_p").alias(parts)
    )
