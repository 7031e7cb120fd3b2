"""Repeated lines and closed blocks against brute force, for any number of partitions."""

from __future__ import annotations

import random

import pytest

from weblattice.llm.repeats import repeated_blocks, repeated_lines, without_repeats

SCHEMA = "id long, run_id long, body_text string, paragraphs array<string>, h int"


def fold(line):
    return "".join(c for c in line.upper().lower() if c.isalpha()) if line else ""


def sequences(rows):
    """Per page its two fields as lists of (pos, key), lines without letters left out."""
    for key, run, text, parts, _ in rows:
        fields = [("body_text", text.split("\n") if text is not None else []), ("paragraphs", parts or [])]
        yield key, run, [(name, [(i, fold(x)) for i, x in enumerate(lines, 1) if fold(x)]) for name, lines in fields]


def brute_blocks(rows, least):
    held: dict = {}
    for key, run, fields in sequences(rows):
        mine = {tuple(k for _, k in lines[i:j]) for _, lines in fields for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)}
        for b in mine:
            held.setdefault((run, b), set()).add(key)
    docs = {k: len(v) for k, v in held.items() if len(v) >= least}
    longer = {(run, part, n) for (run, b), n in docs.items() if len(b) > 1 for part in (b[1:], b[:-1])}
    return sorted((run or 0, len(b), n) for (run, b), n in docs.items() if (run, b, n) not in longer)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    pool, legal = [f"Line {c} here" for c in "abcdefghij"], [f"clause {'x' * i} of the terms" for i in range(1, 75)]
    out = []
    for i in range(60):
        lines = [draw.choice([*pool, "", "123", f"own {chr(97 + i % 26)}{'z' * i}"]) for _ in range(draw.randrange(0, 14))]
        if i % 4 == 0:
            lines += pool[2:6]
        if i % 5 == 0:
            lines = lines[:3] + (legal if i % 10 else legal[:40])
        parts = [draw.choice([*pool, None, ""]) for _ in range(draw.randrange(0, 4))]
        out.append((i, None if i % 7 == 0 else i % 2, "\n".join(lines), parts, 1))
    return [*out, (100, 1, None, None, 1), (101, 1, "", [], 1), (102, 1, "LINE A HERE!\n" * 5, None, 1)]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_closed_blocks(spark, rows, partitions):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repeated_blocks(spark.createDataFrame(rows, SCHEMA), min_docs=4).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.run_id or 0, len(r.block), r.docs) for r in got) == brute_blocks(rows, 4)
    assert max(len(r.block) for r in got) == 74


def test_lines(spark, rows):
    held: dict = {}
    for key, run, fields in sequences(rows):
        for _, lines in fields:
            for _, k in lines:
                held.setdefault((run, k), set()).add(key)
    want = {(key, name, i) for key, run, fields in sequences(rows) for name, lines in fields for i, k in lines if len(held[run, k]) >= 4}
    pages = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in repeated_lines(pages, min_docs=4).collect()} == want
    left = {r.page_id: r for r in without_repeats(pages, min_docs=4).collect()}
    assert left[102].body_text == "" and left[100].body_text is None and left[100].paragraphs is None
    assert len(left) == len(rows)


def test_empty_table(spark):
    pages = spark.createDataFrame([], SCHEMA)
    assert repeated_blocks(pages).collect() == [] and repeated_lines(pages).collect() == []
