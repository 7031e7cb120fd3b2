"""Leaked items against a brute-force search for shared windows."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest

from weblattice.llm import leakage
from weblattice.llm.leakage import leaked_items


def tokens(t):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFC", t).lower()) if t else []


def windows(t, n=12):
    w = tokens(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.fixture(scope="module")
def tables():
    draw = random.Random(5)
    word = lambda: draw.choice("alpha beta gamma delta link page crawl node edge depth".split())
    items = [(i, " ".join(word() for _ in range(draw.choice([5, 12, 13, 40])))) for i in range(20)] + [(90, None), (91, ""), (0, "repeated key " * 9)]
    docs = []
    for i in range(120):
        text = [word() for _ in range(draw.randrange(0, 60))]
        if i % 3 == 0:
            src = tokens(draw.choice(items)[1])
            a = draw.randrange(0, max(1, len(src) - 11))
            text[3:3] = [w.upper() + draw.choice(["", ",", " --", "."]) for w in src[a : a + draw.choice([11, 12, 20])]]
        docs.append((i, " ".join(text)))
    docs += [(200, None), (201, ""), (3, docs[3][1]), (202, " ".join(["x"] * 40_000) + " " + items[3][1] + " " + items[4][1])]
    return docs, items


@pytest.mark.parametrize("limit", [400_000, 0])
def test_broadcast_and_shuffle_find_the_same(spark, monkeypatch, tables, limit):
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", limit)
    docs, items = tables
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, h int")
    got = {tuple(r) for r in leaked_items(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, k) for i, t in docs for k, x in items if windows(t) & windows(x)}
    assert got


def test_empty_tables(spark, tables):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(tables[1], "item_id long, text string")
    assert leaked_items(none, items).collect() == []
    assert leaked_items(spark.createDataFrame(tables[0], "doc_id long, text string"), items.limit(0)).collect() == []
