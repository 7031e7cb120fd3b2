"""Containers: whole documents, capacity, little unused space."""

from __future__ import annotations

import os
import random

import pytest

from weblattice.llm.packing import VOCABULARY, pack_documents, packed


def check(rows, sizes, capacity):
    pieces, used = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        if r.container is not None:
            used.setdefault(r.container, []).append((r.position, r.n_tokens))
    for key, n in sizes.items():
        mine = pieces[key]
        assert sum(r.n_tokens for r in mine) == n
        assert len(mine) == (1 if n <= capacity else -(-n // capacity))
        assert n > 0 or mine[0].container is None
    for parts in used.values():
        at = 0
        for position, n in sorted(parts):
            assert position == at
            at += n
        assert at <= capacity
    return used


@pytest.mark.parametrize("shard_rows", [16_384, 500])
def test_sizes_are_kept_and_containers_filled(spark, shard_rows):
    draw = random.Random(2)
    sizes = {i: draw.choice([0, 1, 64, 64, 1023, 1024, 1025, 5000, draw.randrange(1, 900)]) for i in range(2000)}
    rows = packed(spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long"), shard_rows=shard_rows).collect()
    used = check(rows, sizes, 1024)
    assert sum(sizes.values()) / (1024 * len(used)) > 0.97
    assert {tuple(r) for r in rows} == {tuple(r) for r in packed(spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long").repartition(7), shard_rows=shard_rows).collect()}


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_string_keys_nulls_and_long_texts(spark):
    docs = spark.createDataFrame([("a", "one two three", 1), ("b", None, 1), ("c", "", 1), ("d", "word " * 3000, 1), (None, "lost key", 1), ("a", "one two three", 1)], "doc_id string, text string, shard int")
    rows = pack_documents(docs).collect()
    assert {r.doc_id for r in rows} == {"a", "b", "c", "d", None}
    assert len([r for r in rows if r.doc_id == "a"]) == 2
    assert all(r.container is None for r in rows if r.doc_id in ("b", "c"))
    assert sum(r.n_tokens for r in rows if r.doc_id == "d") >= 3000


def test_empty_table(spark):
    assert packed(spark.createDataFrame([], "doc_id long, n_tokens long")).collect() == []
