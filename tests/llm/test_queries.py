"""The registered queries of the training-data problems."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__


def test_every_problem_has_its_queries():
    names = set(__spark_entry__.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 9, 10)} | {"p8_packed"} <= names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_p3_scores_every_word_of_a_page(spark, tmp_path):
    """Words that stand once, or on one page, count too: with what the words that a page lacks add, the scores are its relative entropy."""
    texts = {1: "the cat and the cat", 2: "the dog, the owl", 3: "Une e\u0301cole", 4: "", 5: None}
    spark.createDataFrame(list(texts.items()), "id long, body_text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = __spark_entry__.queries()["p3_all_scores"](spark, str(tmp_path)).collect()
    words = {1: "the cat and the cat".split(), 2: "the dog the owl".split(), 3: ["une", "\u00e9cole"]}
    assert Counter({(r.page_id, r.term): r.tf for r in got}) == Counter((i, w) for i, ws in words.items() for w in ws)
    cf = Counter(w for ws in words.values() for w in ws)
    total = sum(cf.values())
    for i, ws in words.items():
        pd = {w: (ws.count(w) + 300 * n / total) / (len(ws) + 300) for w, n in cf.items()}
        assert sum(pd.values()) == pytest.approx(1)
        lacking = sum(pd[w] * math.log(pd[w] * total / n) for w, n in cf.items() if w not in ws)
        entropy = sum(pd[w] * math.log(pd[w] * total / n) for w, n in cf.items())
        assert sum(r.score for r in got if r.page_id == i) + lacking == pytest.approx(entropy, abs=1e-8)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.execute(__spark_entry__.oracle_sql()["p3_all_scores"]).fetchall())
