"""Distinctive terms against a brute-force divergence."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pytest

from weblattice.llm import distinctive
from weblattice.llm.distinctive import distinctive_terms

TEXTS = ["the cat and the cat", "the dog, the dog and the école", "ÉCOLE the 12 x9y", "", None, "the the the", "and " * 300]


def brute(rows, mu, min_tf, min_df, max_df):
    counts = {i: Counter(re.findall(r"[^\W\d_]+", unicodedata.normalize("NFC", t).lower())) for i, t in rows if t}
    df, cf = Counter(), Counter()
    for c in counts.values():
        df.update(c.keys())
        cf.update(c)
    total, out = sum(cf.values()), {}
    for i, c in counts.items():
        for w, tf in c.items():
            if tf >= min_tf and min_df <= df[w] <= max_df:
                pc = cf[w] / total
                p = (tf + mu * pc) / (sum(c.values()) + mu)
                out[i, w] = (tf, df[w], cf[w], p * math.log(p / pc))
    return out


@pytest.mark.parametrize("least", [1000, 2])
def test_scores_with_and_without_common_terms(spark, monkeypatch, least):
    monkeypatch.setattr(distinctive, "LEAST", least)
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "id long, body_text string, tf int, term string")
    for limits in ((1, 1, None), (2, 2, 3), (1, 2, 5)):
        got = {(r.id, r.term): (r.tf, r.df, r.cf, r.score) for r in distinctive_terms(docs, min_tf=limits[0], min_df=limits[1], max_df=limits[2]).collect()}
        want = brute(rows, 300.0, limits[0], limits[1], limits[2] or 10**9)
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_empty_table(spark):
    assert distinctive_terms(spark.createDataFrame([], "id long, body_text string")).collect() == []
