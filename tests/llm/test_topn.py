"""Top N per group against a brute-force ranking."""

from __future__ import annotations

import math
import random

from weblattice.llm.topn import top_n

SCHEMA = "target string, donor string, s_score double, _g int, rank string"


def brute(rows, n):
    best: dict = {}
    for t, d, s, *_ in rows:
        if d is not None and s is not None and not math.isnan(s):
            best[t, d] = max(best.get((t, d), -math.inf), s + 0.0)
    out = set()
    for t in {t for t, _ in best}:
        ranked = sorted(((-s, d) for (u, d), s in best.items() if u == t))[:n]
        out |= {(t, d, -s, k) for k, (s, d) in enumerate(ranked, 1)}
    return out


def test_hot_group_ties_repeats_nulls_and_clashing_columns(spark):
    draw = random.Random(3)
    rows = [("hot" if draw.random() < 0.4 else f"t{draw.randrange(30)}", f"d{draw.randrange(200)}", draw.choice([0.0, -0.0, 1.5, 2.5, -1.0, float("nan"), None]), 1, "x") for _ in range(3000)]
    rows += [(None, "d1", 1.0, 1, "x"), ("t1", None, 9.0, 1, "x"), *rows[:50]]
    for subgroups in (None, 1, 7):
        got = {tuple(r) for r in top_n(spark.createDataFrame(rows, SCHEMA), 5, subgroups=subgroups).collect()}
        assert got == brute(rows, 5)


def test_empty_table(spark):
    assert top_n(spark.createDataFrame([], SCHEMA)).collect() == []
