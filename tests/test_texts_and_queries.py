"""Terms and containment against brute force, and registered queries against their SQL."""

from __future__ import annotations

import glob
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weblattice.api import SiteAudit
from weblattice.functions.stemming import stem
from weblattice.operators import text as tx

DATA = "/root/testdata/sf0.001"
#: Queries whose SQL is compared here on the smallest data; the driver compares all.
QUICK = ("op1_", "op2_", "op4_", "op5_", "op14_", "op16_", "op17_", "op23_", "op27_", "op36_", "op42_", "op46_", "op48_", "op54_", "op64_", "op90_", "op95_", "op99_", "op100_", "p2_", "p4_")


@pytest.mark.parametrize("epsilon", [0.05, 0.3])
def test_containment_against_brute_force(spark, epsilon):
    draw = random.Random(8)
    donors = {d: {f"t{min(int(draw.expovariate(0.2)), 30)}" for _ in range(draw.randrange(1, 12))} for d in range(40)}
    targets = {d: {f"t{min(int(draw.expovariate(0.2)), 30)}": draw.uniform(0.1, 3) for _ in range(draw.randrange(1, 12))} for d in range(40)}
    d = spark.createDataFrame([(1, k, t) for k, ts in donors.items() for t in ts], "g long, src long, term string")
    t = spark.createDataFrame([(1, k, x, w) for k, ts in targets.items() for x, w in ts.items()], "g long, dst long, term string, w double")
    want = {}
    for a, ts in donors.items():
        for b, ws in targets.items():
            r = sum(w for x, w in ws.items() if x in ts) / sum(ws.values())
            if a != b and r > epsilon:
                want[a, b] = (r, sum(x in ts for x in ws))
    got = {(r.src, r.dst): (r.ref, r.matched_count) for r in tx.ref(d, t, ["g"], epsilon).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    rows = tx.ref(d, t, ["g"], epsilon).groupBy("src").agg(F.sum("rho").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in rows)
    assert tx.ref(d.limit(0), t, ["g"]).collect() == []


def test_stems_phrases_and_similar_sets(spark):
    pairs = dict(caresses="caress", ponies="poni", agreed="agre", plastered="plaster", hopping="hop", falling="fall", filing="file", happy="happi", sky="sky", relational="relat", hopefulness="hope", adoption="adopt", controlling="control", generalizations="gener")
    assert {k: stem(k) for k in pairs} == pairs and stem("é") == "é"
    assert tx.word_phrases("Don't link 42 pages, of pages!", 2, frozenset({"of"})) == [[("dont", "dont"), ("link", "link"), ("page", "pages")], [("page", "pages")]] and tx.word_phrases(None) == []
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(tx.ngrams(F.col("w"), 2)).collect()] == [["a b", "b c"], [], []]
    r = spark.createDataFrame([([], []), (["a", "a"], ["a", "b"])], "a array<string>, b array<string>").select(tx.set_jaccard(F.col("a"), F.col("b"), 1.0)).collect()
    assert [x[0] for x in r] == [1.0, 0.5]
    base = [f"w{i}" for i in range(60)]
    sets = spark.createDataFrame([(1, 1, base), (1, 2, base), (1, 3, [*base[:57], "x"]), (1, 4, [f"z{i}" for i in range(60)])], "g long, k long, terms array<string>")
    classes = tx.signature_classes(sets, "g", "k", "terms")
    assert {(r.k, r["class"]) for r in classes.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    assert {(r.a, r.b) for r in tx.lsh_candidates(classes, "g").collect()} == {(1, 3)}


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_against_their_sql(spark):
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    for name in (n for n in oracles if n.startswith(QUICK)):
        df = queries[name](spark, DATA)
        cols = sorted(df.columns)
        want = db.sql(oracles[name])
        assert sorted(want.columns) == cols, name
        at = [want.columns.index(c) for c in cols]
        rows = sorted(repr(tuple(_plain(r[c]) for c in cols)) for r in df.collect())
        assert rows == sorted(repr(tuple(_plain(r[i]) for i in at)) for r in want.fetchall()), name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_views_of_a_run(spark, tmp_path):
    audit = SiteAudit(spark, DATA, 1)
    assert {r.run_id for r in audit.summary().collect()} == {1}
    assert {r.severity for r in audit.issues(severity="high").collect()} <= {"high"}
    assert audit.fixes(k=2).count() == 2 and {r.orphan for r in audit.orphans().collect()} <= {True}
    audit.export(audit.summary(), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 1
