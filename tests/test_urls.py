"""URLs: RFC 3986 resolution, canonical forms and their invariants."""

from __future__ import annotations

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from weblattice.functions.urls import canonical, dot_segments, in_scope, is_utility, p0_text, resolve, resolve_text, section, short_url

BASE = "http://a/b/c/d;p?q"
# The examples of RFC 3986, sections 5.4.1 and 5.4.2.
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
    "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/",
    "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g",
    "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h",
    "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y", "g?y/../x": "http://a/b/c/g?y/../x",
}
URLS = [
    "HTTP://Ex.COM:80", "http://ex.com/a/../b/./c", "https://ex.com:443/%7euser/%e9?b=2&a=1&utm_source=x#f", "http://www.ex.com/a/?ref=1", "https://ex.com/a//", "https://ex.com/",
    "https://ex.com/é", "mailto:a@b.c", "https://u:p@WWW.ex.com/x?&&c&a=2&a=1", "https://www.com/x", "http://ex.com:8080/a?gclid=1",
]


def test_examples_of_the_rfc():
    assert {k: resolve_text(BASE, k) for k in EXAMPLES} == EXAMPLES
    assert [dot_segments(x) for x in ("a/../b", "a/..", "/a/b/c/./../../g", "mid/content=5/../6", "")] == ["/b", "/", "/a/g", "mid/6", ""]
    assert resolve_text("/relative", "x") is None and resolve_text(None, "x") is None and resolve_text(BASE, None) is None


def test_column_resolution_is_the_same(spark):
    rows = spark.createDataFrame([(BASE, k) for k in EXAMPLES] + [(None, "x"), (BASE, None)], "base string, ref string")
    got = {r.ref: r.out for r in rows.select("base", "ref", resolve(F.col("base"), F.col("ref")).alias("out")).where("base is not null").collect()}
    assert got == {**EXAMPLES, None: None}


def test_forms_are_stable_and_ever_coarser(spark):
    rows = spark.createDataFrame([(u,) for u in [*URLS, None, ""]], "url string")
    forms = [[r[0] for r in rows.select(canonical(F.col("url"), k)).collect()] for k in range(4)]
    again = [[r[0] for r in spark.createDataFrame([(u,) for u in f], "url string").select(canonical(F.col("url"), k)).collect()] for k, f in enumerate(forms)]
    assert again == forms
    for k in range(3):
        for i in range(len(forms[k])):
            for j in range(i):
                assert forms[k][i] != forms[k][j] or forms[k + 1][i] == forms[k + 1][j]
    at = dict(zip(URLS, zip(*forms)))
    assert at["HTTP://Ex.COM:80"] == ("http://ex.com/", "http://ex.com/", "http://ex.com/", "https://ex.com/")
    assert at["https://ex.com:443/%7euser/%e9?b=2&a=1&utm_source=x#f"] == ("https://ex.com/~user/%E9?b=2&a=1&utm_source=x#f", "https://ex.com/~user/%E9?b=2&a=1&utm_source=x", "https://ex.com/~user/%E9?a=1&b=2", "https://ex.com/~user/%E9")
    assert at["https://www.com/x"][3] == "https://www.com/x" and at["http://www.ex.com/a/?ref=1"][3] == "https://ex.com/a"
    assert forms[0][-2] is None and p0_text("https://ex.com/é") == "https://ex.com/%C3%A9"


@pytest.mark.parametrize("url,seed,inside,below", [
    ("https://a.com/x", "http://a.com", False, False), ("https://a.com:443/x", "https://A.com/", True, True), ("https://b.a.com/", "https://www.a.com/", False, True), ("https://ba.com/", "https://a.com/", False, False),
    ("mailto:x@a.com", "https://a.com/", False, False),
])
def test_scope(spark, url, seed, inside, below):
    r = spark.createDataFrame([(url, seed)], "u string, s string").select(in_scope(F.col("u"), F.col("s")), in_scope(F.col("u"), F.col("s"), True)).first()
    assert tuple(r) == (inside, below)


def test_parts(spark):
    r = spark.createDataFrame([("https://a.com/blog/x?q=1#f",)], "u string").select(section(F.col("u")), short_url(F.col("u")), is_utility(F.col("u"), (r"[?&](q|s)=",)), is_utility(F.col("u"), ())).first()
    assert tuple(r) == ("blog", "/blog/x?q=1", True, False)


def test_modules_import_without_a_session():
    code = "import weblattice.functions.urls, weblattice.operators.statistics, weblattice.operators.text, weblattice.api"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0
