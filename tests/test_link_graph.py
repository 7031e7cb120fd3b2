"""The link graph of a small site, against figures worked out by hand or by a dense solution."""

from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__

A, B, C, D, E = (f"https://a.test/{x}" for x in ("", "b", "c", "d", "e"))


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("site"))
    spark.createDataFrame([(1, "https://a.test/"), (2, "https://z.test")], "id long, root_url string").write.parquet(f"{d}/runs.parquet")
    pages = [(1, 10, "https://a.test/"), (1, 11, "HTTPS://A.test:443/b/?utm_source=x#top"), (1, 12, "https://a.test/c"), (1, 13, "https://a.test/c?x=1"), (1, 14, "https://a.test/d"), (1, 15, None)]
    spark.createDataFrame([(100 + p[1], *p) for p in pages], "id long, run_id long, fetch_id long, url string").write.parquet(f"{d}/pages.parquet")
    links = [
        (1, 1, 10, "https://a.test/b"), (1, 1, 10, "https://a.test/b"), (2, 1, 10, "https://a.test/b/"), (3, 1, 11, "https://a.test/c"), (4, 1, 12, "https://a.test/"),
        (5, 1, 13, "https://a.test/d"), (6, 1, 12, "https://a.test/./c"), (7, 1, 12, "https://a.test/%65"), (8, 1, 12, "https://other.test/"), (9, 1, 12, "mailto:x@a.test"), (10, 1, 12, None), (11, 1, 99, "https://a.test/d"),
    ]
    spark.createDataFrame([(*x, None, None, "main", None, 0) for x in links], "id long, run_id long, source_fetch_id long, resolved_url string, anchor_text string, rel string, dom_region string, template_signature string, position_index int").write.parquet(f"{d}/link_observations.parquet")
    return spark, d


def rows(site, name):
    return [tuple(r) for r in __spark_entry__.queries()[name](*site).collect()]


def test_edges_skip_copies_externals_and_later_fetches_of_a_node(site):
    assert sorted(rows(site, "op2_collapsed_edges")) == [(1, A, B, 2), (1, B, C, 1), (1, C, A, 1), (1, C, E, 1)]


def test_canonical_forms(site):
    forms = {r[0]: r[1:] for r in rows(site, "op1_canonical_urls")}
    assert forms["HTTPS://A.test:443/b/?utm_source=x#top"] == ("https://a.test/b/?utm_source=x#top", "https://a.test/b?utm_source=x", B, B)
    assert forms["https://a.test/%65"][0] == E


def test_degrees_and_depth_hold_nodes_without_links(site):
    assert {r[:3]: r[3:] for r in rows(site, "op3_degrees")}[(1, D, True)] == (0, 0, 0, 0)
    assert {r[1]: r[3] for r in rows(site, "op4_click_depth")} == {A: 0, B: 1, C: 2, E: 3, D: None, "https://z.test/": 0}


def test_components(site):
    assert {r[1]: r[2] for r in rows(site, "op5_strong_components")} == {A: A, B: A, C: A, D: D, E: E, "https://z.test/": "https://z.test/"}


def test_pagerank_counts_nodes_without_links(site):
    names, m = [A, B, C, D, E], np.zeros((5, 5))
    for s, t, w in ((0, 1, 1.0), (1, 2, 1.0), (2, 0, 0.5), (2, 4, 0.5)):
        m[t, s] = w
    m[:, [3, 4]] = 0.2
    x = np.linalg.solve(np.eye(5) - 0.85 * m, np.full(5, 0.15 / 5))
    got = {r[1]: r[2] for r in rows(site, "op6_pagerank") if r[0] == 1}
    assert [got[n] for n in names] == pytest.approx(x.tolist(), abs=1e-8)


def test_merged_nodes_keep_the_earliest_page_and_its_links(spark):
    from weblattice.plans.site import Site, merged

    seeds = spark.createDataFrame([(1, "a", "h"), (2, "a", "h")], "run_id long, node string, site string")
    first = spark.createDataFrame([(1, "a", 10, 1, 100), (1, "b", 11, 2, 101), (1, "c", 12, 1, 102), (2, "b", 20, 1, 200)], "run_id long, node string, fetch_id long, pages long, id long")
    observed = spark.createDataFrame([(1, 1, 100, "a", "b"), (1, 2, 101, "b", "c"), (1, 3, 102, "c", "a"), (2, 4, 200, "b", "c")], "run_id long, id long, doc long, src string, dst string")
    canonical = spark.createDataFrame([(1, "a", "a"), (1, "b", "c"), (1, "c", "c"), (2, "b", "c")], "run_id long, node string, canonical string")
    out = merged(Site(seeds, first, observed), canonical, spark.createDataFrame([(1,)], "run_id long"))
    assert {tuple(r) for r in out.links().collect()} == {(1, "a", "c"), (1, "c", "c"), (2, "b", "c")}
    assert {(r.run_id, r.node, r.pages, r.id) for r in out.first.collect()} == {(1, "a", 1, 100), (1, "c", 3, 101), (2, "b", 1, 200)}
