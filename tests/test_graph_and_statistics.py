"""Graph algorithms and statistics against dense or brute-force solutions."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblattice.operators import statistics as st
from weblattice.operators.canonical import follow_redirects
from weblattice.operators.graph import betweenness, bfs_depth, brandes, collapse, degrees, mulberry32, pagerank, pagerank_per_run, scc, seeded_sample, shared_neighbours, simulate, strong_components
from weblattice.operators.links import diagnose, effort, observation_factors, prominence
from weblattice.operators.ranking import value_ranks
from weblattice.operators.skew import hot_keys, salted_join


def random_edges(seed, n=40, m=120):
    draw = random.Random(seed)
    return [(1, f"n{draw.randrange(n):02}", f"n{draw.randrange(n):02}") for _ in range(m)]


@pytest.fixture(scope="module")
def graph(spark):
    links = spark.createDataFrame(random_edges(1) + [(1, None, "n01"), (2, "a", "b"), (2, "b", "c"), (2, "c", "a")], "run_id long, src string, dst string")
    edges = collapse(links).cache()
    nodes = edges.select("run_id", F.explode(F.array("src", "dst")).alias("node")).union(spark.createDataFrame([(1, "alone")], "run_id long, node string")).distinct().cache()
    return edges, nodes


def dense(edges, nodes, run=1, d=0.85):
    names = sorted(r.node for r in nodes.collect() if r.run_id == run)
    at, n = {x: i for i, x in enumerate(names)}, len(names)
    m = np.zeros((n, n))
    for r in edges.collect():
        if r.run_id == run:
            m[at[r.dst], at[r.src]] += r.weight
    out = m.sum(0)
    m = np.where(out > 0, m / np.where(out > 0, out, 1), 1 / n)
    return dict(zip(names, np.linalg.solve(np.eye(n) - d * m, np.full(n, (1 - d) / n))))


def with_nodes(edges, nodes):
    return edges.select("run_id", "src", "dst", "weight").unionByName(nodes.select("run_id", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("bigint").alias("weight")))


def test_pagerank_against_a_dense_solution(graph):
    edges, nodes = graph
    want = dense(edges, nodes)
    per_run = {r.node: r.pagerank for r in pagerank_per_run(with_nodes(edges, nodes)).collect() if r.run_id == 1}
    assert per_run == pytest.approx(want, abs=1e-8)
    steps = {r.node: r.pagerank for r in pagerank(edges, nodes, iterations=60).collect() if r.run_id == 1}
    assert steps == pytest.approx(want, abs=1e-4)


def test_simulated_links(spark, graph):
    edges, nodes = graph
    base = dense(edges, nodes)
    zero = edges.union(spark.createDataFrame([(1, "alone", "n00", 0)], "run_id long, src string, dst string, weight long"))
    pairs = spark.createDataFrame([(1, "alone", "n00"), (1, "n00", "alone"), (1, "n00", "n00"), (1, "n00", "nowhere")], "run_id long, src string, dst string")
    seeds = spark.createDataFrame([(1, "n00")], "run_id long, node string")
    got = {(r.src, r.dst): r for r in simulate(with_nodes(zero, nodes), pairs, seeds).collect()}
    assert set(got) == {("alone", "n00"), ("n00", "alone")}
    for (a, b), r in got.items():
        after = dense(edges.union(spark.createDataFrame([(1, a, b, 1)], "run_id long, src string, dst string, weight long")), nodes)
        assert r.delta_pr == pytest.approx(after[b] - base[b], abs=1e-8)
    assert (got["n00", "alone"].depth_before, got["n00", "alone"].depth_after) == (None, 1)
    joint = {r.node: r.delta_pr for r in simulate(with_nodes(zero, nodes), pairs, seeds, joint=True).collect()}
    both = dense(edges.union(spark.createDataFrame([(1, "alone", "n00", 1), (1, "n00", "alone", 1)], "run_id long, src string, dst string, weight long")), nodes)
    assert joint == pytest.approx({k: both[k] - base[k] for k in ("n00", "alone")}, abs=1e-8)


def test_depth_components_degrees(spark, graph):
    edges, nodes = graph
    adj = {}
    for r in edges.collect():
        if r.run_id == 1:
            adj.setdefault(r.src, set()).add(r.dst)
    depth, todo = {"n00": 0}, ["n00"]
    for v in todo:
        for u in sorted(adj.get(v, ())):
            if u not in depth:
                depth[u] = depth[v] + 1
                todo.append(u)
    assert {r.node: r.depth for r in bfs_depth(edges, spark.createDataFrame([(1, "n00")], "run_id long, node string")).collect()} == depth
    reach = {}
    for v in {r.node for r in nodes.collect() if r.run_id == 1}:
        seen, todo = {v}, [v]
        for x in todo:
            for u in adj.get(x, ()):
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        reach[v] = seen
    comp = {r.node: r.component for r in scc(with_nodes(edges, nodes)).collect() if r.run_id == 1}
    assert comp == {v: min(u for u in reach[v] if v in reach[u]) for v in reach}
    assert {(r.node, r.out_degree) for r in degrees(edges).collect() if r.run_id == 1 and r.out_degree} == {(v, len(u)) for v, u in adj.items()}
    assert bfs_depth(edges.limit(0), spark.createDataFrame([], "run_id long, node string")).collect() == []


def test_large_ring_is_one_component_in_linear_time():
    n = 20_000
    assert set(strong_components(n, np.arange(n), (np.arange(n) + 1) % n).tolist()) == {0}


def test_betweenness_of_a_path_and_brute_force(spark):
    draw = random.Random(4)
    pairs = sorted({(draw.randrange(12), draw.randrange(12)) for _ in range(30)} - {(i, i) for i in range(12)})
    s, d = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    adj = {v: [b for a, b in pairs if a == v] for v in range(12)}

    def paths(a, b):
        todo, best = [[a]], None
        out = []
        while todo:
            p = todo.pop(0)
            if best is not None and len(p) > best:
                break
            if p[-1] == b:
                best = len(p)
                out.append(p)
                continue
            todo += [[*p, u] for u in adj[p[-1]] if u not in p]
        return out

    want = np.zeros(12)
    for a, b in itertools.permutations(range(12), 2):
        ps = paths(a, b)
        for p in ps:
            for v in p[1:-1]:
                want[v] += 1 / len(ps)
    assert brandes(12, s, d, range(12)) == pytest.approx(want)
    path = spark.createDataFrame([(1, "a", "b", 1), (1, "b", "c", 1)], "run_id long, src string, dst string, weight long")
    assert {r.node: r.betweenness for r in betweenness(path).collect()} == {"a": 0.0, "b": 0.5, "c": 0.0}


def test_seeded_draws():
    draw = mulberry32(42)
    assert [round(next(draw), 6) for _ in range(3)] == [0.601104, 0.448291, 0.852466]
    assert seeded_sample(10, 10, 1) == list(range(10)) and len(set(seeded_sample(1000, 100, 7))) == 100


def test_shared_neighbours(spark):
    e = spark.createDataFrame([(1, a, b, 1) for a, b in ("ax", "bx", "ay", "yb", "zx")], "run_id long, src string, dst string, weight long")
    r = shared_neighbours(e, spark.createDataFrame([(1, "a", "b")], "run_id long, src string, dst string")).first()
    assert r.common == 2 and r.adamic_adar == pytest.approx(1 / math.log(3) + 1 / math.log(2))


def test_redirect_chains_and_loops(spark):
    chain = [(1, f"c{i:03}", f"c{i + 1:03}") for i in range(100)] + [(1, f"l{i:02}", f"l{(i + 1) % 37:02}") for i in range(37)] + [(1, "into", "l20"), (2, "x", "y"), (None, "p", "q")]
    got = {(r.run_id, r.src): r.dst for r in follow_redirects(spark.createDataFrame(chain, "run_id long, src string, dst string")).collect()}
    assert all(got[1, f"c{i:03}"] == "c100" for i in range(100))
    assert {got[1, f"l{i:02}"] for i in range(37)} == {"l00"} and got[1, "into"] == "l00" and got[2, "x"] == "y" and got[None, "p"] == "q"


def test_prominence_effort_and_cases(spark):
    o = spark.createDataFrame([
        (1, 1, "a", "b", "main", "t1", 0), (1, 2, "a", None, None, None, 1), (1, 3, "a", "c", "body", "t2", 2), (1, 4, "a", "b", "footer", "f", 3), (1, 5, "b", "c", "footer", "f", 0), (1, 6, "b", "b", "nav", None, 1),
    ], "run_id long, id long, src string, dst string, dom_region string, template_signature string, position_index int")
    pages = spark.createDataFrame([(1, 3)], "run_id long, pages long")
    f = observation_factors(o, pages)
    assert {r.id: round(r.weight, 6) for r in f.collect()} == {1: 1.0, 2: round(1 / 1.1, 6), 3: round(1 / 1.2, 6), 4: 0.03, 5: 0.03, 6: 0.3}
    p = {(r.src, r.dst): r for r in prominence(f).collect()}
    assert p["a", "b"].weight == pytest.approx(1.03) and sum(r.omega for k, r in p.items() if k[0] == "a") == pytest.approx(1) and ("b", "b") not in p
    clicked = {(r.src, r.dst): (r.weight, r.origin) for r in prominence(f, spark.createDataFrame([(1, "a", "c", 5)], "run_id long, src string, dst string, clicks long")).collect()}
    assert clicked == {("a", "b"): (0.0, "analytics"), ("a", "c"): (5.0, "analytics"), ("b", "c"): (0.03, "structural")}
    first = spark.createDataFrame([(1, "a"), (1, "b"), (1, "z")], "run_id long, node string")
    assert {r.node: (r.kappa, r.reach, r.body_links) for r in effort(o, first, pages).collect()} == {"a": (2, 1, 3), "b": (1, 1, 0), "z": (1, 1, 0)}
    refs = spark.createDataFrame([(1, "a", "b", 0.5, 0.5), (1, "a", "z", 0.5, 0.5), (1, "b", "c", 0.3, 0.05)], "run_id long, src string, dst string, ref double, rho double")
    texts = spark.createDataFrame([(1, x) for x in "abcz"], "run_id long, node string")
    assert {(r.src, r.dst): r.case for r in diagnose(refs, prominence(f), texts).collect()} == {("a", "b"): "v2", ("a", "z"): "v4", ("a", "c"): "v1", ("b", "c"): "v1"}


def test_ranks_over_range_partitions(spark):
    draw = random.Random(9)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, float("nan"), *[float(x) for x in range(50)]])) for _ in range(3000)]
    got = {(r.g, r.v): (r.n, r.below, r.total) for r in value_ranks(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v").collect()}
    want = {}
    for g in ("a", "b", None):
        vs = sorted(v for h, v in rows if h == g and v is not None and not math.isnan(v))
        want |= {(g, v): (vs.count(v), sum(x < v for x in vs), len(vs)) for v in set(vs)}
    assert got == want


def test_statistics_against_numpy(spark):
    draw = np.random.default_rng(5)
    x, y = draw.integers(0, 20, 400).astype(float), draw.integers(0, 20, 400).astype(float)
    y[:200] = x[:200]
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "g long, x double, y double")

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    assert st.spearman(df, ["g"], "x", "y").first().spearman == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    s, n = np.sort(x), len(x)
    assert st.gini(df, ["g"], "x").first().gini == pytest.approx(2 * (np.arange(1, n + 1) * s).sum() / (n * s.sum()) - (n + 1) / n)
    d = x - y
    d = d[d != 0]
    r = st.wilcoxon(df.withColumn("d", F.col("x") - F.col("y")), ["g"], "d").first()
    assert (r.w_plus, r.w_minus) == pytest.approx((ranks(abs(d))[d > 0].sum(), ranks(abs(d))[d < 0].sum()))
    assert st.wilcoxon_p(0, 5) == pytest.approx(2 / 32) and st.wilcoxon_p(3, 6) == pytest.approx(2 * 5 / 64)
    assert st.gamma_q(0.5, 3.841458820694124 / 2) == pytest.approx(0.05) and st.gamma_q(5, 18.307038053275146 / 2) == pytest.approx(0.05)
    b = st.bootstrap_ci(df.withColumn("c", F.monotonically_increasing_id()), ["g"], "c", "x").first()
    assert b.low < b.estimate < b.high and b.high - b.low == pytest.approx(2 * 1.96 * x.std() / 20, rel=0.2)
    k = st.kruskal_wallis(df.withColumn("level", (F.col("y") > 10).cast("int")), ["g"], "level", "x").first()
    assert 0 <= k.p <= 1 and k.levels == 2
    one = spark.createDataFrame([(1, t, float(v)) for t, v in (("a", 1), ("b", 2), ("c", 3))] + [(2, t, float(v)) for t, v in (("a", 2), ("b", 4), ("c", 9))] + [(3, "a", 1.0)], "g long, t string, v double")
    f = st.friedman(one, ["g"], "t", "v", 3).first()
    assert (f.blocks, f.statistic) == (2, pytest.approx(4.0))


def test_salted_join_keeps_nulls_and_hot_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(6000)] + [(None, -1), ("cold", -2), ("none", -3)], "k string, v long")
    keys = spark.createDataFrame([("hot", "H"), (None, "N"), ("cold", "C")], "k string, name string")
    counts = rows.groupBy("k").count().withColumnRenamed("count", "n")
    assert [r.k for r in hot_keys(counts, ["k"]).collect()] == ["hot"]
    got = salted_join(rows, keys, ["k"], F.col("v"), counts)
    assert got.count() == rows.count() and {(r.k, r.name) for r in got.where("v < 1").collect()} == {("hot", "H"), (None, "N"), ("cold", "C"), ("none", None)}
