"""Link graphs keyed by run: edges, degrees, depth, components, PageRank, centrality.

All functions take edges as (run_id, src, dst, weight) with parallel links
already collapsed, and work on all runs at once. Iterative ones loop over
DataFrames and cut their lineage with reliable checkpoints.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblattice.session import checkpointed


def collapse(links: DataFrame) -> DataFrame:
    """Weighted digraph from (run_id, src, dst) links; self-links and null ends dropped."""
    return links.where("src is not null and dst is not null and src != dst").groupBy("run_id", "src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def nodes_of(edges: DataFrame) -> DataFrame:
    """(run_id, node) of both ends."""
    return edges.select("run_id", F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(run_id, node, out_degree, in_degree, out_weight, in_weight) in one aggregate."""
    ends = edges.select("run_id", "weight", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out")))).alias("e"))
    return ends.groupBy("run_id", F.col("e.node").alias("node")).agg(
        F.sum("e.out").alias("out_degree"), F.sum(1 - F.col("e.out")).alias("in_degree"),
        F.sum(F.col("weight") * F.col("e.out")).alias("out_weight"), F.sum(F.col("weight") * (1 - F.col("e.out"))).alias("in_weight"),
    )


def bfs_depth(edges: DataFrame, seeds: DataFrame, max_depth: int = 1000, every: int = 4) -> DataFrame:
    """(run_id, node, depth) of nodes reachable from (run_id, node) seeds.

    The frontier joins the edges; found nodes leave by an anti join. One
    count per level ends the loop; every few levels the lineage is cut.
    """
    pairs = edges.select("run_id", F.col("src").alias("node"), "dst")
    found = checkpointed(seeds.select("run_id", "node").distinct().withColumn("depth", F.lit(0)))
    frontier = found
    for level in range(1, max_depth + 1):
        reached = frontier.select("run_id", "node").join(pairs, ["run_id", "node"]).select("run_id", F.col("dst").alias("node")).distinct()
        new = checkpointed(reached.join(found, ["run_id", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if new.isEmpty():
            break
        found = found.unionByName(new)
        if level % every == 0:
            found = checkpointed(found)
        frontier = new
    return found


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, iterations: int | None = None, tolerance: float = 1e-10, max_iterations: int = 1000, every: int = 5) -> DataFrame:
    """(run_id, node, pagerank) for all runs, as a join-and-aggregate loop.

    Dangling nodes spread evenly. With ``iterations`` exactly so many steps are
    taken; else until every run's L1 change is below ``tolerance``. For many
    small graphs :func:`pagerank_per_run` is faster; this one has no bound on
    the size of a run.
    """
    sizes = nodes.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    out = edges.groupBy("run_id", "src").agg(F.sum("weight").alias("total")).where("total > 0")
    steps = checkpointed(edges.join(out, ["run_id", "src"]).select("run_id", "src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    base = checkpointed(
        nodes.join(sizes, "run_id").join(out.select("run_id", F.col("src").alias("node"), F.lit(False).alias("dangling")), ["run_id", "node"], "left")
        .select("run_id", "node", "n", F.coalesce("dangling", F.lit(True)).alias("dangling"))
    )
    rank = base.select("run_id", "node", (F.lit(1.0) / F.col("n")).alias("pagerank"))
    for k in range(1, (iterations or max_iterations) + 1):
        lost = base.join(rank, ["run_id", "node"]).groupBy("run_id").agg(F.sum(F.when(F.col("dangling"), F.col("pagerank")).otherwise(0.0)).alias("lost"))
        got = steps.join(rank.withColumnRenamed("node", "src"), ["run_id", "src"]).groupBy("run_id", F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("pagerank")).alias("got"))
        new = base.join(got, ["run_id", "node"], "left").join(lost, "run_id").select(
            "run_id", "node", ((1 - damping) / F.col("n") + damping * F.col("lost") / F.col("n") + damping * F.coalesce("got", F.lit(0.0))).alias("pagerank")
        )
        if iterations is None or k % every == 0:
            new = checkpointed(new)
        if iterations is None:
            old = rank.withColumnRenamed("pagerank", "old")
            worst = new.join(old, ["run_id", "node"]).groupBy("run_id").agg(F.sum(F.abs(F.col("pagerank") - F.col("old"))).alias("l1")).agg(F.max("l1")).first()[0]
            rank = new
            if worst is None or worst < tolerance:
                break
        else:
            rank = new
    return rank


def power_iteration(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, damping: float = 0.85, tolerance: float = 1e-10, max_iterations: int = 1000, start: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """PageRank of one graph in memory, and the number of steps."""
    out = np.bincount(src, weights=weight, minlength=n) if len(src) else np.zeros(n)
    share = np.divide(weight, out[src], out=np.zeros(len(src)), where=out[src] > 0) if len(src) else weight
    dangling = out == 0
    x = np.full(n, 1.0 / max(n, 1)) if start is None else start
    for k in range(1, max_iterations + 1):
        y = (1 - damping) / n + damping * x[dangling].sum() / n + damping * np.bincount(dst, weights=share * x[src], minlength=n)
        change = np.abs(y - x).sum()
        x = y
        if change < tolerance:
            return x, k
    return x, max_iterations


def _indexed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, sources, targets and weights; a self-link is no link, but names a node."""
    names, codes = np.unique(np.concatenate([pdf["src"], pdf["dst"]]), return_inverse=True)
    m = len(pdf)
    link = codes[:m] != codes[m:]
    return names, codes[:m][link], codes[m:][link], pdf["weight"].to_numpy(float)[link]


def pagerank_per_run(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-10, max_iterations: int = 1000) -> DataFrame:
    """Converged PageRank, one run per task in NumPy; for runs whose edges fit a task (a crawl's page cap bounds them)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s, d, w = _indexed(pdf)
        if not len(names):
            return pd.DataFrame({"run_id": [], "node": [], "pagerank": [], "steps": []})
        x, k = power_iteration(len(names), s, d, w, damping, tolerance, max_iterations)
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "node": names, "pagerank": x, "steps": k})

    return edges.select("run_id", "src", "dst", "weight").groupBy("run_id").applyInPandas(run, "run_id long, node string, pagerank double, steps int")


def strong_components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Component of each node, named by its smallest member; iterative Tarjan."""
    order = np.argsort(src, kind="stable")
    heads, starts = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    index, low, comp = [-1] * n, [0] * n, [-1] * n
    on, stack, at = [False] * n, [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, starts[root])]
        index[root] = low[root] = at
        at += 1
        stack.append(root)
        on[root] = True
        while work:
            v, e = work.pop()
            if e < starts[v + 1]:
                work.append((v, e + 1))
                u = heads[e]
                if index[u] < 0:
                    index[u] = low[u] = at
                    at += 1
                    stack.append(u)
                    on[u] = True
                    work.append((u, starts[u]))
                elif on[u]:
                    low[v] = min(low[v], index[u])
                continue
            if low[v] == index[v]:
                members = []
                while True:
                    u = stack.pop()
                    on[u] = False
                    members.append(u)
                    if u == v:
                        break
                name = min(members)
                for u in members:
                    comp[u] = name
            if work:
                p = work[-1][0]
                low[p] = min(low[p], low[v])
    return np.array(comp, dtype=np.int64)


def scc(edges: DataFrame) -> DataFrame:
    """(run_id, node, component): strongly connected components per run, named by their smallest node."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s, d, _ = _indexed(pdf)
        comp = strong_components(len(names), s, d)
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "node": names, "component": names[comp] if len(names) else names})

    return edges.select("run_id", "src", "dst", "weight").groupBy("run_id").applyInPandas(run, "run_id long, node string, component string")


def brandes(n: int, src: np.ndarray, dst: np.ndarray, sources) -> np.ndarray:
    """Sum of dependencies of all nodes over the given sources (parallel links count once)."""
    adj: list[list[int]] = [[] for _ in range(n)]
    for a, b in sorted(set(zip(src.tolist(), dst.tolist()))):
        adj[a].append(b)
    total = np.zeros(n)
    for s in sources:
        dist, sigma, seen, back = {s: 0}, {s: 1.0}, [s], {}
        for v in seen:
            for u in adj[v]:
                if u not in dist:
                    dist[u] = dist[v] + 1
                    sigma[u] = 0.0
                    seen.append(u)
                if dist[u] == dist[v] + 1:
                    sigma[u] += sigma[v]
                    back.setdefault(u, []).append(v)
        delta = dict.fromkeys(seen, 0.0)
        for u in reversed(seen):
            for v in back.get(u, ()):
                delta[v] += sigma[v] / sigma[u] * (1 + delta[u])
            if u != s:
                total[u] += delta[u]
    return total


def betweenness(edges: DataFrame, exact_to: int = 300, sampled: int = 100, seed: int = 42) -> DataFrame:
    """(run_id, node, betweenness), normalised by (N-1)(N-2); larger graphs from sampled sources, scaled."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s, d, _ = _indexed(pdf)
        n = len(names)
        sources = range(n) if n <= exact_to else seeded_sample(n, sampled, seed)
        total = brandes(n, s, d, list(sources)) * (n / max(len(sources), 1))
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "node": names, "betweenness": total / max((n - 1) * (n - 2), 1)})

    return edges.select("run_id", "src", "dst", "weight").groupBy("run_id").applyInPandas(run, "run_id long, node string, betweenness double")


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.select("run_id", F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e")).select("run_id", "e.a", "e.b").distinct()


def shared_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(run_id, src, dst, common, adamic_adar) of given pairs.

    Asked pairs drive the join, so no pair of a hub's neighbours is formed
    that nobody asked for. Neighbours of degree 1 weigh nothing.
    """
    u = _undirected(edges)
    deg = u.groupBy("run_id", F.col("a").alias("via")).agg(F.count(F.lit(1)).alias("deg"))
    left = pairs.select("run_id", "src", "dst").distinct().join(u.select("run_id", F.col("a").alias("src"), F.col("b").alias("via")), ["run_id", "src"])
    both = left.join(u.select("run_id", F.col("a").alias("dst"), F.col("b").alias("via")), ["run_id", "dst", "via"], "left_semi").join(deg, ["run_id", "via"])
    return both.groupBy("run_id", "src", "dst").agg(
        F.count(F.lit(1)).alias("common"), F.sum(F.when(F.col("deg") > 1, 1.0 / F.log("deg")).otherwise(0.0)).alias("adamic_adar")
    )


def mulberry32(seed: int):
    """The public 32-bit generator of that name: floats in [0, 1)."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t = ((t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF) ^ t
        yield ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296


def seeded_sample(n: int, k: int, seed: int) -> list[int]:
    """``k`` of ``range(n)`` without replacement, in order: the first k swaps of a Fisher-Yates shuffle."""
    at, draw = list(range(n)), mulberry32(seed)
    for i in range(min(k, n)):
        j = i + int(next(draw) * (n - i))
        at[i], at[j] = at[j], at[i]
    return sorted(at[: min(k, n)])


def levels(n: int, src: np.ndarray, dst: np.ndarray, seeds) -> np.ndarray:
    """Click depth of each node, -1 where no path leads; links without weight count too."""
    depth = np.full(n, -1, dtype=np.int64)
    depth[list(seeds)] = 0
    for d in range(n):
        new = np.unique(dst[depth[src] == d])
        new = new[depth[new] < 0]
        if not len(new):
            break
        depth[new] = d + 1
    return depth


def raised(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, i, j, to: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The links with i -> j of weight ``to`` at least, and whether that changed anything; never lowered."""
    here = np.flatnonzero((src == i) & (dst == j))
    if not len(here):
        return np.append(src, i), np.append(dst, j), np.append(weight, to), True
    if weight[here].max() >= to:
        return src, dst, weight, False
    w = weight.copy()
    w[here[0]] = to
    return src, dst, w, True


def _simulated(left: pd.DataFrame, right: pd.DataFrame, cols: list[str], damping: float, tolerance: float, joint: bool) -> pd.DataFrame:
    if not len(left) or not len(right):
        return pd.DataFrame({c: [] for c in cols})
    run_id = left["run_id"].iloc[0]
    names, s, d, w = _indexed(left)
    n, place = len(names), {x: i for i, x in enumerate(names)}
    seeds = [place[x] for x in sorted(set(left.loc[left["is_seed"].fillna(False).astype(bool), "src"])) if x in place]
    base, _ = power_iteration(n, s, d, w, damping, tolerance)
    before = levels(n, s, d, seeds)
    rows = right.sort_values(["src", "dst"]).drop_duplicates(["src", "dst"])
    steps = [(place.get(a), place.get(b), a, b) for a, b in zip(rows["src"], rows["dst"])]
    steps = [x for x in steps if x[0] is not None and x[1] is not None and x[0] != x[1]]
    out = []
    if joint:
        ns, nd, nw = s, d, w
        for i, j, _, _ in steps:
            ns, nd, nw, _ = raised(ns, nd, nw, i, j)
        x, _ = power_iteration(n, ns, nd, nw, damping, tolerance, start=base)
        after = levels(n, ns, nd, seeds)
        for j in sorted({j for _, j, _, _ in steps}):
            out.append((run_id, names[j], float(x[j] - base[j]), None if before[j] < 0 else int(before[j]), None if after[j] < 0 else int(after[j])))
        return pd.DataFrame(out, columns=cols)
    for i, j, a, b in steps:
        ns, nd, nw, changed = raised(s, d, w, i, j)
        if not changed:
            out.append((run_id, a, b, 0.0, 0.0, *[None if before[j] < 0 else int(before[j])] * 2))
            continue
        x, _ = power_iteration(n, ns, nd, nw, damping, tolerance, start=base)
        # A new link can only bring its target nearer by way of its source.
        near = int(before[i]) + 1 if before[i] >= 0 and (before[j] < 0 or before[i] + 1 < before[j]) else int(before[j])
        out.append((run_id, a, b, float(x[j] - base[j]), float(np.abs(x - base).sum()), None if before[j] < 0 else int(before[j]), None if near < 0 else near))
    return pd.DataFrame(out, columns=cols)


def _with_seeds(edges: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """Edges with ``is_seed``; a seed is told by a self-link without weight."""
    out = edges.select("run_id", "src", "dst", "weight", F.lit(False).alias("is_seed"))
    if seeds is None:
        return out
    return out.unionByName(seeds.select("run_id", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("bigint").alias("weight"), F.lit(True).alias("is_seed")))


def simulate(edges: DataFrame, candidates: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, tolerance: float = 1e-10, joint: bool = False) -> DataFrame:
    """What adding (or raising to weight 1, never lowering) links does.

    Alone, one row per candidate: (run_id, src, dst, delta_pr, l1, depth_before,
    depth_after), each simulated by itself. ``joint``: all of a run's candidates
    together, one row per target: (run_id, node, delta_pr, depth_before,
    depth_after). Simulations start from the converged scores of the run.

    A run's graph and its candidates meet in one task; a crawl's page limit
    bounds both. Candidates whose ends are no nodes, and self-links, have no
    row. Without ``seeds`` depths are null.
    """
    cols = ["run_id", "node", "delta_pr", "depth_before", "depth_after"] if joint else ["run_id", "src", "dst", "delta_pr", "l1", "depth_before", "depth_after"]
    schema = "run_id long, node string, delta_pr double, depth_before long, depth_after long" if joint else "run_id long, src string, dst string, delta_pr double, l1 double, depth_before long, depth_after long"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = _simulated(left, right, cols, damping, tolerance, joint)
        texts = {c: object for c in ("src", "dst", "node") if c in cols}
        return out.astype({"run_id": "int64", "depth_before": "Int64", "depth_after": "Int64", **{c: float for c in ("delta_pr", "l1") if c in cols}, **texts})

    return _with_seeds(edges, seeds).groupBy("run_id").cogroup(candidates.select("run_id", "src", "dst").groupBy("run_id")).applyInPandas(run, schema)
