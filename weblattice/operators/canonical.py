"""Policies P4 and P5: recorded redirects and declared canonicals over P3 nodes.

Edges are keyed by run: (run_id, src, dst). All steps are joins over all runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblattice.functions.urls import part
from weblattice.session import checkpointed


def chosen_edges(edges: DataFrame) -> DataFrame:
    """One edge per source: the target observed most often, of equals the smallest; self-edges and nulls don't count."""
    votes = edges.where("src is not null and dst is not null and src != dst").groupBy("run_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("run_id", "src").agg(F.min_by("dst", F.struct((-F.col("n")).alias("n"), F.col("dst"))).alias("dst"))


def follow_redirects(edges: DataFrame) -> DataFrame:
    """(run_id, src, dst): each source with the end of its chain; from a loop, or into one, the loop's smallest node.

    Pointer doubling: every round doubles the steps a row has taken, so chains
    of length n take log2(n) joins. A row also keeps the smallest node of its
    latest steps; once the open rows have taken more steps than there are open
    rows, they are on their loop, and have been round it.
    """
    at = checkpointed(chosen_edges(edges).select("run_id", "src", "dst", F.col("dst").alias("least")))
    steps = 1
    while True:
        onward = at.select(F.col("run_id").alias("_r"), F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("least").alias("_l"))
        joined = at.join(onward, at["run_id"].eqNullSafe(onward["_r"]) & (at["dst"] == onward["_s"]), "left")
        at = checkpointed(joined.select("run_id", "src", F.coalesce("_d", "dst").alias("dst"), F.when(F.col("_d").isNull(), F.col("dst")).otherwise(F.least("least", "_l")).alias("least"), F.col("_d").isNotNull().alias("open")))
        steps *= 2
        still = at.where("open").count()
        if still == 0 or steps > 2 * still:
            break
    # An open row's latest steps went round its loop once the row itself stood on it: its end's smallest node is the loop's.
    ends = at.where("open").select(F.col("run_id").alias("_r"), F.col("src").alias("_s"), F.col("least").alias("_l"))
    out = at.join(ends, at["run_id"].eqNullSafe(ends["_r"]) & (at["dst"] == ends["_s"]), "left")
    return out.select("run_id", "src", F.coalesce("_l", "dst").alias("dst"))


def same_site(a: Column, b: Column) -> Column:
    return (part(a, 1) == part(b, 1)) & (part(a, 2) == part(b, 2)) & (part(a, 2) != "")


def follow_canonicals(nodes: DataFrame, canonicals: DataFrame, fetched: DataFrame, max_hops: int = 3) -> DataFrame:
    """(run_id, node, canonical) of P4 nodes under declared canonicals.

    A hop counts if its target is on the same site and was fetched; the walk
    stops at the node where a cycle begins; a chain of more than ``max_hops``
    hops is not trusted, and the node stays. ``nodes`` and ``fetched`` have
    (run_id, node). The walk is ``max_hops`` + 1 joins.
    """
    ok = fetched.select("run_id", F.col("node").alias("dst")).distinct()
    valid = checkpointed(chosen_edges(canonicals)).where(same_site(F.col("src"), F.col("dst"))).join(ok, ["run_id", "dst"], "left_semi")
    hop = valid.select(F.col("run_id").alias("_r"), F.col("src").alias("_s"), F.col("dst").alias("_d"))
    state = nodes.select("run_id", "node").distinct().select("run_id", "node", F.array("node").alias("path"), F.lit(None).cast("string").alias("end"))
    for _ in range(max_hops + 1):
        last = F.element_at("path", -1)
        j = state.join(hop, state["run_id"].eqNullSafe(hop["_r"]) & F.col("end").isNull() & (last == hop["_s"]), "left")
        end = (
            F.when(F.col("end").isNotNull(), F.col("end")).when(F.col("_d").isNull(), last).when(F.array_contains("path", F.col("_d")), F.col("_d"))
            .when(F.size("path") > max_hops, F.col("node"))
        )
        # Written per hop: else the next join would spell out the whole walk so far.
        state = checkpointed(j.select("run_id", "node", F.when(F.col("_d").isNotNull(), F.array_append("path", F.col("_d"))).otherwise(F.col("path")).alias("path"), end.alias("end")))
    return state.select("run_id", "node", F.coalesce("end", "node").alias("canonical"))
