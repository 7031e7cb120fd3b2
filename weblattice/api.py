"""One run's audit, or all runs', as DataFrames with the parameters that a report asks for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblattice.plans import link_graph, link_model, pool_statistics, texts


@dataclass(frozen=True)
class SiteAudit:
    """Views over the tables of a folder; ``run_id`` keeps one run, without it all runs come out."""

    spark: SparkSession
    folder: str
    run_id: int | None = None

    def _of_run(self, df: DataFrame) -> DataFrame:
        return df if self.run_id is None else df.where(F.col("run_id") == self.run_id)

    def graph(self) -> DataFrame:
        """Nodes with depth, PageRank, component and degrees."""
        return self._of_run(link_model.graph_facts(link_model.site(self.spark, self.folder))[0])

    def edges(self) -> DataFrame:
        return self._of_run(link_graph.op2_collapsed_edges(self.spark, self.folder))

    def links(self) -> DataFrame:
        """Pairs of pages with prominence."""
        return self._of_run(link_model.op42_prominence(self.spark, self.folder))

    def health(self, outcome: str | None = None) -> DataFrame:
        out = self._of_run(link_model.op50_link_health(self.spark, self.folder))
        return out if outcome is None else out.where(F.col("outcome") == outcome)

    def issues(self, type: str | None = None, severity: str | None = None) -> DataFrame:  # noqa: A002 - the report's own word
        """Structural issues, the gravest first."""
        out = self._of_run(link_model.op48_structural_issues(self.spark, self.folder))
        for name, value in (("type", type), ("severity", severity)):
            out = out if value is None else out.where(F.col(name) == value)
        rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
        return out.orderBy(rank, "type", "rule", "run_id", "node")

    def diagnosis(self, case: str | None = None) -> DataFrame:
        out = self._of_run(link_model.op47_four_cases(self.spark, self.folder))
        out = out if case is None else out.where(F.col("case") == case)
        order = F.array_position(F.array(*[F.lit(c) for c in ("v4", "v3", "v1", "v2")]), F.col("case"))
        return out.orderBy(order, F.desc("severity"), "run_id", "src", "dst")

    def related(self) -> DataFrame:
        return self._of_run(texts.op64_ref(self.spark, self.folder))

    def fixes(self, k: int = 10, scope: str = "run") -> DataFrame:
        """The first ``k`` ranked fixes of each run (at most 10), or of each target (at most 3)."""
        out = self._of_run(pool_statistics.op36_fix_ranking(self.spark, self.folder))
        return out.where((F.col("scope") == scope) & (F.col("rank") <= k))

    def orphans(self) -> DataFrame:
        return self._of_run(link_model.op52_inventory(self.spark, self.folder)).where("orphan")

    def reconciliation(self) -> DataFrame:
        return self._of_run(link_model.op53_channel_yield(self.spark, self.folder))

    def sensitivity(self) -> DataFrame:
        """How pairs of canonicalisation policies differ."""
        return self._of_run(link_graph.op19_policy_pairs(self.spark, self.folder))

    def summary(self) -> DataFrame:
        return self._of_run(link_graph.op12_graph_summary(self.spark, self.folder))

    def export(self, view: DataFrame, path: str, format: str = "csv") -> None:  # noqa: A002 - as in DataFrameWriter
        """A view as files; CSV with a header and quotes doubled."""
        writer = view.write.mode("errorifexists")
        if format == "csv":
            writer.option("header", True).option("escape", '"').csv(path)
        else:
            writer.format(format).save(path)
