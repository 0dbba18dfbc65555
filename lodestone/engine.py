"""One object over a source tree: scan, parse, and ask."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import __version__, exporters
from lodestone.operators import graph as G
from lodestone.operators import text
from lodestone.operators.scoring import file_scores
from lodestone.plans.graph_queries import entry_points, file_of
from lodestone.session import materialize
from lodestone.sources import git_text, python_source, registry
from lodestone.sources.scan import layer_overview, scan


class Engine:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @cached_property
    def files(self) -> DataFrame:
        return materialize(scan(self.spark, self.path), "files")

    @cached_property
    def python_rows(self) -> DataFrame:
        return materialize(python_source.parse(self.files.where("ext = '.py'")), "rows")

    @cached_property
    def edges(self) -> DataFrame:
        return materialize(registry.project_edges(self.files), "edges")

    @cached_property
    def functions(self) -> DataFrame:
        return python_source.functions(self.python_rows)

    def nodes(self) -> DataFrame:
        return G.nodes_of(self.edges).union(self.functions.select("node")).distinct()

    def find(self, name: str) -> DataFrame:
        """Functions whose name ends a node id."""
        return self.nodes().where(F.endswith("node", F.lit("::" + name)) | (F.col("node") == name))

    def impact(self, name: str, tests_only: bool = False) -> DataFrame:
        r = G.reach(self.edges, self.find(name), backwards=True)
        return r.where(file_of().startswith("test")) if tests_only else r

    def explain(self, name: str) -> DataFrame:
        p = G.shortest_paths(self.edges, self.find(name))
        return p.select("node", "depth", F.array_join("path", " <- ").alias("via"))

    def dead_code(self) -> DataFrame:
        entries = materialize(entry_points(self.edges).union(python_source.entry_points(self.python_rows)).distinct(), "entries")
        live = G.reach(self.edges, entries).select("node").union(entries)
        return self.nodes().join(live, "node", "left_anti")

    def cycles(self, max_length: int | None = None) -> DataFrame:
        return G.simple_cycles(self.edges, max_length)

    def hotspots(self, n: int = 10) -> DataFrame:
        bonus = F.greatest(F.coalesce("ccn", F.lit(1)) - 1, F.lit(0))
        r = G.impact_sizes(self.edges).join(self.functions.select("node", "ccn"), "node", "left").join(G.degrees(self.edges), "node")
        return r.select("node", (F.col("impact") + bonus).alias("risk"), "outgoing", "incoming").orderBy(F.desc("risk"), F.desc("outgoing"), F.desc("incoming"), F.desc("node")).limit(n)

    def overview(self) -> DataFrame:
        """Files per layer."""
        return layer_overview(self.files)

    def timeline(self, last: DataFrame, before: DataFrame) -> DataFrame:
        """Every node by whether the last changed files (path) or those before them hold it."""
        n = self.nodes().withColumn("path", file_of())
        mark = lambda x, name: x.select("path").distinct().withColumn(name, F.lit(True))
        j = n.join(mark(last, "changed_last"), "path", "left").join(mark(before, "changed_before"), "path", "left")
        return j.select("node", F.coalesce("changed_last", F.lit(False)).alias("changed_last"), F.coalesce("changed_before", F.lit(False)).alias("changed_before"))

    def blast_radius(self, changed: DataFrame, max_depth: int = 3) -> DataFrame:
        """(node, depth): functions that reach those of the changed files (path) within some steps."""
        start = materialize(self.nodes().withColumn("path", file_of()).join(changed.select("path"), "path", "left_semi").select("node"), "changed")
        return G.reach(self.edges, start, backwards=True, max_depth=max_depth, closed=start)

    def health(self) -> DataFrame:
        """(path, defect, maintainability, performance) of every file, ten where nothing was found."""
        found = self.findings().select(file_of().alias("file_path"), "biomarker_type", "severity", F.lit(None).cast("double").alias("deduction"))
        scores = file_scores(found).withColumnRenamed("file_path", "path")
        return self.files.select("path").join(scores, "path", "left").fillna(10.0, ["defect", "maintainability", "performance"])

    def diff(self, other: Engine) -> DataFrame:
        """(node, side): functions that only this tree has (head) or only the other one (base)."""
        a, b = self.nodes(), other.nodes()
        return a.subtract(b).withColumn("side", F.lit("head")).unionByName(b.subtract(a).withColumn("side", F.lit("base")))

    def duplication(self, size: int = 20) -> DataFrame:
        return text.clones(self.files.select(F.col("path").alias("file"), text.codes(F.col("content")).alias("codes")), size)

    def changed(self, status_lines: DataFrame) -> DataFrame:
        return git_text.changed_functions(self.nodes(), git_text.code_changes(git_text.worktree_changes(status_lines)))

    def complexity(self, n: int = 20) -> DataFrame:
        return self.functions.select("node", "ccn").orderBy(F.desc("ccn"), "node").limit(n)

    def findings(self) -> DataFrame:
        return python_source.syntax_findings(self.python_rows)

    def mermaid(self) -> str:
        return exporters.mermaid(self.edges)

    def sarif(self) -> str:
        d = G.degrees(self.edges).where("outgoing > 0").join(self.functions.select("node", "lineno"), "node", "left")
        return exporters.sarif(d.select("node", F.when(F.col("outgoing") >= 5, "error").otherwise("warning").alias("level"), F.format_string("calls %d functions", "outgoing").alias("text"), F.col("lineno").alias("line")), __version__)
