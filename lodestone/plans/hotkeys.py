"""Problem 3: importers per target against the stored number of dependents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.eager import eager_join, roll_up
from lodestone.tables import once, table


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "kg_edges").where((F.col("type") == "imports") & (F.col("source") != F.col("target")))
    return e.select("source", "target")


def dependents(spark: SparkSession, d: str) -> DataFrame:
    """One row per file: its stored dependents_count and the counted importers, 0 when there is none.

    Edges shrink to one row per (target, source), spread by both, and then to one state per target; files to one state per
    path and numbers; the states join, their counts multiply, and what is joined is rolled up to files."""
    edges = import_edges(spark, d).where(F.col("target").isNotNull() & F.col("source").isNotNull()).distinct()
    by = ("file_id", "repo_id", "dependents_count")
    files = once(table(spark, d, "file_contexts"), "file_path", *by)
    states = eager_join(files, edges, "file_path", "target", right_sums={"importers": F.lit(1)}, how="left", left_by=by)
    return roll_up(states, [F.col(c) for c in ("key", *by)], ["importers"]).select("file_id", "repo_id", F.col("key").alias("file_path"), "dependents_count", F.coalesce("importers", F.lit(0)).alias("importers"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return dependents(spark, d).where(F.col("dependents_count") != F.col("importers")).select("file_id")


def p3_dependents(spark: SparkSession, d: str) -> DataFrame:
    """Per repository: files, stored and counted dependents, files whose stored number is off."""
    x = dependents(spark, d)
    off = (F.col("dependents_count") != F.col("importers")).cast("long")
    return x.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.sum("dependents_count").cast("long").alias("stored"), F.sum("importers").cast("long").alias("counted"), F.sum(F.coalesce(off, F.lit(0))).cast("long").alias("off"))


def p3_edge_findings(spark: SparkSession, d: str) -> DataFrame:
    """Per edge type, the rows and the summed impact of ``kg_edges JOIN health_findings`` on the target file, without
    building the join: both sides are hot on the same files."""
    edges = table(spark, d, "kg_edges").select("source", "target", "type").distinct()
    found = table(spark, d, "health_findings").select("finding_id", "file_path", F.col("health_impact").cast("decimal(18,6)").alias("health_impact")).distinct()
    kinds = ("imports", "depends_on")
    j = eager_join(edges, found, "target", "file_path", {k: (F.col("type") == k).cast("long") for k in kinds}, {"impact": F.col("health_impact")}, {f"{k}_impact": (k, "impact") for k in kinds})
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("edge_type"), F.col(k).alias("pairs"), F.col(f"{k}_impact").alias("impact")) for k in kinds)))
    return roll_up(j.select(rows.alias("s")).select("s.*").where("pairs > 0"), [F.col("edge_type")], ["pairs", "impact"]).select("edge_type", "pairs", F.round(F.col("impact").cast("double"), 2).alias("impact"))


QUERIES = {"p3_found": p3_found, "p3_dependents": p3_dependents, "p3_edge_findings": p3_edge_findings}

_COUNTED = """
 f AS (SELECT DISTINCT file_id, repo_id, file_path, dependents_count FROM file_contexts),
 c AS (SELECT target, count(DISTINCT source) AS importers FROM kg_edges WHERE type = 'imports' AND source <> target GROUP BY target),
 x AS (SELECT f.*, coalesce(importers, 0) AS importers FROM f LEFT JOIN c ON file_path = target)
"""
SQL = {
    "p3_found": f"WITH {_COUNTED} SELECT file_id FROM x WHERE dependents_count <> importers",
    "p3_dependents": f"WITH {_COUNTED} SELECT repo_id, count(*) AS files, CAST(sum(dependents_count) AS BIGINT) AS stored, CAST(sum(importers) AS BIGINT) AS counted, CAST(sum(CASE WHEN dependents_count <> importers THEN 1 ELSE 0 END) AS BIGINT) AS off FROM x GROUP BY repo_id",
    "p3_edge_findings": """
 WITH e AS (SELECT target, type, count(*) AS n FROM (SELECT DISTINCT source, target, type FROM kg_edges) GROUP BY ALL),
 h AS (SELECT file_path, count(*) AS n, sum(CAST(health_impact AS DECIMAL(18,6))) AS s FROM (SELECT DISTINCT finding_id, file_path, health_impact FROM health_findings) GROUP BY ALL)
 SELECT type AS edge_type, CAST(sum(e.n * h.n) AS BIGINT) AS pairs, round(CAST(sum(e.n * h.s) AS DOUBLE), 2) AS impact FROM e JOIN h ON e.target = h.file_path GROUP BY type""",
}
