"""The engine's relations over the input tables, and the same relations as SQL for an independent check.

==============  =====================================================================================================
file_context    file_contexts, one row per file
imports         kg_edges of type imports between two named files, without repeats
depends         kg_edges of type depends_on between two named functions, without repeats
calls           the whole knowledge graph: every edge, of files and of functions, whose target is known and inside
main_calls      a function graph with cycles and self-calls from all line items: each part calls the supplier that ships most
                of it; both numbers share one space of function names
ccn             complexity of the files that have lines: one and a twentieth of the lines (the others default to 1)
part_ccn        complexity of the functions of ``main_calls`` that are parts
changed         files scanned in the last thirty days; ``changed_before``: in the thirty days before
commits         events as commits: author, time, file, whether it fixes a bug
findings        health_findings, one row per finding
==============  =====================================================================================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.tables import table


def function_name(ident: Column) -> Column:
    """Number to function: every 97th is a main."""
    leaf = F.when(ident % 97 == 0, F.lit("main")).otherwise(F.concat(F.lit("fn"), ident.cast("string")))
    return F.concat(F.lit("m"), (ident % 50).cast("string"), F.lit("/f"), (ident % 200).cast("string"), F.lit(".py::"), leaf)


def _sql_name(x: str) -> str:
    return f"('m' || ({x} % 50) || '/f' || ({x} % 200) || '.py::' || CASE WHEN {x} % 97 = 0 THEN 'main' ELSE 'fn' || {x} END)"


def file_context(spark: SparkSession, d: str) -> DataFrame:
    columns = ("file_id", "repo_id", "file_path", "language", "nloc", "has_test_file", "module", "dependents_count", "pagerank_score", "duplication_pct")
    return table(spark, d, "file_contexts").select(*columns).distinct()


def imports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kg_edges").where((F.col("type") == "imports") & F.col("target").isNotNull()).select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()


def depends(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kg_edges").where((F.col("type") == "depends_on") & F.col("target").isNotNull()).select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()


def call_rows(spark: SparkSession, d: str) -> DataFrame:
    """``calls`` with its repeats, for what numbers the edges before it makes them distinct."""
    e = table(spark, d, "kg_edges").where(F.col("target").isNotNull() & ~F.col("target").startswith("ext:"))
    return e.select(F.col("source").alias("src"), F.col("target").alias("dst"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    return call_rows(spark, d).distinct()


def main_calls(spark: SparkSession, d: str) -> DataFrame:
    shipped = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    best = shipped.groupBy("l_partkey").agg(F.min(F.struct((-F.col("q")).alias("k"), "l_suppkey"))["l_suppkey"].alias("s"))
    return best.select(function_name(F.col("l_partkey")).alias("src"), function_name(F.col("s")).alias("dst")).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def ccn(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_contexts").where(F.col("nloc").isNotNull())
    return f.groupBy(F.col("file_path").alias("node")).agg(F.max(F.lit(1) + F.floor(F.col("nloc") / 20).cast("int")).alias("ccn"))


def part_ccn(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(function_name(F.col("p_partkey")).alias("node")).agg(F.max(F.lit(1) + F.col("p_size") % 30).alias("ccn"))


def _scanned(spark: SparkSession, d: str, since: int, until: int) -> DataFrame:
    f = table(spark, d, "file_contexts").select(F.col("file_path").alias("path"), "scanned_at")
    last = f.agg(F.max("scanned_at").alias("last"))  # one row
    age = lambda days: F.col("last") - F.expr(f"INTERVAL {days} DAYS")
    return f.join(F.broadcast(last)).where((F.col("scanned_at") >= age(since)) & (F.col("scanned_at") <= age(until))).select("path").distinct()


def changed_files(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d, 30, 0)


def changed_before(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d, 60, 30)


def commits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").alias("sha"), F.concat(F.lit("dev"), F.col("user_id").cast("string")).alias("author"), "ts", F.concat(F.lit("src/f"), k.cast("string"), F.lit(".py")).alias("path"), (F.col("event_type") == "error").alias("is_fix"), "value")


def findings(spark: SparkSession, d: str) -> DataFrame:
    columns = ("finding_id", "file_path", "biomarker_type", "severity", "function_name", "line_start", "line_end", "deduction", "health_impact", "dimension")
    return table(spark, d, "health_findings").select(*columns).distinct()


# fixed value: the same relations as common table expressions
SQL = {
    "file_context": "file_context AS (SELECT DISTINCT file_id, repo_id, file_path, language, nloc, has_test_file, module, dependents_count, pagerank_score, duplication_pct FROM file_contexts)",
    "imports": "imports AS (SELECT DISTINCT source AS src, target AS dst FROM kg_edges WHERE type = 'imports' AND target IS NOT NULL)",
    "depends": "depends AS (SELECT DISTINCT source AS src, target AS dst FROM kg_edges WHERE type = 'depends_on' AND target IS NOT NULL)",
    "calls": "calls AS (SELECT DISTINCT source AS src, target AS dst FROM kg_edges WHERE target IS NOT NULL AND target NOT LIKE 'ext:%')",
    "main_calls": f"main_calls AS (SELECT DISTINCT {_sql_name('l_partkey')} AS src, {_sql_name('l_suppkey')} AS dst FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY sum(CAST(l_quantity AS BIGINT)) DESC, l_suppkey) AS rn FROM lineitem GROUP BY l_partkey, l_suppkey) WHERE rn = 1)",
    "main_nodes": "main_nodes AS (SELECT src AS node FROM main_calls UNION SELECT dst FROM main_calls)",
    "nodes": "nodes AS (SELECT src AS node FROM calls UNION SELECT dst FROM calls)",
    "ccn": "ccn AS (SELECT file_path AS node, CAST(max(1 + nloc // 20) AS INTEGER) AS ccn FROM file_contexts WHERE nloc IS NOT NULL GROUP BY 1)",
    "part_ccn": f"part_ccn AS (SELECT {_sql_name('p_partkey')} AS node, max(1 + p_size % 30) AS ccn FROM part GROUP BY 1)",
    "changed": "changed AS (SELECT DISTINCT file_path AS path FROM file_contexts WHERE scanned_at >= (SELECT max(scanned_at) FROM file_contexts) - INTERVAL 30 DAY)",
    "changed_before": "changed_before AS (SELECT DISTINCT file_path AS path FROM file_contexts WHERE scanned_at BETWEEN (SELECT max(scanned_at) FROM file_contexts) - INTERVAL 60 DAY AND (SELECT max(scanned_at) FROM file_contexts) - INTERVAL 30 DAY)",
    "closure": "closure AS (SELECT src, dst FROM calls UNION SELECT c.src, e.dst FROM closure c JOIN calls e ON c.dst = e.src)",
    "commits": "commits AS (SELECT event_id AS sha, 'dev' || user_id AS author, ts, 'src/f' || CAST(json_extract(props, '$.k') AS INTEGER) || '.py' AS path, event_type = 'error' AS is_fix, value FROM events)",
    "findings": "findings AS (SELECT DISTINCT finding_id, file_path, biomarker_type, severity, function_name, line_start, line_end, deduction, health_impact, dimension FROM health_findings)",
}


def with_(*names: str) -> str:
    """``WITH [RECURSIVE] ...`` over the named relations, in this order."""
    return ("WITH RECURSIVE " if "closure" in names else "WITH ") + ", ".join(SQL[n] for n in names) + " "
