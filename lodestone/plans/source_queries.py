"""Parsers over the stored source texts, snapshots, and the remaining report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import relations as R
from lodestone.functions import paths as P
from lodestone.operators import graph as G
from lodestone.plans import graph_queries as GQ
from lodestone.plans import history_queries as HQ
from lodestone.plans import scalar_queries as SQ
from lodestone.plans.scalar_queries import _F as _LAYERED
from lodestone.sources import line_sources, python_source, registry
from lodestone.session import materialize
from lodestone.streaming.watch import snapshot_diff
from lodestone.tables import table


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """All deliveries: what a parser finds in them is small, and repeats go there, not among the texts."""
    return table(spark, d, "file_contexts").select(F.col("file_path").alias("path"), "content")


def s5_python_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions of all Python files with complexity, nesting and length."""
    rows = python_source.parse(_sources(spark, d).where(F.col("path").endswith(".py")))
    return python_source.functions(rows).select("node", "lineno", "ccn", "depth", "loc", "n_vars", "n_ifs", "n_args").distinct()


def s6_line_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions and different calls per file of the languages that are read by lines."""
    rows = line_sources.parse(_sources(spark, d).where(~F.col("path").endswith(".py"))).distinct()
    return rows.groupBy("path").agg(F.sum((F.col("kind") == "function").cast("long")).alias("functions"), F.sum((F.col("kind") == "call").cast("long")).alias("calls"))


def s10_project_edges(spark: SparkSession, d: str) -> DataFrame:
    return registry.project_edges(_sources(spark, d))


def _made(spark: SparkSession, d: str) -> DataFrame:
    """A Python file per part, which holds by its size what the stored files lack: main blocks, input in loops, blocking calls
    in async functions, long conditions."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("s"))
    line = lambda text, n: F.repeat(F.lit(text), n)
    body = F.concat(
        F.lit("import time\n\n\ndef helper(a):\n    return 1 if a else 2\n\n\nasync def work(a):\n    for i in a:\n        a += i\n"), line("        open(i)\n", F.col("s") % 3), line("    time.sleep(1)\n", F.col("s") % 2),
        F.lit("    if a == 0"), line(" and a == 1", F.col("s") % 8), F.lit(":\n        pass\n"), F.when(F.col("s") % 4 == 0, "\n\nif __name__ == '__main__':\n    helper(1)\n").otherwise(""),
    )
    return p.select(F.concat(F.lit("made/p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), body.alias("content"))


def s11_entries(spark: SparkSession, d: str) -> DataFrame:
    return python_source.entry_points(python_source.parse(_made(spark, d), "entry"))


def p25_complexities(spark: SparkSession, d: str) -> DataFrame:
    """Both counts of complexity: they differ by conditional expressions."""
    return python_source.functions(python_source.parse(_made(spark, d), "function")).select("node", "ccn", "ccn_plain")


def s10_parse_errors(spark: SparkSession, d: str) -> DataFrame:
    """Python files that the parser skips; the scan goes on without them."""
    rows = python_source.parse(_sources(spark, d).where(F.col("path").endswith(".py")))
    return rows.where("kind = 'error'").select("path").distinct()


def s24_overview(spark: SparkSession, d: str) -> DataFrame:
    f = R.file_context(spark, d).where(F.col("file_path").endswith(".py"))
    return f.groupBy(P.layer(F.regexp_replace("file_path", "^[^/]+/", "")).alias("layer")).agg(F.count(F.lit(1)).alias("files"))


def b_syntax_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the detectors on syntax trees in all stored Python files."""
    rows = python_source.parse(_sources(spark, d).where(F.col("path").endswith(".py")).unionByName(_made(spark, d)), "function", "class", "site")
    return python_source.syntax_findings(rows).distinct()


def b_syntax_sites(spark: SparkSession, d: str) -> DataFrame:
    """Places with findings per file of the made sources."""
    x = python_source.syntax_findings(python_source.parse(_made(spark, d), "site")).where("place <> ''")
    return x.groupBy("node", "biomarker_type", "severity").agg(F.count(F.lit(1)).alias("places"))


def t2_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Files added and changed between two looks at the event log: at the middle of the time that it covers, and at its end.

    A look has the latest event of each path up to then, so none of the log is left out.  The log has no deletions, hence
    nothing is removed."""
    c = R.commits(spark, d)
    middle = c.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("middle"))  # one row
    look = lambda x: x.groupBy("path").agg(F.max(F.struct("ts", "sha")).alias("mtime"))
    early = c.join(F.broadcast(middle), F.col("ts") <= F.col("middle"))
    return snapshot_diff(look(early), look(c))


def a26_compare(spark: SparkSession, d: str) -> DataFrame:
    """Changed functions of two sides, their summed impact, and the difference."""
    head, base = (x.select(F.col("path").alias("file"), F.lit(True).alias(n)) for x, n in ((R.changed_files(spark, d), "head"), (R.changed_before(spark, d), "base")))
    r = GQ.risks(spark, d).withColumn("file", GQ.file_of()).join(head, "file", "left").join(base, "file", "left").select("impact", F.coalesce("head", F.lit(False)).alias("head"), F.coalesce("base", F.lit(False)).alias("base"))
    s = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("impact"))), F.lit(0)).cast("long")
    n = lambda c: F.sum(F.col(c).cast("long"))
    return r.agg(n("head").alias("head_functions"), n("base").alias("base_functions"), s("head").alias("head_risk"), s("base").alias("base_risk"), (s("head") - s("base")).alias("risk_delta"))


def a27_totals(spark: SparkSession, d: str) -> DataFrame:
    x = GQ.a24_changed_risk(spark, d)
    t, m = F.sum("sum_risk"), F.max("max_risk")
    return x.agg(t.cast("long").alias("total"), m.alias("top"), F.when((m >= 5) | (t >= 5), "HIGH").when((m >= 3) | (t >= 3), "MEDIUM").otherwise("LOW").alias("risk"))


def a28_graph_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """The same for equal node sets in any order; nodes are hashed and folded, never gathered."""
    n = R.nodes(R.calls(spark, d))
    return n.agg(F.bit_xor(F.conv(F.substring(F.md5("node"), 1, 15), 16, 10).cast("long")).alias("fingerprint"), F.count(F.lit(1)).alias("nodes"))


def u3_affected(spark: SparkSession, d: str) -> DataFrame:
    """Changed files together with those that the change reaches."""
    changed = R.changed_files(spark, d).select(F.col("path").alias("node"))
    return GQ.g16_blast_radius(spark, d).select("node").union(changed).distinct()


def w4_rank_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The rank that the 51st node has."""
    top = GQ.g12_pagerank(spark, d).orderBy(F.desc("rank"), "node").limit(51)
    return top.agg(F.min("rank").alias("threshold"))


def w9_most_calls(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(R.depends(spark, d)).orderBy(F.desc("outgoing"), "node").limit(50).select("node", "outgoing")


def g16_reviewers(spark: SparkSession, d: str) -> DataFrame:
    """Who should look at a change: the owners of the files that it touches or reaches, by their summed shares."""
    return HQ.reviewers(u3_affected(spark, d).withColumnRenamed("node", "path"), HQ.file_owners(spark, d))


def g16_change_report(spark: SparkSession, d: str) -> DataFrame:
    """One answer on a change: per affected file how far off it lies (0: changed itself), its risk, whether a test bears its
    name, and its owner."""
    changed = R.changed_files(spark, d).select(F.col("path").alias("node"), F.lit(0).alias("depth"))
    near = materialize(changed.unionByName(GQ.g16_blast_radius(spark, d)), "affected")
    gaps = SQ.test_gaps(near.select(F.col("node").alias("path")), R.file_context(spark, d).select(F.col("file_path").alias("path"))).select(F.col("path").alias("node"), F.lit(True).alias("gap"))
    f = R.file_context(spark, d).select(F.col("file_path").alias("node"), "pagerank_score", "dependents_count")
    o = HQ.file_owners(spark, d).select(F.col("path").alias("node"), F.col("name").alias("owner"))
    risk = F.col("pagerank_score") * (1 + F.coalesce(F.col("dependents_count"), F.lit(0)).cast("double") / 100)
    x = near.join(f, "node", "left").join(gaps, "node", "left").join(o, "node", "left")
    return x.select("node", "depth", F.round(risk, 9).alias("risk"), F.coalesce("gap", F.lit(False)).alias("gap"), "owner")


QUERIES = {f.__name__: f for f in (s5_python_functions, s6_line_functions, s10_project_edges, s10_parse_errors, s11_entries, s24_overview, b_syntax_findings, b_syntax_sites, t2_snapshot_diff, a26_compare, a27_totals, a28_graph_fingerprint, u3_affected, w4_rank_threshold, w9_most_calls, g16_reviewers, g16_change_report)}
QUERIES |= {"scalar_p25_complexities": p25_complexities}

_G16 = GQ.SQL["g16_blast_radius"]
SQL = {
    "s11_entries": "SELECT 'made/p' || p_partkey || '.py::helper' AS node FROM part WHERE p_size % 4 = 0",
    "b_syntax_sites": "SELECT 'made/p' || p_partkey || '.py::work' AS node, b AS biomarker_type, CASE WHEN b = 'blocking_sync_in_async' THEN 'high' ELSE 'medium' END AS severity, n AS places FROM (SELECT p_partkey, 'io_in_loop' AS b, CAST(p_size % 3 AS BIGINT) AS n FROM part UNION ALL SELECT p_partkey, 'blocking_sync_in_async', CAST(p_size % 2 AS BIGINT) FROM part UNION ALL SELECT p_partkey, 'complex_conditional', CAST(2 * (p_size % 8) + 1 > 5 AS BIGINT) FROM part) WHERE n > 0",
    "scalar_p25_complexities": "SELECT 'made/p' || p_partkey || '.py::helper' AS node, 2 AS ccn, 1 AS ccn_plain FROM part UNION ALL SELECT 'made/p' || p_partkey || '.py::work', CAST(3 + p_size % 8 AS INTEGER), CAST(3 + p_size % 8 AS INTEGER) FROM part",
    "s24_overview": _LAYERED + "SELECT layer, count(*) AS files FROM fl WHERE file_path LIKE '%.py' GROUP BY layer",
    "t2_snapshot_diff": R.with_("commits").rstrip() + ", a AS (SELECT path, max({'ts': ts, 'sha': sha}) AS m FROM commits WHERE ts <= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM commits) GROUP BY path), b AS (SELECT path, max({'ts': ts, 'sha': sha}) AS m FROM commits GROUP BY path) SELECT path, CASE WHEN a.m IS NULL THEN 'added' WHEN b.m IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (path) WHERE a.m IS NULL OR b.m IS NULL OR a.m <> b.m",
    "a26_compare": GQ._RISK.rstrip() + ", " + R.SQL["changed_before"] + ", x AS (SELECT impact, split_part(node, '::', 1) IN (SELECT path FROM changed) AS h, split_part(node, '::', 1) IN (SELECT path FROM changed_before) AS b FROM risk) SELECT CAST(count(*) FILTER (h) AS BIGINT) AS head_functions, CAST(count(*) FILTER (b) AS BIGINT) AS base_functions, CAST(coalesce(sum(impact) FILTER (h), 0) AS BIGINT) AS head_risk, CAST(coalesce(sum(impact) FILTER (b), 0) AS BIGINT) AS base_risk, CAST(coalesce(sum(impact) FILTER (h), 0) - coalesce(sum(impact) FILTER (b), 0) AS BIGINT) AS risk_delta FROM x",
    "a27_totals": f"SELECT CAST(sum(sum_risk) AS BIGINT) AS total, max(max_risk) AS top, CASE WHEN max(max_risk) >= 5 OR sum(sum_risk) >= 5 THEN 'HIGH' WHEN max(max_risk) >= 3 OR sum(sum_risk) >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM ({GQ.SQL['a24_changed_risk']})",
    "a28_graph_fingerprint": R.with_("calls", "nodes") + "SELECT bit_xor(CAST('0x' || substr(md5(node), 1, 15) AS BIGINT)) AS fingerprint, count(*) AS nodes FROM nodes",
    "u3_affected": f"SELECT node FROM ({_G16}) UNION SELECT path FROM ({R.with_('changed')} SELECT path FROM changed)",
    "w4_rank_threshold": GQ._RANKS + " SELECT min(rank) AS threshold FROM (SELECT rank FROM ranks ORDER BY 1 DESC LIMIT 51)",
    "w9_most_calls": R.with_("depends") + "SELECT node, CAST(outgoing AS BIGINT) AS outgoing FROM (SELECT node, sum(o) AS outgoing FROM (SELECT src AS node, 1 AS o FROM depends UNION ALL SELECT dst, 0 FROM depends) GROUP BY node) ORDER BY outgoing DESC, node LIMIT 50",
    "g16_reviewers": f"WITH aff AS (SELECT node AS path FROM ({_G16}) UNION SELECT path FROM ({R.with_('changed')} SELECT path FROM changed)), {HQ._OWNERS} SELECT name, email, round(sum(share), 3) AS relevance FROM aff JOIN owners USING (path) GROUP BY name, email ORDER BY relevance DESC, name LIMIT 5",
    "g16_change_report": f"WITH aff AS (SELECT node, depth FROM ({_G16}) UNION ALL SELECT path, 0 FROM ({R.with_('changed')} SELECT path FROM changed)), {HQ._OWNERS}, fc AS (SELECT DISTINCT file_path, pagerank_score, dependents_count FROM file_contexts), tp AS (SELECT DISTINCT regexp_extract(file_path, '[^/]*$') AS f FROM file_contexts), b AS (SELECT node, regexp_replace(regexp_extract(node, '[^/]*$'), '\\.[^.]*$', '') AS base FROM aff) SELECT aff.node, CAST(depth AS INTEGER) AS depth, round(pagerank_score * (1 + coalesce(dependents_count, 0)::DOUBLE / 100), 9) AS risk, NOT EXISTS (SELECT 1 FROM tp, b WHERE b.node = aff.node AND (contains(tp.f, 'test_' || b.base) OR contains(tp.f, b.base || '_test') OR contains(tp.f, b.base || '.spec.'))) AS gap, name AS owner FROM aff LEFT JOIN fc ON node = file_path LEFT JOIN owners ON owners.path = node",
}
