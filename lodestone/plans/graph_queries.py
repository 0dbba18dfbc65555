"""Graph queries: reachability, risk, dead code, cycles, centrality, blast radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import relations as R
from lodestone.operators import graph as G
from lodestone.session import materialize



def file_of(node: str = "node") -> Column:
    return F.split_part(node, F.lit("::"), F.lit(1))


def leaf_of(node: str = "node") -> Column:
    return F.element_at(F.split(node, "::"), -1)


ENTRY_NAMES = ("main", "run", "entrypoint", "start")  # fixed values


def g1_graph_counts(spark: SparkSession, d: str) -> DataFrame:
    e = R.calls(spark, d)
    return G.nodes_of(e).agg(F.count(F.lit(1)).alias("nodes")).crossJoin(e.agg(F.count(F.lit(1)).alias("edges")))  # one row each


def a2_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(R.imports(spark, d))


def hottest_target(e: DataFrame) -> DataFrame:
    return G.degrees(e).orderBy(F.desc("incoming"), "node").limit(1).select("node")


def g2_impact(spark: SparkSession, d: str) -> DataFrame:
    """What depends, directly or not, on the node with most dependents; itself only if it lies on a cycle."""
    e = materialize(R.calls(spark, d), "calls")
    return G.reach(e, hottest_target(e), backwards=True).select("node")


def g17_what_if(spark: SparkSession, d: str) -> DataFrame:
    """The same without the complexity bonus, as counts per file."""
    return g2_impact(spark, d).groupBy(file_of().alias("file")).agg(F.count(F.lit(1)).alias("affected"))


def g18_test_impact(spark: SparkSession, d: str) -> DataFrame:
    """Importers, directly or not, of the most imported file that are tests: their path within the repository begins with
    test, or they lie in a folder of tests."""
    e = materialize(R.imports(spark, d), "imports")
    inner = F.regexp_replace("node", "^[^/]+/", "")
    return G.reach(e, hottest_target(e), backwards=True).where(inner.startswith("test") | inner.rlike("(^|/)tests?/")).select("node")


def risks(spark: SparkSession, d: str) -> DataFrame:
    """(node, risk, impact): size of the impact plus complexity above 1."""
    x = G.impact_sizes(R.call_rows(spark, d)).join(R.ccn(spark, d), "node", "left")
    return x.select("node", "impact", (F.col("impact") + F.greatest(F.coalesce("ccn", F.lit(1)) - 1, F.lit(0))).alias("risk"))


def g3_risk(spark: SparkSession, d: str) -> DataFrame:
    return risks(spark, d)


def w1_hotspots(spark: SparkSession, d: str, n: int = 10) -> DataFrame:
    r = risks(spark, d).join(G.degrees(R.calls(spark, d)), "node")
    return r.orderBy(F.desc("risk"), F.desc("outgoing"), F.desc("incoming"), F.desc("node")).limit(n).select("node", "risk", "outgoing", "incoming")


def changed_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Functions of changed files: a semi-join on the file path."""
    return R.nodes(R.calls(spark, d)).withColumn("path", file_of()).join(R.changed_files(spark, d), "path", "left_semi").select("node")


def j2_changed_functions(spark: SparkSession, d: str) -> DataFrame:
    return changed_nodes(spark, d)


def w2_changed_hotspots(spark: SparkSession, d: str, n: int = 5) -> DataFrame:
    r = risks(spark, d).join(G.degrees(R.calls(spark, d)), "node").join(changed_nodes(spark, d), "node", "left_semi")
    return r.orderBy(F.desc("risk"), F.desc("outgoing"), F.desc("incoming"), F.desc("node")).limit(n).select("node", "risk")


def a24_changed_risk(spark: SparkSession, d: str) -> DataFrame:
    """Functions, highest and summed impact per changed file."""
    r = risks(spark, d).join(changed_nodes(spark, d), "node", "left_semi")
    return r.groupBy(file_of().alias("file")).agg(F.count(F.lit(1)).alias("functions"), F.max("impact").alias("max_risk"), F.sum("impact").alias("sum_risk"))


def a25_gate(spark: SparkSession, d: str, threshold: int = 50) -> DataFrame:
    """Whether the highest impact of a changed function stays within the threshold."""
    r = risks(spark, d).join(changed_nodes(spark, d), "node", "left_semi")
    return r.agg(F.max("impact").alias("max_risk"), (F.coalesce(F.max("impact"), F.lit(0)) <= threshold).alias("passed"))


def j6_incident_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with an end in a changed function, without self-loops."""
    e, c = R.calls(spark, d), changed_nodes(spark, d)
    a = e.join(c.select(F.col("node").alias("src")), "src", "left_semi")
    b = e.join(c.select(F.col("node").alias("dst")), "dst", "left_semi")
    return a.select("src", "dst").union(b.select("src", "dst")).distinct().where("src <> dst")


def j7_induced_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between two files that both have a test."""
    e = R.imports(spark, d)
    t = R.file_context(spark, d).where("has_test_file").select("file_path").distinct()
    return e.join(t, e["src"] == t["file_path"], "left_semi").join(t, F.col("dst") == F.col("file_path"), "left_semi").select("src", "dst")


def entry_points(e: DataFrame, main_block: DataFrame | None = None) -> DataFrame:
    """Functions named like an entry; only if there is none, all without a caller; and those of ``main_block`` (node), the
    functions that a file runs when it is the program, as far as the graph holds them."""
    n = G.nodes_of(e)
    named = n.where(F.element_at(F.split(leaf_of(), "\\."), -1).isin(*ENTRY_NAMES))
    none = named.limit(1).agg((F.count(F.lit(1)) == 0).alias("none"))  # one row
    rootless = n.join(e.where("src <> dst").select(F.col("dst").alias("node")), "node", "left_anti").join(e.where("src = dst").select(F.col("dst").alias("node")), "node", "left_anti")
    found = named.unionByName(rootless.crossJoin(F.broadcast(none)).where("none").select("node"))
    return found if main_block is None else found.union(n.join(main_block.select("node"), "node", "left_semi")).distinct()


def g6_entry_points(spark: SparkSession, d: str) -> DataFrame:
    """By name, with the function that has most callers as one that a file runs itself."""
    e = materialize(R.main_calls(spark, d), "calls")
    return entry_points(e, hottest_target(e).union(spark.createDataFrame([("not/in/the/graph.py::main",)], "node string")))


def g6b_entry_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The fallback: no function of the file graph bears an entry's name, so files that nothing imports stand in."""
    return entry_points(R.imports(spark, d))


def roots(e: DataFrame) -> DataFrame:
    """Nodes that nothing points to; all nodes where there is none of these."""
    deg = G.degrees(e)
    none = deg.where("incoming = 0").limit(1).agg((F.count(F.lit(1)) == 0).alias("none"))  # one row
    return deg.crossJoin(F.broadcast(none)).where("incoming = 0 OR none").select("node")


def g21_roots(spark: SparkSession, d: str) -> DataFrame:
    return roots(R.calls(spark, d))


def g21_roots_of_a_ring(spark: SparkSession, d: str) -> DataFrame:
    """The fallback: among the files that both import and are imported, in a circle, none is a root."""
    e = R.imports(spark, d).where("src = dst")
    return roots(e)


def dead_nodes(e: DataFrame) -> DataFrame:
    """What no entry point reaches."""
    start = materialize(entry_points(e), "entries")
    live = G.reach(e, start).select("node").union(start)
    return G.nodes_of(e).join(live, "node", "left_anti")


def g5_dead_code(spark: SparkSession, d: str) -> DataFrame:
    return dead_nodes(materialize(R.main_calls(spark, d), "calls"))


def g8_scc(spark: SparkSession, d: str) -> DataFrame:
    x = materialize(G.components_strong(R.calls(spark, d)), "scc")
    return x.join(x.groupBy("scc").agg(F.count(F.lit(1)).alias("size")), "scc").select("node", "scc", "size")


def g7_cycles(spark: SparkSession, d: str) -> DataFrame:
    return G.simple_cycles(R.main_calls(spark, d)).select(F.array_join("cycle", " > ").alias("cycle"), "length")


def g9_feedback_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.break_cycle_edges(R.main_calls(spark, d)).select("scc", "src", "dst")


def g10_break_cycles(spark: SparkSession, d: str) -> DataFrame:
    """A suggestion per component: edges to turn, and the callers of its members as blast radius."""
    e = materialize(R.main_calls(spark, d), "calls")
    cut = G.break_cycle_edges(e).groupBy("scc").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("cut"))
    blast = G.components_strong(e).join(G.degrees(e), "node").groupBy("scc").agg(F.sum("incoming").alias("blast_radius"))
    return cut.join(blast, "scc").select("scc", "size", "cut", "blast_radius", F.col("scc").alias("anchor"), F.lit(0.7).alias("confidence"))


def g11_split_files(spark: SparkSession, d: str) -> DataFrame:
    """Files with at least 5 functions and a summed complexity of at least 30; blast radius: calls from other files."""
    e = materialize(R.main_calls(spark, d), "calls")
    n = R.nodes(e).join(R.part_ccn(spark, d), "node", "left")
    x = n.groupBy(file_of().alias("file")).agg(F.count(F.lit(1)).alias("functions"), F.sum(F.coalesce("ccn", F.lit(1))).cast("long").alias("complexity"))
    outer = e.where(file_of("src") != file_of("dst")).groupBy(file_of("dst").alias("file")).agg(F.count(F.lit(1)).alias("blast"))
    return x.where("functions >= 5 AND complexity >= 30").join(outer, "file", "left").select("file", "functions", "complexity", F.coalesce("blast", F.lit(0)).alias("blast_radius"))


def g12_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return G.pagerank(R.calls(spark, d)).select("node", F.round("rank", 6).alias("rank"))


def g13_communities(spark: SparkSession, d: str) -> DataFrame:
    """Greedy modularity in connected parts that fit into a task, label propagation in larger ones."""
    return G.communities(R.calls(spark, d))


def g15_explain(spark: SparkSession, d: str) -> DataFrame:
    """Shortest path from the function with most callers to each dependent, and how deep it lies."""
    e = materialize(R.calls(spark, d), "calls")
    p = G.shortest_paths(e, hottest_target(e))
    return p.select("node", "depth", (F.col("depth") == 1).alias("direct"))


def g19_impact_tree(spark: SparkSession, d: str) -> DataFrame:
    """Each dependent under one parent, with the path whose order is that of the tree."""
    e = materialize(R.calls(spark, d), "calls")
    p = G.shortest_paths(e, hottest_target(e))
    return p.select("node", F.element_at("path", -2).alias("parent"), "depth", F.array_join("path", " < ").alias("place"))


def g16_blast_radius(spark: SparkSession, d: str) -> DataFrame:
    """Importers of the changed files up to three steps away; changed files are neither reported nor passed through."""
    e = R.imports(spark, d)
    changed = R.changed_files(spark, d).select(F.col("path").alias("node"))
    return G.reach(e, changed, backwards=True, max_depth=3, closed=materialize(changed, "changed"))


def w3_top_per_file(spark: SparkSession, d: str) -> DataFrame:
    """Of the 200 functions of highest rank, the first of each file."""
    top = g12_pagerank(spark, d).orderBy(F.desc("rank"), "node").limit(200)
    return top.withColumn("file", file_of()).withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("rank"), "node"))).where("k = 1").select("file", "node", "rank")


def u1_head_base(spark: SparkSession, d: str) -> DataFrame:
    """Callers against callees: only in one, only in the other, in both."""
    e = R.calls(spark, d)
    a, b = e.select(F.col("src").alias("node")), e.select(F.col("dst").alias("node"))
    tag = lambda x, t: x.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(t))
    return tag(a.subtract(b), "head").unionByName(tag(b.subtract(a), "base")).unionByName(tag(a.intersect(b), "both")).select("side", "n")


QUERIES = {f.__name__: f for f in (g1_graph_counts, a2_degrees, g2_impact, g17_what_if, g18_test_impact, g3_risk, w1_hotspots, j2_changed_functions, w2_changed_hotspots, a24_changed_risk, a25_gate, j6_incident_edges, j7_induced_edges, g6_entry_points, g6b_entry_fallback, g21_roots, g21_roots_of_a_ring, g5_dead_code, g8_scc, g7_cycles, g9_feedback_edges, g10_break_cycles, g11_split_files, g12_pagerank, g13_communities, g15_explain, g19_impact_tree, g16_blast_radius, w3_top_per_file, u1_head_base)}

_W = R.with_
_DEG = " deg AS (SELECT node, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming FROM (SELECT src AS node, 1 AS o, 0 AS i FROM {e} UNION ALL SELECT dst, 0, 1 FROM {e}) GROUP BY node)"
_HOT = " hot AS (SELECT node FROM deg ORDER BY incoming DESC, node LIMIT 1)"
_UP = " up AS (SELECT e.src AS node FROM {e} e JOIN hot ON e.dst = hot.node UNION SELECT e.src FROM up JOIN {e} e ON e.dst = up.node)"
_CALL_UP = "WITH RECURSIVE " + R.SQL["calls"] + "," + _DEG.format(e="calls") + "," + _HOT + "," + _UP.format(e="calls") + " "
_RISK = R.with_("calls", "nodes", "ccn", "changed", "closure").rstrip() + ", imp AS (SELECT dst AS node, count(*) AS impact FROM closure GROUP BY dst), risk AS (SELECT n.node, coalesce(impact, 0) AS impact, coalesce(impact, 0) + greatest(coalesce(ccn, 1) - 1, 0) AS risk FROM nodes n LEFT JOIN imp USING (node) LEFT JOIN ccn USING (node)), " + _DEG.format(e="calls") + ", touched AS (SELECT node FROM nodes WHERE split_part(node, '::', 1) IN (SELECT path FROM changed)) "
_SCC = R.with_("calls", "nodes", "closure").rstrip() + ", mutual AS (SELECT a.src, min(a.dst) AS m FROM closure a JOIN closure b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src), scc AS (SELECT node, least(node, coalesce(m, node)) AS scc FROM nodes LEFT JOIN mutual ON node = src)"
_ENTRY = "entry AS (SELECT node FROM {n} WHERE split_part(split_part(node, '::', -1), '.', -1) IN ('main', 'run', 'entrypoint', 'start'))"
# the rounds as recursion: each sees the ranks of the one before, and the last one changes all together by less than the tolerance
_RANKS = R.with_("calls", "nodes").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """, outs AS (SELECT src, count(*) AS n FROM calls GROUP BY src), size AS (SELECT count(*)::DOUBLE AS n FROM nodes),
 r AS (SELECT 0 AS k, node, 1.0::DOUBLE / (SELECT n FROM size) AS rank, 1e9::DOUBLE AS moved FROM nodes
 UNION ALL SELECT k, node, rank, sum(abs(rank - was)) OVER () AS moved FROM (
  SELECT b.k + 1 AS k, b.node, 0.15::DOUBLE / (SELECT n FROM size) + 0.85::DOUBLE * (coalesce(g.got, 0) + l.lost / (SELECT n FROM size)) AS rank, b.rank AS was
  FROM r b LEFT JOIN (SELECT c.dst, sum(r.rank / o.n) AS got FROM calls c JOIN outs o USING (src) JOIN r ON r.node = c.src GROUP BY c.dst) g ON g.dst = b.node
  CROSS JOIN (SELECT coalesce(sum(rank) FILTER (src IS NULL), 0) AS lost FROM r LEFT JOIN outs ON r.node = outs.src) l
  WHERE b.k < 100 AND b.moved >= (SELECT n FROM size) * 1e-6)),
 ranks AS (SELECT node, round(rank, 6) AS rank FROM r WHERE k = (SELECT max(k) FROM r))"""
_PATHS = "WITH RECURSIVE " + R.SQL["calls"] + "," + _DEG.format(e="calls") + "," + _HOT + ", lv AS (SELECT e.src AS node, 1 AS depth FROM calls e JOIN hot ON e.dst = hot.node WHERE e.src <> hot.node UNION SELECT e.src, lv.depth + 1 FROM lv JOIN calls e ON e.dst = lv.node WHERE lv.depth < 200), sp AS (SELECT node, min(depth) AS depth FROM lv WHERE node NOT IN (SELECT node FROM hot) GROUP BY node) "

SQL = {
    "g1_graph_counts": _W("calls", "nodes") + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM calls) AS edges",
    "a2_degrees": _W("imports").rstrip() + "," + _DEG.format(e="imports") + " SELECT * FROM deg",
    "g2_impact": _CALL_UP + "SELECT node FROM up",
    "g17_what_if": _CALL_UP + "SELECT split_part(node, '::', 1) AS file, count(*) AS affected FROM up GROUP BY 1",
    "g18_test_impact": "WITH RECURSIVE " + R.SQL["imports"] + "," + _DEG.format(e="imports") + "," + _HOT + "," + _UP.format(e="imports") + " SELECT node FROM up WHERE regexp_replace(node, '^[^/]+/', '') LIKE 'test%' OR regexp_matches(regexp_replace(node, '^[^/]+/', ''), '(^|/)tests?/')",
    "g3_risk": _RISK + "SELECT node, impact, risk FROM risk",
    "w1_hotspots": _RISK + "SELECT node, risk, outgoing, incoming FROM risk JOIN deg USING (node) ORDER BY risk DESC, outgoing DESC, incoming DESC, node DESC LIMIT 10",
    "j2_changed_functions": _W("calls", "nodes", "changed") + "SELECT node FROM nodes WHERE split_part(node, '::', 1) IN (SELECT path FROM changed)",
    "w2_changed_hotspots": _RISK + "SELECT node, risk FROM risk JOIN deg USING (node) WHERE node IN (SELECT node FROM touched) ORDER BY risk DESC, outgoing DESC, incoming DESC, node DESC LIMIT 5",
    "a24_changed_risk": _RISK + "SELECT split_part(node, '::', 1) AS file, count(*) AS functions, max(impact) AS max_risk, CAST(sum(impact) AS BIGINT) AS sum_risk FROM risk WHERE node IN (SELECT node FROM touched) GROUP BY 1",
    "a25_gate": _RISK + "SELECT max(impact) AS max_risk, coalesce(max(impact), 0) <= 50 AS passed FROM risk WHERE node IN (SELECT node FROM touched)",
    "j6_incident_edges": _W("calls", "nodes", "changed").rstrip() + ", t AS (SELECT node FROM nodes WHERE split_part(node, '::', 1) IN (SELECT path FROM changed)) SELECT src, dst FROM calls WHERE src <> dst AND (src IN (SELECT node FROM t) OR dst IN (SELECT node FROM t))",
    "j7_induced_edges": _W("imports", "file_context").rstrip() + ", t AS (SELECT file_path FROM file_context WHERE has_test_file) SELECT src, dst FROM imports WHERE src IN (SELECT file_path FROM t) AND dst IN (SELECT file_path FROM t)",
    "g6_entry_points": _W("main_calls", "main_nodes").rstrip() + ", " + _ENTRY.format(n="main_nodes") + " SELECT node FROM entry UNION SELECT node FROM (SELECT dst AS node FROM main_calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)",
    "g6b_entry_fallback": _W("imports").rstrip() + ", n AS (SELECT src AS node FROM imports UNION SELECT dst FROM imports), " + _ENTRY.format(n="n") + " SELECT node FROM entry UNION SELECT node FROM n WHERE NOT EXISTS (SELECT 1 FROM entry) AND node NOT IN (SELECT dst FROM imports)",
    "g21_roots": _W("calls", "nodes") + "SELECT node FROM nodes WHERE node NOT IN (SELECT dst FROM calls)",
    "g21_roots_of_a_ring": _W("imports") + "SELECT src AS node FROM imports WHERE src = dst",
    "g5_dead_code": "WITH RECURSIVE " + R.SQL["main_calls"] + ", " + R.SQL["main_nodes"] + ", " + R.SQL["closure"].replace("calls", "main_calls") + ", " + _ENTRY.format(n="main_nodes") + " SELECT node FROM main_nodes WHERE node NOT IN (SELECT node FROM entry) AND node NOT IN (SELECT dst FROM closure WHERE src IN (SELECT node FROM entry))",
    "g8_scc": _SCC + " SELECT node, scc, count(*) OVER (PARTITION BY scc) AS size FROM scc",
    "g7_cycles": "WITH RECURSIVE " + R.SQL["main_calls"] + ", p AS (SELECT [src] AS path, dst AS stop, 1 AS n FROM main_calls WHERE src <= dst UNION ALL SELECT list_append(p.path, p.stop), i.dst, n + 1 FROM p JOIN main_calls i ON p.stop = i.src WHERE p.stop > p.path[1] AND NOT list_contains(p.path, p.stop)) SELECT array_to_string(path, ' > ') AS cycle, CAST(n AS INTEGER) AS length FROM p WHERE stop = path[1]",
    "g11_split_files": _W("main_calls", "main_nodes", "part_ccn") + "SELECT file, functions, complexity, coalesce(blast, 0) AS blast_radius FROM (SELECT split_part(node, '::', 1) AS file, count(*) AS functions, CAST(sum(coalesce(ccn, 1)) AS BIGINT) AS complexity FROM main_nodes LEFT JOIN part_ccn USING (node) GROUP BY 1 HAVING count(*) >= 5 AND sum(coalesce(ccn, 1)) >= 30) LEFT JOIN (SELECT split_part(dst, '::', 1) AS file, count(*) AS blast FROM main_calls WHERE split_part(dst, '::', 1) <> split_part(src, '::', 1) GROUP BY 1) USING (file)",
    "g12_pagerank": _RANKS + " SELECT node, rank FROM ranks",
    "w3_top_per_file": _RANKS + ", t AS (SELECT node, rank FROM ranks ORDER BY 2 DESC, 1 LIMIT 200) SELECT file, node, rank FROM (SELECT split_part(node, '::', 1) AS file, node, rank, row_number() OVER (PARTITION BY split_part(node, '::', 1) ORDER BY rank DESC, node) AS k FROM t) WHERE k = 1",
    "g15_explain": _PATHS + "SELECT node, CAST(depth AS INTEGER) AS depth, depth = 1 AS direct FROM sp",
    "g16_blast_radius": _W("imports", "changed").rstrip() + ", c AS (SELECT path AS node FROM changed), l1 AS (SELECT DISTINCT src AS node FROM imports WHERE dst IN (SELECT node FROM c) AND src NOT IN (SELECT node FROM c)), l2 AS (SELECT DISTINCT src AS node FROM imports WHERE dst IN (SELECT node FROM l1) AND src NOT IN (SELECT node FROM c)), l3 AS (SELECT DISTINCT src AS node FROM imports WHERE dst IN (SELECT node FROM l2) AND src NOT IN (SELECT node FROM c)) SELECT node, CAST(min(d) AS INTEGER) AS depth FROM (SELECT node, 1 AS d FROM l1 UNION ALL SELECT node, 2 FROM l2 UNION ALL SELECT node, 3 FROM l3) GROUP BY node",
    "u1_head_base": _W("calls") + "SELECT 'head' AS side, count(*) AS n FROM (SELECT src FROM calls EXCEPT SELECT dst FROM calls) UNION ALL SELECT 'base', count(*) FROM (SELECT dst FROM calls EXCEPT SELECT src FROM calls) UNION ALL SELECT 'both', count(*) FROM (SELECT src FROM calls INTERSECT SELECT dst FROM calls)",
}
