"""Clones, decisions, vectors, workspaces and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import relations as R
from lodestone.functions import paths as P
from lodestone.operators import graph as G
from lodestone.operators import text as T
from lodestone.operators import vectors as V
from lodestone.plans import graph_queries as GQ
from lodestone.plans import scalar_queries as SQ
from lodestone.session import materialize
from lodestone.tables import table


def _codes(spark: SparkSession, d: str) -> DataFrame:
    """(file, codes) once per file: a sign per token is what is shuffled, never a text."""
    return table(spark, d, "file_contexts").select(F.col("file_id").alias("file"), T.codes(F.col("content")).alias("codes")).distinct()


def d1_token_counts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda sign: (F.length("codes") - F.length(F.replace("codes", F.lit(sign), F.lit("")))).cast("int")
    return _codes(spark, d).select(F.col("file").alias("file_id"), F.length("codes").alias("tokens"), n("a").alias("ids"), n('"').alias("strings"))


def d2_repeated_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows that occur more than once within a file."""
    w = T.windows(_codes(spark, d), 20)
    return w.groupBy("file", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("file").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("places"))


def d3_clones(spark: SparkSession, d: str) -> DataFrame:
    return T.clones(_codes(spark, d), 60)


def a23_clone_totals(spark: SparkSession, d: str) -> DataFrame:
    return T.clones(_codes(spark, d), 20).agg(F.count(F.lit(1)).alias("pairs"), F.sum("length").cast("long").alias("tokens"))


def w6_top_clones(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "clone_pairs").select("file_a", "start_a", "file_b", "start_b", "length", "similarity").distinct()
    s = F.when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.col("similarity"))
    return c.where("file_a IS NOT NULL AND file_b IS NOT NULL AND similarity IS NOT NULL").withColumn("weight", F.round(F.col("length") * s, 4)).orderBy(F.desc("weight"), "file_a", "start_a", "file_b", "start_b").limit(500)


def d6_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decision lines of all documents, whatever their source."""
    x = T.decision_lines(table(spark, d, "documents"), "doc_id", "text")
    return x.select("doc_id", F.substring("line", 1, 80).alias("title"), F.lit(0.4).alias("confidence"))


def d7_item_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Lines made of suggestions and part names, half of them with a cause."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("use "), "p_name", F.when(F.col("p_partkey") % 2 == 0, " because ").otherwise(" and "), "p_type").alias("line"))
    x = p.where(F.col("line").rlike(T.DECISION_VERBS) & F.col("line").rlike(T.DECISION_CAUSES))
    return x.select("p_partkey", F.concat(F.lit("PR #"), F.col("p_partkey").cast("string"), F.lit(": "), F.substring("line", 1, 60)).alias("title"), F.lit(0.5).alias("confidence"))


def d8_records(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.lower(F.trim("source")) == "adr")
    return T.decision_records(docs, "doc_id", "text").select("doc_id", "title", "status", F.length("rationale").alias("n"))


def u5_decisions(spark: SparkSession, d: str, limit: int = 100) -> DataFrame:
    """Active decisions of all sources, the surest first, up to a limit, each with the number that there is in all."""
    a = d6_decisions(spark, d).select(F.lit("text").alias("source"), F.col("doc_id").alias("id"), "title", F.lit("active").alias("status"), "confidence")
    b = d7_item_decisions(spark, d).select(F.lit("item").alias("source"), F.col("p_partkey").alias("id"), "title", F.lit("active").alias("status"), "confidence")
    c = d8_records(spark, d).select(F.lit("record").alias("source"), F.col("doc_id").alias("id"), "title", "status", F.lit(0.8).alias("confidence"))
    x = a.unionByName(b).unionByName(c).where(F.lower("status") == "active").distinct()
    total = x.agg(F.count(F.lit(1)).alias("total"))  # one row
    return x.orderBy(F.desc("confidence"), "source", "id", "title").limit(limit).crossJoin(F.broadcast(total))


def _queries(v: DataFrame) -> DataFrame:
    return v.where("vec_id % 100 = 0")


def v2_nearest(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return V.nearest(v, _queries(v), 10).select("query", "vec_id", F.round("score", 6).alias("score"), "place")


def v3_nearest_l2(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return V.nearest(v, _queries(v), 5, metric="l2").select("query", "vec_id", F.round("score", 5).alias("score"), "place")


def v1_upsert(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "label")
    new = v.where("vec_id % 10 = 0").select((F.col("vec_id") + 5).alias("vec_id"), (F.col("label") + 100).alias("label"))
    return V.upsert(v, new, "vec_id")


def v4_delete(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "label")
    return V.delete(v, v.where("label % 2 = 0"), "vec_id")


def g22_repo_edges(spark: SparkSession, d: str) -> DataFrame:
    """Imports between repositories whose both ends are known, with a confidence by their number."""
    e = R.imports(spark, d).select(F.split_part("src", F.lit("/"), F.lit(1)).alias("source"), F.split_part("dst", F.lit("/"), F.lit(1)).alias("target")).where("source <> target")
    r = table(spark, d, "repos").select("repo_id").distinct()
    x = e.groupBy("source", "target").agg(F.count(F.lit(1)).alias("edges"))  # shrunk before the joins
    return x.join(r.withColumnRenamed("repo_id", "source"), "source", "left_semi").join(r.withColumnRenamed("repo_id", "target"), "target", "left_semi").select("source", "target", "edges", F.when(F.col("edges") >= 10, 0.9).otherwise(0.5).alias("confidence"))


def j13_conformance(spark: SparkSession, d: str) -> DataFrame:
    """Edges that a rule forbids: a repository of web pages must not import a job's."""
    e = g22_repo_edges(spark, d)
    rules = table(spark, d, "repos").select("repo_id").distinct()
    bad = rules.where(F.endswith("repo_id", F.lit("-web"))).select(F.col("repo_id").alias("source")).join(e, "source").join(rules.where(F.endswith("repo_id", F.lit("-jobs"))).select(F.col("repo_id").alias("target")), "target")
    return bad.select("source", "target", "edges")


def g14_kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge-graph nodes: the leading node of the highest files, with layer and complexity."""
    t = GQ.w3_top_per_file(spark, d).join(R.ccn(spark, d), "node", "left")
    c = F.coalesce("ccn", F.lit(1))
    return t.select("node", "file", "rank", P.layer(F.regexp_replace("file", "^[^/]+/", "")).alias("layer"), F.when(c > 10, "complex").when(c > 5, "moderate").otherwise("simple").alias("complexity"))


def g14_kg_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between these nodes' files with their number, and between the nodes themselves."""
    top = materialize(GQ.w3_top_per_file(spark, d).select("file", "node"), "top")
    inside = lambda x, c: x.join(F.broadcast(top.select(F.col(c).alias("source")).distinct()), "source", "left_semi").join(F.broadcast(top.select(F.col(c).alias("target")).distinct()), "target", "left_semi").where("source <> target")  # noqa: E731  (200 rows)
    e = R.calls(spark, d)
    files = e.select(GQ.file_of("src").alias("source"), GQ.file_of("dst").alias("target")).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    nodes = e.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(1).cast("long").alias("n"))
    return inside(files, "file").withColumn("type", F.lit("imports")).unionByName(inside(nodes, "node").withColumn("type", F.lit("depends_on")))


def g14_kg_tour(spark: SparkSession, d: str) -> DataFrame:
    """Five steps through the code: the first entry points."""
    x = GQ.entry_points(R.main_calls(spark, d)).orderBy("node").limit(5)
    return x.select(F.concat(F.lit("Entry point: "), "node").alias("title"), GQ.file_of().alias("target"), F.lit("Top-level entry point into the codebase").alias("reason"))


def g23_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by whether the last changes or those before them touched their file."""
    n = R.nodes(R.calls(spark, d)).withColumn("path", GQ.file_of())
    mark = lambda x, name: x.withColumn(name, F.lit(True))
    j = n.join(mark(R.changed_files(spark, d), "changed_last"), "path", "left").join(mark(R.changed_before(spark, d), "changed_before"), "path", "left")
    return j.select("node", F.coalesce("changed_last", F.lit(False)).alias("changed_last"), F.coalesce("changed_before", F.lit(False)).alias("changed_before"))


def k1_mermaid(spark: SparkSession, d: str) -> DataFrame:
    e = R.imports(spark, d)
    safe = lambda c: F.translate(c, "()-", "___")
    return e.select(F.concat(F.lit("    "), safe("src"), F.lit(" --> "), safe("dst")).alias("line"))


def k2_sarif(spark: SparkSession, d: str) -> DataFrame:
    """A result per changed node with calls, an error from five calls on, and per dead node; with its first known line."""
    e = materialize(R.calls(spark, d), "calls")
    deg = G.degrees(e)
    changed = deg.join(GQ.changed_nodes(spark, d), "node", "left_semi").where("outgoing > 0").withColumn("rule", F.lit("change-impact"))
    dead = deg.join(GQ.dead_nodes(e), "node", "left_semi").withColumn("rule", F.lit("dead-code"))
    x = changed.unionByName(dead).join(SQ.j5_line_numbers(spark, d), "node")
    level = F.when((F.col("rule") == "change-impact") & (F.col("outgoing") >= 5), "error").otherwise("warning")
    text = F.when(F.col("rule") == "dead-code", F.concat("node", F.lit(" is never reached"))).otherwise(F.format_string("%s calls %d functions", "node", "outgoing"))
    where = F.array(F.struct(F.struct(F.struct(GQ.file_of().alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    return x.select("node", "rule", level.alias("level"), F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), where.alias("locations"))).alias("result"))


def k5_report(spark: SparkSession, d: str) -> DataFrame:
    """One line per changed file, highest risk first."""
    x = GQ.a24_changed_risk(spark, d)
    return x.select("file", F.format_string("%s: %d functions, risk up to %d", "file", "functions", "max_risk").alias("line"))


def k6_complexity_table(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.plans.scalar_queries import w5_most_complex

    return w5_most_complex(spark, d).select("node", "ccn", F.when(F.col("ccn") >= 10, "HIGH").when(F.col("ccn") >= 5, "MEDIUM").otherwise("LOW").alias("risk"))


def w10_tree(spark: SparkSession, d: str) -> DataFrame:
    """The tree from the roots down, in its order: the first 200 roots and, below each node that stands in it, the first 12
    callees, two levels deep; most calls first."""
    e = materialize(R.calls(spark, d), "calls")
    deg = materialize(G.degrees(e).select("node", "outgoing"), "degrees")
    order = [F.desc("outgoing"), "node"]
    top = GQ.roots(e).join(deg, "node").orderBy(*order).limit(200).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # 200 rows
    levels = [materialize(top.select(F.lit(0).alias("depth"), F.lit("").alias("parent"), "node", "place"), "tree")]
    for depth in (1, 2):
        above = levels[-1].select(F.col("node").alias("parent")).distinct()
        below = e.join(above, e["src"] == above["parent"]).select("parent", F.col("dst").alias("node")).join(deg, "node")
        w = Window.partitionBy("parent").orderBy(*order)  # cut within the window: no more than 12 rows of a parent leave a task
        levels.append(materialize(below.withColumn("place", F.row_number().over(w)).where("place <= 12").select(F.lit(depth).alias("depth"), "parent", "node", "place"), "tree"))
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def s22_cache(spark: SparkSession, d: str) -> DataFrame:
    """Files whose content hash differs from the cached one: the cache holds the files as they were before the last changes."""
    f = table(spark, d, "file_contexts").select("file_id", "file_path", F.sha2("content", 256).alias("sha")).distinct()
    cache = f.join(R.changed_files(spark, d), F.col("file_path") == F.col("path"), "left_anti").select("file_path", "sha")
    return f.join(cache, ["file_path", "sha"], "left_anti").select("file_id", "sha")


def s23_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A hash per repository over its files in order; file hashes are aggregated, never the contents."""
    f = table(spark, d, "file_contexts").select("repo_id", "file_path", F.sha2("content", 256).alias("sha")).distinct()
    x = f.groupBy("repo_id").agg(F.bit_xor(F.conv(F.substring(F.md5(F.concat("file_path", "sha")), 1, 15), 16, 10).cast("long")).alias("fingerprint"), F.count(F.lit(1)).alias("files"))
    return x


QUERIES = {f.__name__: f for f in (d1_token_counts, d2_repeated_windows, d3_clones, a23_clone_totals, w6_top_clones, d6_decisions, d7_item_decisions, d8_records, u5_decisions, v1_upsert, v2_nearest, v3_nearest_l2, v4_delete, g22_repo_edges, j13_conformance, g14_kg_nodes, g14_kg_edges, g14_kg_tour, g23_timeline, k1_mermaid, k2_sarif, k5_report, k6_complexity_table, w10_tree, s22_cache, s23_fingerprint)}

from lodestone.plans.scalar_queries import _F as _LAYERED  # noqa: E402

_DISTINCT = "WITH f AS (SELECT DISTINCT file_id, content FROM file_contexts)"
_TOK = _DISTINCT + r""", l AS (SELECT file_id, list_filter(list_transform(regexp_split_to_array(content, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: len(x) > 0 AND NOT regexp_matches(x, '^(#|//|/\*|\*)')) AS ls FROM f),
 t AS (SELECT file_id, list_transform(flatten(list_transform(ls, lambda x: regexp_extract_all(x, '[a-zA-Z_]\w*|[^\s]'))), lambda y: CASE WHEN regexp_matches(y, '^[a-zA-Z_]\w*$') THEN '$id' WHEN y LIKE '"%' OR y LIKE '''%' THEN '$str' ELSE y END) AS t FROM l)"""
_WIN = _TOK + ", w AS (SELECT file_id AS file, i::INTEGER AS at_, md5(array_to_string(t[i:i + 19], ' ')) AS h FROM (SELECT file_id, t, unnest(range(1, len(t) - 18)) AS i FROM t WHERE len(t) >= 20))"
_D6 = r"SELECT doc_id, substr(line, 1, 80) AS title, 0.4::DOUBLE AS confidence FROM (SELECT doc_id, unnest(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS line FROM documents) WHERE regexp_matches(line, '" + T.DECISION_VERBS + "') AND regexp_matches(line, '" + T.DECISION_CAUSES + "')"
_D7 = "SELECT p_partkey, 'PR #' || p_partkey || ': ' || substr(line, 1, 60) AS title, 0.5::DOUBLE AS confidence FROM (SELECT p_partkey, 'use ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' because ' ELSE ' and ' END || p_type AS line FROM part) WHERE regexp_matches(line, '" + T.DECISION_VERBS + "') AND regexp_matches(line, '" + T.DECISION_CAUSES + "')"
_D8 = r"SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?m)^#\s+(.+)', 1), ''), CAST(doc_id AS VARCHAR)) AS title, coalesce(nullif(regexp_extract(text, '(?i)##\s+Status\s*\n\s*(.+)', 1), ''), nullif(regexp_extract(text, '(?im)^Status:\s*(\S+)', 1), ''), 'active') AS status, CAST(length(substr(text, 1, 500)) AS INTEGER) AS n FROM documents WHERE lower(trim(source)) = 'adr' AND text IS NOT NULL"
_V = "WITH p AS (SELECT q.vec_id AS query, v.vec_id, q.embedding::DOUBLE[] AS a, v.embedding::DOUBLE[] AS b FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"
_RE = R.with_("imports").rstrip() + ", re AS (SELECT source, target, count(*) AS edges FROM (SELECT split_part(src, '/', 1) AS source, split_part(dst, '/', 1) AS target FROM imports) WHERE source <> target AND source IN (SELECT repo_id FROM repos) AND target IN (SELECT repo_id FROM repos) GROUP BY ALL) "
_TOP = GQ._RANKS + ", t AS (SELECT node, rank FROM ranks ORDER BY 2 DESC, 1 LIMIT 200), top AS (SELECT file, node, rank FROM (SELECT split_part(node, '::', 1) AS file, node, rank, row_number() OVER (PARTITION BY split_part(node, '::', 1) ORDER BY rank DESC, node) AS k FROM t) WHERE k = 1)"
SQL = {
    "d1_token_counts": _TOK + " SELECT file_id, CAST(len(t) AS INTEGER) AS tokens, CAST(len(list_filter(t, lambda x: x = '$id')) AS INTEGER) AS ids, CAST(len(list_filter(t, lambda x: x = '$str')) AS INTEGER) AS strings FROM t",
    "d2_repeated_windows": _WIN + " SELECT file, count(*) AS windows, CAST(sum(n) AS BIGINT) AS places FROM (SELECT file, h, count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 1) GROUP BY file",
    "w6_top_clones": "SELECT DISTINCT * FROM (SELECT DISTINCT file_a, start_a, file_b, start_b, length, similarity, round(length * CASE WHEN similarity > 1 THEN similarity / 100 ELSE similarity END, 4) AS weight FROM clone_pairs WHERE file_a IS NOT NULL AND file_b IS NOT NULL AND similarity IS NOT NULL ORDER BY weight DESC, file_a, start_a, file_b, start_b LIMIT 500)",
    "d6_decisions": _D6,
    "d7_item_decisions": _D7,
    "d8_records": _D8,
    "u5_decisions": f"WITH x AS (SELECT DISTINCT * FROM (SELECT 'text' AS source, doc_id AS id, title, 'active' AS status, confidence FROM ({_D6}) UNION ALL SELECT 'item', p_partkey, title, 'active', confidence FROM ({_D7}) UNION ALL SELECT 'record', doc_id, title, status, 0.8::DOUBLE FROM ({_D8})) WHERE lower(status) = 'active') SELECT *, (SELECT count(*) FROM x) AS total FROM x ORDER BY confidence DESC, source, id, title LIMIT 100",
    "v1_upsert": "WITH n AS (SELECT vec_id + 5 AS vec_id, label + 100 AS label FROM embeddings WHERE vec_id % 10 = 0) SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT * FROM n",
    "v2_nearest": _V + ", s AS (SELECT query, vec_id, list_cosine_similarity(a, b) AS score FROM p) SELECT query, vec_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, vec_id) AS place FROM s) WHERE place <= 10",
    "v3_nearest_l2": _V + ", s AS (SELECT query, vec_id, list_distance(a, b) AS score FROM p) SELECT query, vec_id, round(score, 5) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12), vec_id) AS place FROM s) WHERE place <= 5",
    "v4_delete": "SELECT vec_id, label FROM embeddings WHERE label % 2 <> 0",
    "g22_repo_edges": _RE + "SELECT source, target, edges, CASE WHEN edges >= 10 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM re",
    "j13_conformance": _RE + "SELECT source, target, edges FROM re WHERE source LIKE '%-web' AND target LIKE '%-jobs'",
    "g14_kg_nodes": _TOP + ", " + R.SQL["ccn"] + ", " + _LAYERED.strip().removeprefix("WITH ") + " SELECT node, file, rank, (SELECT max(layer) FROM fl WHERE fl.file_path = file) AS layer, CASE WHEN coalesce(ccn, 1) > 10 THEN 'complex' WHEN coalesce(ccn, 1) > 5 THEN 'moderate' ELSE 'simple' END AS complexity FROM top LEFT JOIN ccn USING (node)",
    "g14_kg_edges": _TOP + " SELECT *, 'imports' AS type FROM (SELECT split_part(src, '::', 1) AS source, split_part(dst, '::', 1) AS target, count(*) AS n FROM calls GROUP BY ALL) WHERE source <> target AND source IN (SELECT file FROM top) AND target IN (SELECT file FROM top) UNION ALL SELECT src, dst, 1, 'depends_on' FROM calls WHERE src <> dst AND src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top)",
    "g14_kg_tour": R.with_("main_calls", "main_nodes").rstrip() + ", " + GQ._ENTRY.format(n="main_nodes") + " SELECT 'Entry point: ' || node AS title, split_part(node, '::', 1) AS target, 'Top-level entry point into the codebase' AS reason FROM entry ORDER BY node LIMIT 5",
    "g23_timeline": R.with_("calls", "nodes", "changed", "changed_before") + "SELECT node, split_part(node, '::', 1) IN (SELECT path FROM changed) AS changed_last, split_part(node, '::', 1) IN (SELECT path FROM changed_before) AS changed_before FROM nodes",
    "k1_mermaid": R.with_("imports") + "SELECT '    ' || translate(src, '()-', '___') || ' --> ' || translate(dst, '()-', '___') AS line FROM imports",
    "k2_sarif": R.with_("calls", "nodes", "changed", "findings", "closure").rstrip() + ", dead AS (SELECT node FROM nodes WHERE node NOT IN (SELECT dst FROM closure WHERE src NOT IN (SELECT dst FROM calls)) AND node IN (SELECT dst FROM calls)), ln AS (SELECT file_path AS node, min(line_start) AS line FROM findings WHERE line_start IS NOT NULL GROUP BY 1), x AS (SELECT src AS node, 'change-impact' AS rule, CASE WHEN count(*) >= 5 THEN 'error' ELSE 'warning' END AS level, src || ' calls ' || count(*) || ' functions' AS t FROM calls WHERE split_part(src, '::', 1) IN (SELECT path FROM changed) GROUP BY src UNION ALL SELECT node, 'dead-code', 'warning', node || ' is never reached' FROM dead) "
    """SELECT node, rule, level, '{"ruleId":"' || rule || '","level":"' || level || '","message":{"text":"' || t || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || split_part(node, '::', 1) || '"},"region":{"startLine":' || coalesce(line, 1) || '}}}]}' AS result FROM x LEFT JOIN ln USING (node)""",
    "k5_report": f"SELECT file, file || ': ' || functions || ' functions, risk up to ' || max_risk AS line FROM ({GQ.SQL['a24_changed_risk']})",
    "k6_complexity_table": R.with_("ccn") + "SELECT node, ccn, CASE WHEN ccn >= 10 THEN 'HIGH' WHEN ccn >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM ccn ORDER BY ccn DESC, node LIMIT 20",
    "w10_tree": R.with_("calls", "nodes").rstrip() + ", n AS (SELECT node, coalesce(o, 0) AS outgoing FROM nodes LEFT JOIN (SELECT src AS node, count(*) AS o FROM calls GROUP BY src) USING (node)), l0 AS (SELECT node, row_number() OVER (ORDER BY outgoing DESC, node) AS place FROM n WHERE node NOT IN (SELECT dst FROM calls) QUALIFY place <= 200), l1 AS (SELECT src AS parent, dst AS node, row_number() OVER (PARTITION BY src ORDER BY outgoing DESC, dst) AS place FROM calls JOIN n ON n.node = dst WHERE src IN (SELECT node FROM l0) QUALIFY place <= 12), l2 AS (SELECT src AS parent, dst AS node, row_number() OVER (PARTITION BY src ORDER BY outgoing DESC, dst) AS place FROM calls JOIN n ON n.node = dst WHERE src IN (SELECT node FROM l1) QUALIFY place <= 12) SELECT depth, parent, node, CAST(place AS INTEGER) AS place FROM (SELECT 0 AS depth, '' AS parent, node, place FROM l0 UNION ALL SELECT 1, parent, node, place FROM l1 UNION ALL SELECT 2, parent, node, place FROM l2)",
    "s22_cache": R.with_("changed") + "SELECT DISTINCT file_id, sha256(content) AS sha FROM file_contexts WHERE file_path IN (SELECT path FROM changed) AND content IS NOT NULL",
    "s23_fingerprint": "SELECT repo_id, bit_xor(CAST('0x' || substr(md5(file_path || sha256(content)), 1, 15) AS BIGINT)) AS fingerprint, count(*) AS files FROM (SELECT DISTINCT repo_id, file_path, content FROM file_contexts) GROUP BY repo_id",
}
