"""Scores, key figures and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import relations as R
from lodestone.operators import graph as G
from lodestone.operators import scoring as S
from lodestone.plans import graph_queries as GQ
from lodestone.plans.graph_queries import SQL as _GRAPH
from lodestone.plans.graph_queries import g16_blast_radius
from lodestone.session import materialize


def a5_capped_points(spark: SparkSession, d: str) -> DataFrame:
    x = S.category_sums(R.findings(spark, d))
    return x.select("file_path", "dim", "category", F.round("points", 4).alias("points"), F.round("counted", 4).alias("counted"))


def a6_file_scores(spark: SparkSession, d: str) -> DataFrame:
    x = S.file_scores(R.findings(spark, d))
    return x.select("file_path", *(F.round(c, 4).alias(c) for c in ("defect", "maintainability", "performance")))


def a7_impacts(spark: SparkSession, d: str) -> DataFrame:
    """Every finding's share of the capped points in its home dimension."""
    x = S.finding_impacts(R.findings(spark, d))
    return x.select("finding_id", "dim", F.round("impact", 3).alias("impact"))


def p17_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Home dimension of every biomarker against the stored one."""
    f = R.findings(spark, d)
    return f.groupBy("biomarker_type", S.home_dimension(F.col("biomarker_type")).alias("home"), "dimension").agg(F.count(F.lit(1)).alias("n"))


def a8_kpis(spark: SparkSession, d: str) -> DataFrame:
    """Average health weighted by lines, of all files and of hotspots (pagerank above 0.001); the worst file."""
    s = S.file_scores(R.findings(spark, d)).withColumnRenamed("file_path", "path")
    f = R.file_context(spark, d).join(s, F.col("file_path") == F.col("path"), "left").withColumn("score", F.round(F.coalesce("defect", F.lit(10.0)), 4)).withColumn("w", F.greatest(F.coalesce("nloc", F.lit(0)), F.lit(1)))
    hot = F.col("pagerank_score") > 0.001
    avg = lambda c: F.coalesce(F.sum(F.when(c, F.col("score") * F.col("w"))) / F.sum(F.when(c, F.col("w"))), F.lit(10.0))
    return f.agg(F.round(avg(F.lit(True)), 2).alias("average_health"), F.round(avg(hot), 2).alias("hotspot_health"), F.min(F.struct("score", "file_path"))["file_path"].alias("worst_path"), F.round(F.min("score"), 2).alias("worst_score"), F.count(F.lit(1)).alias("file_count"))


def a9_node_health(spark: SparkSession, d: str) -> DataFrame:
    """Per function: complexity above 10 is a complex method, above 20 a brain method as well; scored in closed form from
    the weighted, capped points."""
    n = R.nodes(R.calls(spark, d)).join(R.ccn(spark, d), "node", "left").select("node", F.coalesce("ccn", F.lit(1)).alias("ccn"))
    size = F.when(F.col("ccn") > 10, F.least(F.lit(S.SEVERITY["high"] * S.WEIGHT["complex_method"]), F.lit(S.CAP["size_and_complexity"]))).otherwise(0.0)
    brain = F.when(F.col("ccn") > 20, F.least(F.lit(S.SEVERITY["critical"] * S.WEIGHT["brain_method"]), F.lit(S.CAP["structural_complexity"]))).otherwise(0.0)
    keep = F.when(F.col("ccn") > 20, 8.0).otherwise(10.0)
    return n.select("node", "ccn", F.round(10.0 - size - brain, 4).alias("defect"), keep.alias("maintainability"))


def a10_repo_health(spark: SparkSession, d: str) -> DataFrame:
    n = R.nodes(R.calls(spark, d)).join(R.ccn(spark, d), "node", "left").select(F.coalesce("ccn", F.lit(1)).alias("ccn"))
    over = lambda k: F.sum((F.col("ccn") > k).cast("double"))
    s = n.agg(over(10).alias("n10"), over(20).alias("n20"), F.count(F.lit(1)).alias("n"))
    defect = F.greatest(F.lit(1.0), F.lit(10.0) - 10.0 * (0.5 * F.col("n10") + 1.0 * F.col("n20")) / F.col("n"))
    maintain = F.greatest(F.lit(1.0), F.lit(10.0) - 10.0 * (0.3 * F.col("n10") + 0.5 * F.col("n20")) / F.col("n"))
    return s.select(F.round(defect, 2).alias("defect"), F.round(maintain, 2).alias("maintainability"), F.lit(10.0).alias("performance"), F.round((defect + maintain + 10.0) / 3, 2).alias("overall"))


def a11_findings_filter(spark: SparkSession, d: str) -> DataFrame:
    """The findings of some types and severities, as rows."""
    x = R.findings(spark, d).where(F.col("severity").isin("high", "critical") & F.col("biomarker_type").isin("complex_method", "ownership_risk", "god_class"))
    return x.select("finding_id", "file_path", "biomarker_type", "severity", "function_name", "line_start", "line_end")


def a20_defect_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Files scored below 7 against files with prior defects: precision, recall, F1; precision of the k worst, over k."""
    s = S.file_scores(R.findings(spark, d)).select("file_path", F.round("defect", 4).alias("score"))
    prior = R.findings(spark, d).where("biomarker_type = 'prior_defect' AND file_path IS NOT NULL").select("file_path").distinct().withColumn("prior", F.lit(1))
    x = s.join(prior, "file_path", "left").withColumn("prior", F.coalesce("prior", F.lit(0))).withColumn("hot", (F.col("score") < 7).cast("int"))
    top = x.orderBy("score", "file_path").limit(25).withColumn("k", F.row_number().over(Window.orderBy("score", "file_path")))  # at most 25 rows
    at = top.agg(*((F.sum(F.when(F.col("k") <= k, F.col("prior")).otherwise(0)) / k).alias(f"p_at_{k}") for k in (5, 10, 25)))
    c = x.agg(F.sum(F.col("hot") * F.col("prior")).alias("tp"), F.sum("hot").alias("hot"), F.sum("prior").alias("prior"))
    p, r = F.coalesce(F.try_divide("tp", "hot"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "prior"), F.lit(0.0))
    return c.crossJoin(at).select(F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4).alias("f1"), *(F.round(f"p_at_{k}", 4).alias(f"p_at_{k}") for k in (5, 10, 25)))  # one row each


def a18_overall_risk(spark: SparkSession, d: str) -> DataFrame:
    """Risk of the last changes: the ranks of the changed files, and how many files they reach."""
    own = R.file_context(spark, d).join(R.changed_files(spark, d), F.col("file_path") == F.col("path"), "left_semi").agg(F.avg("pagerank_score").alias("mean"), F.max("pagerank_score").alias("top"))
    far = g16_blast_radius(spark, d).agg(F.count(F.lit(1)).alias("reached"))
    x = 8 * (1 - F.exp(-10 * (0.5 * F.col("mean") + 0.5 * F.col("top")))) + 2 * F.least(F.col("reached") / 20, F.lit(1.0))
    return own.crossJoin(far).select("reached", F.round(F.least(x, F.lit(10.0)), 4).alias("risk"))  # one row each


def p14_impact_levels(spark: SparkSession, d: str) -> DataFrame:
    """Level and summary of every file's importers."""
    n = F.col("incoming")
    level = F.when(n >= 5, "HIGH").when(n >= 3, "MEDIUM").otherwise("LOW")
    text = F.when(n >= 5, F.format_string("High risk: impacts %d downstream functions.", n)).when(n >= 3, F.format_string("Moderate risk: impacts %d functions.", n)).otherwise(F.format_string("Low risk: limited impact (%d functions).", n))
    return G.degrees(R.imports(spark, d)).select("node", level.alias("level"), text.alias("summary"))


def w7_ranked_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions by (1 + ln(1 + blast)) x (1 + ln(1 + importers)) x confidence."""
    s = R.table(spark, d, "refactoring_suggestions").select("suggestion_id", "file_path", "detector_name", "confidence", "blast_radius").distinct()
    deg = G.degrees(R.imports(spark, d)).select(F.col("node").alias("file_path"), "incoming")
    score = (1 + F.log1p(F.coalesce("blast_radius", F.lit(0)).cast("double"))) * (1 + F.log1p(F.coalesce("incoming", F.lit(0)).cast("double"))) * F.col("confidence")
    return s.join(deg, "file_path", "left").select("suggestion_id", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "suggestion_id").limit(50)


def k4_summary_json(spark: SparkSession, d: str) -> DataFrame:
    """The summary of the graph as one JSON document: counts, hotspots by impact, changed ones, dead nodes; ten of each."""
    e = materialize(R.calls(spark, d), "calls")
    ranked = materialize(G.impact_sizes(e).join(G.degrees(e), "node").select("node", F.col("impact").alias("risk"), "outgoing", "incoming"), "ranked")
    changed = GQ.changed_nodes(spark, d)
    order = [F.desc("risk"), F.desc("outgoing"), F.desc("incoming"), "node"]

    def top(x: DataFrame, name: str) -> DataFrame:
        at = Window.orderBy(*order)  # ten rows
        few = x.orderBy(*order).limit(10).withColumn("k", F.row_number().over(at))
        return few.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.struct("node", "risk").alias("v")))), lambda t: t["v"]).alias(name))

    dead = materialize(GQ.dead_nodes(e), "dead")
    few = dead.orderBy("node").limit(10).agg(F.array_sort(F.collect_list("node")).alias("dead_nodes"))
    counts = ranked.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(e.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(changed.agg(F.count(F.lit(1)).alias("changed"))).crossJoin(dead.agg(F.count(F.lit(1)).alias("dead")))  # one row each
    x = counts.crossJoin(top(ranked, "top_hotspots")).crossJoin(top(ranked.join(changed, "node", "left_semi"), "changed_hotspots")).crossJoin(few)  # one row each
    return x.select(F.to_json(F.struct(F.struct("nodes", "edges", "changed", "dead").alias("counts"), "top_hotspots", "changed_hotspots", "dead_nodes")).alias("payload"))


QUERIES = {f.__name__: f for f in (a5_capped_points, a6_file_scores, a7_impacts, a8_kpis, a9_node_health, a10_repo_health, a11_findings_filter, a20_defect_accuracy, a18_overall_risk, w7_ranked_suggestions, k4_summary_json)}
QUERIES |= {"scalar_p17_dimensions": p17_dimensions, "scalar_p14_impact_levels": p14_impact_levels}


def _case(key: str, values: dict, default: str) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in values.items()) + f" ELSE {default} END"


_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_SEV = f"coalesce(deduction, {_case('lower(severity)', S.SEVERITY, 'CAST(0.5 AS DOUBLE)')})"
_POINTS = R.SQL["findings"] + f""",
 wp AS (
  SELECT finding_id, file_path, 'defect' AS dim, {_case('biomarker_type', S.CATEGORY, "'size_and_complexity'")} AS category, {_SEV} * {_case('biomarker_type', S.WEIGHT, 'CAST(1 AS DOUBLE)')} AS points FROM findings WHERE biomarker_type NOT IN {_IN(S.PERFORMANCE_WEIGHT)}
  UNION ALL SELECT finding_id, file_path, 'maintainability', {_case('biomarker_type', S.MAINTAINABILITY_CATEGORY, "'size_and_complexity'")}, {_SEV} FROM findings WHERE biomarker_type IN {_IN(S.MAINTAINABILITY)}
  UNION ALL SELECT finding_id, file_path, 'performance', 'performance', {_SEV} * {_case('biomarker_type', S.PERFORMANCE_WEIGHT, 'CAST(1 AS DOUBLE)')} FROM findings WHERE biomarker_type IN {_IN(S.PERFORMANCE_WEIGHT)}),
 cs AS (SELECT file_path, dim, category, CAST(sum(CAST(points AS DECIMAL(20,6))) AS DOUBLE) AS points, CASE dim WHEN 'defect' THEN {_case('category', S.CAP, 'CAST(1 AS DOUBLE)')} WHEN 'maintainability' THEN {_case('category', S.MAINTAINABILITY_CAP, 'CAST(1 AS DOUBLE)')} ELSE CAST(1 AS DOUBLE) END AS cap FROM wp WHERE file_path IS NOT NULL GROUP BY file_path, dim, category),
 fs AS (SELECT file_path, {', '.join(f"greatest(1.0, least(10.0, 10.0 - coalesce(sum(CASE WHEN dim = '{x}' THEN least(points, cap) END), 0))) AS {x}" for x in ('defect', 'maintainability', 'performance'))} FROM cs GROUP BY file_path)"""
_C = "WITH " + _POINTS + " "
_BLAST = _GRAPH["g16_blast_radius"]
SQL = {
    "a5_capped_points": _C + "SELECT file_path, dim, category, round(points, 4) AS points, round(least(points, cap), 4) AS counted FROM cs",
    "a6_file_scores": _C + "SELECT file_path, round(defect, 4) AS defect, round(maintainability, 4) AS maintainability, round(performance, 4) AS performance FROM fs",
    "a7_impacts": _C + f"SELECT finding_id, dim, round(CASE WHEN cs.points > 0 THEN wp.points * least(cs.points, cap) / cs.points ELSE 0 END, 3) AS impact FROM wp JOIN cs USING (file_path, dim, category) JOIN findings USING (finding_id) WHERE dim = CASE WHEN biomarker_type IN {_IN(S.PERFORMANCE_WEIGHT)} THEN 'performance' WHEN biomarker_type IN {_IN(S.MAINTAINABILITY_HOME)} THEN 'maintainability' ELSE 'defect' END",
    "a8_kpis": _C.rstrip() + ", " + R.SQL["file_context"] + ", x AS (SELECT file_path, round(coalesce(defect, 10.0), 4) AS score, greatest(coalesce(nloc, 0), 1) AS w, pagerank_score > 0.001 AS hot FROM file_context LEFT JOIN fs USING (file_path)) SELECT round(sum(score * w) / sum(w), 2) AS average_health, round(coalesce(sum(score * w) FILTER (hot) / sum(w) FILTER (hot), 10.0), 2) AS hotspot_health, (SELECT file_path FROM x ORDER BY score, file_path LIMIT 1) AS worst_path, round(min(score), 2) AS worst_score, count(*) AS file_count FROM x",
    "a9_node_health": R.with_("calls", "nodes", "ccn") + "SELECT node, coalesce(ccn, 1) AS ccn, round(CASE WHEN coalesce(ccn, 1) > 20 THEN 7.548 WHEN coalesce(ccn, 1) > 10 THEN 8.548 ELSE 10 END::DOUBLE, 4) AS defect, CASE WHEN coalesce(ccn, 1) > 20 THEN 8.0 ELSE 10.0 END::DOUBLE AS maintainability FROM nodes LEFT JOIN ccn USING (node)",
    "a10_repo_health": R.with_("calls", "nodes", "ccn").rstrip() + ", s AS (SELECT CAST(count(*) FILTER (ccn > 10) AS DOUBLE) AS a, CAST(count(*) FILTER (ccn > 20) AS DOUBLE) AS b, count(*) AS n FROM nodes LEFT JOIN ccn USING (node)), t AS (SELECT greatest(1.0, 10.0 - 10.0 * (0.5::DOUBLE * a + b) / n) AS x, greatest(1.0, 10.0 - 10.0 * (0.3::DOUBLE * a + 0.5::DOUBLE * b) / n) AS y FROM s) SELECT round(x, 2) AS defect, round(y, 2) AS maintainability, 10.0::DOUBLE AS performance, round((x + y + 10.0) / 3, 2) AS overall FROM t",
    "a11_findings_filter": R.with_("findings") + "SELECT finding_id, file_path, biomarker_type, severity, function_name, line_start, line_end FROM findings WHERE severity IN ('high', 'critical') AND biomarker_type IN ('complex_method', 'ownership_risk', 'god_class')",
    "a20_defect_accuracy": _C.rstrip() + ", pr AS (SELECT DISTINCT file_path FROM findings WHERE biomarker_type = 'prior_defect' AND file_path IS NOT NULL), x AS (SELECT file_path, round(defect, 4) AS score, CAST(file_path IN (SELECT file_path FROM pr) AS INTEGER) AS prior, CAST(round(defect, 4) < 7 AS INTEGER) AS hot FROM fs), c AS (SELECT CAST(sum(hot * prior) AS DOUBLE) AS tp, sum(hot) AS h, sum(prior) AS p FROM x), q AS (SELECT coalesce(tp / nullif(h, 0), 0) AS pr, coalesce(tp / nullif(p, 0), 0) AS re FROM c), t AS (SELECT prior, row_number() OVER (ORDER BY score, file_path) AS k FROM x) SELECT round(pr, 4) AS precision, round(re, 4) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 4) AS f1, "
    + ", ".join(f"round((SELECT sum(prior) FILTER (k <= {k}) FROM t) / {k}.0, 4)::DOUBLE AS p_at_{k}" for k in (5, 10, 25)) + " FROM q",
    "a18_overall_risk": R.with_("changed") + "SELECT reached, round(least(8 * (1 - exp(-10 * (0.5 * mean + 0.5 * top))) + 2 * least(reached / 20.0::DOUBLE, 1.0), 10.0), 4) AS risk FROM (SELECT count(*) AS reached FROM (" + _BLAST + ")), (SELECT avg(pagerank_score) AS mean, max(pagerank_score) AS top FROM (SELECT DISTINCT file_id, pagerank_score FROM file_contexts WHERE file_path IN (SELECT path FROM changed)))",
    "w7_ranked_suggestions": R.with_("imports").rstrip() + ", s AS (SELECT DISTINCT suggestion_id, file_path, confidence, blast_radius FROM refactoring_suggestions), g AS (SELECT dst AS file_path, count(*) AS incoming FROM imports GROUP BY dst) SELECT suggestion_id, round((1 + ln(1 + coalesce(blast_radius, 0)::DOUBLE)) * (1 + ln(1 + coalesce(incoming, 0)::DOUBLE)) * confidence, 4) AS score FROM s LEFT JOIN g USING (file_path) ORDER BY score DESC, suggestion_id LIMIT 50",
    "k4_summary_json": GQ._RISK.rstrip() + ", ranked AS (SELECT node, impact AS risk, outgoing, incoming FROM risk JOIN deg USING (node)), dead AS (SELECT node FROM nodes WHERE node NOT IN (SELECT dst FROM closure WHERE src NOT IN (SELECT dst FROM calls)) AND node IN (SELECT dst FROM calls)) "
    """SELECT to_json({'counts': {'nodes': (SELECT count(*) FROM nodes), 'edges': (SELECT count(*) FROM calls), 'changed': (SELECT count(*) FROM touched), 'dead': (SELECT count(*) FROM dead)},
 'top_hotspots': (SELECT list({'node': node, 'risk': risk} ORDER BY risk DESC, outgoing DESC, incoming DESC, node) FROM (SELECT * FROM ranked ORDER BY risk DESC, outgoing DESC, incoming DESC, node LIMIT 10)),
 'changed_hotspots': (SELECT list({'node': node, 'risk': risk} ORDER BY risk DESC, outgoing DESC, incoming DESC, node) FROM (SELECT * FROM ranked WHERE node IN (SELECT node FROM touched) ORDER BY risk DESC, outgoing DESC, incoming DESC, node LIMIT 10)),
 'dead_nodes': coalesce((SELECT list(node ORDER BY node) FROM (SELECT node FROM dead ORDER BY node LIMIT 10)), [])})::VARCHAR AS payload""",
    "scalar_p17_dimensions": R.with_("findings") + f"SELECT biomarker_type, CASE WHEN biomarker_type IN {_IN(S.PERFORMANCE_WEIGHT)} THEN 'performance' WHEN biomarker_type IN {_IN(S.MAINTAINABILITY_HOME)} THEN 'maintainability' ELSE 'defect' END AS home, dimension, count(*) AS n FROM findings GROUP BY ALL",
    "scalar_p14_impact_levels": R.with_("imports").rstrip() + ", n AS (SELECT node, CAST(sum(i) AS BIGINT) AS i FROM (SELECT dst AS node, 1 AS i FROM imports UNION ALL SELECT src, 0 FROM imports) GROUP BY node) SELECT node, CASE WHEN i >= 5 THEN 'HIGH' WHEN i >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN i >= 5 THEN 'High risk: impacts ' || i || ' downstream functions.' WHEN i >= 3 THEN 'Moderate risk: impacts ' || i || ' functions.' ELSE 'Low risk: limited impact (' || i || ' functions).' END AS summary FROM n",
}
