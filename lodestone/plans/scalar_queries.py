"""Scalar functions, layers and test gaps over the file tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import relations as R
from lodestone.functions import embedders
from lodestone.functions import paths as P
from lodestone.operators.vectors import cosine
from lodestone.tables import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Files with the repository's folder taken off."""
    return R.file_context(spark, d).withColumn("path", F.regexp_replace("file_path", "^[^/]+/", ""))


def p1_p2_names(spark: SparkSession, d: str) -> DataFrame:
    n = R.depends(spark, d).select(F.col("src").alias("node")).distinct()
    label = F.element_at(F.split("node", "::"), -1)
    return n.select("node", F.split_part("node", F.lit("::"), F.lit(1)).alias("file"), label.alias("label"), F.element_at(F.split(label, "\\."), -1).alias("bare"))


def p3_suffix_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = R.nodes(R.main_calls(spark, d))
    return n.where(F.endswith(F.col("node"), F.concat(F.lit("::"), F.lit("main")))).select("node")


def p4_module_paths(spark: SparkSession, d: str) -> DataFrame:
    """Dotted module names resolved to a file, or to a package's init file."""
    f = R.file_context(spark, d).where(F.col("file_path").endswith(".py")).select("file_path").distinct()
    m = f.select(F.regexp_replace(F.regexp_replace("file_path", r"\.py$", ""), "/", ".").alias("module")).distinct()
    a = m.withColumn("want", P.module_file(F.col("module")))
    return a.join(f, F.col("want") == F.col("file_path"), "left").select("module", "file_path")


def p7_layers(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("file_id", P.layer(F.col("path")).alias("layer"))


def p8_simple_layers(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("file_id", P.simple_layer(F.col("path")).alias("layer"))


def a4_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Files per layer and per extension."""
    f = _files(spark, d).select(P.layer(F.col("path")).alias("layer"), F.regexp_extract("file_path", r"(\.[^./]+)$", 1).alias("ext"))
    x = f.select(F.explode(F.array(F.struct(F.lit("layer").alias("kind"), F.col("layer").alias("value")), F.struct(F.lit("ext").alias("kind"), F.col("ext").alias("value")))).alias("e")).select("e.*")
    return x.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("files"))


def p9_risk_tags(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("file_id", F.array_join(P.risk_tags(F.col("path")), ",").alias("tags"), P.risk_text(P.risk_tags(F.col("path"))).alias("evidence"))


def p11_safe_to_delete(spark: SparkSession, d: str) -> DataFrame:
    """Files without importers: whether they are safe to delete."""
    f = _files(spark, d)
    idle = f.join(R.imports(spark, d).where("src <> dst").select(F.col("dst").alias("file_path")), "file_path", "left_anti")
    confidence = F.when(F.col("has_test_file"), 0.5).otherwise(0.9)
    return idle.select("file_id", P.safe_to_delete(confidence, F.col("path"), F.col("nloc") > 0).alias("safe"))


def p12_p13_levels(spark: SparkSession, d: str) -> DataFrame:
    c = R.ccn(spark, d)
    return c.select("node", F.when(F.col("ccn") > 10, "complex").when(F.col("ccn") > 5, "moderate").otherwise("simple").alias("bucket"), F.when(F.col("ccn") >= 10, "HIGH").when(F.col("ccn") >= 5, "MEDIUM").otherwise("LOW").alias("level"))


def p15_repo_risk(spark: SparkSession, d: str) -> DataFrame:
    """Risk of a change to a whole repository by its importers."""
    deg = R.imports(spark, d).groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    j = R.file_context(spark, d).join(deg, F.col("file_path") == F.col("dst"), "left").groupBy("repo_id").agg(F.coalesce(F.max("n"), F.lit(0)).alias("top"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return j.select("repo_id", "total", F.when((F.col("top") >= 5) | (F.col("total") >= 5), "HIGH").when((F.col("top") >= 3) | (F.col("total") >= 3), "MEDIUM").otherwise("LOW").alias("risk"))


def p16_deductions(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.operators.scoring import deduction

    return R.findings(spark, d).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(deduction(F.col("severity"))), 3).alias("points"))


def p28_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of every vector with the first one."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    first = v.orderBy("vec_id").limit(1).select(F.col("v").alias("w"))  # one row
    return v.crossJoin(F.broadcast(first)).select("vec_id", F.round(cosine(F.col("v"), F.col("w")), 6).alias("score"))


def p22_labels(spark: SparkSession, d: str) -> DataFrame:
    n = R.depends(spark, d).select(F.col("src").alias("node")).distinct()
    return n.select("node", F.translate("node", "()-", "___").alias("label"), F.replace(F.replace("node", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")).alias("escaped"))


def p29_mock_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen numbers in [0, 1] from the hash of a repository's name, by the embedder of that name."""
    r = table(spark, d, "repos").select("repo_id", embedders.embedder("mock")(F.col("repo_id")).alias("e"))
    return r.select("repo_id", *(F.round(F.col("e")[i], 6).alias(f"e{i:02d}") for i in range(16)))


def p30_file_risk(spark: SparkSession, d: str) -> DataFrame:
    hot = F.coalesce(F.col("dependents_count"), F.lit(0)).cast("double") / 100
    return R.file_context(spark, d).select("file_id", F.round(F.col("pagerank_score") * (1 + hot), 12).alias("risk"))


def s14_changed_filter(spark: SparkSession, d: str) -> DataFrame:
    """Python and JavaScript files outside of test and build folders."""
    f = _files(spark, d)
    skip = F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(x) for x in ("tests", "build", "__pycache__", ".venv"))))
    return f.where(F.col("path").rlike(r"\.(py|js)$") & ~skip).select("file_id")


def j4_default_ccn(spark: SparkSession, d: str) -> DataFrame:
    n = R.nodes(R.calls(spark, d)).join(R.ccn(spark, d), "node", "left")
    return n.select("node", F.coalesce("ccn", F.lit(1)).alias("ccn"))


def w5_most_complex(spark: SparkSession, d: str) -> DataFrame:
    return R.ccn(spark, d).orderBy(F.desc("ccn"), "node").limit(20)


def test_gaps(affected: DataFrame, tests: DataFrame) -> DataFrame:
    """The ``affected`` files (path) without a test: no test's file name (path) holds ``test_{base}``, ``{base}_test`` or
    ``{base}.spec.``, base being the file's name without its last extension.

    A substring search compares every file with every test.  Here a test's name gives what its text could be a test of: all
    beginnings of what stands behind ``test_``, and all ends of what stands before ``_test`` or ``.spec.``; an equi anti-join
    does the rest.  Names are short, so a test gives a bounded number of rows."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    t = tests.select(name("path").alias("n")).distinct()
    at = F.sequence(F.lit(1), F.length("n"))
    starts = lambda mark: F.filter(at, lambda i: F.substring(F.col("n"), i, F.lit(len(mark))) == mark)
    after = F.flatten(F.transform(starts("test_"), lambda i: F.transform(F.sequence(F.lit(0), F.length("n") - i - 4), lambda k: F.substring(F.col("n"), i + 5, k))))
    before = lambda mark: F.flatten(F.transform(starts(mark), lambda i: F.transform(F.sequence(F.lit(1), i), lambda k: F.substring(F.col("n"), k, i - k))))
    bases = t.select(F.explode(F.array_distinct(F.concat(after, before("_test"), before(".spec.")))).alias("base")).distinct()
    f = affected.withColumn("base", F.regexp_replace(name("path"), r"(?<=.)\.[^.]*$", ""))
    return f.join(bases, "base", "left_anti").select("path")


def j8_test_gaps(spark: SparkSession, d: str) -> DataFrame:
    f = R.file_context(spark, d).select(F.col("file_path").alias("path")).distinct()
    return test_gaps(f, f)


def p32_test_paths(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).where(F.col("path").startswith("test")).select("file_id")


def j5_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Every node with the first line that is known of it, 1 where none is."""
    known = R.findings(spark, d).where("line_start IS NOT NULL").groupBy(F.col("file_path").alias("node")).agg(F.min("line_start").alias("line"))
    return R.nodes(R.calls(spark, d)).join(known, "node", "left").select("node", F.coalesce("line", F.lit(1)).alias("line"))


def a21_rate_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Amounts joined to a small table of rates and rolled up: characters by source, one half for sources without a rate."""
    c = lambda x: F.lower(F.trim(x))
    used = table(spark, d, "documents").groupBy(F.coalesce(c("source"), F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("items"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("amount"))
    rates = table(spark, d, "mix_targets").select(c("source").alias("source"), F.col("target_share").alias("rate")).distinct()
    x = used.join(F.broadcast(rates), "source", "left")  # 13 rates
    return x.select("source", "items", "amount", F.round(F.col("amount") * F.coalesce("rate", F.lit(0.5)), 4).alias("total"))


def j15_cross_layer(spark: SparkSession, d: str) -> DataFrame:
    """Imports between layers."""
    f = _files(spark, d).select(F.col("file_path"), P.layer(F.col("path")).alias("layer")).distinct()
    e = R.imports(spark, d)
    a = e.join(f.select(F.col("file_path").alias("src"), F.col("layer").alias("from_layer")), "src").join(f.select(F.col("file_path").alias("dst"), F.col("layer").alias("to_layer")), "dst")
    return a.where("from_layer <> to_layer").groupBy("from_layer", "to_layer").agg(F.count(F.lit(1)).alias("edges"))


def a22_layer_net(spark: SparkSession, d: str) -> DataFrame:
    x = j15_cross_layer(spark, d).where(~F.col("from_layer").isin(*P.PINNED_LAYERS) & ~F.col("to_layer").isin(*P.PINNED_LAYERS))
    ends = x.select(F.explode(F.array(F.struct(F.col("from_layer").alias("layer"), (-F.col("edges")).alias("n")), F.struct(F.col("to_layer").alias("layer"), F.col("edges").alias("n")))).alias("e")).select("e.*")
    return ends.groupBy("layer").agg(F.sum("n").alias("net"))


def w8_layer_order(spark: SparkSession, d: str) -> DataFrame:
    """Layers from the outside in: runtime layers by incoming minus outgoing imports, then the pinned ones."""
    from pyspark.sql import Window

    layers = _files(spark, d).select(P.layer(F.col("path")).alias("layer")).distinct()
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in P.LAYER_RANK.items() for x in kv)), F.col("layer"))
    x = layers.join(a22_layer_net(spark, d), "layer", "left").select("layer", F.col("layer").isin(*P.PINNED_LAYERS).alias("pinned"), F.coalesce("net", F.lit(0)).alias("net"), rank.alias("rank"))
    order = Window.orderBy("pinned", F.when(F.col("pinned"), 0).otherwise(F.col("net")), "rank")  # a dozen rows
    return x.select("layer", F.row_number().over(order).alias("place"))


QUERIES = {f.__name__: f for f in (a4_histograms, s14_changed_filter, j4_default_ccn, w5_most_complex, j8_test_gaps, j5_line_numbers, a21_rate_rollup, j15_cross_layer, a22_layer_net, w8_layer_order)}
QUERIES |= {f"scalar_{f.__name__}": f for f in (p1_p2_names, p3_suffix_lookup, p4_module_paths, p7_layers, p8_simple_layers, p9_risk_tags, p11_safe_to_delete, p12_p13_levels, p15_repo_risk, p16_deductions, p22_labels, p28_cosine, p29_mock_embedding, p30_file_risk, p32_test_paths)}

_L = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
# the values stand here once more, so that a wrong one on the other side shows
_HINT = "CASE WHEN x IN ('cli', 'commands', 'cmd', 'cli_commands') THEN 'CLI' WHEN x IN ('routes', 'api', 'controllers', 'endpoints', 'handlers', 'routers') THEN 'API' WHEN x IN ('services', 'core', 'lib', 'domain', 'logic', 'usecases') THEN 'Service' WHEN x IN ('models', 'db', 'data', 'persistence', 'repository', 'repositories', 'store', 'stores', 'entities') THEN 'Data' WHEN x IN ('components', 'views', 'pages', 'ui', 'layouts', 'widgets', 'screens') THEN 'UI' WHEN x IN ('middleware', 'plugins', 'interceptors', 'guards') THEN 'Middleware' WHEN x IN ('utils', 'helpers', 'common', 'shared', 'tools', 'util') THEN 'Utility' WHEN x IN ('config', 'constants', 'env', 'settings', 'conf') THEN 'Config' WHEN x IN ('types', 'interfaces', 'schemas', 'contracts', 'dtos', 'typings') THEN 'Types' END"
_NAME_TAG = "CASE WHEN x IN ('config', 'configs', 'configuration', 'conf', 'settings', 'setting', 'setup') THEN 'config' WHEN x IN ('env', 'environment', 'environ', 'dotenv') THEN 'environment' WHEN x IN ('bootstrap', 'startup', 'entrypoint') THEN 'bootstrap' WHEN x IN ('database', 'db', 'schema', 'seed', 'seeds', 'migration', 'migrations', 'datastore', 'sqlite') THEN 'database' END"
_FOLDER_TAG = "CASE WHEN x IN ('config', 'configs', 'settings') THEN 'config' WHEN x IN ('env', 'environments') THEN 'environment' WHEN x IN ('bootstrap') THEN 'bootstrap' WHEN x IN ('database', 'db', 'migrations') THEN 'database' WHEN x IN ('scripts', 'bin', 'tasks') THEN 'script' END"
_F = "WITH " + R.SQL["file_context"] + r""",
 f0 AS (SELECT *, regexp_replace(file_path, '^[^/]+/', '') AS path FROM file_context),
 f1 AS (SELECT *, string_split(lower(path), '/') AS parts FROM f0),
 f2 AS (SELECT *, parts[1:len(parts) - 1] AS dirs, parts[-1] AS fname FROM f1),
 f3 AS (SELECT *, CASE WHEN regexp_matches(fname, '^.+\.[^.]*$') THEN regexp_replace(fname, '\.[^.]*$', '') ELSE fname END AS stem FROM f2),
 f4 AS (SELECT *, list_filter(list_transform(list_reverse(dirs), lambda x: """ + _HINT + r"""), lambda x: x IS NOT NULL) AS hints FROM f3),
 fl AS (SELECT *, CASE WHEN regexp_matches(stem, '^(test_|spec_)|(_test|_spec|_specs)$') OR list_has_any(dirs, ['__tests__', 'test', 'tests', 'e2e']) THEN 'Test' WHEN len(dirs) > 0 AND dirs[1] LIKE '.%' THEN 'Config' WHEN list_has_any(dirs, ['examples', '_examples', 'example', 'samples', 'sample', 'demo', 'demos', 'bench', 'benches', 'benchmarks', 'docs', 'doc', 'website', 'scripts', 'script', 'docker', 'plugins']) THEN 'Docs & Tooling' ELSE coalesce(hints[1], 'Application') END AS layer FROM f4) """
_X = _F.rstrip() + ", " + R.SQL["imports"] + ", xl AS (SELECT a.layer AS from_layer, b.layer AS to_layer, count(*) AS edges FROM imports e JOIN (SELECT DISTINCT file_path, layer FROM fl) a ON e.src = a.file_path JOIN (SELECT DISTINCT file_path, layer FROM fl) b ON e.dst = b.file_path WHERE a.layer <> b.layer GROUP BY ALL), net AS (SELECT layer, CAST(sum(n) AS BIGINT) AS net FROM (SELECT from_layer AS layer, -edges AS n FROM xl WHERE from_layer NOT IN ('Test', 'Docs & Tooling') AND to_layer NOT IN ('Test', 'Docs & Tooling') UNION ALL SELECT to_layer, edges FROM xl WHERE from_layer NOT IN ('Test', 'Docs & Tooling') AND to_layer NOT IN ('Test', 'Docs & Tooling')) GROUP BY layer) "
_TAGS = f"list_sort(list_distinct(list_filter(list_concat(list_transform(regexp_split_to_array(fname, '[._\\-]+'), lambda x: {_NAME_TAG}), list_transform(dirs, lambda x: {_FOLDER_TAG})), lambda x: x IS NOT NULL)))"
_HAS = lambda *names: f"list_has_any(parts, {_L(names)})"
SQL = {
    "a4_histograms": _F + r"SELECT 'layer' AS kind, layer AS value, count(*) AS files FROM fl GROUP BY ALL UNION ALL SELECT 'ext', regexp_extract(file_path, '(\.[^./]+)$', 1), count(*) FROM fl GROUP BY ALL",
    "s14_changed_filter": _F + r"SELECT file_id FROM fl WHERE regexp_matches(path, '\.(py|js)$') AND NOT list_has_any(string_split(path, '/'), ['tests', 'build', '__pycache__', '.venv'])",
    "j4_default_ccn": R.with_("calls", "nodes", "ccn") + "SELECT node, coalesce(ccn, 1) AS ccn FROM nodes LEFT JOIN ccn USING (node)",
    "w5_most_complex": R.with_("ccn") + "SELECT node, ccn FROM ccn ORDER BY ccn DESC, node LIMIT 20",
    "j8_test_gaps": "WITH f AS (SELECT DISTINCT file_path AS path FROM file_contexts), t AS (SELECT DISTINCT regexp_extract(path, '[^/]*$') AS n FROM f WHERE path LIKE '%test%' OR path LIKE '%.spec.%'), b AS (SELECT path, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS base FROM f) SELECT path FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(n, 'test_' || base) OR contains(n, base || '_test') OR contains(n, base || '.spec.'))",
    "j5_line_numbers": R.with_("calls", "nodes", "findings") + "SELECT node, coalesce(line, 1) AS line FROM nodes LEFT JOIN (SELECT file_path AS node, min(line_start) AS line FROM findings WHERE line_start IS NOT NULL GROUP BY 1) USING (node)",
    "a21_rate_rollup": "WITH u AS (SELECT coalesce(lower(trim(source)), 'unknown') AS source, count(*) AS items, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS amount FROM documents GROUP BY 1) SELECT u.source, items, amount, round(amount * coalesce(target_share, 0.5), 4) AS total FROM u LEFT JOIN mix_targets m ON u.source = lower(trim(m.source))",
    "scalar_p32_test_paths": _F + "SELECT file_id FROM fl WHERE path LIKE 'test%'",
    "j15_cross_layer": _X + "SELECT * FROM xl",
    "a22_layer_net": _X + "SELECT * FROM net",
    "w8_layer_order": _X + "SELECT layer, CAST(row_number() OVER (ORDER BY layer IN ('Test', 'Docs & Tooling'), CASE WHEN layer IN ('Test', 'Docs & Tooling') THEN 0 ELSE coalesce(net, 0) END, " + "CASE layer " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.LAYER_RANK.items()) + " END) AS INTEGER) AS place FROM (SELECT DISTINCT layer FROM fl) LEFT JOIN net USING (layer)",
    "scalar_p1_p2_names": R.with_("depends") + "SELECT DISTINCT src AS node, split_part(src, '::', 1) AS file, split_part(src, '::', -1) AS label, split_part(split_part(src, '::', -1), '.', -1) AS bare FROM depends",
    "scalar_p3_suffix_lookup": R.with_("main_calls", "main_nodes") + "SELECT node FROM main_nodes WHERE node LIKE '%::main'",
    "scalar_p4_module_paths": _F + "SELECT DISTINCT replace(regexp_replace(a.file_path, '\\.py$', ''), '/', '.') AS module, b.file_path FROM fl a LEFT JOIN fl b ON b.file_path = replace(replace(regexp_replace(a.file_path, '\\.py$', ''), '/', '.'), '.', '/') || '.py' WHERE a.file_path LIKE '%.py'",
    "scalar_p7_layers": _F + "SELECT file_id, layer FROM fl",
    "scalar_p8_simple_layers": _F + f"SELECT file_id, CASE WHEN {_HAS('test', 'tests')} THEN 'Test' WHEN {_HAS('api', 'routes', 'routers', 'controllers')} THEN 'API' WHEN {_HAS('models', 'db', 'persistence')} THEN 'Data' WHEN {_HAS('services', 'core')} THEN 'Service' WHEN {_HAS('components', 'views', 'pages', 'ui')} THEN 'UI' WHEN {_HAS('config', 'settings')} THEN 'Config' ELSE 'Utility' END AS layer FROM fl",
    "scalar_p9_risk_tags": _F + f"SELECT file_id, array_to_string({_TAGS}, ',') AS tags, CASE WHEN len({_TAGS}) > 0 THEN 'Runtime-load risk: ' || array_to_string(list_transform({_TAGS}, lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.TAG_TEXT.items()) + " END), ', ') END AS evidence FROM fl",
    "scalar_p11_safe_to_delete": _F.rstrip() + ", " + R.SQL["imports"] + f" SELECT file_id, coalesce(nloc > 0, false) AND NOT has_test_file AND len({_TAGS}) = 0 AS safe FROM fl WHERE file_path NOT IN (SELECT dst FROM imports WHERE src <> dst)",
    "scalar_p12_p13_levels": R.with_("ccn") + "SELECT node, CASE WHEN ccn > 10 THEN 'complex' WHEN ccn > 5 THEN 'moderate' ELSE 'simple' END AS bucket, CASE WHEN ccn >= 10 THEN 'HIGH' WHEN ccn >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM ccn",
    "scalar_p15_repo_risk": _F.rstrip() + ", " + R.SQL["imports"] + ", g AS (SELECT dst, count(*) AS n FROM imports GROUP BY dst), j AS (SELECT repo_id, coalesce(max(n), 0) AS top, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM fl LEFT JOIN g ON file_path = dst GROUP BY repo_id) SELECT repo_id, total, CASE WHEN top >= 5 OR total >= 5 THEN 'HIGH' WHEN top >= 3 OR total >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM j",
    "scalar_p16_deductions": R.with_("findings") + "SELECT severity, count(*) AS n, max(CASE severity WHEN 'low' THEN 0.3 WHEN 'medium' THEN 0.7 WHEN 'high' THEN 1.2 WHEN 'critical' THEN 2.0 ELSE 0.5 END)::DOUBLE AS points FROM findings GROUP BY severity",
    "scalar_p28_cosine": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(list_cosine_similarity(v, (SELECT v FROM v ORDER BY vec_id LIMIT 1)), 6) AS score FROM v",
    "scalar_p22_labels": R.with_("depends") + "SELECT DISTINCT src AS node, translate(src, '()-', '___') AS label, replace(replace(src, '&', '&amp;'), '<', '&lt;') AS escaped FROM depends",
    "scalar_p29_mock_embedding": "SELECT repo_id, " + ", ".join(f"round(CAST(('0x' || substr(sha256(repo_id), {2 * i + 1}, 2)) AS INTEGER) / 255.0::DOUBLE, 6) AS e{i:02d}" for i in range(16)) + " FROM repos",
    "scalar_p30_file_risk": R.with_("file_context") + "SELECT file_id, round(pagerank_score * (1 + coalesce(dependents_count, 0)::DOUBLE / 100), 12) AS risk FROM file_context",
}
