"""Ownership, history and detector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import relations as R
from lodestone.operators import biomarkers as B
from lodestone.operators import history as H
from lodestone.tables import table

NOW = "2024-02-01 00:00:00"
SINCE = 852_076_800  # start of 1997


def _now():
    return F.lit(NOW).cast("timestamp")


def a12_ownership(spark: SparkSession, d: str) -> DataFrame:
    return H.ownership(R.commits(spark, d)).select("path", "top_author", "share", "contributors")


def a13_bus_factor(spark: SparkSession, d: str) -> DataFrame:
    return H.ownership(R.commits(spark, d)).select("path", "bus_factor")


def a14_active_contributors(spark: SparkSession, d: str) -> DataFrame:
    return R.commits(spark, d).agg(F.greatest(F.countDistinct("author"), F.lit(1)).alias("contributors"))


def _blame(spark: SparkSession, d: str) -> DataFrame:
    """Line items as blame lines: the part is the file, the order the commit, its customer the author."""
    li = table(spark, d, "lineitem")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    mail = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "").otherwise(F.concat(F.lower("c_mktsegment"), F.lit("@example.org")))
    return j.select(F.concat(F.lit("f"), (F.col("l_partkey") % 300).cast("string")).alias("file_path"), (F.col("l_partkey") * 7 + F.col("l_linenumber")).cast("int").alias("line_no"), F.col("l_orderkey").alias("sha"), F.unix_timestamp("o_orderdate").alias("author_ts"), F.concat(F.lit("dev"), (F.col("o_custkey") % 40).cast("string")).alias("author"), mail.alias("email"))


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    start = (F.col("p_partkey") * 7).cast("int")
    return p.select(F.concat(F.lit("f"), (F.col("p_partkey") % 300).cast("string")).alias("file_path"), F.concat(F.lit("fn"), F.col("p_partkey").cast("string")).alias("function"), start.alias("start"), (start + F.col("p_size") % 40).alias("end"))


def a15_range_owner(spark: SparkSession, d: str) -> DataFrame:
    x = H.owner_in_ranges(_blame(spark, d), _ranges(spark, d))
    return x.select("file_path", "function", "owner", "email", F.round("share", 4).alias("share"), "lines")


def a16_range_commits(spark: SparkSession, d: str) -> DataFrame:
    """All distinct commits in the range, and those since a time."""
    return H.owner_in_ranges(_blame(spark, d), _ranges(spark, d), since=SINCE).select("file_path", "function", "commits", "recent_commits")


def a17_median_age(spark: SparkSession, d: str) -> DataFrame:
    return H.owner_in_ranges(_blame(spark, d), _ranges(spark, d)).select("file_path", "function", "median_ts")


def a19_reviewers(spark: SparkSession, d: str) -> DataFrame:
    """The five people with the largest summed share of all files of the log."""
    o = H.ownership(R.commits(spark, d)).select("path", F.col("top_author").alias("name"), F.concat("top_author", F.lit("@example.org")).alias("email"), "share")
    return reviewers(o.select("path"), o)


def reviewers(affected: DataFrame, owners: DataFrame, n: int = 5) -> DataFrame:
    """(name, email, relevance): the owners (path, name, email, share) of the affected files (path), by their summed shares.
    Owners without a name and null shares don't count; the first e-mail by its letters stands for a name, or nothing."""
    x = affected.select("path").distinct().join(owners.where("name IS NOT NULL AND share IS NOT NULL"), "path")
    return x.groupBy("name").agg(F.coalesce(F.min(F.nullif("email", F.lit(""))), F.lit("")).alias("email"), F.round(F.sum("share"), 3).alias("relevance")).orderBy(F.desc("relevance"), "name").limit(n)


def file_owners(spark: SparkSession, d: str) -> DataFrame:
    """Owners of stored files: file n of the event log is the one with that id."""
    o = H.ownership(R.commits(spark, d)).select(F.regexp_extract("path", r"f(\d+)", 1).cast("long").alias("file_id"), "top_author", "share")
    f = R.file_context(spark, d).select("file_id", F.col("file_path").alias("path"))
    return f.join(F.broadcast(o), "file_id").select("path", F.col("top_author").alias("name"), F.concat("top_author", F.lit("@example.org")).alias("email"), "share")  # as many files as the log's keys: 100


def git_meta(spark: SparkSession, d: str) -> DataFrame:
    return H.git_meta(R.commits(spark, d), _now())


def r8_git_meta(spark: SparkSession, d: str) -> DataFrame:
    return git_meta(spark, d).withColumn("change_entropy", F.round("change_entropy", 6))


def b_history_findings(spark: SparkSession, d: str) -> DataFrame:
    c = R.commits(spark, d)
    co = H.co_changes(c, F.concat_ws("|", F.date_trunc("day", "ts").cast("string"), "author"))
    num = F.regexp_extract("path", r"f(\d+)", 1).cast("int")
    x = git_meta(spark, d).join(co, "path", "left").withColumn("nloc", num * 7).withColumn("max_ccn", num % 15)
    return B.detect(x, B.HISTORY_DETECTORS, ["path"])


def b_file_findings(spark: SparkSession, d: str) -> DataFrame:
    f = R.file_context(spark, d).select("file_id", F.col("has_test_file").alias("has_test"), F.col("dependents_count").alias("dependents"), "nloc", F.col("pagerank_score").alias("pagerank"), (F.col("duplication_pct") / 100).alias("duplication"))
    return B.detect(f, B.FILE_DETECTORS, ["file_id"])


def b_function_findings(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    f = p.select(F.concat(F.lit("fn"), F.col("p_partkey").cast("string")).alias("function"), (F.col("p_size") % 30).alias("ccn"), (F.col("p_partkey") % 25).alias("n_vars"), (F.col("p_size") % 9).alias("n_ifs"), (F.col("p_size") * 3).alias("loc"), (F.col("p_partkey") % 9).alias("depth"), (F.col("p_partkey") % 8).alias("n_args"))
    return B.detect(f, B.FUNCTION_DETECTORS, ["function"])


def t_churn_windows(spark: SparkSession, d: str) -> DataFrame:
    return H.churn_windows(R.commits(spark, d))


def j12_commit_authors(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the name of their customer, unknown where there is none."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy(F.coalesce("c_name", F.lit("unknown")).alias("author")).agg(F.count(F.lit(1)).alias("commits"))


def u6_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Files replaced by their later state: the last event of each path wins, removed ones go."""
    c = R.commits(spark, d)
    return H.latest(c.select("path", "sha", "author", "is_fix"), "path", "sha").where(~F.col("is_fix")).select("path", "sha", "author")


QUERIES = {f.__name__: f for f in (a12_ownership, a13_bus_factor, a14_active_contributors, a15_range_owner, a16_range_commits, a17_median_age, a19_reviewers, r8_git_meta, b_history_findings, b_file_findings, b_function_findings, t_churn_windows, j12_commit_authors, u6_upsert)}

_OWN = R.with_("commits").rstrip() + ", a AS (SELECT path, author, count(*) AS n, max(ts) AS last_ts FROM commits GROUP BY ALL), own AS (SELECT path, author AS top_author, n / total::DOUBLE AS s, total, contributors FROM (SELECT *, sum(n) OVER (PARTITION BY path) AS total, count(*) OVER (PARTITION BY path) AS contributors, row_number() OVER (PARTITION BY path ORDER BY n DESC, author) AS k FROM a) WHERE k = 1) "
_META = _OWN.rstrip() + f", per AS (SELECT path, count(*) AS total, CAST(sum(CAST(ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AS INTEGER)) AS BIGINT) AS recent_changes, CAST(sum(CAST(is_fix AS INTEGER)) AS BIGINT) AS bug_fixes, CAST(date_diff('day', min(ts), TIMESTAMP '{NOW}') AS INTEGER) AS age_days FROM commits GROUP BY path), gm AS (SELECT path, total, recent_changes, bug_fixes, age_days, CAST(sum(CAST(n / total::DOUBLE >= 0.1 AS INTEGER)) AS BIGINT) AS n_owners, count(*) AS n_authors, CAST(sum(CAST(n * 2 >= total / 10.0 AND last_ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AS INTEGER)) AS BIGINT) AS former_owners, CASE WHEN count(*) > 1 THEN sum(-(n / total::DOUBLE) * log2(n / total::DOUBLE)) / log2(count(*)) ELSE 0 END AS change_entropy FROM a JOIN per USING (path) GROUP BY path, total, recent_changes, bug_fixes, age_days) "
_OWNERS = _OWN.strip().removeprefix("WITH ") + ", owners AS (SELECT DISTINCT file_path AS path, top_author AS name, top_author || '@example.org' AS email, round(s, 3) AS share FROM own JOIN file_contexts ON file_id = CAST(regexp_extract(own.path, 'f([0-9]+)', 1) AS BIGINT))"
_BL = "WITH b AS (SELECT 'f' || (l_partkey % 300) AS file_path, CAST(l_partkey * 7 + l_linenumber AS INTEGER) AS line_no, l_orderkey AS sha, CAST(epoch(o_orderdate) AS BIGINT) AS author_ts, 'dev' || (o_custkey % 40) AS author, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '' ELSE lower(c_mktsegment) || '@example.org' END AS email FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey), r AS (SELECT 'f' || (p_partkey % 300) AS file_path, 'fn' || p_partkey AS function, p_partkey * 7 AS s, p_partkey * 7 + p_size % 40 AS e FROM part), j AS (SELECT b.*, r.function FROM b JOIN r ON b.file_path = r.file_path AND b.line_no BETWEEN r.s AND r.e) "


def _union(source: str, keep: str, rules: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{n}' AS biomarker_type, {sev} AS severity FROM {source} WHERE {cond}" for n, cond, sev in rules)


SQL = {
    "a12_ownership": _OWN + "SELECT path, top_author, round(s, 3) AS share, contributors FROM own",
    "a13_bus_factor": _OWN + "SELECT path, CASE WHEN s >= 0.8 THEN 1 ELSE greatest(contributors, 1) END AS bus_factor FROM own",
    "a14_active_contributors": R.with_("commits") + "SELECT greatest(count(DISTINCT author), 1) AS contributors FROM commits",
    "a15_range_owner": _BL + "SELECT file_path, function, author AS owner, email, round(n / lines::DOUBLE, 4) AS share, lines FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY file_path, function) AS BIGINT) AS lines, row_number() OVER (PARTITION BY file_path, function ORDER BY n DESC, author) AS k FROM (SELECT file_path, function, author, count(*) AS n, coalesce((min({'l': line_no, 's': sha, 'e': email}) FILTER (email <> '')).e, '') AS email FROM j GROUP BY file_path, function, author)) WHERE k = 1",
    "a16_range_commits": _BL + "SELECT file_path, function, count(DISTINCT sha) AS commits, count(DISTINCT sha) FILTER (author_ts >= 852076800) AS recent_commits FROM j GROUP BY ALL",
    "a17_median_age": _BL + "SELECT file_path, function, CAST(floor(median(author_ts) FILTER (author_ts > 0)) AS BIGINT) AS median_ts FROM j GROUP BY ALL",
    "a19_reviewers": _OWN + "SELECT top_author AS name, top_author || '@example.org' AS email, round(sum(round(s, 3)), 3) AS relevance FROM own GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5",
    "r8_git_meta": _META + "SELECT path, total, recent_changes, bug_fixes, age_days, n_owners, n_authors, former_owners, round(change_entropy, 6) AS change_entropy FROM gm",
    "b_history_findings": _META.rstrip() + ", g AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') || '|' || author AS g, path FROM commits), co AS (SELECT a.path, count(DISTINCT b.path) AS partners FROM g a JOIN g b USING (g) WHERE a.path <> b.path GROUP BY a.path), x AS (SELECT gm.*, coalesce(partners, 0) AS partners, CAST(regexp_extract(path, 'f([0-9]+)', 1) AS INTEGER) * 7 AS nloc, CAST(regexp_extract(path, 'f([0-9]+)', 1) AS INTEGER) % 15 AS max_ccn FROM gm LEFT JOIN co USING (path)) " + _union("x", "path", [("ownership_risk", "n_owners = 1 AND nloc > 200", "'medium'"), ("developer_congestion", "n_authors >= 3 AND recent_changes > 10", "'low'"), ("knowledge_loss", "former_owners > 2", "'low'"), ("churn_risk", "recent_changes > 15", "'medium'"), ("code_age_volatility", "age_days > 365 AND recent_changes > 5", "'low'"), ("change_entropy", "change_entropy > 0.7", "'medium'"), ("co_change_scatter", "partners > 5", "'low'"), ("prior_defect", "bug_fixes > 3", "CASE WHEN bug_fixes > 5 THEN 'medium' ELSE 'low' END"), ("bumpy_road", "recent_changes > 5 AND max_ccn > 8", "'medium'")]),
    "b_file_findings": R.with_("file_context") + _union("file_context", "file_id", [("untested_hotspot", "NOT coalesce(has_test_file, false) AND dependents_count > 5", "'high'"), ("coverage_gap", "NOT coalesce(has_test_file, false) AND nloc > 100", "'medium'"), ("function_hotspot", "pagerank_score > 0.01 AND dependents_count > 10", "'medium'"), ("dry_violation", "duplication_pct / 100 > 0.2", "'medium'"), ("large_class", "nloc > 400", "'high'")]),
    "b_function_findings": "WITH f AS (SELECT 'fn' || p_partkey AS function, p_size % 30 AS ccn, p_partkey % 25 AS n_vars, p_size % 9 AS n_ifs, p_size * 3 AS loc, p_partkey % 9 AS depth, p_partkey % 8 AS n_args FROM part) " + _union("f", "function", [("brain_method", "ccn >= 15 AND n_vars >= 15 AND n_ifs >= 5", "'high'"), ("complex_method", "ccn > 10", "CASE WHEN ccn > 20 THEN 'high' ELSE 'medium' END"), ("large_method", "loc > 60", "CASE WHEN loc > 100 THEN 'high' ELSE 'medium' END"), ("nested_complexity", "depth > 4", "CASE WHEN depth > 6 THEN 'high' ELSE 'medium' END"), ("primitive_obsession", "n_args > 5", "'low'")]),
    "t_churn_windows": R.with_("commits") + "SELECT date_trunc('day', ts)::TIMESTAMP AS start, path, count(*) AS changes FROM commits GROUP BY ALL",
    "j12_commit_authors": "SELECT coalesce(c_name, 'unknown') AS author, count(*) AS commits FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "u6_upsert": R.with_("commits") + "SELECT path, sha, author FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY sha DESC) AS k FROM commits) WHERE k = 1 AND NOT is_fix",
}
