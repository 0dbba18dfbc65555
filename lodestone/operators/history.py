"""Ownership and change history from commits (sha, author, ts, path, is_fix) and blame lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def author_counts(commits: DataFrame) -> DataFrame:
    """(path, author, n): the compact state that every ownership figure starts from."""
    return commits.where(F.col("path").isNotNull() & F.col("author").isNotNull()).groupBy("path", "author").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


def ownership(commits: DataFrame) -> DataFrame:
    """(path, top_author, share, contributors, bus_factor): most commits, the smaller name on ties."""
    a = author_counts(commits)
    x = a.groupBy("path").agg(F.min(F.struct((-F.col("n")).alias("k"), "author")).alias("top"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("contributors"))
    share = -F.col("top.k") / F.col("total")
    return x.select("path", F.col("top.author").alias("top_author"), F.round(share, 3).alias("share"), "contributors", F.when(share >= 0.8, F.lit(1).cast("long")).otherwise(F.greatest(F.col("contributors"), F.lit(1))).alias("bus_factor"))


def git_meta(commits: DataFrame, now: Column, window_days: int = 7) -> DataFrame:
    """Per path what the history detectors read: owners (at least a tenth of the commits), authors, commits within the
    window, former owners (top half of authors without a commit in it), age, normalised entropy of the authors, fixes."""
    a = author_counts(commits)
    recent = F.col("ts") >= now - F.expr(f"INTERVAL {window_days} DAYS")
    per = commits.groupBy("path").agg(F.count(F.lit(1)).alias("total"), F.sum(recent.cast("long")).alias("recent_changes"), F.sum(F.col("is_fix").cast("long")).alias("bug_fixes"), F.datediff(now, F.min("ts")).alias("age_days"))
    j = a.join(per, "path")
    p = F.col("n") / F.col("total")
    own = j.groupBy("path").agg(
        F.sum((p >= 0.1).cast("long")).alias("n_owners"),
        F.count(F.lit(1)).alias("n_authors"),
        F.sum(((F.col("n") * 2 >= F.col("total") / 10) & (F.col("last_ts") < now - F.expr(f"INTERVAL {window_days} DAYS"))).cast("long")).alias("former_owners"),
        F.sum(-p * F.log2(p)).alias("h"),
    )
    return per.join(own, "path").select("path", "total", "recent_changes", "bug_fixes", "age_days", "n_owners", "n_authors", "former_owners", F.when(F.col("n_authors") > 1, F.col("h") / F.log2(F.col("n_authors").cast("double"))).otherwise(0.0).alias("change_entropy"))


def co_changes(commits: DataFrame, group: Column, lg_size: int = 16) -> DataFrame:
    """(path, co_change_partners): how many other paths were touched in a group (day and author, say) together with it.

    No pairs are built: each group's paths become one sketch, each path unites the sketches of its groups, and the estimate
    of the union, less the path itself, is the result.  Work is linear in the rows however large a group is; the estimate is
    exact for small unions and within about 1 % beyond."""
    g = commits.select(group.alias("g"), "path").where(F.col("g").isNotNull() & F.col("path").isNotNull()).distinct()
    sketches = g.groupBy("g").agg(F.hll_sketch_agg("path", lg_size).alias("s"))
    return g.join(sketches, "g").groupBy("path").agg((F.hll_sketch_estimate(F.hll_union_agg("s")) - 1).alias("co_change_partners"))


def owner_in_ranges(blame: DataFrame, ranges: DataFrame, width: int = 64, since: int = 0) -> DataFrame:
    """Blame lines (file_path, line_no, sha, author_ts, author, email) within functions (file_path, function, start, end): the
    author of most lines, their first e-mail that isn't empty, their share, distinct commits, those from ``since`` on, and the
    lower median time.

    A range join: both sides are cut into blocks of ``width`` lines, so the join is on equality of (file, block) and the
    bounds are a residual filter; a line never meets functions of other blocks."""
    r = ranges.withColumn("block", F.explode(F.sequence((F.col("start") / width).cast("int"), (F.col("end") / width).cast("int"))))
    b = blame.withColumn("block", (F.col("line_no") / width).cast("int"))
    j = b.join(r, ["file_path", "block"]).where(F.col("line_no").between(F.col("start"), F.col("end")))
    mail = F.min(F.when(F.col("email") != "", F.struct("line_no", "sha", "email")))["email"]
    per = j.groupBy("file_path", "function", "author").agg(F.count(F.lit(1)).alias("n"), F.coalesce(mail, F.lit("")).alias("email"))
    top = per.groupBy("file_path", "function").agg(F.min(F.struct((-F.col("n")).alias("k"), "author", "email")).alias("t"), F.sum("n").alias("lines"))
    times = j.where("author_ts > 0").groupBy("file_path", "function").agg(F.floor(F.percentile("author_ts", 0.5)).alias("median_ts"))
    shas = j.groupBy("file_path", "function").agg(F.countDistinct("sha").alias("commits"), F.countDistinct(F.when(F.col("author_ts") >= since, F.col("sha"))).alias("recent_commits"))
    return top.join(shas, ["file_path", "function"]).join(times, ["file_path", "function"], "left").select("file_path", "function", F.col("t.author").alias("owner"), F.col("t.email").alias("email"), (-F.col("t.k") / F.col("lines")).alias("share"), "lines", "commits", "recent_commits", "median_ts")


def churn_windows(commits: DataFrame, length: str = "1 day") -> DataFrame:
    """(start, path, changes) in tumbling windows; the batch form of the stream in ``streaming.watch``."""
    return commits.groupBy(F.window("ts", length)["start"].alias("start"), "path").agg(F.count(F.lit(1)).alias("changes"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest ``order`` of each key: an upsert's outcome, as one partial maximum per key and task."""
    rest = [c for c in df.columns if c not in (key, order)]
    top = df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("top"))
    return top.select(key, "top.*").select(*df.columns)
