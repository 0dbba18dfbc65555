"""Text that a version-control client prints, as DataFrames of lines (value)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODE = r"\.(py|js)$"


def worktree_changes(lines: DataFrame) -> DataFrame:
    """(status, path) of short status lines: a rename counts as its new name, a path deleted on both sides is dropped."""
    x = lines.where(F.length("value") >= 4).select(F.substring("value", 1, 2).alias("status"), F.substring("value", 4, 1 << 30).alias("rest"))
    path = F.regexp_replace(F.regexp_replace("rest", "^.* -> ", ""), '^"|"$', "")
    return x.where("status <> 'DD'").select("status", path.alias("path")).distinct()


def ref_changes(lines: DataFrame) -> DataFrame:
    return lines.select(F.trim("value").alias("path")).where(F.length("path") > 0).distinct()


def staged_python(lines: DataFrame) -> DataFrame:
    """Staged Python files: the names that a diff of the index prints for added, copied and modified files."""
    return ref_changes(lines).where(F.col("path").endswith(".py"))


def code_changes(changes: DataFrame) -> DataFrame:
    """Python and JavaScript files outside of test, build and environment folders."""
    parts = F.split("path", "/")
    skip = F.arrays_overlap(parts, F.array(*(F.lit(x) for x in ("tests", "build", "__pycache__", ".venv"))))
    return changes.where(F.col("path").rlike(CODE) & ~skip)


def changed_functions(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Functions (node) of changed files, a semi-join on the normalised path."""
    norm = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^\./", "")
    c = changes.select(norm(F.col("path")).alias("file")).distinct()
    return nodes.withColumn("file", norm(F.split_part("node", F.lit("::"), F.lit(1)))).join(c, "file", "left_semi").select("node").distinct()


def log_lines(lines: DataFrame) -> DataFrame:
    """(sha, subject) of one-line logs."""
    return lines.select(F.regexp_extract("value", r"^([0-9a-f]{4,40})\s", 1).alias("sha"), F.regexp_extract("value", r"^[0-9a-f]{4,40}\s+(.*)$", 1).alias("subject")).where("sha <> ''")


_HEADER = re.compile(r"^([0-9a-f]{40}) (\d+) (\d+)(?: (\d+))?$")


def blame_rows(path: str, text: str) -> Iterator[tuple]:
    """(path, line, sha, time, author, email) of a porcelain blame; facts of a commit are printed once and kept."""
    facts: dict[str, dict[str, str]] = {}
    sha, line = "", 0
    for raw in text.split("\n"):
        if m := _HEADER.match(raw):
            sha, line = m[1], int(m[3])
            facts.setdefault(sha, {})
        elif raw.startswith("\t"):
            f = facts.get(sha, {})
            yield path, line, sha, int(f.get("author-time", "0") or 0), f.get("author", "unknown"), f.get("author-mail", "").strip("<>")
        elif sha:
            key, _, value = raw.partition(" ")
            facts[sha].setdefault(key, value)


def blame_lines(blames: DataFrame, max_bytes: int = 5 << 20) -> DataFrame:
    """Blame lines of (path, content) rows; larger files are left to ``max_bytes``."""
    b = blames.where(F.col("content").isNotNull() & (F.octet_length("content") <= max_bytes)).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string())
        for x in batches:
            rows = [r for p, t in zip(x.column("path").to_pylist(), x.column("content").to_pylist()) for r in blame_rows(p, t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["file_path", "line_no", "sha", "author_ts", "author", "email"])

    return b.mapInArrow(run, "file_path string, line_no int, sha string, author_ts bigint, author string, email string")
