"""Code files as a DataFrame: path, ext, content, sha256, mtime, size."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values: folders never scanned, besides hidden ones, and extensions with a parser
SKIP = (".venv", "venv", "env", ".git", "__pycache__", "node_modules", "build", "dist")
EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".go", ".rs", ".java")


def ignore_patterns(lines: list[str]) -> list[tuple[str, bool]]:
    """(regex over relative paths, negated) of ignore-file lines; comments and blanks give none."""
    out = []
    for line in lines:
        p = line.rstrip()
        if not p or p.startswith("#"):
            continue
        negated, p = p.startswith("!"), p.removeprefix("!")
        anchored = "/" in p.rstrip("/")
        folder, p = p.endswith("/"), p.strip("/")
        body = ""
        i = 0
        while i < len(p):
            if p.startswith("**", i):
                body, i = body + ".*", i + 2
            elif p[i] == "*":
                body, i = body + "[^/]*", i + 1
            elif p[i] == "?":
                body, i = body + "[^/]", i + 1
            else:
                body, i = body + re.escape(p[i]), i + 1
        out.append((("^" if anchored else "(^|.*/)") + body + ("/.*$" if folder else "(/.*)?$"), negated))
    return out


def _ignored(path: str, patterns: list[tuple[re.Pattern, bool]]) -> bool:
    """The last matching line decides."""
    out = False
    for x, negated in patterns:
        if x.match(path):
            out = not negated
    return out


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    """One partition per second-level folder; a task walks its folder, leaves out what is pruned before descending, and
    reads the files that remain."""

    def __init__(self, options: dict) -> None:
        self.root = os.path.abspath(options["path"])
        self.extensions = tuple(options.get("extensions", ",".join(EXTENSIONS)).split(","))
        self.lines = json.loads(options.get("ignore", "[]"))

    def _kept(self, name: str) -> bool:
        return name not in SKIP and not name.startswith(".")

    def partitions(self) -> list[InputPartition]:
        out, level = [_Folder("", False)], [""]
        for _ in range(2):
            below = [os.path.join(d, e.name) for d in level for e in os.scandir(os.path.join(self.root, d)) if e.is_dir(follow_symlinks=False) and self._kept(e.name)]
            level = below
            if not below:
                break
            out += [_Folder(d, False) for d in below]
        keep = set(level)
        return [_Folder(p.path, p.path in keep) for p in out]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        patterns = [(re.compile(p), n) for p, n in ignore_patterns(self.lines)]
        for folder, dirs, names in os.walk(os.path.join(self.root, partition.path)):
            dirs[:] = sorted(d for d in dirs if self._kept(d)) if partition.deep else []
            for name in sorted(names):
                full = os.path.join(folder, name)
                path = os.path.relpath(full, self.root).replace(os.sep, "/")
                ext = os.path.splitext(name)[1].lower()
                if ext not in self.extensions or _ignored(path, patterns):
                    continue
                with open(full, "rb") as f:
                    raw = f.read()
                stat = os.stat(full)
                yield path, ext, raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest(), datetime.fromtimestamp(stat.st_mtime, timezone.utc).replace(tzinfo=None), stat.st_size


class CodeFiles(DataSource):
    """``spark.read.format("codefiles").option("ignore", json list of ignore lines).load(folder)``: the folder must be
    visible to all executors.  Spark's own file listing leaves out names that begin with an underscore, so it can't see a
    package's init file."""

    @classmethod
    def name(cls) -> str:
        return "codefiles"

    def schema(self) -> str:
        return "path string, ext string, content string, sha256 string, mtime timestamp, size bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan(spark: SparkSession, base: str, extensions: tuple[str, ...] = EXTENSIONS, respect_ignore: bool = True) -> DataFrame:
    """All code files below ``base``.  Folders in SKIP and hidden folders are left out; with ``respect_ignore`` the ignore
    file at the root applies.  Texts that aren't UTF-8 keep replacement characters."""
    ignore = os.path.join(os.path.abspath(base), ".gitignore")
    lines: list[str] = []
    if respect_ignore and os.path.exists(ignore):
        with open(ignore, encoding="utf-8") as f:
            lines = f.read().splitlines()
    spark.dataSource.register(CodeFiles)
    return spark.read.format("codefiles").option("extensions", ",".join(extensions)).option("ignore", json.dumps(lines)).load(base)


def read_texts(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("md", "rst", "txt")) -> DataFrame:
    """(name, text) of the text files in a folder, whole, by name: records of decisions, change logs."""
    x = spark.read.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").text(folder, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("value").alias("text"))
    return x.orderBy("name")


def write_cache(files: DataFrame, folder: str) -> None:
    """Keeps (path, sha256) of the files for the next ``cache_split``: written beside and then put in place of the old one."""
    spark = files.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (folder.rstrip("/") + ".new", folder))
    files.select("path", "sha256").distinct().write.mode("overwrite").parquet(new.toString())
    fs = old.getFileSystem(conf)
    fs.delete(old, True)
    fs.rename(new, old)


def cache_split(files: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) against cached (path, sha256): only misses need parsing."""
    key = cached.select("path", "sha256").distinct()
    return files.join(key, ["path", "sha256"], "left_semi"), files.join(key, ["path", "sha256"], "left_anti")


def layer_overview(files: DataFrame) -> DataFrame:
    from lodestone.functions.paths import layer

    return files.groupBy(layer(F.col("path")).alias("layer")).agg(F.count(F.lit(1)).alias("files"))
