"""Groups of directly or indirectly linked records.

Union-find runs inside bounded partitions of the edges and keeps a spanning forest: every node points to the smallest node
of its tree, so a partition sends at most one row per node and repeated links vanish.  Forests then merge in fewer, still
bounded partitions.  When they stop shrinking and the rest is too large for one task, the graph is contracted: each node
takes the smallest of its parents, its other parents are linked to that one, and only nodes that are a parent somewhere
stay in the graph.  Each contraction drops all leaves, so the rest ends up in one bounded task, and the labels travel back
level by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import materialize
from lodestone.tables import table

#: Edges that one union-find task takes at most: two strings of about 100 bytes each keep it within 1 GB.
MAX_TASK_EDGES = 1_000_000
#: Parts in which the leaves of one parent meet its label.
SALTS = 64


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest code of each code's tree.  Links hang the larger root under the smaller one; paths are halved."""
    parent = list(range(n))
    for x, y in zip(a.tolist(), b.tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for i in range(n):  # a parent is never larger than its child
        parent[i] = parent[parent[i]]
    return np.array(parent, dtype=np.int64)


def _forest(bound: int):
    """Edges (a, b) of one partition to their forest (a = node, b = smallest node of the tree), without the roots.

    The partition is taken in runs of ``bound`` edges: what a run holds, its forest included, is all that is in memory.  A
    forest that keeps at most half of its run goes on into the next one; a larger one is told, and later steps merge it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, bound):
                held.append(batch.slice(at, bound))
                rows += held[-1].num_rows
                if rows >= bound:
                    kept = list(_trees(pa.Table.from_batches(held)))
                    rows = sum(x.num_rows for x in kept)
                    if 2 * rows > bound:
                        yield from kept
                        kept, rows = [], 0
                    held = kept
        if rows:
            yield from _trees(pa.Table.from_batches(held))

    return run


def _trees(table_: pa.Table) -> Iterator[pa.RecordBatch]:
    if not table_.num_rows:
        return
    names, codes = np.unique(np.concatenate([table_.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]), return_inverse=True)
    half = table_.num_rows
    root = union_find(codes[:half], codes[half:], len(names))
    child = np.flatnonzero(root != np.arange(len(names)))
    kind = table_.schema.field("a").type
    for i in range(0, len(child), 50_000):
        part = child[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(names[part], kind), pa.array(names[root[part]], kind)], ["a", "b"])


def _merge(edges: DataFrame, bound: int) -> DataFrame:
    kind = dict(edges.dtypes)["a"]
    return edges.select("a", "b").mapInArrow(_forest(bound), f"a {kind}, b {kind}")


def components(edges: DataFrame, a: str, b: str, max_task_edges: int = MAX_TASK_EDGES, fan_in: int = 8) -> DataFrame:
    """(node, group): every node of a link with the smallest node that it is linked with, directly or not.

    Links are undirected and may repeat.  A link with a null end is left out; a link of a node with itself gives the node
    its own group.  No links give an empty result.  Strings compare in byte order.  Other columns are ignored.
    ``max_task_edges`` bounds what one union-find task holds; beyond it the graph is contracted first, with equal results.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    alone = links.where(F.col("a") == F.col("b")).select("a", "b")
    levels: list[DataFrame] = []
    level = materialize(_merge(links.where(F.col("a") != F.col("b")), max_task_edges), "forest")
    n = level.count()
    parts = max(1, len(level.inputFiles()))
    while n > max_task_edges:
        parts = max(-(-parts // fan_in), -(-n // max_task_edges) + 1)
        merged = materialize(_merge(level.repartition(parts), max_task_edges), "forest")
        m = merged.count()
        level, shrunk, n = merged, m < 0.7 * n, m
        if n > max_task_edges and not shrunk:
            up = materialize(level.groupBy("a").agg(F.min("b").alias("m")), "parents")
            stay = level.select(F.col("b").alias("a")).distinct()
            leaves = materialize(up.join(stay, "a", "left_anti"), "leaves")
            levels.append(leaves)
            inner = up.join(stay, "a", "left_semi").select("a", F.col("m").alias("b"))
            rest = level.join(up, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(inner)
            level = materialize(_merge(rest, max_task_edges), "forest")
            n = level.count()
            parts = max(1, len(level.inputFiles()))
    top = _merge(level.repartition(1), max_task_edges)
    found = top.select(F.col("a").alias("node"), F.col("b").alias("group"))
    for leaves in reversed(levels):
        known = materialize(found, "labels")
        # a leaf's label is its parent's; a parent without a label of its own is the root of its tree.  Many leaves may hang
        # on one parent: they are salted by themselves, and a parent's label goes to every salt that its leaves have
        salted = leaves.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
        wanted = salted.select("m", "salt").distinct().join(known, F.col("m") == known["node"]).select("m", "salt", "group")
        below = salted.join(wanted, ["m", "salt"], "left").select(F.col("a").alias("node"), F.coalesce("group", "m").alias("group"))
        found = below.unionByName(known)
    found = materialize(found, "labels")
    roots = found.select(F.col("group").alias("node"), F.col("group")).distinct()
    if alone.isEmpty():
        return found.unionByName(roots)
    lone = alone.select(F.col("a").alias("node"), F.col("b").alias("group")).distinct()
    known = found.unionByName(roots)
    return known.unionByName(lone.join(known.select("node"), "node", "left_anti"))


def strong_links(spark: SparkSession, d: str, least: float = 0.8) -> DataFrame:
    """Pairs of different files whose similarity, per cent brought to a share, is at least ``least``."""
    x = table(spark, d, "clone_pairs").select("file_a", "file_b", "similarity")
    share = F.when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.col("similarity"))
    return x.where((F.col("file_a") != F.col("file_b")) & (share >= least)).select("file_a", "file_b")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return components(strong_links(spark, d), "file_a", "file_b").select(F.col("group").alias("group_path"), F.col("node").alias("file_path"))


def p4_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    x = components(strong_links(spark, d), "file_a", "file_b")
    return x.groupBy("group").agg(F.count(F.lit(1)).alias("files")).groupBy("files").agg(F.count(F.lit(1)).alias("groups"))


QUERIES = {"p4_found": p4_found, "p4_sizes": p4_sizes}

_GROUPS = """
 e AS (SELECT DISTINCT file_a AS a, file_b AS b FROM clone_pairs WHERE file_a <> file_b AND CASE WHEN similarity > 1 THEN similarity / 100 ELSE similarity END >= 0.8),
 u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT a AS node, a AS reached FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.reached = u.a),
 g AS (SELECT node AS file_path, min(reached) AS group_path FROM r GROUP BY node)
"""
SQL = {
    "p4_found": f"WITH RECURSIVE {_GROUPS} SELECT group_path, file_path FROM g",
    "p4_sizes": f"WITH RECURSIVE {_GROUPS} SELECT files, count(*) AS groups FROM (SELECT group_path, count(*) AS files FROM g GROUP BY group_path) GROUP BY files",
}
