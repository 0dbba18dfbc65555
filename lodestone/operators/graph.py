"""Graph operators over edges (src, dst).

Loops keep their state in tables of the shared folder, so plans stay short and a lost executor repeats one task.  Every
loop ends when it finds nothing new; cycles and self-loops are allowed everywhere.  Null ends are left out, repeated edges
count once, an empty edge table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import impacts
from lodestone.session import materialize, release

#: Edges between numbers that one task takes at most (16 MB of them, some 300 MB as lists).
MAX_TASK_EDGES = 1_000_000
#: The same where the task keeps arrays only (some 50 bytes an edge at the most).
MAX_TASK_PAIRS = 16_000_000
#: Bits of a reach set that one task of ``impact_sizes`` holds at most, over all nodes.
MAX_TASK_BITS = 1 << 30
#: Steps of a level loop that stay apart before they are written as one.
LEVELS = 16


def clean(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).where(F.col("node").isNotNull()).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, outgoing, incoming) over distinct edges; one pass, partial sums first."""
    ends = clean(edges).select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between numbers, (node, id)): long keys make the wide tables of a closure several times smaller."""
    e = materialize(clean(edges), "edges")
    ids = materialize(nodes_of(e).withColumn("id", F.monotonically_increasing_id()), "ids")
    n = e.join(ids.select(F.col("node").alias("src"), F.col("id").alias("s")), "src").join(ids.select(F.col("node").alias("dst"), F.col("id").alias("d")), "dst")
    return n.select(F.col("s").alias("src"), F.col("d").alias("dst")), ids


def closure_ids(edges: DataFrame) -> DataFrame:
    """All pairs (src, dst) joined by a path of one or more distinct edges, by path doubling.

    After step k every pair within 2**k edges is known.  Only pairs found in the last step are extended: a shortest path
    of up to twice the length starts with one of them.  So the number of steps is the logarithm of the longest shortest
    path, no pair is derived from old pairs alone, and each step writes its new pairs only: what is known is the union of
    the steps."""
    steps = [materialize(edges, "closure")]
    while True:
        known = reduce(DataFrame.unionByName, steps)
        longer = steps[-1].alias("a").join(known.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src"), F.col("b.dst")).distinct()
        new = materialize(longer.join(known, ["src", "dst"], "left_anti"), "closure")
        if new.isEmpty():
            return known
        steps.append(new)


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (src, dst) joined by a path of one or more edges."""
    e, ids = numbered(edges)
    r = closure_ids(e)
    named = r.join(ids.select(F.col("id").alias("src"), F.col("node").alias("s")), "src").join(ids.select(F.col("id").alias("dst"), F.col("node").alias("d")), "dst")
    return named.select(F.col("s").alias("src"), F.col("d").alias("dst"))


def _in_rank_order(src: np.ndarray, dst: np.ndarray, n: int) -> list[np.ndarray]:
    """Edges of an acyclic graph, grouped so that every edge into a node comes in an earlier group than those out of it."""
    left = np.bincount(dst, minlength=n)
    order = np.argsort(src, kind="stable")
    start = np.searchsorted(src[order], np.arange(n + 1))
    front, groups = np.flatnonzero(left == 0), []
    while len(front):
        edges = np.concatenate([order[start[v] : start[v + 1]] for v in front]) if len(front) else np.empty(0, np.int64)
        if not len(edges):
            break
        groups.append(edges)
        np.subtract.at(left, dst[edges], 1)
        reached = np.unique(dst[edges])
        front = reached[left[reached] == 0]
    return groups


def _block_reach(key: tuple, batch: pa.Table) -> pa.Table:
    """From how many members of one block of nodes each component is reached, by bit sets."""
    src, dst, bit = (batch.column(c).to_numpy() for c in ("src", "dst", "bit"))
    own = np.flatnonzero(bit >= 0)
    names, codes = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = codes[: len(src)], codes[len(src) :]
    words = int(bit.max()) // 64 + 1
    state = np.zeros((len(names), words), dtype=np.uint64)
    np.bitwise_or.at(state, (b[own], bit[own] // 64), np.uint64(1) << (bit[own] % 64).astype(np.uint64))
    edge = np.flatnonzero(bit < 0)
    e, f = a[edge], b[edge]
    for group in _in_rank_order(e, f, len(names)):
        np.bitwise_or.at(state, f[group], state[e[group]])
    n = np.bitwise_count(state).sum(axis=1)
    keep = np.flatnonzero(n)
    return pa.table({"comp": pa.array(names[keep], pa.int64()), "n": pa.array(n[keep].astype(np.int64), pa.int64())})


def _acyclic_sizes(dag: DataFrame, members: DataFrame, max_task_edges: int) -> DataFrame:
    """(comp, n): how many members of ``members`` (id, comp) lie in each component or above it in the acyclic ``dag``.

    The members are cut into blocks; a block's reach is a bit set per component, so that a task needs the edges and one bit
    per component and member.  Where the edges don't fit into a task, the bits travel level by level as 16 words a row, and
    are united by the map-side aggregate."""
    n, m = dag.count(), members.count()
    if n <= max_task_edges:
        width = max(64, min(1 << 16, MAX_TASK_BITS // max(n + m, 1) // 64 * 64))
        blocks = -(-m // width)
        at = members.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")) if blocks > 1 else members.withColumn("block", F.lit(0))
        at = at.select("block", "comp", (F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1).cast("long").alias("bit"))  # a block is bounded by the width
        own = at.select("block", F.col("comp").alias("src"), F.col("comp").alias("dst"), "bit")
        edges = dag.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "src", "dst", F.lit(-1).cast("long").alias("bit"))
        found = own.unionByName(edges).groupBy("block").applyInArrow(_block_reach, "comp bigint, n bigint")
        return found.groupBy("comp").agg(F.sum("n").alias("n"))
    words = 16
    blocks = -(-m // 512)  # a block of 1024 bits holds some 512 members by their hash; those beyond go to a further one
    at = members.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    at = at.select("comp", "part", (F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1).alias("k"))
    at = at.select("comp", (F.col("part") * 8 + F.floor(F.col("k") / 1024)).alias("block"), F.pmod("k", F.lit(1024)).alias("k"))
    bits = [F.bit_or(F.when(F.floor(F.col("k") / 64) == w, F.expr("shiftleft(1L, CAST(k % 64 AS INT))")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)]
    names = [f"w{w}" for w in range(words)]
    state = materialize(at.groupBy("comp", "block").agg(*bits), "bits")
    new = state
    while True:
        sent = new.join(dag, new["comp"] == dag["src"]).select(F.col("dst").alias("comp"), "block", *names)
        both = state.withColumn("old", F.lit(True)).unionByName(sent.withColumn("old", F.lit(False)))
        same = F.lit(True)
        merged = both.groupBy("comp", "block").agg(*(F.bit_or(w).alias(w) for w in names), *(F.coalesce(F.bit_or(F.when(F.col("old"), F.col(w))), F.lit(0).cast("long")).alias("o" + w) for w in names))
        for w in names:
            same = same & (F.col(w) == F.col("o" + w))
        merged = materialize(merged.withColumn("moved", ~same).select("comp", "block", *names, "moved"), "bits")
        state, new = merged.select("comp", "block", *names), merged.where("moved").select("comp", "block", *names)
        if new.isEmpty():
            break
    count = sum((F.bit_count(F.col(w)) for w in names[1:]), F.bit_count(F.col(names[0])))
    return state.groupBy("comp").agg(F.sum(count).cast("long").alias("n"))


def paired(edges: DataFrame, key: Callable[[str], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """(distinct edges between numbers, (node, id)), as ``numbered``, without a join: a number is the hash of its name.  Where two
    names share one, which is counted, they are numbered instead."""
    e = edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    ids = materialize(nodes_of(e).select("node", key("node").alias("id")), "ids")
    if ids.select("id").distinct().count() < ids.count():
        release(ids)
        pairs, ids = numbered(edges)
    else:
        pairs = e.select(key("src").alias("src"), key("dst").alias("dst")).distinct()
    return materialize(pairs, "pairs"), ids


def impact_sizes(edges: DataFrame, max_task_edges: int = MAX_TASK_PAIRS, part_words: int = impacts.PART_WORDS, key: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """(node, impact): from how many nodes each node is reached over at least one edge, itself only if it lies on a cycle.

    Strongly connected components are contracted first: their members share one figure, and what is left has no cycle.  No
    pair of nodes is ever written.  Up to ``max_task_edges`` edges one task does it, but for connected parts whose reach sets
    take more than ``part_words`` words; these go to tasks by blocks of members."""
    pairs, ids = paired(edges, key)
    if pairs.count() > max_task_edges:
        return _spread_sizes(pairs, ids, max_task_edges)
    found = materialize(pairs.repartition(1).mapInArrow(impacts.impact_task(part_words), impacts.SCHEMA), "impacts")
    n = found.where("n IS NOT NULL").select("id", "n")
    links = found.where("up IS NOT NULL").select(F.col("up").alias("src"), F.col("comp").alias("dst"))
    if not links.isEmpty():
        members = found.where("own IS NOT NULL")
        more = _acyclic_sizes(links, members.where("own = 1").select("id", "comp"), min(max_task_edges, MAX_TASK_EDGES))
        n = n.unionByName(members.select("id", "comp").join(more, "comp").select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    return ids.join(n, "id").select("node", F.col("n").alias("impact"))


def _spread_sizes(e: DataFrame, ids: DataFrame, max_task_edges: int) -> DataFrame:
    """The same by joins."""
    comps = materialize(component_ids(e, min(max_task_edges, MAX_TASK_EDGES)), "comps")
    a, b = comps.select(F.col("id").alias("src"), F.col("comp").alias("a")), comps.select(F.col("id").alias("dst"), F.col("comp").alias("b"))
    ce = e.join(a, "src").join(b, "dst").select("a", "b", (F.col("src") == F.col("dst")).alias("self"))
    dag = materialize(ce.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "dag")
    looped = ce.where("self").select(F.col("a").alias("comp")).distinct().withColumn("looped", F.lit(1))
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    n = _acyclic_sizes(dag, comps, min(max_task_edges, MAX_TASK_EDGES)).join(sizes, "comp").join(looped, "comp", "left")
    # a node that lies on no cycle isn't among its own origins
    impact = n.select("comp", F.when((F.col("size") > 1) | F.col("looped").isNotNull(), F.col("n")).otherwise(F.col("n") - 1).alias("impact"))
    return ids.join(comps, "id").join(impact, "comp").select("node", "impact")


def trim(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """Edges that may lie on a cycle: what starts where nothing arrives, or ends where nothing leaves, is peeled off while
    that takes away at least a tenth.  The result holds every cycle."""
    e = materialize(clean(edges), "edges")
    n = e.count()
    for _ in range(rounds):
        kept = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept = materialize(kept.select("src", "dst"), "core")
        m = kept.count()
        release(e)
        e, done, n = kept, m > 0.9 * n, m
        if done or not m:
            break
    return e


def tarjan(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the smallest id of each one's strongly connected component) of a small graph."""
    names, codes = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n = len(names)
    a, b = codes[: len(src)], codes[len(src) :]
    order = np.argsort(a, kind="stable")
    out = b[order].tolist()
    start = np.searchsorted(a[order], np.arange(n + 1)).tolist()
    seen, low, comp = [-1] * n, [0] * n, [-1] * n
    stack: list[int] = []
    clock = 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        seen[root] = low[root] = clock
        clock += 1
        stack.append(root)
        work = [(root, start[root])]
        while work:
            v, i = work[-1]
            if i < start[v + 1]:
                work[-1] = (v, i + 1)
                w = out[i]
                if seen[w] < 0:
                    seen[w] = low[w] = clock
                    clock += 1
                    stack.append(w)
                    work.append((w, start[w]))
                elif comp[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
            if low[v] == seen[v]:
                members = []
                while True:
                    w = stack.pop()
                    members.append(w)
                    if w == v:
                        break
                first = min(members)
                for w in members:
                    comp[w] = first
    return names, names[np.array(comp, dtype=np.int64)] if n else names


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if parts:
        t = pa.Table.from_batches(parts)
        ids, comp = tarjan(t.column("src").to_numpy(), t.column("dst").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(comp, pa.int64())], ["id", "comp"])


def component_ids(edges: DataFrame, max_task_edges: int = MAX_TASK_EDGES) -> DataFrame:
    """(id, comp) of every node of edges between numbers: nodes on a common cycle share a number.

    Up to ``max_task_edges`` edges one task finds them.  Beyond, what lies on no cycle is peeled off; then every node takes
    the largest number that reaches it, and the nodes with the number of a node r that also reach r are r's component.  These
    leave, and the rest, which has lost at least a component per number, goes on until it fits into a task.  Rows stay linear in the
    edges, in every step."""
    every = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    rest, done = edges, []
    while True:
        if rest.limit(max_task_edges + 1).count() <= max_task_edges:
            done.append(rest.repartition(1).mapInArrow(_one_task, "id bigint, comp bigint"))
            break
        rest = trim(rest.where("src <> dst"))
        if rest.isEmpty():
            break
        if rest.limit(max_task_edges + 1).count() <= max_task_edges:
            continue
        color = materialize(rest.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("color", F.col("id")).withColumn("moved", F.lit(True)), "color")
        while True:
            sent = rest.join(color.where("moved").select(F.col("id").alias("src"), "color"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("color").alias("up"))
            new = color.join(sent, "id", "left").select("id", F.greatest("color", "up").alias("color"), F.coalesce(F.col("up") > F.col("color"), F.lit(False)).alias("moved"))
            new = materialize(new, "color")
            release(color)
            color = new
            if color.where("moved").isEmpty():
                break
        c = color.select("id", "color")
        inner = rest.join(c.withColumnRenamed("id", "src"), "src").join(c.select(F.col("id").alias("dst"), F.col("color").alias("c")), "dst").where("color = c")
        inner = materialize(inner.select(F.concat_ws(":", "src", "color").alias("src"), F.concat_ws(":", "dst", "color").alias("dst")), "inner")
        roots = c.where("id = color").select(F.concat_ws(":", "id", "color").alias("node"))
        back = reach(inner, roots, backwards=True).select("node").union(roots).distinct()
        parts = back.select(F.split_part("node", F.lit(":"), F.lit(1)).cast("long").alias("id"), F.split_part("node", F.lit(":"), F.lit(2)).cast("long").alias("comp"))
        parts = materialize(parts, "parts")
        done.append(parts)
        gone = parts.select("id")
        rest = materialize(rest.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "rest")
    found = reduce(DataFrame.unionByName, done) if done else every.select("id", F.col("id").alias("comp")).limit(0)
    return every.join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def reach(edges: DataFrame, sources: DataFrame, backwards: bool = False, max_depth: int | None = None, closed: DataFrame | None = None) -> DataFrame:
    """(node, depth) of what ``sources`` (node) reach over at least one edge, by levels; depth is the smallest.

    A source is in the result only if a path leads back to it.  Nodes in ``closed`` (node) are neither reported nor
    expanded.
    """
    e = clean(edges)
    e = materialize(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backwards else e, "edges")
    level, seen, depth = sources.select("node").distinct(), [], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = level.join(e, level["node"] == e["src"]).select(F.col("dst").alias("node")).distinct()
        if closed is not None:
            step = step.join(closed.select("node"), "node", "left_anti")
        if seen:
            step = step.join(reduce(DataFrame.union, [x.select("node") for x in seen]), "node", "left_anti")
        level = materialize(step, "level")
        if level.isEmpty():
            break
        seen.append(level.withColumn("depth", F.lit(depth)))
        if len(seen) > LEVELS:
            parts = seen
            seen = [materialize(reduce(DataFrame.unionByName, parts), "seen")]
            for x in parts[:-1]:
                release(x)
    if not seen:
        return sources.select("node").withColumn("depth", F.lit(0)).limit(0)
    return reduce(DataFrame.unionByName, seen)


def shortest_paths(edges: DataFrame, start: DataFrame, backwards: bool = True) -> DataFrame:
    """(node, path, depth): the shortest path from a start node to each node that is reached, the smallest by its elements
    among equally short ones; start nodes themselves are left out."""
    e = clean(edges)
    e = materialize(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backwards else e, "edges")
    first = start.select("node").distinct()
    seen = [materialize(first.select("node", F.array("node").alias("path")), "paths")]
    level = seen[0]
    while True:
        step = level.join(e, level["node"] == e["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        known = reduce(DataFrame.union, [x.select("node") for x in seen])
        level = materialize(step.groupBy("node").agg(F.min("path").alias("path")).join(known, "node", "left_anti"), "paths")
        if level.isEmpty():
            break
        seen.append(level)
        if len(seen) > LEVELS:
            parts = seen
            seen = [materialize(reduce(DataFrame.unionByName, parts), "paths")]
            for x in parts[:-1]:
                release(x)
    return reduce(DataFrame.unionByName, seen).join(first, "node", "left_anti").withColumn("depth", F.size("path") - 1)


def components_strong(edges: DataFrame, max_task_edges: int = MAX_TASK_EDGES) -> DataFrame:
    """(node, scc): nodes on a common cycle share the smallest of them; a node on no cycle stands alone."""
    e, ids = numbered(edges)
    comps = materialize(component_ids(materialize(e, "numbered"), max_task_edges), "comps")
    named = ids.join(comps, "id").select("node", "comp")
    return named.join(named.groupBy("comp").agg(F.min("node").alias("scc")), "comp").select("node", "scc")


def simple_cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """(cycle, length): all elementary circuits, each once, from its smallest node on.

    Only edges inside a strongly connected component can lie on one; paths start at their smallest node and never return to
    a node they hold, so the loop ends with the longest path.  The number of circuits can be exponential; who can do with
    the short ones sets ``max_length``, the most nodes of a circuit."""
    e = materialize(clean(edges), "edges")
    scc = components_strong(e)
    inner = e.join(scc.select(F.col("node").alias("src"), F.col("scc").alias("a")), "src").join(scc.select(F.col("node").alias("dst"), F.col("scc").alias("b")), "dst").where("a = b").select("src", "dst")
    inner = materialize(inner, "inner")
    paths = inner.where(F.col("src") <= F.col("dst")).select(F.array("src").alias("path"), F.col("dst").alias("at"))
    found, length = None, 0
    while max_length is None or length < max_length:
        length += 1
        paths = materialize(paths, "cycle-paths")
        done = paths.where(F.col("at") == F.col("path")[0]).select(F.col("path").alias("cycle"))
        found = done if found is None else found.unionByName(done)
        open_ = paths.where((F.col("at") > F.col("path")[0]) & ~F.array_contains("path", F.col("at")))
        if open_.isEmpty():
            break
        paths = open_.join(inner, F.col("at") == F.col("src")).select(F.concat("path", F.array("at")).alias("path"), F.col("dst").alias("at"))
    return found.withColumn("length", F.size("cycle"))


def _rank_task(rounds: int, damping: float, tolerance: float):
    """The same rounds in one task, over numbered edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        names, codes = np.unique(np.concatenate([t.column("src").to_numpy(), t.column("dst").to_numpy()]), return_inverse=True)
        a, b, n = codes[: t.num_rows], codes[t.num_rows :], len(names)
        out = np.bincount(a, minlength=n)
        rank, idle = np.full(n, 1.0 / n), out == 0
        for _ in range(rounds):
            share = rank / np.maximum(out, 1)
            new = (1 - damping) / n + damping * (np.bincount(b, weights=share[a], minlength=n) + rank[idle].sum() / n)
            moved, rank = np.abs(new - rank).sum(), new
            if moved < n * tolerance:
                break
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(rank)], ["id", "rank"])

    return run


def pagerank(edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6, max_task_edges: int = MAX_TASK_EDGES) -> DataFrame:
    """(node, rank) from the uniform start, until a round changes all ranks together by less than ``tolerance`` a node, or
    after ``rounds``; the mass of nodes without an out-edge is spread over all.  Up to ``max_task_edges`` edges the rounds run
    in one task.  Beyond, contributions are summed per node map-side before they are shuffled, so a hot node receives one
    partial sum per task; the result is the same but for the last digits."""
    if clean(edges).limit(max_task_edges + 1).count() <= max_task_edges:
        numbers, ids = numbered(edges)
        ranks = materialize(numbers.repartition(1).mapInArrow(_rank_task(rounds, damping, tolerance), "id bigint, rank double"), "ranks")
        return ids.join(ranks, "id").select("node", "rank")
    e = clean(edges)
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    weighted = materialize(e.join(out, "src"), "weighted")
    all_nodes = materialize(nodes_of(e).join(out.select(F.col("src").alias("node"), "n"), "node", "left"), "nodes")
    size = max(all_nodes.count(), 1)
    ranks = all_nodes.select("node", "n", F.lit(1.0 / size).alias("rank"), F.lit(1.0 / size).alias("was"))
    for _ in range(rounds):
        lost = ranks.where("n IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = weighted.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        step = ranks.select("node", "n", F.col("rank").alias("was")).join(got, F.col("node") == F.col("dst"), "left").crossJoin(F.broadcast(lost))  # one row
        old = ranks
        ranks = materialize(step.select("node", "n", (F.lit((1 - damping) / size) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / size)).alias("rank"), "was"), "ranks")
        release(old if old.inputFiles() and "ranks-" in old.inputFiles()[0] else None)
        moved = ranks.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
        if moved is None or moved < size * tolerance:
            break
    return ranks.select("node", "rank")


def _greedy(names: list, edges: list[tuple], m: int) -> dict:
    """Greedy modularity on one connected part of a graph of ``m`` edges: the pair whose union gains most is united, the
    pair with the smallest names on ties, while something is gained.  A community is named by its smallest node."""
    near: dict = {x: {} for x in names}
    degree = dict.fromkeys(names, 0)
    for a, b in edges:
        near[a][b] = near[a].get(b, 0) + 1
        near[b][a] = near[b].get(a, 0) + 1
        degree[a] += 1
        degree[b] += 1
    home = {x: [x] for x in names}
    gain = lambda a, b: 2 * m * near[a][b] - degree[a] * degree[b]  # noqa: E731  (in units of 1 / 2 m ** 2)
    heap = [(-gain(a, b), a, b) for a in names for b in near[a] if a < b]
    heapq.heapify(heap)
    while heap:
        g, a, b = heapq.heappop(heap)
        if g >= 0:
            break
        if a not in home or b not in home or -g != gain(a, b):
            continue
        home[a] += home.pop(b)
        degree[a] += degree.pop(b)
        for c, w in near.pop(b).items():
            del near[c][b]
            if c != a:
                near[a][c] = near[c][a] = near[a].get(c, 0) + w
        for c in near[a]:
            x, y = (a, c) if a < c else (c, a)
            heapq.heappush(heap, (-gain(x, y), x, y))
    return {x: k for k, xs in home.items() for x in xs}


def communities(edges: DataFrame, max_part_edges: int = 2_000, rounds: int = 50, max_task_edges: int = MAX_TASK_EDGES) -> DataFrame:
    """(node, community), a community named by its smallest node, on the undirected graph without self-loops.

    Unions within different connected parts don't touch each other, so greedy modularity runs exactly, part by part, each
    of up to ``max_part_edges`` edges in one task.  It unites one pair at a time, which doesn't distribute: larger
    parts take label propagation instead, see ``label_communities``.  A node without a neighbour stands alone."""
    e = clean(edges).where(F.col("src") != F.col("dst"))
    e = materialize(e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "undirected")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    part = materialize(components_strong(both, max_task_edges), "parts")
    pe = materialize(e.join(part.withColumnRenamed("node", "src"), "src"), "part-edges")
    size = pe.groupBy("scc").agg(F.count(F.lit(1)).alias("n"))
    small = pe.join(size.where(F.col("n") <= max_part_edges), "scc").select("scc", "src", "dst")
    large = pe.join(size.where(F.col("n") > max_part_edges), "scc").select("src", "dst")
    m = e.count()
    kind = dict(e.dtypes)["src"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _greedy(sorted({*pdf["src"], *pdf["dst"]}), list(zip(pdf["src"], pdf["dst"])), m)
        return pd.DataFrame({"node": list(found), "community": list(found.values())})

    exact = small.groupBy("scc").applyInPandas(run, f"node {kind}, community {kind}")
    spread = label_communities(large, rounds, max_task_edges)
    known = exact.unionByName(spread)
    lone = nodes_of(edges).join(part.select("node"), "node", "left_anti").select("node", F.col("node").alias("community"))
    return known.unionByName(lone)


def _label_task(rounds: int):
    """The same rounds in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        kind = t.schema.field("src").type
        names, a = np.unique(t.column("src").to_numpy(zero_copy_only=False), return_inverse=True)
        b, n, ends = np.searchsorted(names, t.column("dst").to_numpy(zero_copy_only=False)), len(names), t.num_rows
        half, degree = np.zeros(n, dtype=np.int64), np.bincount(a, minlength=n)
        half[a] = t.column("half").to_numpy()
        label, still, low = np.arange(n), 0, np.iinfo(np.int64).min
        for k in range(rounds):
            total = np.bincount(label, weights=degree, minlength=n).astype(np.int64)
            votes, count = np.unique(a * n + label[b], return_counts=True)
            node, voted = votes // n, votes % n
            own = voted == label[node]
            gain = ends * count - degree[node] * (total[voted] - np.where(own, degree[node], 0))
            stay = -degree * (total[label] - degree)
            stay[node[own]] = gain[own]
            most = np.full(n, low)
            np.maximum.at(most, node, gain)
            top = gain == most[node]
            best = np.full(n, n)
            np.minimum.at(best, node[top], voted[top])
            moves = (half == k % 2) & (most > stay) & (best < n)
            label = np.where(moves, best, label)
            still = 0 if moves.any() else still + 1
            if still == 2:
                break
        _, home = np.unique(label, return_inverse=True)
        first = np.full(home.max() + 1, n)
        np.minimum.at(first, home, np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(names[first[home]], kind)], ["node", "community"])

    return run


def label_communities(edges: DataFrame, rounds: int = 50, max_task_edges: int = MAX_TASK_EDGES) -> DataFrame:
    """(node, community) by label propagation on the undirected graph: each node takes the label around it that gains most
    modularity, the smallest on ties, and keeps its own unless another gains more.  In odd rounds only the one half of the
    nodes moves, in even rounds the other one (by hash), so neighbours don't swap labels for ever; it ends when neither
    half moves, or after ``rounds``.  Up to ``max_task_edges`` edges the rounds run in one task, with the same result."""
    e = clean(edges).where(F.col("src") != F.col("dst"))
    both = materialize(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    lone = nodes_of(edges).join(both.select(F.col("src").alias("node")), "node", "left_anti").select("node", F.col("node").alias("community"))
    ends = both.count()
    if ends <= max_task_edges:
        kind = dict(both.dtypes)["src"]
        found = both.withColumn("half", F.pmod(F.xxhash64("src"), F.lit(2))).repartition(1).mapInArrow(_label_task(rounds), f"node {kind}, community {kind}")
        return materialize(found, "labels").unionByName(lone)
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree")).withColumn("label", F.col("node")), "labels")
    still = 0
    for k in range(rounds):
        total = labels.groupBy("label").agg(F.sum("degree").alias("total"))
        own = labels.select("node", F.col("label").alias("own"), "degree")
        votes = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.count(F.lit(1)).alias("n"))
        x = votes.unionByName(own.select("node", F.col("own").alias("label"), F.lit(0).cast("long").alias("n"))).groupBy("node", "label").agg(F.sum("n").alias("n"))
        x = x.join(total, "label").join(own, "node")
        gain = ends * F.col("n") - F.col("degree") * (F.col("total") - F.when(F.col("label") == F.col("own"), F.col("degree")).otherwise(0))
        x = x.select("node", "label", "own", gain.alias("gain"))
        best = x.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("k"), "label")).alias("top"), F.max(F.when(F.col("label") == F.col("own"), F.col("gain"))).alias("stay"))
        moves = (-F.col("top.k") > F.col("stay")) & (F.pmod(F.xxhash64("node"), F.lit(2)) == k % 2)
        new = materialize(labels.join(best, "node").select("node", "degree", F.when(moves, F.col("top.label")).otherwise(F.col("label")).alias("label"), moves.alias("moved")), "labels")
        still = still + 1 if new.where("moved").isEmpty() else 0
        release(labels)
        labels = new.select("node", "degree", "label")
        if still == 2:
            break
    named = labels.groupBy("label").agg(F.min("node").alias("community"))
    return labels.join(named, "label").select("node", "community").unionByName(lone)


def feedback_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Back edges of one small component by peeling: sinks go last, sources first, else the node with the largest surplus
    of out-edges (the smallest name on ties) goes first; the cut is what then points backwards."""
    left = {x: set() for x in sorted({*pdf["src"], *pdf["dst"]})}
    into = {x: set() for x in left}
    for a, b in zip(pdf["src"], pdf["dst"]):
        if a != b:
            left[a].add(b)
            into[b].add(a)
    front: list[str] = []
    back: list[str] = []
    remaining = set(left)

    def take(x: str) -> None:
        remaining.discard(x)
        for y in left[x]:
            into[y].discard(x)
        for y in into[x]:
            left[y].discard(x)

    while remaining:
        if sinks := sorted(x for x in remaining if not left[x]):
            back.insert(0, sinks[0])
            take(sinks[0])
        elif sources := sorted(x for x in remaining if not into[x]):
            front.append(sources[0])
            take(sources[0])
        else:
            best = min(remaining, key=lambda x: (len(into[x]) - len(left[x]), x))
            front.append(best)
            take(best)
    place = {x: i for i, x in enumerate(front + back)}
    return pdf[[place[a] > place[b] for a, b in zip(pdf["src"], pdf["dst"])]]


def break_cycle_edges(edges: DataFrame, max_size: int = 20, max_cut: int = 4) -> DataFrame:
    """(scc, size, src, dst): the edges to turn around in every component of 2 to ``max_size`` nodes whose cut has 1 to
    ``max_cut`` edges.  A component goes to one task; its size is bounded by the guard before the grouping."""
    scc = materialize(components_strong(edges), "scc")
    small = scc.groupBy("scc").agg(F.count(F.lit(1)).alias("size")).where((F.col("size") >= 2) & (F.col("size") <= max_size))
    members = scc.join(small, "scc")
    e = clean(edges).join(members.select(F.col("node").alias("src"), F.col("scc").alias("a"), "size"), "src").join(members.select(F.col("node").alias("dst"), F.col("scc").alias("b")), "dst").where("a = b")
    kind = dict(e.dtypes)["src"]
    cut = e.select(F.col("a").alias("scc"), "size", "src", "dst").groupBy("scc").applyInPandas(feedback_order, f"scc {kind}, size bigint, src {kind}, dst {kind}")
    n = Window.partitionBy("scc")
    return cut.withColumn("cut", F.count(F.lit(1)).over(n)).where(F.col("cut") <= max_cut)
