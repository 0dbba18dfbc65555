"""Token windows, clones and decision lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize

# fixed values: what a recorded decision says, and what gives its reason
DECISION_VERBS = r"(?i)\b(use|chose|decided|migrate|adopt|replace|move|extract|split|rename|upgrade|downgrade|switch|introduce|remove|deprecate|add|implement|refactor|redesign|restructure)\b"
DECISION_CAUSES = r"(?i)\b(because|since|so that|in order to|to avoid|to fix|to support|reason|rationale|motivation|trade.?off|alternative)\b"


def lines(text: Column) -> Column:
    return F.transform(F.split(text, "\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def code_lines(text: Column) -> Column:
    return F.filter(lines(text), lambda x: (F.length(x) > 0) & ~x.rlike(r"^(#|//|/\*|\*)"))


def tokens(text: Column) -> Column:
    """Identifiers as $id, quote signs as $str, every other sign as itself; blank and comment lines are skipped."""
    raw = F.flatten(F.transform(code_lines(text), lambda x: F.regexp_extract_all(x, F.lit(r"[a-zA-Z_]\w*|[^\s]"), F.lit(0))))
    return F.transform(raw, lambda t: F.when(t.rlike(r"^[a-zA-Z_]\w*$"), "$id").when(t.startswith('"') | t.startswith("'"), "$str").otherwise(t))


def windows(files: DataFrame, size: int = 20) -> DataFrame:
    """(file, at, before, h) over (file, codes): the hash of every run of ``size`` tokens and the token before it.  Shorter
    files and null codes give none."""
    t = files.where(F.length("codes") >= size)
    at = t.select("file", "codes", F.explode(F.sequence(F.lit(1), F.length("codes") - size + 1)).alias("at"))
    before = F.when(F.col("at") > 1, F.substring("codes", F.col("at") - 1, F.lit(1))).otherwise("")
    return at.select("file", "at", before.alias("before"), F.xxhash64(F.substring("codes", F.col("at"), F.lit(size))).alias("h"))


def codes(text: Column) -> Column:
    """The tokens as a text of one character each: every token but $id and $str is a single sign, and no sign is a letter a or a quote."""
    return F.concat_ws("", F.transform(tokens(text), lambda t: F.when(t == "$id", "a").when(t == "$str", '"').otherwise(t)))


def _common(x: str, y: str, a: int, b: int) -> int:
    """How long ``x`` from ``a`` on and ``y`` from ``b`` on agree: steps that double, then halve."""
    n, most, step = 0, min(len(x) - a, len(y) - b), 64
    while n < most:
        k = min(step, most - n)
        if x[a + n : a + n + k] == y[b + n : b + n + k]:
            n += k
            step *= 2
        elif k == 1:
            break
        else:
            step = k // 2
            most = min(most, n + k)
    return n


def _links(size: int):
    """Per sorted partition: places of a class, each with the class's first place.  Only the first class of a partition can have
    begun in an earlier one; its places come without their first (``link`` 0), and ``link`` 2 names the first place that the
    partition knows of its first and its last class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, first, names = None, None, ("h", "file", "at", "before")
        kind = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kind = batch.schema.field("file").type
            h, file, at, before = (batch.column(c) for c in names)
            hs = h.to_numpy()
            new = np.ones(n, dtype=bool)
            new[1:] = hs[1:] != hs[:-1]
            if rep is not None:
                new[0] = hs[0] != rep[0]
            if first is None:
                first = (hs[0], file[0].as_py(), at[0].as_py(), before[0].as_py())
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            pick = pa.array(np.maximum(start, 0))
            old = pa.array(start < 0)
            rf = pc.if_else(old, pa.scalar(rep[1] if rep else None, kind), file.take(pick))
            ra = pc.if_else(old, pa.scalar(rep[2] if rep else None, pa.int32()), at.take(pick))
            rb = pc.if_else(old, pa.scalar(rep[3] if rep else None, pa.string()), before.take(pick))
            unknown = pa.array(hs == first[0])
            apart = pc.or_(pc.not_equal(file, rf), pc.greater_equal(pc.subtract(at, ra), size))
            turns = pc.or_(pc.not_equal(before, rb), pc.equal(before, ""))
            keep = pc.or_(unknown, pc.and_(pc.and_(apart, turns), pc.invert(pa.array(new))))
            link = pc.if_else(unknown, pa.scalar(0, pa.int32()), pa.scalar(1, pa.int32()))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (h, file, at, before, rf, ra, link)], [*names, "first_file", "first_at", "link"])
            s = int(start[-1])
            rep = (hs[-1], file[s].as_py(), at[s].as_py(), before[s].as_py()) if s >= 0 else rep
        if rep is not None:
            for x in [first] if rep[0] == first[0] else [first, rep]:
                yield pa.RecordBatch.from_arrays([pa.array([x[0]], pa.int64()), pa.array([x[1]], kind), pa.array([x[2]], pa.int32()), pa.array([x[3]]), pa.nulls(1, kind), pa.nulls(1, pa.int32()), pa.array([2], pa.int32())], [*names, "first_file", "first_at", "link"])

    return run


def _extend(size: int):
    """Each place pair of two files to its length: they agree until the texts differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, (x, y, places) in enumerate(zip(b.column("codes_a").to_pylist(), b.column("codes_b").to_pylist(), b.column("places").to_pylist())):
                for p in places:
                    at.append(i)
                    rows.append((p["a"], p["b"], size + _common(x, y, p["a"] - 1 + size, p["b"] - 1 + size)))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("file_a").take(take), pa.array([r[0] for r in rows], pa.int32()), b.column("file_b").take(take), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["file_a", "start_a", "file_b", "start_b", "length"])

    return run


def clones(files: DataFrame, size: int = 20) -> DataFrame:
    """(file_a, start_a, file_b, start_b, length, similarity) over (file, codes): passages of at least ``size`` tokens in
    common, as long as they go to both sides; what is in common is equal, so the similarity is 1.

    Every window of ``size`` tokens belongs to the class of its hash, represented by its first place.  A place is linked to it
    once, and only where the token before them differs: a passage is told at its beginning, and the texts say how far it
    goes.  Going left from any window in common ends at such a beginning, so each file with ``size`` tokens in common with
    another one stands in a row; two files may be linked through a third one instead of directly.  Places of one file count
    when they lie at least a window apart.

    The windows are sorted once by range, so a class of any size spreads over partitions.  Texts meet once per pair of files."""
    files = materialize(files.select("file", "codes").where(F.col("codes").isNotNull()), "codes")
    kind = files.schema["file"].dataType.simpleString()
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = windows(files, size).repartitionByRange(parts, "h", "file", "at").sortWithinPartitions("h", "file", "at")
    rows = materialize(ordered.select("h", "file", "at", "before").mapInArrow(_links(size), f"h bigint, file {kind}, at int, before string, first_file {kind}, first_at int, link int"), "links")
    firsts = rows.where("link = 2").groupBy("h").agg(F.min(F.struct("file", "at", "before")).alias("r"))  # at most two classes a partition
    late = rows.where("link = 0").join(F.broadcast(firsts), "h").where((F.col("before") != F.col("r.before")) | (F.col("before") == "")).where((F.col("file") != F.col("r.file")) | (F.col("at") - F.col("r.at") >= size))
    links = rows.where("link = 1").select(F.col("first_file").alias("file_a"), F.col("first_at").alias("a"), F.col("file").alias("file_b"), F.col("at").alias("b"))
    links = links.unionByName(late.select(F.col("r.file").alias("file_a"), F.col("r.at").alias("a"), F.col("file").alias("file_b"), F.col("at").alias("b")))
    pairs = links.groupBy("file_a", "file_b").agg(F.collect_list(F.struct("a", "b")).alias("places"))  # bounded by the tokens of the two
    a, b = (files.select(F.col("file").alias(f"file_{x}"), F.col("codes").alias(f"codes_{x}")) for x in "ab")
    both = pairs.join(a, "file_a").join(b, "file_b")
    return both.mapInArrow(_extend(size), f"file_a {kind}, start_a int, file_b {kind}, start_b int, length bigint").withColumn("similarity", F.lit(1.0))


def decision_lines(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, line): lines with a verb of decision and a cause."""
    x = docs.select(F.col(ident), F.explode(lines(F.col(text))).alias("line"))
    return x.where(F.col("line").rlike(DECISION_VERBS) & F.col("line").rlike(DECISION_CAUSES))


def decision_records(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, title, status, rationale): first heading, the line below the heading Status, the first 500 characters."""
    title = F.regexp_extract(text, r"(?m)^#\s+(.+)", 1)
    status = F.regexp_extract(text, r"(?i)##\s+Status\s*\n\s*(.+)", 1)
    inline = F.regexp_extract(text, r"(?im)^Status:\s*(\S+)", 1)
    pick = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c), F.lit("active"))
    return docs.where(F.col(text).isNotNull()).select(F.col(ident), F.coalesce(F.nullif(title, F.lit("")), F.col(ident).cast("string")).alias("title"), pick(status, inline).alias("status"), F.substring(text, 1, 500).alias("rationale"))
