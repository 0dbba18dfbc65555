"""Exact nearest vectors in blocks, and upserts by id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors per pass: with 1024 dimensions a block is 32 MB for each task.
BLOCK = 4096


def cosine(a, b):
    """Cosine of two array columns of equal length; 0 where a norm is 0, null where the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding", metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(query, ident, score, place): the k best rows for each query vector among all rows, the smaller id on ties.

    A block of at most ``block`` queries goes to every task, which scores its rows by matrix products and keeps k per query;
    only these meet in a shuffle.  More queries mean more passes, so memory is bounded whatever their number.  ``metric`` is
    cosine (larger is nearer) or l2 (smaller).  Null vectors and vectors of another length than the query's match nothing.
    """
    spark = vectors.sparkSession
    q = queries.where(F.col(vector).isNotNull()).select(F.col(ident).alias("q"), F.col(vector).alias("v"))
    n = q.count()
    blocks = max(1, -(-n // block))
    numbered = q.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(blocks))) if blocks > 1 else q.withColumn("b", F.lit(0))
    kind = dict(vectors.dtypes)[ident]
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(ident).alias("i"), F.col(vector).alias("v"))
    out = None
    for b in range(blocks):
        part = numbered.where(F.col("b") == b).select("q", "v").collect()
        groups: dict[int, tuple[list, np.ndarray]] = {}
        for size in {len(r["v"]) for r in part}:
            own = [r for r in part if len(r["v"]) == size]
            groups[size] = ([r["q"] for r in own], np.array([r["v"] for r in own], dtype=np.float64))
        shared = spark.sparkContext.broadcast(groups)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            groups = shared.value
            for batch in batches:
                ids, vecs = batch.column("i").to_pylist(), batch.column("v").to_pylist()
                for size, (names, m) in groups.items():
                    at = [j for j, v in enumerate(vecs) if len(v) == size]
                    if not at:
                        continue
                    x = np.array([vecs[j] for j in at], dtype=np.float64)
                    dot = m @ x.T
                    if metric == "cosine":
                        norm = np.linalg.norm(m, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
                        score = np.where(norm > 0, dot / np.where(norm > 0, norm, 1), 0.0)
                        key = -np.round(score, 12)
                    else:
                        score = np.sqrt(np.maximum((m**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * dot, 0))
                        key = np.round(score, 12)
                    idarr = np.array([ids[j] for j in at])
                    for r, name in enumerate(names):
                        best = np.lexsort((idarr, key[r]))[:k]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(best), batch.schema.field("i").type), pa.array(idarr[best].tolist(), batch.schema.field("i").type), pa.array(score[r][best], pa.float64())], ["q", "i", "s"])

        found = rows.mapInArrow(run, f"q {kind}, i {kind}, s double")
        out = found if out is None else out.unionByName(found)
    order = F.round("s", 12)
    w = Window.partitionBy("q").orderBy(F.desc(order) if metric == "cosine" else F.asc(order), "i")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(F.col("q").alias("query"), F.col("i").alias(ident), F.col("s").alias("score"), "place")


def upsert(stored: DataFrame, new: DataFrame, ident: str) -> DataFrame:
    """Stored rows with the new ones in their place; new ids are inserted."""
    return stored.join(new.select(ident), ident, "left_anti").unionByName(new)


def delete(stored: DataFrame, ids: DataFrame, ident: str) -> DataFrame:
    return stored.join(ids.select(ident), ident, "left_anti")
