"""The N best items of every group by one global sort.

A range-partitioned sort on (group, score descending, id) spreads a hot group over as many partitions as its size asks
for.  Equal rows (repeated deliveries) carry the same key, so they lie side by side in one partition and count once.  In
each sorted partition only the last group can go on in the next one; its row count is that partition's carry.  The carries
of the earlier partitions, summed up, turn a position within the partition into the exact global position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.tables import table


def _changed(column: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """True where a value differs from the one before it; ``last`` is the value before the first."""
    out = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        out[1:] = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    if last is not None:
        out[0] = column[0] != last
    if pa.types.is_floating(column.type):  # NaN is the same as NaN here
        nan = pc.is_nan(column).to_numpy(zero_copy_only=False)
        out[1:] &= ~(nan[1:] & nan[:-1])
        out[0] &= not (nan[0] and last is not None and last.as_py() != last.as_py())
    return out


def _positions(n: int):
    """Per sorted partition: the rows among the first ``n`` of their group there, and one carry row for the last group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, pa.Scalar] = {}
        count, pid, schema = 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            group, score, ident = batch.column("g"), batch.column("s"), batch.column("i")
            new_group = _changed(group, last.get("g"))
            new_row = new_group | _changed(score, last.get("s")) | _changed(ident, last.get("i"))
            kept = np.cumsum(new_row)
            starts = np.flatnonzero(new_group)
            base = np.full(batch.num_rows, -count)
            if len(starts):
                at = np.maximum.accumulate(np.where(new_group, np.arange(batch.num_rows), -1))
                base = np.where(at >= 0, kept[np.maximum(at, 0)] - 1, -count)
            position = kept - base
            take = pa.array(new_row & (position <= n))
            pid = batch.column("p")[0]
            columns = [c.filter(take) for c in (group, score, ident, batch.column("p"))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(position[take.to_numpy(zero_copy_only=False)], pa.int64()), pa.nulls(len(columns[0]), pa.int64())], ["g", "s", "i", "p", "position", "carry"])
            last = {"g": group[-1], "s": score[-1], "i": ident[-1]}
            count, schema = int(position[-1]), batch.schema
        if schema is not None:
            one = {k: pa.array([v.as_py()], schema.field(k).type) for k, v in (("g", last["g"]), ("s", last["s"]), ("i", last["i"]), ("p", pid))}
            yield pa.RecordBatch.from_arrays([*one.values(), pa.array([0], pa.int64()), pa.array([count], pa.int64())], [*one, "position", "carry"])

    return run


def top_n(df: DataFrame, group: list[str], score: str, ident: str, n: int = 3) -> DataFrame:
    """For each group the ``n`` rows with the highest ``score``, the smaller ``ident`` first on ties.

    Rows with a null in a group column, the score or the id are left out; NaN ranks above every number, as in Spark's own
    order; a repeated (group, score, id) counts once.  Columns: the group columns, score, ident and ``position``
    (1 .. n).  Other columns of the input, whatever their names, are dropped before the sort.  ``ident`` must be unique
    within a group but for repeats.  An empty table gives an empty result.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(F.struct(*group).alias("g"), F.col(score).alias("s"), F.col(ident).alias("i")).where(F.col("s").isNotNull() & F.col("i").isNotNull())
    for c in group:
        rows = rows.where(F.col(f"g.{c}").isNotNull())
    flat = rows.select(F.to_json("g").alias("g") if len(group) > 1 else F.col(f"g.{group[0]}").alias("g"), "s", "i")
    kinds = dict(flat.dtypes)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = flat.repartitionByRange(parts, F.asc("g"), F.desc("s"), F.asc("i")).sortWithinPartitions(F.asc("g"), F.desc("s"), F.asc("i"))
    near = ordered.withColumn("p", F.spark_partition_id()).mapInArrow(_positions(n), f"g {kinds['g']}, s {kinds['s']}, i {kinds['i']}, p int, position bigint, carry bigint")
    earlier = Window.partitionBy("g").orderBy("p").rangeBetween(Window.unboundedPreceding, -1)
    exact = near.withColumn("position", F.col("position") + F.coalesce(F.sum("carry").over(earlier), F.lit(0))).where(F.col("carry").isNull() & (F.col("position") <= n))
    out = exact.withColumn("g", F.from_json("g", rows.schema["g"].dataType)) if len(group) > 1 else exact.withColumn("g", F.struct(F.col("g").alias(group[0])))
    return out.select("g.*", F.col("s").alias(score), F.col("i").alias(ident), F.col("position").cast("int").alias("position"))


def ranked_items(spark: SparkSession, d: str, n: int) -> DataFrame:
    """Findings by health_impact and suggestions by blast_radius, both kinds in one sort."""
    f = table(spark, d, "health_findings").select(F.lit("finding").alias("item_kind"), "file_path", F.col("health_impact").alias("score"), F.col("finding_id").alias("item_id"))
    s = table(spark, d, "refactoring_suggestions").select(F.lit("suggestion").alias("item_kind"), "file_path", F.col("blast_radius").cast("double").alias("score"), F.col("suggestion_id").alias("item_id"))
    return top_n(f.unionByName(s), ["item_kind", "file_path"], "score", "item_id", n)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ranked_items(spark, d, 3).select("item_kind", "item_id")


def p2_top5(spark: SparkSession, d: str) -> DataFrame:
    return ranked_items(spark, d, 5).select("item_kind", "file_path", "item_id", "score", "position")


QUERIES = {"p2_found": p2_found, "p2_top5": p2_top5}

_ITEMS = """
 x AS (SELECT DISTINCT 'finding' AS item_kind, file_path, health_impact AS score, finding_id AS item_id FROM health_findings
 UNION ALL SELECT DISTINCT 'suggestion', file_path, CAST(blast_radius AS DOUBLE), suggestion_id FROM refactoring_suggestions),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_kind, file_path ORDER BY score DESC, item_id) AS INTEGER) AS position FROM x WHERE file_path IS NOT NULL AND score IS NOT NULL)
"""
SQL = {
    "p2_found": f"WITH {_ITEMS} SELECT item_kind, item_id FROM r WHERE position <= 3",
    "p2_top5": f"WITH {_ITEMS} SELECT item_kind, file_path, item_id, score, position FROM r WHERE position <= 5",
}
