"""Change streams: micro-batches of changed files, incremental edges, churn windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.session import shared_folder

EVENTS = "path string, mtime timestamp, content string"


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files of change events (JSON lines of path, mtime, content; content null: removed) as they arrive."""
    return spark.readStream.schema(EVENTS).json(folder)


def _state(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps of each path the time of its last event and whether the file is there, also when it is gone: a file that comes
    again is added, the removal of one that isn't there reports nothing, nor do older or equal events."""
    last, there = state.get if state.exists else (None, False)
    rows = pd.concat(list(frames)).sort_values("mtime", kind="stable").drop_duplicates("mtime", keep="last")
    at = rows["mtime"].astype("int64")
    if last is not None:
        rows, at = rows[at > last], at[at > last]
    now = rows["content"].notna()
    was = now.shift(1, fill_value=there)
    change = pd.Series("modified", index=rows.index).mask(now & ~was, "added").mask(~now, "removed")
    said = now | was
    if len(rows):
        state.update((int(at.iloc[-1]), bool(now.iloc[-1])))
    yield pd.DataFrame({"path": [key[0]] * int(said.sum()), "mtime": rows["mtime"][said].to_numpy(), "change": change[said].to_numpy()}, columns=["path", "mtime", "change"])


def changes(stream: DataFrame) -> DataFrame:
    """(path, mtime, change): the difference of each path to what was seen before, held as state per path.  The state of a path
    is a time and a flag and never expires: a file may come again after any time."""
    return stream.groupBy("path").applyInPandasWithState(_state, "path string, mtime timestamp, change string", "mtime bigint, there boolean", "append", GroupStateTimeout.NoTimeout)


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two snapshots (path, mtime): the batch form of ``changes``."""
    j = before.withColumnRenamed("mtime", "was").join(after, "path", "full")
    return j.select("path", F.when(F.col("was").isNull(), "added").when(F.col("mtime").isNull(), "removed").when(F.col("mtime") != F.col("was"), "modified").alias("change")).where("change IS NOT NULL")


def apply_changes(edges: DataFrame, touched: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Edges after a change: those that start in a touched file (path) go, the new ones come.  Files compare as a whole,
    so a path that merely begins alike keeps its edges."""
    file = F.split_part("src", F.lit("::"), F.lit(1))
    return edges.withColumn("path", file).join(touched.select("path").distinct(), "path", "left_anti").select("src", "dst").unionByName(new_edges.select("src", "dst")).distinct()


#: Batches after which what they wrote is put together.
COMPACT = 16


def maintain(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, on_batch: Callable[[DataFrame], None] | None = None, compact: int = COMPACT) -> StreamingQuery:
    """Keeps the edge table below ``folder`` current.  A micro-batch writes the files that it touches and their edges only;
    of a file, the edges of the last batch that touches it count.  Every ``compact`` batches these are put together as one.

    The latest event of a path in the batch counts.  A batch is written whole before its entry names it, so a batch that is
    run again gives the same table."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("path").agg(F.max(F.struct("mtime", "content")).alias("m")).select("path", "m.content").persist()
        new = parse(last.where("content IS NOT NULL")).select("src", "dst").distinct()
        path = f"{folder}/b{number:08d}-{uuid.uuid4().hex[:8]}"
        last.select("path").write.parquet(f"{path}/touched")
        new.withColumn("path", F.split_part("src", F.lit("::"), F.lit(1))).write.parquet(f"{path}/edges")
        _enter(spark, folder, number, path, False)
        last.unpersist()
        if number % compact == compact - 1:
            whole = f"{folder}/w{number:08d}-{uuid.uuid4().hex[:8]}"
            current(spark, folder).withColumn("path", F.split_part("src", F.lit("::"), F.lit(1))).write.parquet(f"{whole}/edges")
            _enter(spark, folder, number, whole, True)
        if on_batch:
            on_batch(current(spark, folder))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _enter(spark: SparkSession, folder: str, number: int, path: str, whole: bool) -> None:
    spark.createDataFrame([(number, path, whole)], "n bigint, path string, whole boolean").coalesce(1).write.mode("append").json(f"{folder}/versions")


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The edge table as of the last batch, None before the first: what was last put together, less the files touched since,
    and of these the edges of the last batch that touched each.  At most ``compact`` batches are read."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/versions")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    entries = spark.read.schema("n bigint, path string, whole boolean").json(f"{folder}/versions")
    top = entries.where("whole").agg(F.max("n")).first()[0]
    rows = entries.where(F.lit(True) if top is None else (F.col("n") > top) | ((F.col("n") == top) & F.col("whole"))).orderBy("n", "path").collect()  # bounded by ``compact``
    last = {r.n: r for r in rows}  # a batch that was run again: one of its equal entries
    if not last:
        return None
    tagged = [spark.read.parquet(f"{r.path}/edges").withColumn("n", F.lit(r.n)) for r in last.values()]
    touched = [spark.read.parquet(f"{r.path}/touched").withColumn("n", F.lit(r.n)) for r in last.values() if not r.whole]
    edges = reduce(DataFrame.unionByName, tagged)
    if touched:
        newest = reduce(DataFrame.unionByName, touched).groupBy("path").agg(F.max("n").alias("newest"))
        edges = edges.join(newest, "path", "left").where(F.col("newest").isNull() | (F.col("n") == F.col("newest")))
    return edges.select("src", "dst").distinct()


def churn(stream: DataFrame, length: str = "1 hour", late: str = "3 days") -> DataFrame:
    """Changes per path and window with a watermark for late rows (an extension: the watched original has none)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length), "path").agg(F.count(F.lit(1)).alias("changes")).select(F.col("window.start").alias("start"), "path", "changes")


def temporary_checkpoint(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lodestone/stream-{uuid.uuid4().hex}"
