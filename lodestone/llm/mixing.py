"""Mixing sources to target weights by Poisson replication.

Each document draws how often it is used from a Poisson distribution, inverted at a number hashed from its id, with the
repetition rate of its source as the mean and the source's cap as the upper end.  The total size is the largest at which
every source that has tokens reaches its share with a rate of at most ``MOST_RATE`` times its cap, unless the caller sets
a smaller one: so every source is drawn, the scarcest one too, which gives nearly all that its cap allows.  Draws only grow
with the rate, so the rate of each source is then tuned on the tokens that the draws really give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.tokens import VOCABULARY, with_tokens
from lodestone.session import materialize
from lodestone.tables import table

#: Up to so many sources the table of rates (a few kB a source) is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 10_000
GRID = 17
#: The largest rate, in caps: at twice a cap of 5 a document is used 4.9 times in the mean.
MOST_RATE = 2.0


def thresholds(rate: float, cap: int) -> list[float]:
    """A document whose number is at least the k-th threshold is used more than k times (k from 0)."""
    if not np.isfinite(rate):
        return [0.0] * cap
    if rate <= 0:
        return [2.0] * cap
    k = np.arange(cap, dtype=float)
    log_p = k * np.log(rate) - rate - np.cumsum(np.log(np.maximum(k, 1)))
    return np.minimum(np.cumsum(np.exp(log_p)), 2.0).tolist()


def capped_mean(rate: float, cap: int) -> float:
    return float(cap) if not np.isfinite(rate) else sum(1 - min(t, 1.0) for t in thresholds(rate, cap))


def rate_for(mean: float, cap: int) -> float:
    """The Poisson rate whose draws, cut at ``cap``, have this mean; infinite at the cap."""
    if mean >= cap * (1 - 1e-9):
        return float("inf")
    if mean <= 0:
        return 0.0
    low, high = 0.0, max(4.0 * cap, 40.0)
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < mean else (low, mid)
    return (low + high) / 2


def number(ident: str, seed: int) -> F.Column:
    """A number in [0, 1) hashed from the id."""
    return F.shiftrightunsigned(F.xxhash64(F.col(ident), F.lit(seed)), 11).cast("double") / F.lit(float(2**53))


def clean_source(c: str) -> F.Column:
    return F.lower(F.trim(F.col(c)))


def _joined(docs: DataFrame, rates: DataFrame) -> DataFrame:
    return docs.join(F.broadcast(rates) if rates.count() <= BROADCAST_SOURCES else rates, "source")


def _grids(stats: DataFrame, around: str, width: float) -> DataFrame:
    """Per source ``GRID`` rates around a column, each with its thresholds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[["source", "wanted_tokens", "max_repeats", around]].copy()
            lists = [[0.0 if r == 0 else r * (1 + width * (2 * i / (GRID - 1) - 1)) for i in range(GRID)] for r in f[around]]
            f["rates"] = lists
            f["marks"] = [[thresholds(r, int(c)) for r in rs] for rs, c in zip(lists, f["max_repeats"])]
            yield f[["source", "wanted_tokens", "rates", "marks"]]

    return stats.mapInPandas(run, "source string, wanted_tokens double, rates array<double>, marks array<array<double>>")


def plan_rates(sized: DataFrame, targets: DataFrame, seed: int, total_tokens: float | None = None) -> DataFrame:
    """Per source: available tokens, wanted tokens, tuned rate and thresholds.  ``sized``: doc_id, source, n_tokens."""
    have = sized.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("available"), F.count(F.lit(1)).alias("documents"))
    goal = targets.groupBy(clean_source("source").alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    s = goal.join(have, "source", "left").fillna({"available": 0.0, "documents": 0})
    usable = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)

    def most(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["most_uses"] = [capped_mean(MOST_RATE * c, int(c)) if c and c > 0 else 0.0 for c in f["max_repeats"]]
            yield f

    s = s.mapInPandas(most, "source string, target_share double, max_repeats int, available double, documents bigint, most_uses double")
    top = s.where(usable).agg(F.sum("target_share").alias("share"), F.min(F.col("available") * F.col("most_uses") / F.col("target_share")).alias("size")).first()
    share, size = top["share"] or 1.0, top["size"] or 0.0
    total = min(total_tokens, size * share) if total_tokens is not None else size * share
    wanted = F.when(usable, F.col("target_share") / share * total).otherwise(0.0)
    s = s.withColumn("reachable_share", F.when(usable, F.col("target_share") / share).otherwise(0.0)).withColumn("wanted_tokens", wanted)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["rate"] = [rate_for(w / a, int(c)) if a > 0 else 0.0 for w, a, c in zip(f["wanted_tokens"], f["available"], f["max_repeats"])]
            yield f

    fields = "source string, target_share double, max_repeats int, available double, documents bigint, reachable_share double, wanted_tokens double"
    cols = [x.split()[0] for x in fields.split(", ")]
    s = materialize(s.select(*cols).mapInPandas(first, fields + ", rate double"), "rates")
    for width in (0.5, 0.07):
        j = _joined(sized.select("source", "n_tokens", number("doc_id", seed).alias("u")), _grids(s, "rate", width))
        sums = j.groupBy("source").agg(F.first("rates").alias("rates"), F.first("wanted_tokens").alias("w"), *(F.sum(F.col("n_tokens") * F.size(F.filter(F.col("marks")[i], lambda t: F.col("u") >= t))).alias(f"t{i}") for i in range(GRID)))
        tried = F.array(*(F.struct(F.abs(F.col(f"t{i}") - F.col("w")).alias("off"), F.col("rates")[i].alias("r")) for i in range(GRID)))
        best = sums.select("source", F.array_min(tried)["r"].alias("tuned"))
        s = materialize(s.join(best, "source", "left").withColumn("rate", F.when(F.col("rate") == float("inf"), F.col("rate")).otherwise(F.coalesce("tuned", "rate"))).drop("tuned"), "rates")

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["marks"] = [thresholds(r, int(c)) for r, c in zip(f["rate"], f["max_repeats"])]
            yield f

    return materialize(s.mapInPandas(last, fields + ", rate double, marks array<double>"), "rates")


def sized_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, source, n_tokens of every document with a source and at least one token."""
    d = with_tokens(docs.withColumn("source", clean_source("source")), "text", ["doc_id", "source"], vocabulary)
    return materialize(d.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0)), "sized")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The mixed corpus in shuffled order: doc_id, copy (1 ..), source, text.

    Sources compare in lower case without outer blanks.  Documents without text, without a source or of a source that is
    no target are left out, as are targets without tokens (their share goes to the others in proportion).  No document is
    used more than ``max_repeats`` times.  A requested ``total_tokens`` above what the caps allow is lowered to it.
    """
    rates = plan_rates(sized_documents(docs, vocabulary), targets, seed, total_tokens)
    d = docs.where(F.length("text") > 0).select("doc_id", clean_source("source").alias("source"), "text", number("doc_id", seed).alias("u"))
    used = _joined(d, rates.select("source", "marks")).withColumn("uses", F.size(F.filter("marks", lambda t: F.col("u") >= t))).where("uses > 0")
    copies = used.select("doc_id", F.explode(F.sequence(F.lit(1), "uses")).alias("copy"), "source", "text")
    place = F.xxhash64("doc_id", "copy", F.lit(seed + 1))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.withColumn("__place", place).repartitionByRange(parts, "__place").sortWithinPartitions("__place").drop("__place")


def shares(docs: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The shares reached: per target source its goal and what ``mix`` with the same arguments uses."""
    sized = sized_documents(docs, vocabulary)
    rates = plan_rates(sized, targets, seed, total_tokens)
    used = _joined(sized.withColumn("u", number("doc_id", seed)), rates.select("source", "marks")).withColumn("uses", F.size(F.filter("marks", lambda t: F.col("u") >= t)))
    got = used.groupBy("source").agg(F.sum("uses").alias("copies"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"))
    total = got.agg(F.sum("tokens").alias("total"))
    r = rates.select("source", "target_share", "reachable_share", "max_repeats", "documents", F.col("available").cast("long").alias("available"))
    j = r.join(got, "source", "left").fillna({"copies": 0, "most_uses": 0, "tokens": 0}).join(F.broadcast(total))  # one row
    return j.withColumn("actual_share", F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(0.0)).drop("total")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
