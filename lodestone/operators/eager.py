"""Aggregation before the join, for keys that hold most of the records.

Both inputs shrink to one compact state per join key before they meet, so the join never sees more than one row of a key
on either side, however hot the key is.  Pre-aggregation is map-side first (Spark's partial aggregate), hence a key with a
third of all rows sends at most one partial state per map task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, key: str, sums: Mapping[str, Column] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per non-null ``key`` (and values of ``by``): ``n`` rows and the sum of every expression in ``sums`` (nulls are
    skipped)."""
    aggs = [F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(a) for a, c in (sums or {}).items())]
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), *by).agg(*aggs)


def eager_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_sums: Mapping[str, Column] | None = None, right_sums: Mapping[str, Column] | None = None, products: Mapping[str, tuple[str, str]] | None = None, how: str = "inner", left_by: Sequence[str] = ()) -> DataFrame:
    """Per key of ``left JOIN right`` on the keys: the number of joined rows and the sums over the joined rows, without
    building them.

    ``pairs`` = n_left * n_right; a sum over left columns counts n_right times and the reverse.  With ``how="left"`` or
    ``"full"`` a key missing on one side counts as one null-extended row there, as in the plain join.  Null keys match
    nothing; they are left out.  ``products`` names (left alias, right alias): the sum over the joined rows of the product
    of the two expressions.  ``left_by`` names columns of the left side that the result is later rolled up by: the left states
    are kept apart by them.  Columns: key, those of ``left_by``, n_left, n_right, pairs, then sums and products by alias,
    which must differ.
    """
    left_sums, right_sums, products = dict(left_sums or {}), dict(right_sums or {}), dict(products or {})
    if clash := (left_sums.keys() & right_sums.keys()) | ({"key", "n", "n_left", "n_right", "pairs", *left_by} & (left_sums.keys() | right_sums.keys())):
        raise ValueError(f"aliases used twice: {sorted(clash)}")
    a = key_states(left, left_key, left_sums, left_by).withColumnRenamed("n", "n_left")
    b = key_states(right, right_key, right_sums).withColumnRenamed("n", "n_right")
    j = a.join(b, "key", how)
    n_left, n_right = F.coalesce("n_left", F.lit(0)), F.coalesce("n_right", F.lit(0))
    return j.select(
        "key",
        *left_by,
        n_left.alias("n_left"),
        n_right.alias("n_right"),
        (F.greatest(n_left, F.lit(1)) * F.greatest(n_right, F.lit(1))).alias("pairs"),
        *((F.col(x) * F.greatest(n_right, F.lit(1))).alias(x) for x in left_sums),
        *((F.col(x) * F.greatest(n_left, F.lit(1))).alias(x) for x in right_sums),
        *((F.col(x) * F.col(y)).alias(p) for p, (x, y) in products.items()),
    )


def roll_up(states: DataFrame, by: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """Roll per-key states up to coarser groups: sums of sums."""
    return states.groupBy(*by).agg(*(F.sum(s).alias(s) for s in sums))


def distinct_partners(df: DataFrame, key: str, partner: str, alias: str) -> DataFrame:
    """Per ``key`` the number of distinct ``partner`` values.

    The first shuffle is on (key, partner): a hot key spreads over all partitions by its partners.  The second one
    carries one partial count per key and task.  Rows with a null key or partner are left out.
    """
    pairs = df.where(F.col(key).isNotNull() & F.col(partner).isNotNull()).select(F.col(key).alias("key"), F.col(partner).alias("partner")).distinct()
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias(alias))
