"""Readers for the input tables.

Growing tables may deliver a row twice; the second delivery differs in ``ingested_at`` only.  ``once`` keeps one row of
each id over the selected columns, so the shuffle carries just those columns and never a whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows over ``columns``: a repeated delivery counts once."""
    return df.select(*columns).distinct()
