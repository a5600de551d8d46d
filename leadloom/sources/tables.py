"""Readers for the Parquet tables and the missing-value policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that stand for a missing value, lower case (fixed values).
MISSING_WORDS = ("", "n/a", "na", "none", "null")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_missing(c: Column) -> Column:
    """True for NULL, empty and the words that stand for a missing value."""
    return F.coalesce(F.lower(F.trim(c)).isin(*MISSING_WORDS), F.lit(True))


def present(c: Column) -> Column:
    """The column, NULL where it is missing."""
    return F.when(~is_missing(c), c)


def unique_records(df: DataFrame, *columns: str, key: str = "record_id") -> DataFrame:
    """One row for each key with just `columns`; re-delivered rows count once, rows without a key are left out."""
    return df.select(key, *columns).where(F.col(key).isNotNull()).dropDuplicates([key])
