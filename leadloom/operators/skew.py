"""Equi-joins whose hot keys are split over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: str, rows_per_task: int = 20_000) -> DataFrame:
    """Inner join on `keys`; each key with more than `rows_per_task` rows on the left is cut into that many-row parts.

    `spread_by` is a column of the left side that tells its rows apart. Rows of the right side with a hot
    key are repeated once for each part. The table of hot keys has at most rows / rows_per_task rows; it is
    joined without a hint, so it is sent to all tasks only where its measured size allows.
    """
    hot = left.groupBy(*keys).count().where(F.col("count") > rows_per_task)
    hot = hot.select(*keys, F.ceil(F.col("count") / rows_per_task).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    a = left.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(spread_by), parts).cast("int")).drop("_parts")
    b = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return a.join(b, [*keys, "_part"]).drop("_part")
