"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set a temporary one is, but only on one machine: executors couldn't share it."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not (sc.master or "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='leadloom-')}")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """`df` read back from a reliable checkpoint, so later stages don't recompute what led to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)
