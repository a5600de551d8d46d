"""Streams of listings: the first of each identity, committed once."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadloom.operators.firstwins import first_wins_by_rules
from leadloom.operators.identity import identity
from leadloom.plans.leads import leads_of
from leadloom.plans.lineage import cut
from leadloom.sources.runs import read_log
from leadloom.sources.sinks import commit_records

SIGNALS = "kgmid place_id canonical_domain normalized_phone name_key city key_type identity_key".split()
KEPT = "seq struct<batch: bigint, row: bigint>, " + ", ".join(f"{s} string" for s in SIGNALS) + ", strong boolean"


def commit_stream(listings: DataFrame, records_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch's leads appended to the table of records, but for the identities it has.

    Batches run one after the other, so the table is what decides what is new; a batch that is run again
    after a failure finds its own rows there and appends none of them.
    """

    def commit(batch: DataFrame, _: int) -> None:
        leads = leads_of(batch).withColumnRenamed("identity_key", "record_id").where("record_id is not null")
        commit_records(leads.drop("identity"), records_path)

    writer = listings.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def dedup_stream(listings: DataFrame, kept_path: str, checkpoint: str, reject=None, available_now: bool = True) -> StreamingQuery:
    """The first of each business by the five rules, over all micro-batches, appended to the table at `kept_path`.

    The rows kept by earlier batches are read again as seeds of smaller seq, so a batch is decided as if all
    had been one table; a batch run again finds its own rows and appends none. Rows that `reject`, a
    predicate, takes out are decided after deduplication and not kept, so that a later row of the same
    business is seen as new: their identity is rolled back.
    """

    def decide(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        i = batch.select("*", identity(batch.columns).alias("_i")).select("*", *[F.col(f"_i.{c}").alias(f"_{c}") for c in SIGNALS])
        i = cut(i.withColumn("_seq", F.struct(F.lit(number).cast("long").alias("batch"), F.monotonically_increasing_id().alias("row"))))
        new = i.select(F.col("_seq").alias("seq"), *[F.col(f"_{c}").alias(c) for c in SIGNALS], (F.col("_kgmid").isNotNull() | F.col("_place_id").isNotNull()).alias("strong"))
        kept = read_log(spark, kept_path, KEPT).where(F.col("seq.batch") < number)
        dupes = first_wins_by_rules(kept.unionByName(new)).where(F.col("seq.batch") == number)
        fresh = new.join(dupes.where("duplicate is null").select("seq"), "seq", "left_semi")
        if reject is not None:
            fresh = fresh.join(i.where(reject).select(F.col("_seq").alias("seq")), "seq", "left_anti")
        again = read_log(spark, kept_path, KEPT).where(F.col("seq.batch") == number)
        if again.isEmpty():
            fresh.write.mode("append").parquet(kept_path)

    writer = listings.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stop_when_idle(query: StreamingQuery, seconds: float, poll: float = 1.0) -> None:
    """Stops a query once it had no rows for so long."""
    idle = 0.0
    while query.isActive and idle < seconds:
        time.sleep(poll)
        last = query.lastProgress
        idle = idle + poll if not last or not last["numInputRows"] else 0.0
    query.stop()


def windowed_counts(events: DataFrame, time_col: str, by: str, window: str, late: str) -> DataFrame:
    """Rows by window and key of a stream or a table; on a stream, later than `late` is left out."""
    d = events.withWatermark(time_col, late) if events.isStreaming else events
    return d.groupBy(F.window(time_col, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
