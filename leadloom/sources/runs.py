"""The table of queries and counters of runs, rows for trials, and the settings of a run."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

QUERY_LOG = "query string, status string, seq long, updated_at double"
COUNTER_LOG = "name string, amount long"


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log at `path`, empty where none was written yet; columns that older files lack are NULL."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(StructType.fromDDL(schema)).parquet(path) if there else spark.createDataFrame([], schema)


def query_states(log: DataFrame) -> DataFrame:
    """(query, status, updated_at) of each query's latest entry; of entries at one time, the one with the larger seq."""
    return log.groupBy("query").agg(F.max_by(F.struct("status", "updated_at"), F.struct("updated_at", "seq")).alias("s")).select("query", "s.*")


def _next(log: DataFrame) -> int:
    return (log.agg(F.max("seq")).first()[0] or 0) + 1


def register_queries(spark: SparkSession, path: str, queries: DataFrame, now: float) -> None:
    """Appends `queries` (query) as pending, but for those the log has."""
    log = read_log(spark, path, QUERY_LOG)
    fresh = queries.select("query").where("query is not null").distinct().join(log.select("query"), "query", "left_anti")
    fresh.select("query", F.lit("pending").alias("status"), F.lit(_next(log)).cast("long").alias("seq"), F.lit(now).alias("updated_at")).write.mode("append").parquet(path)


def mark_queries(spark: SparkSession, path: str, queries: DataFrame, status: str, now: float) -> None:
    """Appends a new status, done or failed, for `queries` (query); a failed one is pending again."""
    log = read_log(spark, path, QUERY_LOG)
    kept = "pending" if status == "failed" else status
    queries.select("query").distinct().select("query", F.lit(kept).alias("status"), F.lit(_next(log)).cast("long").alias("seq"), F.lit(now).alias("updated_at")).write.mode("append").parquet(path)


def pending_queries(states: DataFrame) -> DataFrame:
    return states.where("status is null or status <> 'done'").select("query").orderBy("query")


def without_done(df: DataFrame, states: DataFrame, query: str = "query") -> DataFrame:
    """Rows of `df` whose query isn't done; rows without a query stay."""
    return df.join(states.where("status = 'done'").select(F.col("query").alias(query)).distinct(), query, "left_anti")


def discovered(records: DataFrame) -> DataFrame:
    """(query, discovered, committed) counted from the table of records."""
    return records.where("source_query is not null").groupBy(F.col("source_query").alias("query")).agg(F.count("*").alias("discovered"), F.count_if(F.col("stage") == "committed").alias("committed"))


def count_up(spark: SparkSession, path: str, amounts: dict[str, int]) -> None:
    spark.createDataFrame(sorted(amounts.items()), COUNTER_LOG).write.mode("append").parquet(path)


def counters(log: DataFrame) -> DataFrame:
    return log.groupBy("name").agg(F.sum("amount").alias("value"))


# The rows of the offline source.
_DEMO_REVIEWS = ["Great service, very professional and friendly team!", "Quick, reliable, and reasonably priced. Highly recommend.", "They arrived on time and did an excellent clean job."]


def demo_listings(spark: SparkSession, query: str) -> DataFrame:
    """Three complete listings that need no network."""
    i = F.col("id")
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    place = text("0x1", i, "2:0x3", i, "4")
    street = text(i + 100, " Main St, Dallas, TX 75201")
    return spark.range(3).select(
        F.lit(query).alias("query"), (i + 1).cast("int").alias("_position"), F.lit(3).alias("_total"), text("Sample Business ", i + 1).alias("business_name"), F.lit("Local Service").alias("category"),
        text("phone:tel:+1 555 000 ", i + 1000).alias("phone"), text("+1555000", i + 1000).alias("phone_international"), text("https://sample", i + 1, ".example.com").alias("website"),
        street.alias("address"), F.concat(street, F.lit(", United States")).alias("full_address"), F.lit("Dallas").alias("city"), F.lit("TX").alias("state"), F.lit("75201").alias("postal_code"), F.lit("US").alias("country"),
        (i * 0.001 + 32.7767).alias("latitude"), (i * 0.001 - 96.797).alias("longitude"), F.round(i * 0.1 + 4.5, 1).cast("string").alias("rating"), (i * 10 + 40).cast("string").alias("review_count"),
        F.lit("Claimed").alias("claimed_status"), F.lit("Open").alias("business_status"), F.lit("Mon: 9 AM to 5 PM; Tue: 9 AM to 5 PM").alias("business_hours"), F.lit("11 days ago").alias("latest_image_upload"),
        F.lit("YES").alias("by_owner_photos"), F.lit("YES").alias("has_recent_post"), F.lit("3 days ago").alias("latest_post_date"), place.alias("place_id"), place.alias("cid"), text("/g/", i + 1000).alias("kgmid"),
        F.slice(F.array(*[F.lit(r) for r in _DEMO_REVIEWS]), F.lit(1), (i + 1).cast("int")).alias("_reviews"),
    )


def trial_listings(spark: SparkSession, rows: int, query: str = "trial") -> DataFrame:
    """So many plain listings, each with a site of its own, for measuring runs."""
    i = F.col("id")
    return spark.range(rows).select(F.lit(query).alias("query"), (i + 1).cast("int").alias("_position"), F.lit(rows).alias("_total"), F.format_string("Bench Business %d", i).alias("business_name"), F.format_string("https://site%d.example.org/", i).alias("website"), F.format_string("/g/bench%d", i).alias("kgmid"), F.lit("Dallas").alias("city"))


def run_rates(done: DataFrame, started: str, ended: str) -> DataFrame:
    """(rows, seconds, rows_a_second, mean_seconds, longest_seconds) of rows with their times of begin and end."""
    begun, over = (F.col(c).cast("timestamp").cast("double") for c in (started, ended))
    spent, whole = over - begun, F.max(over) - F.min(begun)
    return done.agg(F.count("*").alias("rows"), whole.alias("seconds"), F.when(whole > 0, F.count("*") / whole).alias("rows_a_second"), F.avg(spent).alias("mean_seconds"), F.max(spent).alias("longest_seconds"))


def load_settings(path: str, known: dict[str, dict]) -> dict[str, dict]:
    """Settings of a YAML file over the defaults of `known` {section: {name: default}}.

    ${NAME} in a text becomes that environment variable, or ${NAME:-other}. Unknown sections or names and
    values of another type than their default are refused.
    """
    import yaml

    doc = _interpolated(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})
    out = {section: dict(values) for section, values in known.items()}
    for section, values in doc.items():
        if section not in out:
            raise ValueError(f"unknown section {section}")
        for name, value in (values or {}).items():
            if name not in out[section]:
                raise ValueError(f"unknown setting {section}.{name}")
            default = out[section][name]
            if default is not None and not isinstance(value, (int, float) if type(default) is float else type(default)):
                raise ValueError(f"{section}.{name} should be {type(default).__name__}, is {value!r}")
            out[section][name] = value
    return out


def _interpolated(value):
    if isinstance(value, dict):
        return {k: _interpolated(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_interpolated(v) for v in value]
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: os.environ.get(m.group(1), m.group(2) or ""), value) if isinstance(value, str) else value
