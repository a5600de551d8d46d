"""From raw listings to leads: normalisation, quality, reviews and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import reviews, text, web
from leadloom.functions.panel import digits_to_intl
from leadloom.operators import identity
from leadloom.schema import LEAD_COLUMNS, MISSING, SOCIAL_COLUMNS
from leadloom.sources.tables import present

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def normalise(listings: DataFrame) -> DataFrame:
    """Listings with text, URL, phone and numbers in one form each, and their identity; NULL for what is missing."""
    have = set(listings.columns)
    col = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    plain = ["business_name", "category", "address", "full_address", "city", "state", "postal_code", "claimed_status", "business_status", "place_id", "kgmid", "cid", "plus_code", "business_hours", "latest_image_upload", "by_owner_photos", "has_recent_post", "latest_post_date"]
    urls = ["website", "google_maps_url", "cover_image_url", *SOCIAL_COLUMNS]
    d = listings.select(
        *[text.normalize_text(present(col(c).cast("string"))).alias(c) for c in plain],
        *[(web.normalize_url(col(c)) if c in have else F.lit(None).cast("string")).alias(c) for c in urls],
        digits_to_intl(present(col("phone_international"))).alias("phone_international"),
        F.coalesce(present(col("source_location")), F.nullif(text.query_location(col("query")), F.lit(""))).alias("source_location"),
        F.coalesce(present(col("keyword")), text.query_keyword(col("query"))).alias("source_keyword"),
        F.upper(present(col("country"))).alias("country"),
        web.normalize_phone(col("phone"), F.upper(present(col("country")))).alias("phone"),
        F.when(col("latitude").cast("string").try_cast("double").between(-90, 90), col("latitude").cast("string").try_cast("double")).alias("latitude"),
        F.when(col("longitude").cast("string").try_cast("double").between(-180, 180), col("longitude").cast("string").try_cast("double")).alias("longitude"),
        F.coalesce(text.rating_of(col("rating").cast("string")), F.when(present(col("rating").cast("string")).rlike(r"^[0-5](\.\d+)?$"), present(col("rating").cast("string")).try_cast("double"))).alias("rating"),
        F.coalesce(text.review_count_of(col("rating").cast("string")), text.to_int(present(col("review_count").cast("string")))).alias("review_count"),
        col("query").alias("source_query"),
        (F.coalesce(F.col("_reviews"), F.array().cast("array<string>")) if "_reviews" in have else F.array().cast("array<string>")).alias("reviews"),
        (F.col("_position") if "_position" in have else F.lit(0)).alias("position"),
    )
    return d.withColumn("identity", identity.identity(d.columns))


def quality_issues(df: DataFrame) -> Column:
    """Names of a row's faults: no name, a rating that is no number or out of range, control characters in a text."""
    rating = present(F.col("rating").cast("string"))
    faults = [
        F.when(present(F.col("business_name")).isNull(), "missing_name"),
        F.when(rating.isNotNull() & rating.try_cast("double").isNull(), "rating_non_numeric").when(~rating.try_cast("double").between(0, 5), F.concat(F.lit("rating_out_of_range:"), rating)),
        *[F.when(F.col(c).rlike(CONTROL), f"control_chars_in:{c}") for c, kind in df.dtypes if kind == "string"],
    ]
    return F.array_compact(F.array(*faults))


def with_review_analysis(df: DataFrame, texts: str = "reviews") -> DataFrame:
    """`df` with sentiment, topics, top review and score of its array of reviews."""
    kept = reviews.kept_reviews(F.col(texts), 1, 1000)
    d = df.withColumn("_kept", kept).withColumn("sentiment_score", reviews.sentiment(F.col("_kept"))).withColumn("keywords", reviews.top_keywords(F.col("_kept")))
    return d.withColumn("top_review", reviews.top_review(F.col("_kept"))).withColumn("lead_score", reviews.lead_score(F.col("rating"), F.col("review_count"), F.col("sentiment_score"), F.size("keywords"))).drop("_kept")


def export_columns(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The lead columns as text in the order of the export, N/A for what is missing, columns of custom signals after them."""
    extra = extra or []
    clash = [c for c in extra if c in LEAD_COLUMNS]
    if clash:
        raise ValueError(f"columns of leads already: {clash}")
    return df.select(*[F.coalesce(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string"), F.lit(MISSING)).alias(c) for c in [*LEAD_COLUMNS, *extra]])


def leads_of(listings: DataFrame) -> DataFrame:
    """One lead for each identity in `listings`: the first by query and position."""
    d = with_review_analysis(normalise(listings)).select("*", F.col("identity.identity_key").alias("identity_key"))
    order = F.struct("source_query", "position", "place_id", "business_name", "phone", "address")
    d = d.withColumn("_order", order)
    first = d.where("identity_key is not null").groupBy("identity_key").agg(F.min_by(F.struct(*d.columns), "_order").alias("r")).select("r.*")
    return first.unionByName(d.where("identity_key is null")).drop("_order")
