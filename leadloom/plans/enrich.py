"""Whole leads: listings with what their sites and the checks of their mail domains tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import outreach, places, web
from leadloom.plans.leads import export_columns
from leadloom.plans.sites import site_rows
from leadloom.schema import SOCIAL_COLUMNS
from leadloom.sources.tables import present


def record_id(strong: Column, *rest: Column) -> Column:
    """An id of one colon: the strong id, its own colons as hyphens, and eight digits of a hash of all; without one the hash alone.

    The hash stands for the random part of ids, so that a run repeated gives the same ones.
    """
    digest = F.sha2(F.concat_ws("\u001f", strong, *rest), 256)
    known = present(strong)
    return F.coalesce(F.concat(F.replace(known, F.lit(":"), F.lit("-")), F.lit(":"), F.substring(digest, 1, 8)), F.substring(digest, 1, 32))


def requires_website(df: DataFrame) -> DataFrame:
    return df.where(present(F.col("website")).isNotNull())


def in_regions(df: DataFrame, rings: list[list[tuple[float, float]]], key: str = "record_id") -> DataFrame:
    """Rows inside a ring, and rows without a readable location; all of them where there are no rings."""
    if not rings:
        return df
    lat, lon = F.col("latitude").cast("string").try_cast("double"), F.col("longitude").cast("string").try_cast("double")
    inside = F.lit(False)
    for ring in rings:
        odd = F.lit(False)
        for (a_lat, a_lon), (b_lat, b_lon) in zip(ring, [*ring[1:], ring[0]]):
            if a_lat != b_lat:
                odd = odd != ((F.lit(a_lat) > lat) != (F.lit(b_lat) > lat)) & (lon < (lat - a_lat) * ((b_lon - a_lon) / (b_lat - a_lat)) + a_lon)
        inside = inside | (odd if len(ring) > 2 else F.lit(False))
    return df.where(lat.isNull() | lon.isNull() | inside)


def mail_checks(df: DataFrame, results: DataFrame | None) -> DataFrame:
    """`df` (emails) with mx_status and mx_reason of its first address's domain by `results` (domain, status, reason).

    Without results nothing is checked; a domain that they lack is inconclusive. Mailboxes are never probed.
    """
    first = F.get("emails", F.lit(0))
    domain = F.when(first.contains("@"), F.lower(F.substring_index(first, "@", -1)))
    if results is None:
        d = df.withColumn("mx_status", F.when(first.isNotNull(), "Not Checked")).withColumn("mx_reason", F.when(first.isNotNull(), "mx_disabled"))
    else:
        r = results.select(F.lower("domain").alias("_domain"), F.col("status").alias("_status"), F.col("reason").alias("_reason")).dropDuplicates(["_domain"])
        d = df.withColumn("_domain", domain).join(r, "_domain", "left")
        d = d.withColumn("mx_status", F.when(first.isNull(), None).when(F.col("_domain").isNull(), "FAIL").otherwise(F.coalesce("_status", F.lit("INCONCLUSIVE"))))
        d = d.withColumn("mx_reason", F.when(first.isNull(), None).when(F.col("_domain").isNull(), "no_domain").otherwise(F.coalesce("_reason", F.lit("not_looked_up")))).drop("_domain", "_status", "_reason")
    return d.withColumn("smtp_status", F.when(first.isNotNull(), "Not Checked")).withColumn("smtp_reason", F.when(first.isNotNull(), "smtp_disabled"))


def hosts_by_preference(hosts: Column) -> Column:
    """Names of mail hosts of an array of (preference, host), smallest preference first, then by name."""
    return F.transform(F.array_sort(F.transform(hosts, lambda h: F.struct(h["preference"], h["host"]))), lambda h: h["host"])


def with_sites(leads: DataFrame, pages: DataFrame, results: DataFrame | None = None, max_pages: int | None = None, early_stop: bool = False) -> DataFrame:
    """`leads` (website and what else is known) with the columns that their sites' pages tell.

    `pages` has site, page_order, url, html and status, its site written as any URL of the lead's host. Profiles of the listing
    go before those of the site. Leads without a site have no website status; those whose site wasn't crawled
    are UNKNOWN.
    """
    s = site_rows(pages.withColumn("site", web.normalize_url(F.col("site"))), early_stop, max_pages)
    people = pages.where("html is not null").select(web.host_of(F.col("site")).alias("_host"), "page_order", places.decision_maker_struct(F.col("text") if "text" in pages.columns else F.regexp_replace("html", "<[^>]+>", " ")).alias("p"))
    people = people.where("p.name is not null").groupBy("_host").agg(F.min_by("p", "page_order").alias("p")).select("_host", F.col("p.name").alias("decision_maker_name"), F.col("p.title").alias("decision_maker_title"))
    s = s.withColumn("_host", web.host_of(F.col("site"))).drop("site", "pages", "home_status", "home_url").dropDuplicates(["_host"]).join(people, "_host", "left")
    both = [c for c in s.columns if c in leads.columns and c != "_host"]
    d = leads.withColumn("_host", web.host_of(F.col("website"))).join(s.withColumnsRenamed({c: f"_site_{c}" for c in both}).withColumn("_crawled", F.lit(True)), "_host", "left")
    d = d.select(*[F.coalesce(present(F.col(c)), F.col(f"_site_{c}")).alias(c) if c in both and c in SOCIAL_COLUMNS else F.coalesce(F.col(f"_site_{c}"), F.col(c)).alias(c) if c in both else F.col(c) for c in d.columns if not c.startswith("_site_")])
    known, crawled = F.col("_host").isNotNull(), F.coalesce("_crawled", F.lit(False))
    d = d.withColumn("website_status", F.when(known & ~crawled, "UNKNOWN").when(known, F.col("website_status"))).drop("_host", "_crawled")
    return mail_checks(d, results)


def with_hook(leads: DataFrame) -> DataFrame:
    """`leads` with pitch_hook from rating, reviews, keywords and sentiment."""
    return leads.withColumn("pitch_hook", outreach.pitch_hook(*[F.col(c) for c in ("business_name", "category", "rating", "review_count", "keywords", "sentiment_score")]))


def whole_leads(leads: DataFrame, pages: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """All lead columns as text of `leads`, as leads_of() gives them, with their sites; arrays joined as in the export."""
    d = with_hook(with_sites(leads, pages, results))
    d = d.withColumn("record_id", record_id(F.coalesce("kgmid", "place_id"), F.col("business_name"), F.col("phone"), F.col("source_query")))
    d = d.withColumn("emails", F.nullif(F.array_join("emails", ","), F.lit(""))).withColumn("tech_stack", F.nullif(F.array_join("tech_stack", ", "), F.lit(""))).withColumn("review_keywords", F.nullif(F.array_join("keywords", ","), F.lit("")))
    tags = [c for c in ("meta_pixel", "ga4", "booking_system", "chat_widget") if c in d.columns]
    return export_columns(d.withColumns({c: F.when(F.col(c) == "YES", "yes").otherwise(F.col(c)) for c in tags} | {"ssl": F.when(F.col("ssl"), "yes")}))
