"""Queries of the core over the tables, each (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import geo, markup, outreach, panel, places, reviews, text, web
from leadloom.operators import filters, identity, packed, spatial
from leadloom.operators.firstwins import first_wins_by_rules
from leadloom.plans import enrich
from leadloom.plans import leads as plans
from leadloom.schema import LEAD_COLUMNS, SOCIAL_COLUMNS
from leadloom.sources import runs, sinks
from leadloom.sources.tables import present, table, unique_records
from leadloom.streaming.dedup import windowed_counts

NEAR_M = 50.0
PACKED = ["emails", "tech_stack", "review_keywords"]
#: Filters of the example queries.
WANTED = {"include_all": ["rating >= 4"], "include_any": [{"field": "claimed_status", "op": "=", "value": "Claimed"}, {"field": "review_count", "op": ">=", "value": 50}], "exclude_any": [{"field": "business_status", "op": "contains", "value": "closed"}, {"field": "country", "op": "in", "value": ["GB"]}]}
WANTED_LATE = {"include_any": [{"email_found": "yes"}, "rating >= 4.5"], "exclude_all": [{"field": "meta_pixel", "value": "no"}, {"field": "ga4", "value": "no"}]}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spatial.located(table(spark, sf_dir, "leads"), "record_id", "latitude", "longitude")
    near = spatial.near_pairs(points, NEAR_M).select(F.lit("near").alias("kind"), "id_a", "id_b")
    zone = spatial.regions_of_points(points, table(spark, sf_dir, "areas"), "area_id", "ring")
    return near.unionByName(zone.select(F.lit("zone").alias("kind"), F.col("id").alias("id_a"), F.col("region_id").alias("id_b")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = unique_records(table(spark, sf_dir, "leads"), *PACKED)
    return packed.unpack(leads, "record_id", PACKED).withColumn("pos", F.col("pos").cast("int"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.located(table(spark, sf_dir, "leads"), "record_id", "latitude", "longitude")


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = unique_records(table(spark, sf_dir, "leads"), "website")
    return d.select("record_id", web.normalize_url(F.col("website")).alias("url"), web.host_of(F.col("website")).alias("host"), web.domain_of(F.col("website")).alias("domain"))


def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = unique_records(table(spark, sf_dir, "leads"), "phone", "country")
    return d.select("record_id", web.normalize_phone(F.col("phone"), present(F.col("country"))).alias("phone"))


def emails_in_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = unique_records(table(spark, sf_dir, "leads"), "top_review")
    return d.select("record_id", F.explode(web.emails_in(F.col("top_review"))).alias("email"))


def email_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = unique_records(table(spark, sf_dir, "leads"), "emails", "website")
    one = packed.unpack(d, "record_id", ["emails"], ["website"])
    return one.select("record_id", "pos", web.normalize_email(F.col("item")).alias("email"), F.coalesce(web.email_rejection(F.col("item"), F.col("website")), F.lit("kept")).alias("verdict"))


def identity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = unique_records(table(spark, sf_dir, "leads"), "place_id", "business_name", "website", "phone", "city")
    i = identity.identity(["place_id", "business_name", "website", "phone", "city"])
    return d.select("record_id", i.alias("i")).groupBy("i.key_type").agg(F.count("*").alias("records"), F.countDistinct("i.identity_key").alias("identities"))


def first_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = unique_records(table(spark, sf_dir, "leads"), "place_id", "city").withColumn("place_id", present(F.col("place_id")))
    return identity.first_wins(d, ["place_id"], ["record_id"]).select("record_id", "place_id")


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "listings").select("_position", "query", "kgmid", "place_id", "business_name", "website", "phone", "city", "country")
    d = d.withColumn("seq", F.struct("query", "_position", *[F.coalesce(c, F.lit("")).alias(c) for c in ("place_id", "business_name", "phone", "website")])).dropDuplicates(["seq"])
    i = d.select("seq", identity.identity(d.columns).alias("i")).select("seq", "i.*")
    i = i.withColumn("strong", F.col("kgmid").isNotNull() | F.col("place_id").isNotNull())
    return first_wins_by_rules(i).groupBy(F.coalesce("duplicate", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("listings"))


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_records(table(spark, sf_dir, "leads"), "rating", "review_count", "claimed_status", "business_status", "country", "emails", "meta_pixel", "ga4")


def filter_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply(_leads(spark, sf_dir), WANTED).select("record_id")


def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _leads(spark, sf_dir)
    return d.select(F.coalesce(filters.rejection(WANTED, d.columns), F.lit("kept")).alias("reason")).groupBy("reason").count().withColumnRenamed("count", "records")


def filter_two_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    early, late = filters.split(WANTED_LATE)
    return filters.apply(filters.apply(_leads(spark, sf_dir), early), late).select("record_id")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = unique_records(table(spark, sf_dir, "leads"), *[c for c in LEAD_COLUMNS if c != "record_id"])
    return d.select("record_id", F.array_join(plans.quality_issues(d), ";").alias("issues"))


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "leads")
    return plans.export_columns(unique_records(d, *[c for c in d.columns if c != "record_id"]))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "listings").select("query", "rating", "review_count")
    r = F.coalesce(text.rating_of(F.col("rating")), present(F.col("rating")).try_cast("double"))
    return d.select("query", r.alias("r")).groupBy("query").agg(F.count("*").alias("listings"), F.count("r").alias("rated"), F.round(F.avg("r"), 6).alias("mean_rating"))


def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "listings").select("_reviews")
    d = d.select(F.explode("_reviews").alias("review")).distinct()
    return d.select("review", F.bround(reviews.review_sentiment(F.col("review")), 6).alias("sentiment"), F.size(text.tokens(F.col("review"))).alias("tokens"))


def listing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "listings").where(F.size("_reviews") > 0).select("_reviews").distinct()
    s = reviews.sentiment(F.col("_reviews"))
    return d.select(F.array_join("_reviews", "|").alias("reviews"), s.alias("sentiment"), reviews.top_review(F.col("_reviews")).alias("top_review"), F.array_join(reviews.top_keywords(F.col("_reviews")), ",").alias("keywords"))


def first_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = unique_records(table(spark, sf_dir, "leads"), *SOCIAL_COLUMNS)
    return identity.first_claims(d, "record_id", "record_id", SOCIAL_COLUMNS)


def first_of_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.limited(unique_records(table(spark, sf_dir, "leads"), "source_query"), "source_query", ["record_id"], 3).select("record_id", "source_query")


def unseen_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.unseen(table(spark, sf_dir, "incoming").select("seq_no", "record_id", "identity_key"), table(spark, sf_dir, "records").where("stage = 'committed'"), ["identity_key"]).select("seq_no", "record_id")


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").groupBy("stage").agg(F.count("*").alias("records"), F.count("committed_row").alias("with_row"), F.countDistinct("source_query").alias("queries"))


def query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "queries").select("query", text.query_keyword(F.col("query")).alias("keyword"), text.query_location(F.col("query")).alias("location"))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"))


def keyword_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower(F.coalesce("text", F.lit("")))
    flags = [text.yes_no(markup.keyword_signal(low, ks)).alias(n) for n, ks in markup.KEYWORD_SIGNALS.items()]
    return table(spark, sf_dir, "documents").select("doc_id", *flags)


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour", "10 minutes").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.struct(F.floor((F.col("lat") + 90) / 0.05).cast("long").alias("row"), F.floor((F.col("lon") + 180) / 0.05).cast("long").alias("column"))
    return coordinates(spark, sf_dir).groupBy(cell.alias("c")).agg(F.count("*").alias("points")).select("c.row", "c.column", "points")


def panel_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = unique_records(table(spark, sf_dir, "leads"), "business_hours", "plus_code", "phone", "business_status", "claimed_status", "latest_image_upload")
    return d.select(
        "record_id", panel.status_of_hours(F.col("business_hours")).alias("hours_status"), panel.plus_code(present(F.col("plus_code"))).alias("plus_code"), panel.digits_to_intl(present(F.col("phone"))).alias("intl"),
        panel.business_status(F.col("business_status") == "Permanently closed", F.col("business_status"), F.col("business_hours")).alias("status"), panel.claimed_status(F.col("claimed_status") == "Unclaimed").alias("claimed"),
        panel.first_present(F.col("plus_code"), F.col("latest_image_upload"), F.col("phone")).alias("first_present"), text.upload_label(F.concat(F.lit("Photo · "), F.col("latest_image_upload"))).alias("upload"),
        panel.hours_line(F.split("business_hours", ";")).alias("hours"),
    )


def plain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = unique_records(table(spark, sf_dir, "leads"), "business_name", "review_count", "rating", "top_review")
    plain = text.normalize_text(F.col("business_name"))
    return d.select("record_id", plain.alias("name"), text.name_key(plain).alias("name_key"), text.to_int(F.col("review_count")).alias("reviews"), text.to_float(F.col("rating")).alias("rating"), text.clean_review(F.col("top_review")).alias("review"))


def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = unique_records(table(spark, sf_dir, "leads"), "business_name", "place_id").withColumn("place_id", present(F.col("place_id"))).withColumnRenamed("business_name", "lead_name")
    listed = table(spark, sf_dir, "listings").select("place_id", "business_name").where("place_id is not null").distinct()
    return leads.join(listed, "place_id").select("record_id", "business_name", panel.names_compatible(F.col("lead_name"), F.col("business_name")).alias("compatible"))


def listing_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = unique_records(table(spark, sf_dir, "leads"), "google_maps_url", "place_id", "latitude", "longitude")
    pinned = F.concat(F.col("google_maps_url"), F.lit("/@0,0,17z/data=!1s"), F.col("place_id"), F.lit("!3d12.5!4d-7.25?hl=de&utm_source=x&entry=y&k=1#f"))
    ids = places.listing_ids(pinned)
    return d.select("record_id", web.clean_listing_url(pinned).alias("clean"), panel.with_region(pinned, "en", "us").alias("region"), ids["place_name"].alias("place_name"), ids["place_id"].alias("place_id"), ids["latitude"].alias("lat"), ids["longitude"].alias("lon"))


def opening_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = unique_records(table(spark, sf_dir, "leads"), "business_name", "category", "rating", "review_count", "review_keywords", "sentiment_score")
    topics = F.split(F.lower(present(F.col("review_keywords"))), ",")
    return d.select("record_id", outreach.pitch_hook(F.col("business_name"), F.col("category"), F.col("rating"), F.col("review_count"), topics, F.col("sentiment_score").try_cast("double")).alias("hook"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = "business_name category city state rating review_count sentiment_score review_keywords top_review facebook instagram linkedin cms".split()
    d = unique_records(table(spark, sf_dir, "leads"), *used)
    return d.select("record_id", outreach.prompt_text({c: F.col(c) for c in used}).alias("prompt"))


def lead_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = unique_records(table(spark, sf_dir, "leads"), "rating", "review_count", "sentiment_score")
    n = F.lit(2)
    return d.select("record_id", reviews.lead_score(F.col("rating").try_cast("double"), F.col("review_count").try_cast("int"), F.coalesce(F.col("sentiment_score").try_cast("double"), F.lit(0.0)), n).alias("score"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.length(text.strip_tags(F.col("text"))).alias("visible"), panel.is_challenge(F.col("text")).alias("challenge"), panel.goal_reached(F.col("text")).alias("goal"), F.size(F.coalesce(panel.sentences(F.col("text")), F.array())).alias("sentences"), markup.page_reason(F.lit(200), F.col("text")).alias("reason"))


def kept_review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "listings").select("_reviews").where("_reviews is not null").distinct()
    return d.select(F.array_join("_reviews", "|").alias("reviews"), F.array_join(reviews.kept_reviews(F.col("_reviews"), 25, 60), "|").alias("kept"))


def _query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "queries").select("query", "status", F.lit(0).cast("long").alias("seq"), "updated_at")


def waiting_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.pending_queries(runs.query_states(_query_log(spark, sf_dir)))


def undone_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = unique_records(table(spark, sf_dir, "leads"), "source_query")
    return runs.without_done(leads, runs.query_states(_query_log(spark, sf_dir)), "source_query").select("record_id", "source_query")


def discovered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.discovered(table(spark, sf_dir, "records"))


def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.counters(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.lit(1).alias("amount")))


def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select("ts", (F.col("ts").cast("timestamp").cast("double") + F.floor("value")).cast("timestamp").alias("ended"))
    r = runs.run_rates(d, "ts", "ended")
    return r.select("rows", F.round("seconds", 3).alias("seconds"), F.round("rows_a_second", 6).alias("rows_a_second"), F.round("mean_seconds", 6).alias("mean_seconds"), F.round("longest_seconds", 3).alias("longest_seconds"))


def with_website(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.requires_website(unique_records(table(spark, sf_dir, "leads"), "website"))


def in_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = unique_records(table(spark, sf_dir, "leads"), "latitude", "longitude")
    return spatial.within_regions(d, "record_id", "latitude", "longitude", table(spark, sf_dir, "areas"), "area_id", "ring").select("record_id")


def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "listings").select("kgmid", "place_id", "business_name", "query").distinct()
    return d.select("business_name", "query", enrich.record_id(F.coalesce(present(F.col("kgmid")), present(F.col("place_id"))), F.col("business_name"), F.col("query")).alias("id"))


def committed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sinks.committed(table(spark, sf_dir, "records"))
    return d.select("record_id", "committed_row", F.from_json("raw_json", "business_name string, city string").alias("r")).select("record_id", "committed_row", "r.*")


def migrated_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.migrated(table(spark, sf_dir, "records"), ["signal_custom"]).drop("committed_row")


def reconciled_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = unique_records(table(spark, sf_dir, "leads"), "business_name", "city")
    return sinks.reconciled(d, table(spark, sf_dir, "records"))


def numbered_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = unique_records(table(spark, sf_dir, "leads"), "business_name")
    return sinks.with_row_index(d, ["record_id"]).select("record_id", "row_index")


def mail_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = unique_records(table(spark, sf_dir, "leads"), "emails", "website")
    results = d.select(web.domain_of(F.col("website")).alias("domain")).where("domain is not null").distinct().select("domain", F.lit("PASS").alias("status"), F.lit("mx_records=1").alias("reason"))
    first = d.select("record_id", F.array_compact(F.array(web.normalize_email(present(F.col("emails"))))).alias("emails"))
    return enrich.mail_checks(first, results).select("record_id", "mx_status", "mx_reason", "smtp_status")


def demo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.demo_listings(spark, "plumber in Dallas").select("_position", "business_name", "phone", "website", "full_address", "rating", "review_count", "place_id", "kgmid", F.size("_reviews").alias("n_reviews"))


def trial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.trial_listings(spark, 1000).select("_position", "_total", "business_name", "website", "kgmid")


def phone_and_rating_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "listings").select("query", "rating", "review_count", "country").distinct()
    r = F.col("rating").cast("string")
    return d.select("query", r.alias("raw"), F.col("review_count").cast("string").alias("raw_count"), text.rating_of(r).alias("stars"), text.review_count_of(r).alias("reviews"), F.upper(present(F.col("country"))).alias("country")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p2_found, coordinates, url_parts, phones, emails_in_reviews, email_verdicts, identity_types, first_by_place, first_wins, filter_leads, filter_reasons, filter_two_passes, quality, export_rows, ratings, review_scores, listing_scores,
        first_claim, first_of_query, unseen_batches, stages, query_words, document_tokens, keyword_signals, event_windows, grid_cells, panel_texts, plain_names, name_matches, listing_urls, opening_lines, prompts, lead_scores, page_texts, kept_review_texts,
        waiting_queries, undone_leads, discovered_counts, event_counters, event_rates, with_website, in_areas, record_ids, committed_rows, migrated_export, reconciled_export, numbered_export, mail_domains, demo_rows, trial_rows, phone_and_rating_listings,
    )
}

# SQL ---------------------------------------------------------------------------------------------------------

_MISSING = "('', 'n/a', 'na', 'none', 'null')"


def _present(c: str) -> str:
    return f"case when lower(trim({c})) not in {_MISSING} then {c} end"


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _coordinate(c: str, minus: str, plus: str, most: int) -> str:
    t = f"replace(replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ',', '.'), '−', '-')"
    pattern = r"^([NSEWnsew])?\s*([+-]?(?:\d+\.?\d*|\.\d+))\s*[°º]?\s*([NSEWnsew])?$"
    n, letter = f"try_cast(regexp_extract({t}, '{pattern}', 2) as double)", f"upper(concat(regexp_extract({t}, '{pattern}', 1), regexp_extract({t}, '{pattern}', 3)))"
    value = f"(case when {letter} in ('', '{plus}') then {n} when {letter} = '{minus}' then -abs({n}) end)"
    return f"case when {value} between -{most} and {most} then {value} end"


_POINTS = f"""points as (select * from (select distinct record_id as id, {_coordinate("latitude", "S", "N", 90)} as lat, {_coordinate("longitude", "W", "E", 180)} as lon from leads where record_id is not null)
  where lat is not null and lon is not null and not (lat = 0 and lon = 0))"""
_METRES = "2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_BANDS = "bands as (select *, cast(floor(lat * 1000) as bigint) as band from points)"
_TOKENS = lambda c: f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: length(x) > 1)"
_HITS = lambda c, ws: f"len(list_filter({_TOKENS(c)}, lambda w: w in {_in(ws)}))"
_URL_HOST = "regexp_replace(lower(regexp_extract(w, '^https?://([^/?#]*)', 1)), '^www\\.', '')"
_FIELD = lambda c: f"(case when lower(trim({c})) in ('yes', 'true', 'y', '1') then 1.0 when lower(trim({c})) in ('no', 'false', 'n', '0', '') then 0.0 when regexp_full_match(trim({c}), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') then try_cast(trim({c}) as double) end)"
_WANTED = f"""case when not coalesce({_FIELD("rating")} >= 4, false) then 'include_all'
  when not (coalesce(trim(claimed_status) = 'Claimed', false) or coalesce({_FIELD("review_count")} >= 50, false)) then 'include_any'
  when coalesce(contains(trim(business_status), 'closed'), false) or coalesce(trim(country) = 'GB', false) then 'exclude_any' end"""
_FLAG = lambda c: f"(coalesce(lower(trim({c})), '') not in ('', 'n/a', 'no'))"
_PIECES = r"\s*[,;|·•\r\n\t]\s*|\s+/\s+"


def _unpacked(field: str) -> str:
    more = r"|\s+" if field == "emails" else ""
    cell = f"regexp_replace({field}, '^\\s+|\\s+$', '', 'g')"
    cell = f"(case when {cell} like '[%]' then substr({cell}, 2, length({cell}) - 2) else {cell} end)"
    marked = f"array_to_string(list_transform(string_split({cell}, '\"'), lambda x, i: case when i % 2 = 1 then regexp_replace(x, '{_PIECES}{more}', chr(31), 'g') else x end), '\"')"
    bare = f"list_transform(string_split({marked}, chr(31)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"
    items = f"list_filter(list_transform({bare}, lambda x: case when length(x) >= 2 and x like '\"%\"' then trim(replace(substr(x, 2, length(x) - 2), '\"\"', '\"')) else x end), lambda x: x <> '')"
    return f"select record_id, '{field}' as field_name, unnest(generate_series(1, len(items))) as pos, unnest(items) as item from (select record_id, {items} as items from (select distinct record_id, {field} from leads where record_id is not null and lower(trim({field})) not in {_MISSING}))"


def _unescaped(c: str, rounds: int) -> str:
    """SQL that resolves the common character references."""
    for _ in range(rounds):
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&#x27;", "''"), ("&#x2F;", "/"), ("&amp;", "&")):
            c = f"replace({c}, '{entity}', '{char}')"
    return c


_NAME_WORDS = lambda c: f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda x: length(x) > 2 and x not in {_in(panel.GENERIC_NAME_WORDS)})"

_PLAIN = lambda c: f"nullif(trim(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace({_unescaped(c, 2)}, '<[^>]*>', ' ', 'g'), '[\\p{{Z}}\\t\\r\\n]', ' ', 'g'), '{text.FORMATTING_NOISE}�', ''), '\\p{{Cc}}', '', 'g'), ' +', ' ', 'g')), '')"
_PHONES = r"""with p as (select distinct record_id, case when lower(trim(country)) not in ('', 'n/a', 'na', 'none', 'null') then upper(country) end as land, regexp_replace(trim(case when lower(trim(phone)) not in ('', 'n/a', 'na', 'none', 'null') then phone end), '(?i)^(phone:tel:|tel:)', '') as t from leads where record_id is not null),
      q as (select record_id, coalesce(land, 'US') as land, regexp_extract(t, '(?i)[\s,;]*(?:ext(?:ension)?\.?|x|#|poste|anexo)\s*[:.#\- ]*\s*(\d{1,6})\b.*$', 1) as ext, trim(regexp_extract(regexp_replace(t, '(?i)[\s,;]*(?:ext(?:ension)?\.?|x|#|poste|anexo)\s*[:.#\- ]*\s*(\d{1,6})\b.*$', ''), '^([+]?[\d\s().,\-]+)', 1)) as n from p),
      r as (select *, regexp_replace(n, '\D', '', 'g') as d from q),
      s as (select *, case when n like '+%' then d when n like '00%' then substr(d, 3) when land in ('DE', 'FR', 'GB', 'ES') then case land when 'DE' then '49' when 'FR' then '33' when 'GB' then '44' else '34' end || regexp_replace(d, '^0', '') when length(d) = 10 then '1' || d when length(d) = 11 and d like '1%' then d end as w from r)
      select record_id, case when length(w) between 7 and 15 and (w not like '1%' or length(w) = 11) then '+' || w || case when ext <> '' then ' x' || ext else '' end end as phone from s"""
#: Phones of records whose country isn't asked about.
_PHONES_US = _PHONES.replace("upper(country)", "cast(null as varchar)")

SQL = {
    "p1_found": f"""with {_POINTS}, {_BANDS},
      edges as (select area_id, ring[i] as p, ring[case when i = len(ring) then 1 else i + 1 end] as q from (select area_id, ring, unnest(generate_series(1, len(ring))) as i from areas)),
      crossings as (select id, area_id, count(*) as n from points join edges on (p.lat > lat) <> (q.lat > lat) and lon < (q.lon - p.lon) * (lat - p.lat) / (q.lat - p.lat) + p.lon group by all)
      select 'near' as kind, a.id as id_a, b.id as id_b from bands a join (select id, lat, lon, band + unnest([-1, 0, 1]) as band from bands) b on a.band = b.band where a.id < b.id and {_METRES} <= 50
      union all select 'zone', id, area_id from crossings where n % 2 = 1""",
    "p2_found": " union all ".join(_unpacked(f) for f in PACKED).join(["select record_id, field_name, cast(pos as integer) as pos, item from (", ")"]),
    "coordinates": f"with {_POINTS} select id, lat, lon from points",
    "url_parts": f"""select record_id, case when w is not null then regexp_extract(w, '^(https?)://', 1) || '://' || {_URL_HOST} || regexp_replace(regexp_extract(w, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(w, '(\\?[^#]*)', 1) end as url,
      case when w is not null then {_URL_HOST} end as host, case when w is not null then array_to_string(string_split({_URL_HOST}, '.')[-2:], '.') end as domain
      from (select distinct record_id, {_present("website")} as w from leads where record_id is not null)""",
    "phones": _PHONES,
    "emails_in_reviews": rf"""with t as (select distinct record_id, regexp_replace(regexp_replace(top_review, '(?i)\s*[\[(]\s*at\s*[\])]\s*', '@', 'g'), '(?i)\s*[\[(]\s*dot\s*[\])]\s*', '.', 'g') as x from leads where record_id is not null)
      select distinct record_id, email from (select record_id, regexp_replace(lower(unnest(regexp_extract_all(x, '{web.EMAIL_TOKEN.replace("'", "''")}'))), '^[\s."''<>]+|[\s."''<>]+$', '', 'g') as email from t) where email <> ''""",
    "first_by_place": f"with d as (select distinct record_id, {_present('place_id')} as place_id from leads where record_id is not null) select min(record_id) as record_id, place_id from d where place_id is not null group by place_id union all select record_id, place_id from d where place_id is null",
    "filter_leads": f"select distinct record_id from leads where record_id is not null and ({_WANTED}) is null",
    "filter_reasons": f"select coalesce({_WANTED}, 'kept') as reason, count(*) as records from (select distinct record_id, rating, review_count, claimed_status, business_status, country from leads where record_id is not null) group by 1",
    "filter_two_passes": f"select distinct record_id from leads where record_id is not null and coalesce({_FIELD('rating')} >= 4.5, false) and coalesce(lower(trim(emails)), '') not in ('', 'n/a') and not (not {_FLAG('meta_pixel')} and not {_FLAG('ga4')})",
    "quality": f"""with d as (select distinct {", ".join(LEAD_COLUMNS)}, {_present("rating")} as r from leads where record_id is not null)
      select record_id, array_to_string(list_filter([case when {_present("business_name")} is null then 'missing_name' end, case when r is not null and try_cast(r as double) is null then 'rating_non_numeric' when not try_cast(r as double) between 0 and 5 then 'rating_out_of_range:' || r end,
      {", ".join(f"case when regexp_matches({c}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') then 'control_chars_in:{c}' end" for c in ["record_id", *[c for c in LEAD_COLUMNS if c != "record_id"]])}], lambda x: x is not null), ';') as issues from d""",
    "export_rows": "select distinct " + ", ".join(f"coalesce({c}, 'N/A') as {c}" for c in LEAD_COLUMNS) + " from leads where record_id is not null",
    "ratings": rf"""select query, count(*) as listings, count(r) as rated, round(avg(r), 6) as mean_rating from (select query, coalesce(try_cast(replace(nullif(regexp_extract(rating, '\b([1-5][.,]\d)\b', 1), ''), ',', '.') as double), try_cast({_present("rating")} as double)) as r from listings) group by query""",
    "review_scores": f"select review, round_even(case when p + n > 0 then (p - n) / (p + n) end, 6) as sentiment, tokens from (select review, {_HITS('review', reviews.POSITIVE)} as p, {_HITS('review', reviews.NEGATIVE)} as n, len({_TOKENS('review')}) as tokens from (select distinct unnest(_reviews) as review from listings))",
    "listing_scores": f"""with d as (select distinct _reviews as rs, array_to_string(_reviews, '|') as reviews from listings where len(_reviews) > 0),
      e as (select reviews, generate_subscripts(rs, 1) as i, unnest(rs) as t from d),
      k as (select *, {_HITS("t", reviews.POSITIVE)} as p, {_HITS("t", reviews.NEGATIVE)} as n from e), s as (select *, case when p + n > 0 then (p - n) / (p + n) end as score from k),
      w as (select reviews, w, count(*) as c, min(seen) as seen from (select reviews, unnest({_TOKENS("t")}) as w, i * 100000 + generate_subscripts({_TOKENS("t")}, 1) as seen from e) where w not in {_in(sorted({*text.STOPWORDS, *reviews.PANEL_WORDS, *reviews.NO_TOPICS, *reviews.POSITIVE, *reviews.NEGATIVE}))} group by 1, 2),
      r as (select reviews, w, row_number() over (partition by reviews order by c desc, seen) as n from w)
      select reviews, coalesce(round_even(avg(score), 3), 0) as sentiment, arg_min(t, row(-coalesce(score, 0), -length(t), i)) as top_review, coalesce((select string_agg(w, ',' order by n) from r where r.reviews = s.reviews and n <= 5), '') as keywords from s group by reviews""",
    "first_claim": f"""with d as (select distinct record_id, {", ".join(f"{_present(c)} as {c}" for c in SOCIAL_COLUMNS)} from leads where record_id is not null),
      x as (select record_id, unnest([{", ".join(SOCIAL_COLUMNS)}]) as v from d), o as (select v, min(record_id) as owner from x where v is not null group by v)
      select record_id, {", ".join(f"(select {c} from o where o.v = d.{c} and o.owner = d.record_id) as {c}" for c in SOCIAL_COLUMNS)} from d""",
    "first_of_query": "select record_id, source_query from (select record_id, source_query, row_number() over (partition by source_query order by record_id) as n from (select distinct record_id, source_query from leads where record_id is not null)) where n <= 3",
    "unseen_batches": "select seq_no, record_id from incoming i where not exists (select 1 from records r where r.stage = 'committed' and r.identity_key = i.identity_key)",
    "stages": "select stage, count(*) as records, count(committed_row) as with_row, count(distinct source_query) as queries from records group by stage",
    "query_words": r"select query, trim(regexp_replace(query, '(?i)\s+(?:in|near)\s+.*$', '')) as keyword, case when regexp_matches(query, '(?i)\s+(in|near)\s+') then trim(regexp_replace(query, '(?i)^.*?\s+(?:in|near)\s+', '')) else '' end as location from queries",
    "document_tokens": f"select doc_id, len(t) as tokens, len(list_distinct(t)) as distinct_tokens from (select doc_id, {_TOKENS('coalesce(text, chr(32))')} as t from documents)",
    "keyword_signals": "select doc_id, " + ", ".join("case when " + " or ".join(f"contains(lower(coalesce(text, '')), '{k}')" if " " in k else f"regexp_matches(' ' || lower(coalesce(text, '')) || ' ', '[^\\p{{L}}\\p{{N}}\\p{{M}}_]{k}[^\\p{{L}}\\p{{N}}\\p{{M}}_]')" for k in ks) + f" then 'YES' else 'NO' end as {n}" for n, ks in markup.KEYWORD_SIGNALS.items()) + " from documents",
    "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n from events group by 1, 2",
    "grid_cells": f'with {_POINTS} select cast(floor((lat + 90) / 0.05) as bigint) as "row", cast(floor((lon + 180) / 0.05) as bigint) as "column", count(*) as points from points group by 1, 2',
    "panel_texts": f"""with d as (select distinct record_id, business_hours, {_present("plus_code")} as p, {_present("phone")} as phone, business_status, {_present("business_status")} as bs, {_present("business_hours")} as bh, claimed_status, latest_image_upload, {_present("latest_image_upload")} as u from leads where record_id is not null),
      e as (select *, regexp_replace(regexp_extract(phone, '\\+[\\d\\s().\\-]+'), '[^\\d+]', '', 'g') as plus, regexp_replace(phone, '\\D', '', 'g') as digits, trim(coalesce(trim(bs), trim(bh))) as line from d)
      select record_id, case when regexp_matches(lower(business_hours), 'open\\s*24\\s*hours') then 'Open' end as hours_status, nullif(trim(regexp_replace(p, '\\s+', ' ', 'g')), '') as plus_code,
      case when plus <> '' then plus when digits <> '' then '+' || digits end as intl,
      case when business_status = 'Permanently closed' then 'Permanently closed' when lower(line) like 'open%' then 'Open' when lower(line) like 'close%' then 'Closed' else nullif(trim(split_part(line, '·', 1)), '') end as status,
      case when claimed_status = 'Unclaimed' then 'Unclaimed' else 'Claimed' end as claimed, coalesce(trim(p), trim(u), trim(phone)) as first_present, nullif(trim(latest_image_upload), '') as upload,
      nullif(array_to_string(list_filter(list_transform(string_split(business_hours, ';'), lambda x: trim(x)), lambda x: x <> ''), '; '), '') as hours from e""",
    "plain_names": f"""with d as (select distinct record_id, business_name, review_count, rating, top_review from leads where record_id is not null),
      n as (select *, {_PLAIN("business_name")} as name from d)
      select record_id, name, nullif(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '') as name_key, try_cast(regexp_replace(review_count, '[^0-9-]', '', 'g') as bigint) as reviews, try_cast(regexp_replace(rating, '[^0-9.\\-]', '', 'g') as double) as rating,
      trim(regexp_replace(regexp_replace(top_review, '{text.REVIEW_NOISE}', ' ', 'g'), '\\s+', ' ', 'g')) as review from n""",
    "name_matches": f"""with l as (select distinct record_id, business_name as a, {_present("place_id")} as place_id from leads where record_id is not null), g as (select distinct place_id, business_name from listings where place_id is not null),
      w as (select record_id, g.business_name, {_NAME_WORDS("a")} as x, {_NAME_WORDS("g.business_name")} as y from l join g using (place_id)) select record_id, business_name, len(x) = 0 or len(y) = 0 or list_has_any(x, y) as compatible from w""",
    "listing_urls": r"""with d as (select distinct record_id, google_maps_url || '/@0,0,17z/data=!1s' || place_id || '!3d12.5!4d-7.25' as u, '?hl=de&utm_source=x&entry=y&k=1#f' as t, google_maps_url as g, place_id as p from leads where record_id is not null)
      select record_id, u || '?hl=de&k=1' as clean, u || '&utm_source=x&entry=y&k=1#f?hl=en&gl=us' as region, nullif(regexp_extract(g || '/', '/maps/place/([^/]+)', 1), '') as place_name, case when u is not null then nullif(regexp_extract('!1s' || p, '!1s(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)', 1), '') end as place_id,
      case when u is not null then 12.5 end as lat, case when u is not null then -7.25 end as lon from d""",
    "opening_lines": f"""with d as (select distinct record_id, {_present("business_name")} as n, {_present("category")} as c, {_present("rating")} as r, review_count, {_present("review_keywords")} as k, try_cast(sentiment_score as double) as s from leads where record_id is not null),
      e as (select *, lower(trim(coalesce(c, 'your services'))) as trade, split_part(lower(k), ',', 1) as first from d), f as (select *, case when k is null or first in {_in(reviews.NO_TOPICS)} then trade else first end as topic from e)
      select record_id, 'I noticed ' || trim(coalesce(n, 'your business')) || ' has ' || coalesce(try_cast(review_count as integer), 0) || ' reviews' || coalesce(' and a ' || r || ' rating', '') ||
      case when s > 0.3 then ' with customers consistently praising ' || topic when s < -0.3 then ' but some recent reviews mention ' || topic || ' — a quick fix could lift that' else ' — and I''d love to help you turn that into more qualified leads' end || '.' as hook from f""",
    "prompts": f"""with d as (select distinct record_id, {", ".join(f"{_present(c)} as {c}" for c in "business_name category city state rating review_count sentiment_score review_keywords top_review facebook instagram linkedin cms".split())} from leads where record_id is not null)
      select record_id, concat_ws(chr(10), 'Write a personalized outreach opening line for this business:', 'Name: ' || coalesce(business_name, 'N/A'), 'Category: ' || coalesce(category, 'N/A'), 'Location: ' || coalesce(city, '') || ', ' || coalesce(state, ''), 'Rating: ' || coalesce(rating, 'N/A'), 'Review count: ' || coalesce(review_count, 'N/A'),
      'Sentiment score: ' || nullif(sentiment_score, '0'), 'Common praise/topics in reviews: ' || review_keywords, 'Sample review: ' || substr(top_review, 1, 300), 'Active social platforms: ' || nullif(concat_ws(', ', case when facebook is not null then 'facebook' end, case when instagram is not null then 'instagram' end, case when linkedin is not null then 'linkedin' end), ''),
      'Website platform: ' || cms, 'The hook should acknowledge something specific about this business (its reputation, review themes, or niche) and pivot to a value offer. Return ONLY the hook text.') as prompt from d""",
    "lead_scores": """with d as (select distinct record_id, try_cast(rating as double) as r, try_cast(review_count as integer) as n, coalesce(try_cast(sentiment_score as double), 0) as s from leads where record_id is not null)
      select record_id, greatest(0, least(100, cast(round_even(case when r > 0 then least(40.0, r * 8) else 0.0 end + least(20.0, coalesce(n, 0) / 5) + greatest(0.0, (s + 1) / 2) * 25 + 6, 0) as integer))) as score from d""",
    "page_texts": rf"""with d as (select doc_id, text, lower(coalesce(text, '')) as low, trim(regexp_replace({_unescaped("regexp_replace(regexp_replace(text, '(?is)<script[^>]*>.*?</script\\s*>|<style[^>]*>.*?</style\\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g')", 1)}, '\s+', ' ', 'g')) as seen from documents)
      select doc_id, length(seen) as visible, contains(low, 'unusual traffic') or contains(low, 'captcharedirect') or contains(low, 'g-recaptcha') as challenge,
      contains(low, 'mailto:') or contains(low, 'contact') or contains(low, 'book') or contains(low, 'appointment') or contains(low, 'facebook.com') or contains(low, 'instagram.com') or contains(low, 'linkedin.com') as goal,
      coalesce(len(list_distinct(list_transform(regexp_extract_all(seen, '[A-Za-z0-9][^.!?]{{20,500}}[.!?]'), lambda x: trim(x)))), 0) as sentences, case when strlen(coalesce(text, '')) < 500 then 'JS_REQUIRED' end as reason from d""",
    "kept_review_texts": """with d as (select distinct _reviews as rs from listings where _reviews is not null), e as (select rs, generate_subscripts(rs, 1) as i, trim(unnest(rs)) as t from d), f as (select rs, t, min(i) as i from e where length(t) >= 25 group by 1, 2)
      select array_to_string(d.rs, '|') as reviews, coalesce((select string_agg(substr(t, 1, 60), '|' order by i) from f where f.rs = d.rs), '') as kept from d""",
    "waiting_queries": "select query from queries where status <> 'done' or status is null group by query",
    "undone_leads": "select distinct record_id, source_query from leads l where record_id is not null and not exists (select 1 from queries q where q.query = l.source_query and q.status = 'done')",
    "discovered_counts": "select source_query as query, count(*) as discovered, count(*) filter (stage = 'committed') as committed from records where source_query is not null group by 1",
    "event_counters": "select event_type as name, count(*) as value from events group by 1",
    "event_rates": """with d as (select epoch_us(ts) / 1e6 as a, epoch_us(ts) / 1e6 + floor(value) as b from events)
      select count(*) as rows, round(max(b) - min(a), 3) as seconds, round(count(*) / (max(b) - min(a)), 6) as rows_a_second, round(avg(b - a), 6) as mean_seconds, round(max(b - a), 3) as longest_seconds from d""",
    "with_website": f"select distinct record_id, website from leads where record_id is not null and {_present('website')} is not null",
    "in_areas": f"""with {_POINTS}, edges as (select area_id, ring[i] as p, ring[case when i = len(ring) then 1 else i + 1 end] as q from (select area_id, ring, unnest(generate_series(1, len(ring))) as i from areas)),
      crossings as (select id, area_id, count(*) as n from points join edges on (p.lat > lat) <> (q.lat > lat) and lon < (q.lon - p.lon) * (lat - p.lat) / (q.lat - p.lat) + p.lon group by all)
      select distinct record_id from leads where record_id is not null and (record_id not in (select id from points) or record_id in (select id from crossings where n % 2 = 1))""",
    "record_ids": f"""with d as (select distinct coalesce({_present("kgmid")}, {_present("place_id")}) as s, business_name, query, kgmid, place_id from listings), h as (select *, sha256(concat_ws(chr(31), s, business_name, query)) as h from d)
      select business_name, query, coalesce(replace(s, ':', '-') || ':' || substr(h, 1, 8), substr(h, 1, 32)) as id from h""",
    "committed_rows": "select record_id, committed_row, json_extract_string(raw_json, '$.business_name') as business_name, json_extract_string(raw_json, '$.city') as city from records where stage = 'committed'",
    "migrated_export": "select " + ", ".join("coalesce(record_id, 'N/A') as record_id" if c == "record_id" else f"coalesce(json_extract_string(raw_json, '$.{c}'), 'N/A') as {c}" for c in [*LEAD_COLUMNS, "signal_custom"]) + " from records where stage = 'committed'",
    "reconciled_export": "select distinct record_id, business_name, city from leads where record_id in (select record_id from records where stage = 'committed')",
    "numbered_export": "select record_id, row_number() over (order by record_id) - 1 as row_index from (select distinct record_id from leads where record_id is not null)",
    "mail_domains": rf"""with d as (select distinct record_id, {_present("website")} as w, regexp_replace(lower({_present("emails")}), '^[\s."''<>]+|[\s."''<>]+$', '', 'g') as e from leads where record_id is not null),
      r as (select distinct array_to_string(string_split({_URL_HOST}, '.')[-2:], '.') as domain from d where w is not null), f as (select record_id, case when regexp_full_match(e, '{web.EMAIL_TOKEN.replace("'", "''")}') then e end as e from d)
      select record_id, case when e is not null then case when domain is not null then 'PASS' else 'INCONCLUSIVE' end end as mx_status, case when e is not null then case when domain is not null then 'mx_records=1' else 'not_looked_up' end end as mx_reason, case when e is not null then 'Not Checked' end as smtp_status
      from f left join r on domain = split_part(e, '@', 2)""",
    "demo_rows": """select cast(i + 1 as integer) as _position, 'Sample Business ' || (i + 1) as business_name, 'phone:tel:+1 555 000 ' || (1000 + i) as phone, 'https://sample' || (i + 1) || '.example.com' as website, (100 + i) || ' Main St, Dallas, TX 75201, United States' as full_address,
      cast(round(4.5 + 0.1 * i, 1) as varchar) as rating, cast(40 + 10 * i as varchar) as review_count, '0x1' || i || '2:0x3' || i || '4' as place_id, '/g/' || (1000 + i) as kgmid, cast(i + 1 as integer) as n_reviews from range(3) t(i)""",
    "trial_rows": "select cast(i + 1 as integer) as _position, 1000 as _total, 'Bench Business ' || i as business_name, 'https://site' || i || '.example.org/' as website, '/g/bench' || i as kgmid from range(1000) t(i)",
    "phone_and_rating_listings": rf"""select distinct query, rating as raw, cast(review_count as varchar) as raw_count, try_cast(replace(nullif(regexp_extract(rating, '\b([1-5][.,]\d)\b', 1), ''), ',', '.') as double) as stars,
      try_cast(regexp_replace(coalesce(nullif(regexp_extract(rating, '\((\d[\d.,\s]*)\)', 1), ''), nullif(regexp_extract(rating, '(?i)(\d[\d.,]*)\s+reviews?', 1), '')), '[^0-9-]', '', 'g') as bigint) as reviews, upper({_present("country")}) as country from listings""",
    "identity_types": f"""with d as (select distinct record_id, {_present("place_id")} as place, {_present("website")} as w, {_present("phone")} as phone, {_PLAIN("business_name")} as name, lower({_PLAIN("city")}) as city, {_present("business_name")} as has_name from leads where record_id is not null),
      e as (select *, case when w is not null then array_to_string(string_split({_URL_HOST}, '.')[-2:], '.') end as domain, nullif(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '') as key from d),
      k as (select case when place is not null then 'place_id' when domain is not null then 'domain+city' when p.phone is not null then 'phone' when has_name is not null and key is not null then 'name+city' else 'none' end as key_type,
        case when place is not null then 'pid:' || trim(place) when domain is not null then 'dom:' || domain || '|city:' || coalesce(city, 'n/a') when p.phone is not null then 'ph:' || p.phone when has_name is not null and key is not null then 'name:' || key || '|city:' || coalesce(city, 'n/a') end as key from e join ({_PHONES_US}) p using (record_id))
      select key_type, count(*) as records, count(distinct key) as identities from k group by 1""",
    "email_verdicts": f"""with u as ({_unpacked("emails")}), s as (select distinct record_id, {_present("website")} as w from leads where record_id is not null),
      e as (select u.record_id, pos, regexp_replace(lower(item), '^[\\s."''<>]+|[\\s."''<>]+$', '', 'g') as x, case when w is not null then array_to_string(string_split({_URL_HOST}, '.')[-2:], '.') end as home from u join s using (record_id)),
      f as (select record_id, cast(pos as integer) as pos, home, case when regexp_full_match(x, '{web.EMAIL_TOKEN.replace("'", "''")}') and x not in {_MISSING} then x end as email from e), g as (select *, split_part(email, '@', 1) as local, split_part(email, '@', 2) as domain from f)
      select record_id, pos, email, case when email is null then 'invalid_syntax' when string_split(domain, '.')[-1] in {_in(web.ASSET_ENDINGS)} then 'asset_filename' when domain in {_in(web.DISPOSABLE_DOMAINS)} then 'disposable_domain'
      when {" or ".join(f"domain = '{v}' or domain like '%.{v}'" for v in web.VENDOR_DOMAINS)} then 'vendor_or_disposable_domain' when length(email) > 120 then 'too_long' when regexp_matches(local, '^(message|email|click|hire|reach|talk)[a-z0-9]{{2}}') then 'cta_glued_local_part'
      when home is not null and domain <> home and domain not in {_in(web.PERSONAL_PROVIDERS)} then 'off_domain' when home is not null and domain in {_in(web.PERSONAL_PROVIDERS)} and regexp_full_match(local, '(web|dev|seo|digital|design|media|marketing|agency)[a-z_.-]{{0,24}}[a-z0-9]{{0,6}}') then 'agency_freemail_local_part' else 'kept' end as verdict from g""",
}
