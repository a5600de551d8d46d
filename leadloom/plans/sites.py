"""From crawled pages to one row a website: emails, profiles, technologies and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom.functions import markup, text, web
from leadloom.schema import SOCIAL_COLUMNS



def page_emails(html: Column, site: Column) -> Column:
    """A page's usable addresses in order: mail links, then linked data, then its visible text without testimonials and comments."""
    linked = F.transform(F.filter(markup.attributes(html, "a", "href"), lambda h: F.lower(h).startswith("mailto:")), lambda h: web.normalize_email(F.regexp_replace(F.substring(h, F.lit(8), F.length(h)), r"\?.*$", "")))
    found = F.array_distinct(F.array_compact(F.concat(linked, web.emails_in(markup.linked_data(html)), web.emails_in(text.strip_tags(markup.without_voices(html))))))
    return F.filter(found, lambda e: web.email_rejection(e, site).isNull())


def page_profiles(html: Column) -> Column:
    """A struct of the first profile link of each platform."""
    urls = markup.links(html)
    return F.struct(*[F.get(F.transform(F.filter(urls, _on(p)), lambda u: web.normalize_url(u)), F.lit(0)).alias(p) for p in SOCIAL_COLUMNS])


def _on(platform: str):
    return lambda u: F.coalesce(web.platform_of(u) == platform, F.lit(False))


def site_rows(pages: DataFrame, early_stop: bool = False, max_pages: int | None = None) -> DataFrame:
    """A row a site from `pages` (site, page_order, html, status): what its pages have together, of the first `max_pages` where that is given.

    With early_stop the pages after the first at which both an address and a profile are known are left out.
    Emails are distinct in page order, a platform's profile is the first one, technologies and signals are
    those of any page. NULL html counts as empty; sites of NULL are left out. ssl tells whether the site's
    first page is served by https.
    """
    order = W.partitionBy("site").orderBy("page_order", "url")
    p = pages.where("site is not null").select("site", "page_order", "url", F.coalesce("html", F.lit("")).alias("html"), "status")
    p = p.withColumn("n", F.row_number().over(order))
    p = p if max_pages is None else p.where(F.col("n") <= max_pages)
    p = p.withColumn("emails", page_emails(F.col("html"), F.col("site"))).withColumn("profiles", page_profiles(F.col("html")))
    if early_stop:
        has = (F.size("emails") > 0).cast("int"), F.coalesce(*[F.col(f"profiles.{s}") for s in SOCIAL_COLUMNS]).isNotNull().cast("int")
        before = order.rowsBetween(W.unboundedPreceding, -1)
        p = p.withColumn("_e", F.coalesce(F.max(has[0]).over(before), F.lit(0))).withColumn("_s", F.coalesce(F.max(has[1]).over(before), F.lit(0))).where("_e = 0 or _s = 0")
    signals = markup.page_signals(F.col("html"))
    p = p.select("site", "n", "url", "status", "emails", "profiles", markup.technologies(F.col("html")).alias("tech"), signals.alias("signals"))
    names = [*markup.TAG_SOURCES, "booking_system", *[f"signal_{k}" for k in markup.KEYWORD_SIGNALS]]
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("n")))
    ordered = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c])))
    d = p.groupBy("site").agg(
        F.max("n").alias("pages"), ordered("emails").alias("emails"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tech")))).alias("tech_stack"), F.min_by("status", "n").alias("home_status"), F.min_by("url", "n").alias("home_url"),
        *[first(F.col(f"profiles.{s}")).alias(s) for s in SOCIAL_COLUMNS], *[text.yes_no(F.max(F.col(f"signals.{n}"))).alias(n) for n in names],
    )
    return d.withColumn("email_count", F.size("emails")).withColumn("cms", markup.cms_of(F.col("tech_stack"))).withColumn("ssl", F.lower("home_url").startswith("https://")).withColumn("website_status", web.website_status(web.status_reason(F.col("home_status"))))


def with_custom_signals(df: DataFrame, html_col: str, specs: dict[str, dict]) -> DataFrame:
    """`df` with a YES or NO column for each spec {column: {"keywords": [...], "match": "any" or "all"}}.

    A spec without keywords is NO; a column that `df` has already is refused.
    """
    clash = [c for c in specs if c in df.columns]
    if clash:
        raise ValueError(f"columns already: {clash}")
    blob = F.concat_ws(" ", F.lower(text.strip_tags(F.col(html_col))), F.lower(F.col(html_col)))
    return df.withColumns({c: text.yes_no(markup.keyword_signal(blob, s.get("keywords") or [], s.get("match", "any") == "all")) for c, s in specs.items()})
