import pytest
from pyspark.sql import functions as F

from leadloom.functions import markup, reviews, text, web


def _map(spark, fn, values, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in d.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_urls(spark):
    cases = {"https://Example.com/Path/": "https://example.com/Path", "WWW.Example.COM": "https://example.com", "https://a.com/?utm_source=x&keep=1": "https://a.com?keep=1", "http://a.com:80//x//y/": "http://a.com/x/y", "http://a.com:8080/x#f": "http://a.com:8080/x", "https://www.google.com/url?url=https%3A%2F%2Fb.com%2Fq": "https://b.com/q", "mailto:a@b.com": None, "tel:+1": None, "": None, "N/A": None, None: None, "host:80": None}
    assert _map(spark, web.normalize_url, list(cases)) == list(cases.values())


def test_domains(spark):
    cases = {"https://www.example.co.uk/a": "example.co.uk", "http://sub.example.com": "example.com", "http://1.1.1.1/x": "1.1.1.1", "https://me.github.io": "me.github.io", None: None}
    assert _map(spark, web.domain_of, list(cases)) == list(cases.values())


def test_phones(spark):
    cases = [("+1 (555) 000-1234", "US", "+15550001234"), ("555-000-1234", "US", "+15550001234"), ("020 7183 8750", "GB", "+442071838750"), ("0044 20 7183 8750", "US", "+442071838750"), ("(555) 123-4567 ext 890 call anytime", "US", "+15551234567 x890"), ("phone:tel:+1 555 000 1000", None, "+15550001000"), ("555-123-4567 #22", "US", "+15551234567 x22"), ("call us", "US", None), (None, "US", None), ("123", "US", None)]
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p string, c string, e string")
    for r in d.select("i", web.normalize_phone(F.col("p"), F.col("c")).alias("o"), "e").collect():
        assert r["o"] == r["e"], cases[r["i"]]


def test_emails(spark):
    assert _map(spark, web.normalize_email, ["Foo@Bar.COM", "bad", "", None]) == ["foo@bar.com", None, None, None]
    assert _map(spark, web.emails_in, ["x a@b.co, A@b.co or c [at] d [dot] org.", "none"]) == [["a@b.co", "c@d.org"], []]
    cases = [("john@acme.com", "https://acme.com", None), ("x@example.com", None, "disposable_domain"), ("logo@2x.png", None, "asset_filename"), ("info@other.com", "https://acme.com", "off_domain"), ("messagehpd@acme.com", "https://acme.com", "cta_glued_local_part"), ("websolid2020@gmail.com", "https://acme.com", "agency_freemail_local_part"), ("x@o1.sentry.io", None, "vendor_or_disposable_domain"), ("bad", None, "invalid_syntax")]
    d = spark.createDataFrame(cases, "e string, s string, w string")
    assert all(r["o"] == r["w"] for r in d.select(web.email_rejection(F.col("e"), F.col("s")).alias("o"), "w").collect())


def test_social(spark):
    cases = {"https://facebook.com/acme": "facebook", "https://www.facebook.com/sharer/x": None, "https://instagram.com/a/p/xyz": None, "https://instagram.com/acme/": "instagram", "https://x.com/acme": "twitter_x", "https://t.co/abc": None, "https://acme.com": None, "https://tiktok.com/@a": "tiktok"}
    assert _map(spark, web.platform_of, list(cases)) == list(cases.values())


def test_text(spark):
    assert _map(spark, text.normalize_text, ["A &amp; <b>c</b>​\x00  d", " \n ", None]) == ["A & c d", None, None]
    assert _map(spark, text.tokens, ["It's great, A 24/7 shop", None]) == [["it", "great", "24", "shop"], []]
    assert _map(spark, text.to_int, ["1,200", "4.5", "x", None]) == [1200, 45, None, None]
    assert _map(spark, text.rating_of, ["4.8 (365)", "4,8 (365)", "none"]) == [4.8, 4.8, None]
    assert _map(spark, text.review_count_of, ["4.8 (365)", "4.5 · 120 reviews", "x"]) == [365, 120, None]
    assert _map(spark, text.query_keyword, ["law firm in Dallas, TX", "gym"]) == ["law firm", "gym"]
    assert _map(spark, text.open_status, ["Open now", "Closed · opens 9", "Moved · x", ""]) == ["Open", "Closed", "Moved", None]
    assert _map(spark, text.strip_tags, ["<p>a&nbsp;b</p><script>x()</script>c"]) == ["a b c"]


def test_reviews(spark):
    d = spark.createDataFrame([(["great work", "terrible and rude, but great"], 4.8, 200), ([], 0.0, 0)], "t array<string>, r double, n int")
    s = reviews.sentiment(F.col("t"))
    rows = d.select(s.alias("s"), reviews.top_review(F.col("t")).alias("top"), reviews.lead_score(F.col("r"), F.col("n"), s, F.lit(0)).alias("score")).collect()
    assert rows[0]["s"] == pytest.approx(0.333) and rows[0]["top"] == "great work"
    assert rows[1]["s"] == 0.0 and rows[1]["top"] is None and rows[1]["score"] == 12
    assert _map(spark, reviews.top_keywords, [["halo plumbing fixed it", "plumbing by halo, months ago"]], "array<string>") == [["halo", "plumbing"]]
    assert _map(spark, lambda c: reviews.kept_reviews(c, 5, 8), [["ok", " good work here ", "good work here"]], "array<string>") == [["good wor"]]


def test_markup(spark):
    html = '<a href="https://a.com/contact">c</a><a href="/x">x</a><a href="https://a.com/z">z</a><script async src="https://www.googletagmanager.com/gtm.js?id=1"></script><link rel="x" href="/wp-content/a.css"><p>Fully licensed, not unlicensed</p>'
    r = spark.createDataFrame([(html,)], "h string").select(markup.links(F.col("h")).alias("l"), markup.technologies(F.col("h")).alias("t"), markup.page_signals(F.col("h")).alias("s"), markup.crawl_order(markup.links(F.col("h")), F.lit("a.com"), 5).alias("c")).first()
    assert r["l"] == ["https://a.com/contact", "https://a.com/z"] and r["c"] == r["l"]
    assert r["t"] == ["WordPress", "Google Tag Manager"]
    assert r["s"]["gtm"] and r["s"]["signal_licensed_insured"] and not r["s"]["meta_pixel"] and not r["s"]["booking_system"]
