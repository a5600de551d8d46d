import pytest
from pyspark.sql import functions as F

from leadloom.functions import markup, outreach, panel, web
from leadloom.functions import reviews as r


def _map(spark, fn, values, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [x["o"] for x in d.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_panel_texts(spark):
    assert _map(spark, panel.digits_to_intl, ["tel:+1 (555) 000-1234", "555 000", "none", None]) == ["+15550001234", "+555000", None, None]
    assert _map(spark, panel.status_of_hours, ["Mon: Open 24  hours", "8 AM to 5 PM", None]) == ["Open", None, None]
    assert _map(spark, panel.plus_code, [" 64RA+M8  Dallas ", "", None]) == ["64RA+M8 Dallas", None, None]
    assert _map(spark, lambda c: panel.with_region(c, "en", "us"), ["https://m.example/x?hl=de&q=1", "https://m.example/x"]) == ["https://m.example/x&q=1?hl=en&gl=us", "https://m.example/x?hl=en&gl=us"]
    assert _map(spark, lambda c: panel.names_compatible(c, F.lit("Acme Plumbing")), ["ACME Heating", "Zed Plumbing", "Plumbing LLC", None]) == [True, False, True, True]
    assert _map(spark, panel.hours_line, [["Mon 9", " ", "Tue 8 "], [], None], "array<string>") == ["Mon 9; Tue 8", None, None]
    assert _map(spark, lambda c: panel.business_status(F.lit(False), F.lit("N/A"), c), ["Opens at 9 · x", "Closed · 9", "Busy · now", None]) == ["Open", "Closed", "Busy", None]
    assert _map(spark, panel.panel_links, [["https://x.example", "https://google.com/maps/place/1", ""], None], "array<string>") == [["https://x.example"], None]
    assert _map(spark, panel.is_challenge, ["Our systems have detected Unusual Traffic", "ok", None]) == [True, False, False]
    assert _map(spark, panel.goal_reached, ["Book now", "ok", None]) == [True, False, False]
    assert _map(spark, panel.sentences, ["<p>They came on time and fixed the tap. Short one.</p>", None]) == [["They came on time and fixed the tap."], None]


def test_nested_reviews(spark):
    text = ')]}\'\n[null, [["a", ["great service by all", 3]], {"text": "fine work"}, ["x"]], ["tok"]]'
    got = _map(spark, panel.nested_reviews_struct, [text, "no json", None, "[1]"])
    assert [(x["reviews"], x["token"]) for x in got] == [(["great service by all", "fine work"], "tok"), ([], None), ([], None), ([], None)]


def test_url_identity(spark):
    d = spark.createDataFrame([("N/A", None, "https://m.example/maps/place/Acme+Co/@1,2,17z/data=!1s0x8:0x9!3d29.5!4d-95.5"), ("Zed", 1.0, None)], "business_name string, latitude double, url string")
    a, b = panel.with_url_identity(d, "url").collect()
    assert (a["business_name"], a["latitude"], a["place_id"]) == ("Acme Co", 29.5, "0x8:0x9") and (b["business_name"], b["latitude"], b["place_id"]) == ("Zed", 1.0, None)


def test_platforms(spark):
    good = {"https://facebook.com/acme.co": "facebook", "https://m.facebook.com/pages/acme": "facebook", "https://instagram.com/acme/tagged": "instagram", "https://linkedin.com/company/acme": "linkedin", "https://youtube.com/@acme": "youtube", "https://youtube.com/c/acme": "youtube", "https://x.com/acme": "twitter_x", "https://tiktok.com/@acme": "tiktok", "https://github.com/acme": "github", "https://snapchat.com/add/acme": "snapchat", "https://pinterest.com/acme/": "pinterest"}
    bad = ["https://facebook.com/sharer.php", "https://instagram.com/p/abc", "https://linkedin.com/acme", "https://youtube.com/watch", "https://x.com/a_name_that_is_too_long", "https://x.com/i/status", "https://tiktok.com/acme", "https://facebook.com/", "https://notfacebook.com/acme", "https://snapchat.com/acme", None]
    assert _map(spark, web.platform_of, list(good)) == list(good.values()) and _map(spark, web.platform_of, bad) == [None] * len(bad)


def test_hooks_and_prompts(spark):
    d = spark.createDataFrame([(1, "Acme", "Plumber", "4.5", "12", ["halo"], 0.5), (2, None, "Plumber", "N/A", "x", ["got"], -0.5), (3, "Zed", None, None, None, None, 0.0)], "i int, n string, c string, r string, k string, t array<string>, s double")
    got = [x["h"] for x in d.select("i", outreach.pitch_hook(*[F.col(c) for c in "ncrkts"]).alias("h")).orderBy("i").collect()]
    assert got[0] == "I noticed Acme has 12 reviews and a 4.5 rating with customers consistently praising halo."
    assert got[1] == "I noticed your business has 0 reviews but some recent reviews mention plumber — a quick fix could lift that."
    assert got[2] == "I noticed Zed has 0 reviews — and I'd love to help you turn that into more qualified leads."
    text = d.where("i = 1").select(outreach.prompt_text({"business_name": F.col("n"), "rating": F.col("r"), "facebook": F.lit("https://f")}).alias("p")).first()["p"]
    assert "Name: Acme\nCategory: N/A\nLocation: , \nRating: 4.5" in text and "Active social platforms: facebook" in text and "Sample review" not in text
    assert _map(spark, outreach.answer_text, ['{"choices":[{"message":{"content":" \\"Hi\\nyou\\" "}}]}', "{}", None]) == ["Hi you", None, None]


def test_pages_markup(spark):
    html = '<a href="/about">a</a><a href="team.html">t</a><a href="mailto:x@y.z">m</a><a href="//cdn.example/x">c</a><a href="https://o.example/">o</a>'
    assert _map(spark, lambda c: markup.absolute_links(c, F.lit("https://acme.example/en/index.html")), [html, "", None]) == [["https://acme.example/about", "https://acme.example/en/team.html", "https://cdn.example/x", "https://o.example/"], [], None]
    xml = "<urlset><url><loc> https://a.example/x </loc></url><url><loc>https://a.example/contact</loc></url><url><loc>ftp://no</loc></url></urlset>"
    assert _map(spark, markup.sitemap_links, [xml]) == [["https://a.example/x", "https://a.example/contact"]] and _map(spark, lambda c: markup.sitemap_links(c, "zzz"), [xml]) == [["https://a.example/contact"]]
    voices = '<div>a</div><div class="x review-body">bad <div>in</div> b</div><!-- c@d.example --><p>end</p>'
    assert "bad" not in _map(spark, markup.without_voices, [voices])[0] and "end" in _map(spark, markup.without_voices, [voices])[0] and "c@d" not in _map(spark, markup.without_voices, [voices])[0]
    assert _map(spark, lambda c: markup.technologies(c, F.create_map(F.lit("CF-Ray"), F.lit("1"))), ["<p>"]) == [["Cloudflare"]]
    got = _map(spark, markup.classes_of, [["WordPress", "Google Tag Manager", "GA4"]], "array<string>")[0]
    assert (got["cms"], got["gtm"], got["ga4"], got["analytics"]) == ("WordPress", "detected", "detected", None)
    assert _map(spark, lambda c: markup.page_reason(F.lit(200), c), ["x", "y" * 500, None]) == ["JS_REQUIRED", None, "JS_REQUIRED"]
    e = _map(spark, lambda c: markup.signal_evidence(c, ["emergency"], [r"24\s*/\s*7"]), ["open 24/7", "emergency", "none", None])
    assert [(x["found"], x["evidence"]) for x in e] == [(True, r"re:24\s*/\s*7"), (True, "emergency"), (False, None), (False, None)]
    assert _map(spark, lambda c: markup.tag_signal(c, "gtm"), ['<script src="https://www.googletagmanager.com/gtm.js?id=1">', "GTM-ABC1234", "gtm"]) == [True, True, False]
    assert r.NO_TOPICS and pytest
