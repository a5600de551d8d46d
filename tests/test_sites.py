import pytest

from leadloom.plans import sites

HOME = '<a href="mailto:Jo@Acme.com?subject=x">m</a><a href="https://facebook.com/acme">f</a><link href="/wp-content/x.css"><p>We are licensed.</p>'


def _pages(spark):
    rows = [
        ("https://acme.com", 0, "https://acme.com", HOME, 200),
        ("https://acme.com", 1, "https://acme.com/contact", '<p>info@acme.com or info@other.com</p><a href="https://facebook.com/other">f</a><a href="https://x.com/acme">x</a>', 200),
        ("http://gone.com", 0, "http://gone.com", None, 404),
        (None, 0, "http://x.com", HOME, 200),
    ]
    return spark.createDataFrame(rows, "site string, page_order int, url string, html string, status int")


def test_site_rows(spark):
    rows = {r["site"]: r for r in sites.site_rows(_pages(spark)).collect()}
    acme, gone = rows["https://acme.com"], rows["http://gone.com"]
    assert acme["emails"] == ["jo@acme.com", "info@acme.com"] and acme["email_count"] == 2 and acme["pages"] == 2
    assert acme["facebook"] == "https://facebook.com/acme" and acme["twitter_x"] == "https://x.com/acme" and acme["cms"] == "WordPress"
    assert acme["signal_licensed_insured"] == "YES" and acme["gtm"] == "NO" and acme["ssl"] and acme["website_status"] == "LIVE"
    assert gone["website_status"] == "DEAD" and gone["emails"] == [] and not gone["ssl"] and len(rows) == 2
    early = {r["site"]: r for r in sites.site_rows(_pages(spark), early_stop=True).collect()}
    assert early["https://acme.com"]["emails"] == ["jo@acme.com"] and early["https://acme.com"]["twitter_x"] is None
    assert sites.site_rows(_pages(spark).where("false")).collect() == []


def test_custom_signals(spark):
    d = spark.createDataFrame([("<p>Emergency repair, open late</p>",), (None,)], "html string")
    specs = {"s_any": {"keywords": ["emergency", "x y"]}, "s_all": {"keywords": ["emergency", "open late"], "match": "all"}, "s_none": {"keywords": []}}
    assert [tuple(r) for r in sites.with_custom_signals(d, "html", specs).select("s_any", "s_all", "s_none").collect()] == [("YES", "YES", "NO"), ("NO", "NO", "NO")]
    with pytest.raises(ValueError):
        sites.with_custom_signals(d, "html", {"html": {}})
