"""Links, scripts, technologies and signals in pages' markup as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import strip_tags, unescape

# Fixed values ------------------------------------------------------------------------------------------------

TECHNOLOGIES = {
    "WordPress": "wp-content|wp-includes|wp-json", "Shopify": r"cdn\.shopify\.com|myshopify\.com", "Wix": r"static\.wixstatic\.com|wix\.com/", "Squarespace": r"squarespace\.com", "Webflow": r"webflow\.com|webflow\.js", "Elementor": "elementor",
    "Google Tag Manager": r"googletagmanager\.com", "Google Analytics": r"google-analytics\.com", "React": r"react(?:\.min)?\.js|__REACT_DEVTOOLS", "Vue.js": r"vue(?:\.min)?\.js|__VUE__", "Angular": r"angular(?:\.min)?\.js|ng-version", "Next.js": "__NEXT_DATA__|/_next/static",
    "Bootstrap": r"bootstrap(?:\.min)?\.css|bootstrap(?:\.min)?\.js", "jQuery": r"jquery(?:\.min)?\.js", "Google Fonts": r"fonts\.googleapis\.com", "Font Awesome": "font-awesome|fontawesome", "Stripe": r"js\.stripe\.com", "PayPal": r"paypal\.com|paypalobjects\.com", "HubSpot": r"js\.hs-scripts\.com",
    "Tawk.to": r"tawk\.to", "Intercom": "intercom", "Calendly": r"calendly\.com", "Acuity Scheduling": r"acuityscheduling\.com", "WooCommerce": "woocommerce", "BigCommerce": "bigcommerce", "Magento": "magento", "Django": "csrftoken", "Ruby on Rails": "csrf-param",
}
#: Names of response headers that tell a technology.
HEADER_TECHNOLOGIES = {"cf-ray": "Cloudflare"}
#: Classes of elements that hold what others say.
VOICES = "testimonial testimonials review reviews review-body comment comments wp-block-comment".split()
CMS = "WordPress Shopify Wix Squarespace Webflow Joomla Drupal Magento BigCommerce WooCommerce".split()
KEYWORD_SIGNALS = {
    "pricing": ("pricing", "price per", "starting at", "rate card", "quote online"),
    "financing": ("financing", "payment plan", "0% interest", "monthly installments"),
    "licensed_insured": ("licensed", "insured", "bonded", "certified"),
    "established": ("family owned", "established in", "since 19", "since 20", "years of experience"),
    "portfolio": ("portfolio", "case study", "our work", "projects", "gallery"),
    "mobile_service": ("mobile service", "we come to you", "on-site", "house calls"),
    "membership": ("membership", "subscribe", "join our", "loyalty program"),
}
CRAWL_HINTS = "contact about services team staff our-story about-us contact-us get-in-touch pricing booking".split()
BOOKING_HOSTS = "calendly.com acuityscheduling.com booksy.com mindbodyonline.com vagaro.com fresha.com setmore.com appointy.com youcanbook.me simplybook.me schedulicity.com".split()
#: What the script sources of each tag hold, and patterns of its calls and ids in the markup itself.
TAG_SOURCES = {
    "meta_pixel": ("connect.facebook.net", "facebook.com/tr", "fbq("),
    "ga4": ("googletagmanager.com/gtag/js", "google-analytics.com/analytics.js", "google-analytics.com/ga.js"),
    "gtm": ("googletagmanager.com/gtm.js",),
    "chat_widget": ("tawk.to", "intercom", "drift", "livechatinc", "zopim", "crisp.chat", "freshchat", "hubspot.com/forms"),
    "analytics": ("google-analytics.com/analytics.js", "google-analytics.com/ga.js", "segment.com/analytics", "static.hotjar.com", "clarity.ms/tag"),
    "advertising": ("doubleclick.net", "adsbygoogle.js", "connect.facebook.net"),
}
TAG_CALLS = {
    "meta_pixel": (r"(?i)fbq\(",),
    "ga4": (r"gtag\(\s*['\"]config['\"]", r"G-[A-Z0-9]{8,10}\b"),
    "gtm": (r"GTM-[A-Z0-9]{6,}\b",),
    "analytics": (r"mixpanel\.init\(", "matomo", r"_paq\.push"),
    "advertising": (r"fbq\(\s*['\"]init['\"]", r"adsbygoogle\s*=", r"googlesyndication\.com", r"doubleclick\.net"),
}


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


def attributes(html: Column, tag: str, name: str) -> Column:
    """Values of an attribute of all tags of a name, in order, references resolved."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*?\s{name}\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.transform(found, lambda x: unescape(F.trim(x)))


def links(html: Column) -> Column:
    """The absolute http links of a page, each once, in order."""
    return F.array_distinct(F.filter(attributes(html, "a", "href"), lambda x: x.rlike("(?i)^https?://")))


def absolute_links(html: Column, base: Column) -> Column:
    """The http links of a page, each once, in order, relative ones completed by the page's URL."""
    site, folder = F.regexp_extract(base, r"(?i)^(https?://[^/?#]*)", 1), F.regexp_extract(base, r"(?i)^(https?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(site, F.lit("/")))

    def whole(x: Column) -> Column:
        joined = F.concat(folder, F.regexp_replace(x, r"^\./", ""))
        return F.when(x.rlike("(?i)^https?://"), x).when(x.startswith("//"), F.concat(F.regexp_extract(base, "(?i)^(https?:)", 1), x)).when(x.startswith("/"), F.concat(site, x)).when(~x.rlike(r"^(?:#|\?|[A-Za-z][A-Za-z0-9+.\-]*:)") & (x != ""), F.regexp_replace(joined, r"[^/]+/\.\./", ""))

    return F.array_distinct(F.array_compact(F.transform(attributes(html, "a", "href"), whole)))


def sitemap_links(xml: Column, keyword: str = "", most: int = 15) -> Column:
    """The http links of a site map, those with the keyword or a crawl hint where there are any, at most so many."""
    urls = F.filter(F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc\b[^>]*>(.*?)</loc>"), F.lit(1)), lambda u: unescape(F.trim(u))), lambda u: u.rlike("^https?://"))
    if keyword:
        wanted = F.filter(urls, lambda u: F.lower(u).rlike("|".join([rf"\Q{keyword.lower()}\E", *CRAWL_HINTS])))
        urls = F.when(F.size(wanted) > 0, wanted).otherwise(urls)
    return F.slice(urls, 1, most)


def linked_data(html: Column) -> Column:
    """The contents of a page's blocks of linked data."""
    return F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1)), "\n")


def without_voices(html: Column) -> Column:
    """A page without comments, captions of figures and elements that hold testimonials, reviews or visitors' comments.

    An element goes with what is in it up to its first closing tag; one level of the same tag within is allowed for.
    """
    h = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    h = F.regexp_replace(h, r"(?is)<figcaption\b[^>]*>.*?</figcaption\s*>", " ")
    named = "|".join(VOICES)
    return F.regexp_replace(h, rf"(?is)<(\w+)\b[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?(?:{named})(?:\s[^\"']*)?[\"'][^>]*>(?:(?!</?\1\b).)*(?:<\1\b[^>]*>(?:(?!</?\1\b).)*</\1\s*>(?:(?!</?\1\b).)*)*</\1\s*>", " ")


def scripts(html: Column) -> Column:
    return attributes(html, "script", "src")


def crawl_order(urls: Column, host: Column, most: int) -> Column:
    """Links of the same host by the first hint that they hold, at most so many, in stable order."""

    def rank(u: Column) -> Column:
        out = F.lit(len(CRAWL_HINTS))
        for i, hint in reversed(list(enumerate(CRAWL_HINTS))):
            out = F.when(F.lower(u).contains(hint), F.lit(i)).otherwise(out)
        return out

    same = F.filter(F.array_distinct(urls), lambda u: F.lower(F.regexp_extract(u, r"(?i)^https?://([^/?#]*)", 1)) == F.lower(host))
    ranked = F.array_sort(F.transform(same, lambda u, i: F.struct(rank(u).alias("r"), i.alias("i"), u.alias("u"))))
    return F.slice(F.transform(ranked, lambda x: x["u"]), 1, most)


def has_keyword(text: Column, keyword: str) -> Column:
    """A phrase anywhere, a single word as a whole word; `text` is in lower case."""
    k = keyword.strip().lower()
    return F.lit(False) if not k else text.contains(k) if " " in k else text.rlike(r"(?U)\b\Q" + k + r"\E\b")


def keyword_signal(text: Column, keywords, every: bool = False) -> Column:
    """Whether any, or every, keyword is in the lower-case text."""
    tests = [F.coalesce(has_keyword(text, k), F.lit(False)) for k in keywords]
    out = F.lit(bool(every and tests))
    for t in tests:
        out = out & t if every else out | t
    return out


def tag_signal(html: Column, name: str) -> Column:
    """Whether a tag's script is loaded or called in a page."""
    return _any([F.exists(scripts(html), lambda s: _any([F.lower(s).contains(x) for x in TAG_SOURCES[name]])), *[html.rlike(x) for x in TAG_CALLS.get(name, ())]])


def technologies(html: Column, headers: Column | None = None) -> Column:
    """Names of the technologies whose marks are in script sources, link targets, meta contents or names of headers, a map."""
    marks = F.array_join(F.concat(scripts(html), attributes(html, "link", "href"), attributes(html, "meta", "content")), "\n")
    found = [F.when(marks.rlike("(?i)" + p), F.lit(n)) for n, p in TECHNOLOGIES.items()]
    if headers is not None:
        names = F.transform(F.map_keys(headers), lambda k: F.lower(k))
        found += [F.when(F.array_contains(names, h), F.lit(n)) for h, n in HEADER_TECHNOLOGIES.items()]
    return F.array_compact(F.array(*found))


def classes_of(found: Column) -> Column:
    """A struct of the classes that an array of technologies supports: cms, analytics, tag manager, gtm, ga4 and meta pixel."""
    low = F.transform(found, lambda x: F.lower(x))
    has = lambda *names: F.arrays_overlap(low, F.array(*[F.lit(n.lower()) for n in names]))
    return F.struct(
        cms_of(found).alias("cms"), F.when(has("Google Analytics", "Google Analytics 4"), "Google Analytics").alias("analytics"), F.when(has("Google Tag Manager"), "Google Tag Manager").alias("tag_manager"),
        F.when(has("Google Tag Manager"), "detected").alias("gtm"), F.when(has("Google Analytics 4", "GA4"), "detected").alias("ga4"), F.when(has("Meta Pixel"), "detected").alias("meta_pixel"),
    )


def page_reason(status: Column, html: Column) -> Column:
    """Why a page can't be read by itself: JS_REQUIRED where a good answer has fewer than 500 bytes."""
    return F.when((status == 200) & (F.octet_length(F.coalesce(html, F.lit(""))) < 500), "JS_REQUIRED")


def signal_evidence(text: Column, keywords=(), patterns=(), every: bool = False) -> Column:
    """A struct (found, evidence) of keywords and patterns in a lower-case text: whether any, or every one, is there, and the first that is."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(has_keyword(text, k), F.lit(False)), F.lit(k)) for k in keywords], *[F.when(F.coalesce(text.rlike("(?i)" + p), F.lit(False)), F.lit("re:" + p)) for p in patterns]))
    n = len(keywords) + len(patterns)
    hits = hits if n else F.array().cast("array<string>")
    return F.struct(((F.size(hits) == n) & F.lit(n > 0) if every else F.size(hits) > 0).alias("found"), F.get(hits, F.lit(0)).alias("evidence"))


def cms_of(found: Column) -> Column:
    return F.coalesce(*[F.when(F.array_contains(found, c), F.lit(c)) for c in CMS])


def page_signals(html: Column) -> Column:
    """A struct of YES or NO for each tag, booking and keyword signal of a page."""
    blob = F.concat_ws(" ", F.lower(strip_tags(html)), F.lower(html))
    flags = [tag_signal(html, n).alias(n) for n in TAG_SOURCES] + [_any([F.lower(html).contains(h + "/") for h in BOOKING_HOSTS]).alias("booking_system")]
    flags += [keyword_signal(blob, ks).alias(f"signal_{n}") for n, ks in KEYWORD_SIGNALS.items()]
    return F.struct(*flags)
