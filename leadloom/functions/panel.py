"""What a listing's detail panel says, as column expressions. NULL means missing."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.places import listing_ids
from leadloom.functions.text import normalize_text, open_status, strip_tags
from leadloom.sources.tables import present

# Fixed values ------------------------------------------------------------------------------------------------

NAVIGATION_LINKS = ("google.com/maps/place/", "/maps/dir/", "google.com/maps/search/")
CHALLENGE_WORDS = ("unusual traffic", "captcharedirect", "g-recaptcha")
GOAL_WORDS = ("mailto:", "contact", "book", "appointment", "facebook.com", "instagram.com", "linkedin.com")
GENERIC_NAME_WORDS = "plumbing plumber plumbers heating cooling air conditioning electric electrical service services company the and repair repairs contractor contractors llc inc".split()
REVIEW_FIELDS = ("text", "comment", "review", "snippet")


def first_present(*candidates: Column) -> Column:
    """The first of several candidates that isn't missing, trimmed."""
    return F.coalesce(*[F.trim(present(c)) for c in candidates])


def hours_line(lines: Column) -> Column:
    """An array of lines of opening hours as one text; NULL without any."""
    return F.nullif(F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), "; "), F.lit(""))


def status_of_hours(hours: Column) -> Column:
    """Open where hours say it is so all day; hours of a day tell nothing about now."""
    return F.when(F.lower(hours).rlike(r"open\s*24\s*hours"), "Open")


def business_status(closed_for_good: Column, *lines: Column) -> Column:
    """Permanently closed where the panel says so, else what the first status line begins with."""
    return F.when(F.coalesce(closed_for_good, F.lit(False)), "Permanently closed").otherwise(open_status(first_present(*lines)))


def claimed_status(claim_link: Column) -> Column:
    """Unclaimed where the panel offers to claim the listing."""
    return F.when(F.coalesce(claim_link, F.lit(False)), "Unclaimed").otherwise("Claimed")


def plus_code(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def digits_to_intl(c: Column) -> Column:
    """A number that is written with + as its digits after +, else all digits after a +; NULL without digits."""
    plus = F.regexp_replace(F.regexp_extract(c, r"\+[\d\s().\-]+", 0), r"[^\d+]", "")
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(plus != "", plus).when(digits != "", F.concat(F.lit("+"), digits))


def panel_links(links: Column) -> Column:
    """Links that lead out of the listings' site."""
    return F.filter(links, lambda h: F.coalesce(h != "", F.lit(False)) & ~_holds(h, NAVIGATION_LINKS))


def _holds(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def names_compatible(a: Column, b: Column) -> Column:
    """Whether two names share a word of three letters or more that isn't a general one; a name without any is compatible with all."""
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*GENERIC_NAME_WORDS))
    x, y = words(a), words(b)
    return (F.size(x) == 0) | (F.size(y) == 0) | F.arrays_overlap(x, y)


def is_challenge(text: Column) -> Column:
    """Whether a page asks its visitor to prove to be human."""
    return F.coalesce(_holds(F.lower(text), CHALLENGE_WORDS), F.lit(False))


def goal_reached(text: Column) -> Column:
    """Whether a page already has what a crawl looks for."""
    return F.coalesce(_holds(F.lower(text), GOAL_WORDS), F.lit(False))


def with_region(url: Column, language: str, country: str) -> Column:
    """A URL whose language and country parameters are replaced."""
    bare = F.regexp_replace(url, r"(?i)([&?])(?:hl|gl)=[^&]*", "")
    return F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit(f"hl={language}&gl={country}"))


def with_url_identity(df, url: str):
    """`df` with latitude, longitude, place_id, cid, kgmid and business_name filled from its listing URL where they are missing."""
    ids = listing_ids(F.col(url))
    slug = normalize_text(F.coalesce(F.try_url_decode(ids["place_name"]), F.replace(ids["place_name"], F.lit("+"), F.lit(" "))))
    for name, value in {**{c: ids[c] for c in ("latitude", "longitude", "place_id", "cid", "kgmid")}, "business_name": slug}.items():
        now = F.col(name) if name in df.columns else F.lit(None).cast("string")
        kept = now if dict(df.dtypes).get(name) == "double" else present(now.cast("string"))
        df = df.withColumn(name, F.coalesce(kept, value.cast("double" if dict(df.dtypes).get(name) == "double" else "string")))
    return df


def sentences(html: Column) -> Column:
    """The distinct sentences of 22 to 502 characters in a page's visible text: reviews, where no better source is."""
    return F.array_distinct(F.transform(F.regexp_extract_all(strip_tags(html), F.lit(r"([A-Za-z0-9][^.!?]{20,500}[.!?])"), F.lit(1)), lambda s: F.trim(s)))


def _longest(entry) -> str:
    """The longest text of two words or more in nested lists; in an object only a review's own fields count."""
    best = ""
    stack = [entry]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += reversed(x)
            continue
        own = [x[k] for k in REVIEW_FIELDS if isinstance(x.get(k), str)] if isinstance(x, dict) else [x] if isinstance(x, str) and len(x.split()) > 1 and any(c.isalpha() for c in x) else []
        for text in own:
            best = text if len(text) > max(3, len(best)) else best
    return best


def nested_reviews(response: str | None) -> tuple[list[str], str | None]:
    """Texts of reviews and the next page's token in a response of nested lists, whose guard before the first bracket goes."""
    text = response or ""
    at = text.find("\n") + 1 if text.startswith(")]}'") else 0
    try:
        doc = json.loads(text[at:] if at else text.removeprefix(")]}'"))
    except ValueError:
        return [], None
    if not isinstance(doc, list) or len(doc) < 2:
        return [], None
    token = doc[2] if len(doc) > 2 else None
    token = token[0] if isinstance(token, list) and token else token
    return [t for e in (doc[1] if isinstance(doc[1], list) else []) if (t := _longest(e))], str(token) if token else None


def nested_reviews_struct(c: Column) -> Column:
    """nested_reviews() of a column."""

    @F.pandas_udf("struct<reviews: array<string>, token: string>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([nested_reviews(t) for t in texts], columns=["reviews", "token"])

    return parse(c.cast("string"))
