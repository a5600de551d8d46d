"""Text, number and status functions of listings as column expressions. NULL means missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ------------------------------------------------------------------------------------------------

#: Marks of formatting that carry no text; joiners of letters stay.
FORMATTING_NOISE = "﻿​­؜᠎‎‏‪‫‬‭‮⁠⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯"
STOPWORDS = (
    "the a an and or but if of to in on for with at by from is are was were be been this that these those it its as so we you they he she i my their our your his her "
    "not no has have had do does did will would can could should about over into me us them am very really just also out up down there here when what which who whom why how all "
    "any each more most some such only own same than too then now s t don ve ll re"
).split()
#: The traces of the review panel in a review's text.
REVIEW_NOISE = (
    r"(?i)\b\d+\s+reviews?\b|\b\d+\s+photos?\b|\b\d+\s+(?:months?|weeks?|days?|years?|hours?)\s+ago\b|\b(?:a|an)\s+(?:month|week|day|year|hour)\s+ago\b"
    r"|\bLocal Guide\b|\bEdited\b|\bMore\b|\bLike\b(?:\s+\d+)?\b|\bShare\b|\s·\s|\s•\s"
)
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&#x27;": "'", "&#x2F;": "/", "&amp;": "&"}


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unescape(c: Column, rounds: int = 1) -> Column:
    """The common character references of markup resolved, up to so many times."""
    for _ in range(rounds):
        for entity, char in _ENTITIES.items():
            c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def normalize_text(c: Column) -> Column:
    """Plain text in one line: references resolved twice at most, tags and control characters gone, spaces collapsed; NULL if nothing is left."""
    t = unescape(c.cast("string"), 2)
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    t = F.regexp_replace(t, r"[\p{Z}\t\r\n]", " ")
    t = F.regexp_replace(F.translate(t, FORMATTING_NOISE + "�", ""), r"\p{Cc}", "")
    return F.nullif(F.trim(F.regexp_replace(t, " +", " ")), F.lit(""))


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, longer than one character."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) > 1)


def to_int(c: Column) -> Column:
    """The digits of a text as a whole number, with its sign; all else is dropped, also a decimal point."""
    return F.regexp_replace(c.cast("string"), "[^0-9-]", "").try_cast("long")


def to_float(c: Column) -> Column:
    """The digits of a text as a number with a decimal point; commas are dropped."""
    return F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def strip_tags(c: Column) -> Column:
    """Visible text of simple markup."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(t, r"<[^>]+>", " ")), r"\s+", " "))


def clean_review(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, REVIEW_NOISE, " "), r"\s+", " "))


def name_key(c: Column) -> Column:
    """Letters and digits of any script in lower case."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), F.lit(""))


def query_keyword(c: Column) -> Column:
    """What a query asks for: its text before the first in or near."""
    return F.trim(F.get(F.split(c, r"(?i)\s+(?:in|near)\s+", 2), F.lit(0)))


def query_location(c: Column) -> Column:
    """Where a query asks for it; "" without in or near."""
    return F.coalesce(F.trim(F.get(F.split(c, r"(?i)\s+(?:in|near)\s+", 2), F.lit(1))), F.lit(""))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "YES").otherwise("NO")


def open_status(c: Column) -> Column:
    """Open or Closed from a line of opening hours: what it begins with, else its text before the middle dot."""
    t = F.lower(F.trim(c))
    head = F.trim(F.get(F.split(c, "·"), F.lit(0)))
    return F.when(t.startswith("open"), "Open").when(t.startswith("close"), "Closed").otherwise(F.nullif(head, F.lit("")))


def upload_label(c: Column) -> Column:
    """The second part of a photo's label."""
    return F.nullif(F.trim(F.get(F.split(c, "·"), F.lit(1))), F.lit(""))


def rating_of(c: Column) -> Column:
    """A rating from 1 to 5 with one decimal in a panel's text."""
    return F.replace(F.nullif(F.regexp_extract(c, r"\b([1-5][.,]\d)\b", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def review_count_of(c: Column) -> Column:
    """The count of reviews: a number in brackets, else one before the word."""
    inside, before = F.regexp_extract(c, r"\((\d[\d.,\s]*)\)", 1), F.regexp_extract(c, r"(?i)(\d[\d.,]*)\s+reviews?", 1)
    return to_int(F.coalesce(F.nullif(inside, F.lit("")), F.nullif(before, F.lit(""))))
