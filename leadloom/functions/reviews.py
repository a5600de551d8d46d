"""Sentiment, topics and scores of reviews as column expressions on arrays of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import STOPWORDS, tokens

# Fixed values ------------------------------------------------------------------------------------------------

POSITIVE = (
    "great excellent awesome amazing fantastic friendly professional helpful best love loved quick fast reliable recommend recommended outstanding wonderful perfect clean honest knowledgeable responsive polite "
    "courteous efficient highly quality superb top exceed impressed satisfied happy delighted thank trust caring attentive timely worth seamless smooth"
).split()
NEGATIVE = (
    "terrible awful horrible bad poor rude unprofessional worst slow late unreliable disappointed disappointing waste overpriced expensive scam avoid dirty broken unresponsive never refund complain complaint ruined "
    "failed failure frustrating messy rip-off rip liar"
).split()
PANEL_WORDS = "ago month months week weeks year years day days hour hours review reviews photo photos like likes share shared edited response owner local guide helpful read more updated".split()
NO_TOPICS = (
    "got get came come went took take made make called call needed need put did done said told gave give know knew think thought want wanted used use using let kept keep see seen explained fixed replaced installed scheduled "
    "arrived showed hired recommended recommend worked working asked ask answered left paid charged sent tried found believe felt feel noticed checked helped help definitely really always never every time back first second way recently "
    "job work place company business guy guys man men people team crew tech technician plumber plumbers home house money price prices pricing experience review reviews "
    "couldn wouldn shouldn didn wasn isn aren weren hasn haven won don ain shutt shut lot bit etc im id ive theyd theyre"
).split()


def review_sentiment(text: Column, positive=POSITIVE, negative=NEGATIVE) -> Column:
    """Mean of +1 and -1 over the lexicon's words in a text; NULL without any."""
    ws = tokens(text)
    p, n = F.size(F.filter(ws, lambda w: w.isin(*positive))), F.size(F.filter(ws, lambda w: w.isin(*negative)))
    return F.when(p + n > 0, (p - n) / (p + n))


def sentiment(texts: Column) -> Column:
    """Mean sentiment of the reviews that have one, rounded half to even at three places; 0 without any."""
    each = F.array_compact(F.transform(texts, lambda t: review_sentiment(t)))
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(each), F.lit(0))
    return F.coalesce(F.bround(mean, 3), F.lit(0.0))


def top_keywords(texts: Column, most: int = 5) -> Column:
    """The most frequent words of topics, those first seen first among equals."""
    banned = sorted({*STOPWORDS, *PANEL_WORDS, *NO_TOPICS, *POSITIVE, *NEGATIVE})
    ws = F.filter(F.flatten(F.transform(texts, tokens)), lambda w: ~w.isin(*banned))
    counted = F.transform(F.array_distinct(ws), lambda w: F.struct((-F.size(F.filter(ws, lambda x: x == w))).alias("n"), F.array_position(ws, w).alias("at"), w.alias("w")))
    return F.slice(F.transform(F.array_sort(counted), lambda x: x["w"]), 1, most)


def top_review(texts: Column) -> Column:
    """The review of the best sentiment, the longest among equals, then the first."""
    ranked = F.array_sort(F.transform(texts, lambda t, i: F.struct((-F.coalesce(review_sentiment(t), F.lit(0.0))).alias("s"), (-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.get(F.transform(ranked, lambda x: x["t"]), F.lit(0))


def lead_score(rating: Column, reviews: Column, mood: Column, keywords: Column) -> Column:
    """From 0 to 100: rating, count of reviews, sentiment and topics, rounded half to even."""
    score = F.when(rating > 0, F.least(F.lit(40.0), rating * 8)).otherwise(F.lit(0.0)) + F.least(F.lit(20.0), F.coalesce(reviews, F.lit(0)) / 5)
    score = score + F.greatest(F.lit(0.0), (mood + 1) / 2) * 25 + F.least(F.lit(15), 3 * keywords)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(score).cast("int")))


def kept_reviews(texts: Column, least: int, most: int) -> Column:
    """Trimmed distinct reviews of at least `least` characters, cut to `most`."""
    return F.transform(F.filter(F.array_distinct(F.transform(texts, lambda t: F.trim(t))), lambda t: (t != "") & (F.length(t) >= least)), lambda t: F.substring(t, 1, most))
