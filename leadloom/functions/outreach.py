"""Opening lines for a business, and the text that asks a language model for one, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.reviews import NO_TOPICS
from leadloom.sources.tables import present


def pitch_hook(name: Column, category: Column, rating: Column, reviews: Column, topics: Column, mood: Column) -> Column:
    """A line that tells a business its count of reviews, its rating, and its first topic where the mood is clear.

    `topics` is an array, `mood` from -1 to 1. A missing name or category is spoken of in general; a topic
    that says nothing gives way to the category.
    """
    trade = F.lower(F.trim(F.coalesce(present(category), F.lit("your services"))))
    first = F.get(topics, F.lit(0))
    topic = F.when(first.isNotNull() & ~first.isin(*NO_TOPICS), first).otherwise(trade)
    score = present(rating.cast("string"))
    tail = (
        F.when(mood > 0.3, F.concat(F.lit(" with customers consistently praising "), topic))
        .when(mood < -0.3, F.concat(F.lit(" but some recent reviews mention "), topic, F.lit(" — a quick fix could lift that")))
        .otherwise(" — and I'd love to help you turn that into more qualified leads")
    )
    return F.concat(
        F.lit("I noticed "), F.trim(F.coalesce(present(name), F.lit("your business"))), F.lit(" has "), F.coalesce(reviews.cast("string").try_cast("int"), F.lit(0)).cast("string"), F.lit(" reviews"),
        F.coalesce(F.concat(F.lit(" and a "), score, F.lit(" rating")), F.lit("")), tail, F.lit("."),
    )


def prompt_text(record: dict[str, Column]) -> Column:
    """The text that asks for an opening line; lines of what a record lacks are left out. `record` has columns by lead column."""
    have = lambda c: present(record[c].cast("string")) if c in record else F.lit(None).cast("string")
    said = lambda c: F.coalesce(have(c), F.lit("N/A"))
    line = lambda label, value: F.concat(F.lit(label + ": "), value)
    active = F.array_join(F.array_compact(F.array(*[F.when(have(c).isNotNull(), F.lit(c)) for c in ("facebook", "instagram", "linkedin")])), ", ")
    lines = [
        F.lit("Write a personalized outreach opening line for this business:"), line("Name", said("business_name")), line("Category", said("category")),
        F.concat(F.lit("Location: "), F.coalesce(have("city"), F.lit("")), F.lit(", "), F.coalesce(have("state"), F.lit(""))),
        line("Rating", said("rating")), line("Review count", said("review_count")), line("Sentiment score", F.nullif(have("sentiment_score"), F.lit("0"))),
        line("Common praise/topics in reviews", have("review_keywords")), line("Sample review", F.substring(have("top_review"), 1, 300)),
        line("Active social platforms", F.nullif(active, F.lit(""))), line("Website platform", have("cms")),
        F.lit("The hook should acknowledge something specific about this business (its reputation, review themes, or niche) and pivot to a value offer. Return ONLY the hook text."),
    ]
    return F.concat_ws("\n", *lines)


def answer_text(response: Column) -> Column:
    """The line in a model's JSON response, without quotes around it, in one line; NULL for none."""
    t = F.trim(F.get_json_object(response, "$.choices[0].message.content"))
    return F.nullif(F.trim(F.replace(F.trim(F.regexp_replace(t, '^"+|"+$', "")), F.lit("\n"), F.lit(" "))), F.lit(""))
