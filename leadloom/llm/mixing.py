"""Mixing sources to target shares by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom.plans.lineage import cut

#: Ranks are summed up over so many slices of each source, so no task sorts a source.
SLICES = 4096
#: A text longer than this part of its source's sample is given a chance in inverse proportion to its size.
LARGE_PART = 64


def distinct_texts(docs: DataFrame, id_col: str, text_col: str, source_col: str, targets: DataFrame) -> DataFrame:
    """One row (id, source) for each text of the sources in `targets`: that of its smallest id.

    A text found again, in the same or another source, is the same text: it counts towards that row's source.
    """
    d = docs.join(targets.select(F.col("source").alias(source_col)), source_col, "left_semi")
    d = d.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    d = d.groupBy(F.sha2(text_col, 256).alias("_text")).agg(F.min(F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))).alias("x"))
    return d.select("x.id", "x.source", "x.text")


def _mixed(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """`sizes` with what its source needs: copies that every text gets, and tokens that a sample has to give."""
    held = sizes.groupBy("source").agg(F.sum("n").alias("held"))
    t = targets.where("target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats").join(held, "source").where("held > 0")
    # the largest total at which no source needs more than its texts times their repeats
    total = t.agg(F.min(F.col("held") * F.col("max_repeats") / F.col("target_share"))).first()[0]
    t = t.withColumn("need", F.least(F.lit(total or 0.0) * F.col("target_share"), (F.col("held") * F.col("max_repeats")).cast("double")))
    whole = F.least(F.floor(F.col("need") / F.col("held") + 1e-9), F.col("max_repeats").cast("long"))
    return t.withColumn("whole", whole).withColumn("sampled", F.greatest(F.lit(0.0), F.col("need") - whole * F.col("held")))


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(id, source, n, copies) of the texts that the mix uses, from `sizes` (id, source, n) with one row a text.

    The total is the largest that the scarcest source allows. Every text of a source gets its whole copies;
    the tokens still missing come from a Pareto sample: chances are alike but for very long texts, whose
    chances fall with their size, so that one text can't outweigh a share. Texts are ranked by random odds u / (1 - u) divided by inclusion odds p / (1 - p), u drawn from the id and the
    seed. Ranks are taken from the lowest until the missing tokens are reached. Sources without a target,
    without texts or with a target of 0 are left out. Sums over the ranks go by slices of each source, so
    no source is sorted in one task.
    """
    s = cut(sizes.where("n > 0 and source is not null"))
    plan = _mixed(s, targets)
    # a chance proportional to w = min(1, large / size) and at most 1, with the sum of chance times size at the missing tokens
    large = F.col("sampled") / LARGE_PART
    w = F.least(F.lit(1.0), large / F.col("n"))
    d = s.join(plan.select("source", "whole", "sampled"), "source")
    sums = d.groupBy("source").agg(F.first("sampled").alias("sampled"), F.coalesce(F.sum(F.when(F.col("n") <= large, F.col("n"))), F.lit(0)).alias("small"), F.coalesce(F.sum(F.when(F.col("n") > large, large)), F.lit(0.0)).alias("big"))
    k = sums.select("source", (F.col("sampled") / F.greatest(F.col("small") + F.col("big"), F.lit(1.0))).alias("k"), F.greatest(F.col("sampled") - F.col("small"), F.lit(0.0)).alias("over"), "big")
    k = k.select("source", "k", F.when((F.col("k") > 1) & (F.col("big") > 0), F.col("over") / F.col("big")).otherwise(F.col("k")).alias("k_big"))
    d = d.join(k, "source")
    p = F.least(F.lit(1.0), F.greatest(F.when(F.col("n") <= large, F.col("k")).otherwise(F.col("k_big")) * w, F.lit(1e-9)))
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    q = F.when(p >= 1.0, F.lit(0.0)).otherwise((u / (1 - u)) / (p / (1 - p)))
    d = d.withColumn("q", q).withColumn("slice", F.floor(F.col("q") / (F.col("q") + 1) * SLICES).cast("int"))
    sums = d.groupBy("source", "slice").agg(F.sum("n").alias("t"), F.first("sampled").alias("sampled"))
    before = sums.withColumn("before", F.coalesce(F.sum("t").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    d = d.join(before.select("source", "slice", "before", (F.col("before") + F.col("t") <= F.col("sampled")).alias("taken")), ["source", "slice"])
    d = d.where((F.col("whole") > 0) | (F.col("before") < F.col("sampled")))
    # only the slice in which the sum is reached is ranked text by text; certain texts share slice 0 and rank by size
    border = d.where((~F.col("taken")) & (F.col("before") < F.col("sampled")))
    rank = W.partitionBy("source", "slice").orderBy("q", F.desc("n"), "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    border = border.withColumn("upto", F.col("before") + F.sum("n").over(rank))
    border = border.withColumn("extra", (F.col("upto") - F.col("n") / 2 <= F.col("sampled")).cast("int"))
    others = d.where(F.col("taken") | (F.col("before") >= F.col("sampled"))).withColumn("extra", F.col("taken").cast("int"))
    out = others.select("id", "source", "n", "whole", "extra").unionByName(border.select("id", "source", "n", "whole", "extra"))
    return out.select("id", "source", "n", (F.col("whole") + F.col("extra")).cast("int").alias("copies")).where("copies > 0")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source of `targets`: its target share, texts, tokens, the share reached and the most copies."""
    by = mixed.groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("n") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    t = targets.select("source", "target_share", "max_repeats").join(by, "source", "left").na.fill(0, ["texts", "tokens", "most_copies"])
    total = F.sum("tokens").over(W.partitionBy())  # a row a source
    return t.withColumn("reached_share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))


def faults(mixed: DataFrame, targets: DataFrame, slack: float = 0.02) -> DataFrame:
    """(source, used_too_often, listed_twice, share_missed) of each target: texts beyond its repeats, rows of one text, 1 where its share is off by more than `slack`."""
    mixed = cut(mixed)
    twice = mixed.groupBy("source", "id").count().where("count > 1").groupBy("source").agg(F.count("*").alias("twice"))
    often = mixed.join(targets.select("source", "max_repeats"), "source").where("copies > max_repeats").groupBy("source").agg(F.count("*").alias("often"))
    off = share_report(mixed, targets).select("source", (F.abs(F.col("reached_share") - F.col("target_share")) > slack).cast("int").alias("off"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    return off.join(twice, "source", "left").join(often, "source", "left").select("source", zero("often").alias("used_too_often"), zero("twice").alias("listed_twice"), zero("off").alias("share_missed"))
