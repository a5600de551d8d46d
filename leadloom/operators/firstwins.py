"""The first of each business by five rules that depend on what was kept before, decided in rounds of aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.plans.lineage import cut

MOST_ROUNDS = 200


def first_wins_by_rules(records: DataFrame) -> DataFrame:
    """`records` with `duplicate`: the rule by which an earlier kept record makes a row a duplicate, NULL for kept rows.

    `records` has seq, unique and not NULL, and identity_key, canonical_domain, normalized_phone, name_key, city
    and strong (has an id of its own), as of identity(). In the order of seq a row is a duplicate if a row kept
    before it has its key; or the first kept of its domain has its name; or a weak kept row has its phone, and
    the first kept of the phone its name; or, for rows without an id, a weak kept row has its domain and city,
    or its phone. Rows without any of these are kept. Seeds of earlier runs are rows with smaller seq.

    No group is ordered or gathered: each round asks only for the first kept and the first undecided row of
    every key, domain, domain with city and phone, and decides all rows that these settle. The first undecided
    row is settled in each round, and rows of other groups don't wait for it; a few rounds do for real data.
    """
    names = {"identity_key": "_key", "canonical_domain": "_domain", "normalized_phone": "_phone", "name_key": "_name", "city": "_city"}
    d = records.select("seq", F.coalesce("strong", F.lit(False)).alias("_strong"), *[F.nullif(F.col(c), F.lit("")).alias(n) for c, n in names.items()])
    d = cut(d.withColumn("_name", F.coalesce("_name", F.lit(""))).withColumn("_state", F.lit(None).cast("string")))
    for _ in range(MOST_ROUNDS):
        d = cut(_round(d))
        if d.where("_state is null").isEmpty():
            break
    else:
        raise RuntimeError(f"rows undecided after {MOST_ROUNDS} rounds")
    return records.join(d.select("seq", F.nullif(F.col("_state"), F.lit("kept")).alias("duplicate")), "seq")


def _round(d: DataFrame) -> DataFrame:
    kept, open_, weak = F.col("_state") == "kept", F.col("_state").isNull(), ~F.col("_strong")
    first = lambda test: F.min(F.when(test, F.col("seq")))
    named = F.min(F.when(kept, F.struct("seq", F.col("_name").alias("name"))))
    todo = d.where(open_)
    by_key = d.where("_key is not null").groupBy("_key").agg(first(kept).alias("key_kept"), first(open_).alias("key_open"))
    by_domain = d.where("_domain is not null").groupBy("_domain").agg(named.alias("domain_first"), first(open_).alias("domain_open"))
    by_city = d.where("_domain is not null and _city is not null").groupBy("_domain", "_city").agg(first(kept & weak).alias("city_kept"), first(open_ & weak).alias("city_open"))
    by_phone = d.where("_phone is not null").groupBy("_phone").agg(named.alias("phone_first"), first(open_).alias("phone_open"), first(kept & weak).alias("weak_kept"), first(open_ & weak).alias("weak_open"))
    x = todo.join(by_key, "_key", "left").join(by_domain, "_domain", "left").join(by_city, ["_domain", "_city"], "left").join(by_phone, "_phone", "left")

    def before(c: Column) -> Column:
        return F.coalesce(c < F.col("seq"), F.lit(False))

    def settled(head: Column, open_at: Column) -> Column:  # the first kept is known and no undecided row can come before it
        return before(head["seq"]) & F.coalesce(open_at > head["seq"], F.lit(True))

    has_name = F.col("_name") != ""
    domain_head, phone_head = settled(F.col("domain_first"), F.col("domain_open")), settled(F.col("phone_first"), F.col("phone_open"))
    domain_same, phone_same = F.col("domain_first.name") == F.col("_name"), F.col("phone_first.name") == F.col("_name")
    rules = [
        ("identity", before(F.col("key_kept")), before(F.col("key_open"))),
        ("domain+name", has_name & domain_head & domain_same, has_name & ~domain_head & before(F.col("domain_open"))),
        ("phone+name", has_name & before(F.col("weak_kept")) & phone_head & phone_same, has_name & (before(F.col("weak_kept")) | before(F.col("weak_open"))) & ~(phone_head & ~phone_same) & (before(F.col("weak_open")) | before(F.col("phone_open")))),
        ("domain+city", weak & before(F.col("city_kept")), weak & before(F.col("city_open"))),
        ("phone", weak & before(F.col("weak_kept")), weak & before(F.col("weak_open"))),
    ]
    wait = F.lit(False)
    for _, hit, waits in rules:
        wait = wait | (waits & ~hit)
    state = F.coalesce(*[F.when(hit, F.lit(name)) for name, hit, _ in rules], F.when(~wait, F.lit("kept")))
    return d.where(~open_).unionByName(x.select(*[c for c in d.columns if c != "_state"], state.alias("_state")))
