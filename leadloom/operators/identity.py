"""Identity of listings, and keeping the first of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom.functions.text import name_key, normalize_text
from leadloom.functions.web import domain_of, normalize_phone
from leadloom.sources.tables import present


def identity(columns: list[str]) -> Column:
    """A struct of a listing's identity signals, key type and key.

    The key is the SHA-1 of the strongest signal there is: kgmid, place_id, domain with city, phone, name with
    city. A missing city reads n/a in the key.
    """
    col = lambda n: F.col(n).cast("string") if n in columns else F.lit(None).cast("string")
    kgmid, place, domain = present(col("kgmid")), present(col("place_id")), domain_of(col("website"))
    land = F.upper(F.trim(col("country")))
    phone = normalize_phone(F.coalesce(present(col("phone")), col("phone_international")), F.when(land.rlike("^[A-Z]{2}$"), land))
    name = name_key(normalize_text(present(col("business_name"))))
    city = F.lower(normalize_text(present(col("city"))))
    town = F.coalesce(city, F.lit("n/a"))
    ladder = [
        ("kgmid", F.concat(F.lit("kg:"), F.trim(kgmid))),
        ("place_id", F.concat(F.lit("pid:"), F.trim(place))),
        ("domain+city", F.concat(F.lit("dom:"), domain, F.lit("|city:"), town)),
        ("phone", F.concat(F.lit("ph:"), phone)),
        ("name+city", F.concat(F.lit("name:"), name, F.lit("|city:"), town)),
    ]
    kind = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in ladder], F.lit("none"))
    key = F.coalesce(*[c for _, c in ladder])
    return F.struct(kgmid.alias("kgmid"), place.alias("place_id"), domain.alias("canonical_domain"), phone.alias("normalized_phone"), name.alias("name_key"), city.alias("city"), kind.alias("key_type"), F.sha1(key).alias("identity_key"))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`; rows with a NULL in a key are all kept.

    First rows are found by an aggregate, so a key of very many rows is reduced where it is read.
    """
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    rest = df.where(" or ".join(f"`{k}` is null" for k in keys))
    first = known.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_first")).select("_first.*")
    return first.unionByName(rest)


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't among those seen; NULL keys are never seen."""
    return df.join(seen.select(*keys).distinct(), keys, "left_anti")


def first_claims(df: DataFrame, owner: str, order: str, fields: list[str]) -> DataFrame:
    """`df` with each value of `fields`, over all of them, left only to the row that claims it first; NULL elsewhere."""
    long = df.select(owner, order, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), present(F.col(f)).alias("value")) for f in fields])).alias("x")).select(owner, order, "x.*").where("value is not null")
    first = long.groupBy("value").agg(F.min_by(owner, order).alias("_claimant"))
    mine = long.join(first, "value").where(F.col(owner) == F.col("_claimant"))
    wide = mine.groupBy(owner).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    return df.drop(*fields).join(wide, owner, "left").select(*df.columns)


def numbered(df: DataFrame, by: str, order: list[str], name: str = "position") -> DataFrame:
    """`df` with each row's number within its group; groups are expected to be of bounded size."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order)))


def limited(df: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """At most so many first rows of each group, found by partial top-k before the shuffle's end."""
    return numbered(df, by, order, "_n").where(F.col("_n") <= most).drop("_n")
