import unicodedata

import pytest
from pyspark.sql import functions as F

from leadloom.llm import lookalike, quality

COMMON = {"en": ["the", "is", "and", "of", "to", "a", "in", "it"], "de": ["der", "die", "und", "ist"]}


def _reasons(spark, texts):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, stats string").drop("stats")
    rows = quality.text_statistics(d, "text", COMMON).withColumn("r", quality.failures(F.col("stats"))).orderBy("doc_id").collect()
    return [(r["stats"], r["r"]) for r in rows]


def test_statistics_and_rules(spark):
    prose = "The workshop is in the village, and it is open to a number of visitors. It is the cleanest of the district."
    got = _reasons(spark, [prose, prose.upper(), "- sofa\n- roof\n- crown", "", None, "x;y;{}[]<>|" * 50, "Die Firma ist gut und der Preis ist fair.", "the " * 200_000])
    stats, reasons = got[0]
    assert stats["n_words"] == 22 and stats["punctuated_lines"] == 1.0 and 0.5 < stats["common_words"] < 0.9 and reasons == []
    assert got[1][1] == [] and got[1][0]["common_words"] == stats["common_words"]
    assert got[2][0]["bullet_lines"] == 1.0 and "bullets" in got[2][1] and "few common words" in got[2][1] and "unpunctuated lines" in got[2][1]
    assert got[3][1] == ["empty"] and got[4][1] == ["empty"] and got[4][0]["mean_word_length"] == 0.0
    assert "symbols" in got[5][1] and got[6][1] == [] and got[7][0]["n_words"] == 200_000


def test_which_rules_decide(spark):
    wrapped = "the workshop is in the\nvillage and it is open to a\nnumber of the visitors"
    texts = [wrapped, wrapped.replace("\n", " "), "if(!a){to()}\nthe_is[in]={};" * 4, "- the sofa is in it\n- a roof is in the house\n- it is a crown", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = quality.text_statistics(d, "text", COMMON).withColumn("r", quality.failures(F.col("stats"))).withColumn("prose", quality.is_prose(F.col("r"))).orderBy("doc_id").collect()
    assert rows[0]["r"] == ["unpunctuated lines", "short lines"] and not rows[0]["prose"]
    assert rows[1]["r"] == ["unpunctuated lines"] and rows[1]["prose"]
    assert "symbols" in rows[2]["r"] and not rows[2]["prose"] and "bullets" in rows[3]["r"] and not rows[3]["prose"] and rows[4]["prose"]
    assert quality.text_statistics(d.where("false"), "text", COMMON).collect() == [] and quality.text_statistics(d, "text", {}).count() == 5


def test_common_words_are_bounded(spark):
    d = spark.createDataFrame([("en", "The"), ("en", "the"), (None, "x"), ("de", None)], "lang string, word string")
    assert quality.common_words(d) == {"en": ["the"]}


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("Ｃａｆé　Ｎｏ．１", "Café No.1"),
        ("Café", "Café"),
        ("Plu​mber﻿", "Plumber"),
        ("Auto repair shop", "Auto repair shop"),
        ("Рlumbеr", "Plumber"),
        ("Αutο repair shοp", "Auto repair shop"),
        ("Rooﬁng", "Roofing"),
        ("𝐏𝐥𝐮𝐦𝐛𝐞𝐫", "Plumber"),
        ("Lɑw fırm", "Law firm"),
        ("Кaфе Ромелька", "Кафе Ромелька"),
        ("А. Smith", "A. Smith"),
    ],
)
def test_one_form(text, form):
    assert lookalike.consistent(text) == form


@pytest.mark.parametrize("text", ["Bäckerei Müller & Söhne – “Süß”…", "Кафе Ромелька 228", "Κουρείο Βελιδάς", "מאפיית דולן", "مخبز السرفان 2981", "サクトミ写真館-1995", "カフェ・ノルメ", "벨로미 미용실", "plain ASCII  text", ""])
def test_true_names_stay(text):
    assert lookalike.consistent(text) == text


def test_transducer_refuses_conflicts():
    with pytest.raises(ValueError):
        lookalike.Transducer({"a": "b", "b": "c"})
    t = lookalike.Transducer({"ab": "X", "abc": "Y", "q": "Z"})
    assert t("abcabq") == "YXZ" and t("") == ""
    assert all(lookalike.consistent(v) == v for v in lookalike.form_rules().values())


def test_inconsistent_fields(spark):
    d = spark.createDataFrame([("a", "Рlumbеr", "Gym", 1), ("b", None, "Ｇｙｍ", 2), ("c", "", "Gym", 3)], "record_id string, name string, category string, form int")
    got = {(r["record_id"], r["field_name"], r["form"]) for r in lookalike.inconsistent_fields(d, "record_id", ["name", "category"]).collect()}
    assert got == {("a", "name", "Plumber"), ("b", "category", "Gym")}
    assert lookalike.inconsistent_fields(d.where("false"), "record_id", ["name"]).collect() == []


def test_decomposed_syllables_and_marks_after_wide_letters():
    for text in ("한국 치과", "각", "café", "バカ", "Й"):
        assert lookalike.consistent(unicodedata.normalize("NFD", text)) == text
    assert lookalike.consistent("ﾊﾞｶ") == lookalike.consistent("ﾊ\u3099カ") == "バカ"
    assert lookalike.consistent("ｅ\u0301") == "é" and lookalike.consistent("가\u11a8") == "각"
    assert lookalike.consistent("P\u0430\u0301ris") == "Páris"
