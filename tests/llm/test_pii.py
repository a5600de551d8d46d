import re

import pytest

from leadloom.llm import pii


def _kinds(text):
    return [(k, text[a:b]) for k, a, b in pii.find_mentions(text)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Write me at <k.falk+maps@mail.example> now.", [("EMAIL", "k.falk+maps@mail.example")]),
        ("Contact: vz [at] quiet [dot] example", [("EMAIL", "vz [at] quiet [dot] example")]),
        ("Ordered 3 @ 4.50 each. Follow them @dailyshop for specials.", []),
        ("Ph:001 893 960 1237 -- leave a message.", [("PHONE", "001 893 960 1237")]),
        ("Nobody rang +1(998)296-0197 as promised.", [("PHONE", "+1(998)296-0197")]),
        ("Erreichbar unter (0793) 94010 ab 18 Uhr.", [("PHONE", "(0793) 94010")]),
        ("Text 426-7154; my wife picks up.", [("PHONE", "426-7154")]),
        ("SSN QQ 52 78 64 C was on it!", [("ID", "QQ 52 78 64 C")]),
        ("Had to show ID no. 947-77-3832 twice.", [("ID", "947-77-3832")]),
        ("Man wollte den Pass T072946683 sehen.", [("ID", "T072946683")]),
        ("Apuntaron el DNI 76640365-R en la factura.", [("ID", "76640365-R")]),
        ("Invoice 4179-2289-11 was wrong. Part no. 003359-1781 fits. Ticket #171-062-B. Paid $1,146.50. They were here 2009-2021.", []),
        ("They came to 929 N Chandler Road within the hour.", [("ADDRESS", "929 N Chandler Road")]),
        ("Wir wohnen Rosenkampstr. 12a im zweiten Stock.", [("ADDRESS", "Rosenkampstr. 12a")]),
        ("Vivimos en C/ Lomrilett 167 y no.", [("ADDRESS", "C/ Lomrilett 167")]),
        ("Ils sont venus au 164 bis rue de la Côte le lendemain.", [("ADDRESS", "164 bis rue de la Côte")]),
        ("The Main Street branch is closer. Exit 14 off Highway 86.", []),
        ("I spoke with Dr. Kelkivane twice.", [("NAME", "Kelkivane")]),
        ("Ask for leocadia fenneman, total pro.", [("NAME", "leocadia fenneman")]),
        ("Shout-out to I. Kasrilin!", [("NAME", "I. Kasrilin")]),
        ("May I say the coffee is superb. Mark my words. Grace period was nice. Our Hod Dental visit was quick.", []),
        ("", []),
    ],
)
def test_mentions(text, found):
    assert _kinds(text) == found


def test_mentions_of_a_table(spark):
    d = spark.createDataFrame([("a", "Ünï x@y.example 😀 z@y.example", 1), ("b", None, 2), ("c", "", 3), ("d", "nothing " * 50_000, 4)], "record_id string, top_review string, kind int")
    got = sorted((r["record_id"], r["kind"], r["start_pos"]) for r in pii.mentions(d, "record_id", "top_review").collect())
    assert got == [("a", "EMAIL", 5), ("a", "EMAIL", 19)]


def test_surrogates_are_distinct_consistent_and_keyed(spark):
    rows = [(f"r{i}", f"Ask for Rose Kelsa{chr(97 + i % 26)}{chr(97 + i // 26)}, total pro. Mail r{i}@x.example today. SSN 9{i % 90 + 10}-{i % 90 + 10}-{i + 1000} was.") for i in range(120)]
    rows += [("full", "Thanks to Odette Ravdri for it. ODETTE helped."), ("part", "Ask for Odette, total pro.")]
    d = spark.createDataFrame(rows, "record_id string, top_review string")
    one = {r["record_id"]: r["replaced"] for r in pii.with_surrogates(d, "record_id", "top_review", "k1").collect()}
    assert len(one) == 122 and not any("x.example" in t or "Kelsa" in t or "Odette " in t for t in one.values())
    assert len({t.split("Mail ")[1].split(" ")[0] for k, t in one.items() if k[0] == "r"}) == 120
    assert len({t.split("SSN ")[1].split(" ")[0] for k, t in one.items() if k[0] == "r"}) == 120
    given = {t.split("Ask for ")[1].split(" ")[0] for k, t in one.items() if k[0] == "r"}
    assert len(given) == 1 and all(t.endswith(" was.") and " today. SSN " in t for k, t in one.items() if k[0] == "r")
    assert one["full"].split("Thanks to ")[1].split(" ")[0] == one["part"].split("Ask for ")[1].split(",")[0]
    again = {r["record_id"]: r["replaced"] for r in pii.with_surrogates(d, "record_id", "top_review", "k1").collect()}
    other = {r["record_id"]: r["replaced"] for r in pii.with_surrogates(d, "record_id", "top_review", "k2").collect()}
    assert again == one and other["part"] != one["part"]


def test_placeholders(spark):
    d = spark.createDataFrame([("a", "Mail x@y.example or ring 426-7154."), ("b", "nothing")], "record_id string, top_review string")
    assert [tuple(r) for r in pii.with_placeholders(d, "record_id", "top_review").select("record_id", "replaced").collect()] == [("a", "Mail [EMAIL] or ring [PHONE].")]


def test_surrogates_keep_script_gender_form_and_coreference(spark):
    rows = [
        ("a", "Ask for Anna-Marie Kelsan, total pro."), ("b", "Ask for Мария, total pro."), ("c", "Ask for Robert, total pro."),
        ("d", "Contact: vz [at] quiet [dot] example"), ("e", "Contact: vz@quiet.example now"), ("f", "Ring (212) 555-1234 now"), ("g", "Ring 212-555-1234 now"),
    ]
    d = spark.createDataFrame(rows, "record_id string, top_review string")
    got = {r["record_id"]: r["replaced"] for r in pii.with_surrogates(d, "record_id", "top_review", "k1").collect()}
    assert re.fullmatch(r"Ask for \w+ella-\w+ella \w+, total pro\.", got["a"])
    assert re.fullmatch(r"Ask for [\u0400-\u04ff]+ина, total pro\.", got["b"]) and re.fullmatch(r"Ask for \w+bert, total pro\.", got["c"])
    name = re.fullmatch(r"Contact: (\w+) \[at\] mail \[dot\] example", got["d"]).group(1)
    assert got["e"] == f"Contact: {name}@mail.example now"
    a, b = (re.fullmatch(p, got[k]) for k, p in (("f", r"Ring \((\d{3})\) (\d{3})-(\d{4}) now"), ("g", r"Ring (\d{3})-(\d{3})-(\d{4}) now")))
    assert a.groups() == b.groups() != ("212", "555", "1234")
