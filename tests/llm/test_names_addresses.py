import random

from pyspark.sql import functions as F

from leadloom.llm import addresses, names
from leadloom.llm import queries as llm_queries
from leadloom.llm.components import component_labels


def test_name_parts():
    p = names.parse_name("Edward Grilstoman Cleaning Services, L.L.C.", "House cleaning service", "Ashan")
    assert p == {"core": ["grilstoman"], "given": "edward", "trade": "cleaning", "latin": True}
    assert names.parse_name("ned grilstoman clng svcs - Ashan", None, "Ashan") == p
    assert names.parse_name("The Painting Morlisker", "Painter", "")["core"] == ["morlisker"]
    assert names.parse_name("FalnevanePhotography", None, "")["core"] == ["falnevane"]
    assert names.parse_name("wickfedaceroofing", None, "")["core"] == ["wickfedace"]
    assert names.parse_name(None, None, "")["core"] == [] and not names.parse_name("Кафе Ромелька 2", "", "")["latin"]
    assert names.host_name("https://www.kasfeplumbing-langan.example/home", "langan") == ("kasfe", "plumbing")
    assert names.host_name("http://wenmiashan.pages.example", "ashanfield", True) == ("wenmi", "") and names.host_name("https://chain.example", "", True) == ("", "")


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return row[-1]


def test_metric_pairs_equal_brute_force(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(4, 9))) for _ in range(700)]
    rows = [("big", w, i) for i, w in enumerate(words)] + [("small", w, 1000 + i) for i, w in enumerate(words[:40])]
    d = spark.createDataFrame(rows, "block string, s string, i int").select("block", "s", F.struct("i").alias("p"))
    got = [(min(r["l"]["i"], r["r"]["i"]), max(r["l"]["i"], r["r"]["i"])) for r in names.metric_pairs(d, 2).collect()]
    want = {(a[2], b[2]) for k, a in enumerate(rows) for b in rows[k + 1 :] if a[0] == b[0] and _edits(a[1], b[1]) <= 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_linked_records(spark):
    rows = [
        ("1", "Dormileaf & Hoddohart Plumbing", "Plumber", "ash", "https://dormileafplumbing-ash.example", None),
        ("2", "hoddohart + dormilaef plbg", "Plumber", "ash", None, None),
        ("3", "Dormileaf & Hoddohart Dental", "Dental clinic", "ash", None, None),
        ("4", "Dormileaf & Hoddohart Plumbing", "Plumber", "oak", None, None),
        ("5", "Кафе Ромелька 2", "Plumber", "ash", "http://www.dormileafplumbing-ash.example/x", "+1555"),
        ("6", "Edward Grilsto Roofing", "Roofing contractor", "ash", None, None),
        ("7", "N. Grilsto Roofing", None, "ash", None, None),
        ("8", "Ned Grilsto Rfg", None, "ash", None, None),
        ("m", "M. Grilsto Roofing", None, "ash", None, None),
        ("9", None, None, "ash", None, None),
        ("10", "Dormileaf & Hoddohart Plumbing", "Plumber", "", None, None),
    ]
    d = spark.createDataFrame(rows, "record_id string, name string, category string, town string, website string, phone string")
    got = {tuple(r) for r in names.entity_pairs(names.linked_records(names.parsed(d, "name", "category", "town", "website"))).collect()}
    assert got == {("1", "2"), ("1", "5"), ("2", "5"), ("6", "7"), ("6", "8"), ("7", "8")}
    assert names.entity_pairs(names.linked_records(names.parsed(d.where("false"), "name", "category", "town", "website"))).collect() == []


def test_components(spark):
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r["id"]: r["label"] for r in component_labels(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert {got[f"c{i:03}"] for i in range(61)} == {"c000"} and got["x"] == got["y"] == "x" and "z" not in got
    assert component_labels(spark.createDataFrame([], "a string, b string"), "a", "b").collect() == []


def test_street_parts():
    part = addresses.street_part
    assert part("No. 204 East Chandler Str", None, "ashan", None, None) == {"number": "204", "core": ["chandler"], "kind": "str", "way": "e"}
    assert part("Ste. 24, 71 Lantern Blvd", None, "ashan", None, None)["core"] == ["lantern"]
    assert part("Tannery Dr. 1533", None, "ashan", None, None)["number"] == "1533"
    assert part(None, "Ashanfield\nPA 17117\n#81, Tannery Dr. 1533", "ashanfield", "PA", "17117") == {"number": "1533", "core": ["tannery"], "kind": "dr", "way": ""}
    assert part(None, "Schulzengasse 2809 18608 Culenrode Germany", "culenrode", None, "18608") == {"number": "2809", "core": ["schulzen"], "kind": "gasse", "way": ""}
    assert part("227 Seventh Avenue", None, "x", None, None)["core"] == part("227 7th Ave", None, "x", None, None)["core"]
    assert part("12 rue de la Côte, appt 2B", None, "x", None, None)["core"] == ["cote"]
    assert part("N/A", None, "x", None, None) is None and part(None, None, "x", None, None) is None
    assert addresses.postal_key("171O1-2345") == "17101" and addresses.postal_key("zc1 5ab") == "zc15ab"


def _places(spark, rows):
    d = spark.createDataFrame([(*r, "clash") for r in rows], "record_id string, a string, town string, p string, number string")
    d = d.withColumn("none", F.lit(None).cast("string"))
    return addresses.address_parts(d, "a", "none", "town", "none", "p")


def test_same_place_by_mined_rewrites(spark):
    rows = []
    for i, street in enumerate(["Tannery", "Magnolia", "Hickory", "Orchard", "Windmill"]):
        rows += [(f"{i}a", f"{i + 10} {street} Street", "ash", f"1000{i}"), (f"{i}b", f"{i + 10} {street} St", "ash", f"1000{i}"), (f"{i}c", f"{i + 10} {street} Str.", "ash", f"1000{i}")]
    rows += [("t", "10 Tannrey St", "ash", "10000"), ("u", "10 Tannery", "ash", "10000"), ("v", "10 Tannery Ave", "ash", "20000"), ("w", "11 Tannery Street", "ash", "10000"), ("x", "10 Tannery Street", "oak", "10000"), ("y", None, "ash", "1"), ("z", "10 Tannery Street", "", "10000")]
    got = {tuple(r) for r in addresses.same_place_pairs(_places(spark, rows)).collect()}
    groups = [["0a", "0b", "0c", "t", "u"], *[[f"{i}a", f"{i}b", f"{i}c"] for i in range(1, 5)]]
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}


def test_shared_domains_come_from_the_data(spark):
    rows = [(f"r{i}", f"www.shop{i}.unseen-host.example", t) for i, t in enumerate("abc")] + [("c1", "https://chain.example", "a"), ("c2", "chain.example/x", "b"), ("c3", "CHAIN.example", "c"), ("o1", "own.example", "a"), ("o2", "own.example", "b"), ("n", None, "a"), ("e", "", None)]
    d = spark.createDataFrame(rows, "id string, site string, town string")
    got = {r["id"]: r["shared"] for r in names.with_shared(d, "site", names.shared_domains(d, "site", "town")).collect()}
    assert {k for k, v in got.items() if v} == {"r0", "r1", "r2", "c1", "c2", "c3"} and len(got) == 10


def test_streets_that_share_numbers_are_no_rewrites(spark):
    """Real streets of one postal zone meet at many numbers, but each is attested without the other far more often."""
    rows, n = [], 0
    for number in range(100, 160):
        for street in (("Hickory Ct",) if number % 4 else ("Hickory Ct", "Yarrow Ave")):
            for spelled in (street, street.upper()):
                rows.append((f"r{n}", f"{number} {spelled}", "ashan", "TX", "10101"))
                n += 1
    rows += [("x1", "300 Old Gallows Rd", "ashan", "TX", "10101"), ("x2", "300 Old Gallows Dr", "ashan", "TX", "10101")]
    d = spark.createDataFrame(rows, "record_id string, address string, town string, state string, postal string").withColumn("full", F.lit(None).cast("string"))
    got = addresses.same_place_pairs(addresses.address_parts(d, "address", "full", "town", "state", "postal")).collect()
    assert len(got) == 75 and not {"x1", "x2"} & {i for r in got for i in r}


def test_slips_of_articles_umlauts_and_states():
    part = addresses.street_part
    assert part("136 av. drs Glycines", None, "denovaux", None, None)["core"] == ["glycines"]
    assert part("251 Avenue dees Acacias", None, "denovaux", None, None)["core"] == ["acacias"]
    assert part("12 Dee Lake Avenue", None, "denovaux", None, None)["core"] == ["dee", "lake"]
    assert part("Jaegerhofstrasse 120", None, "x", None, None)["core"] == part("Jägerhof Straße 120", None, "x", None, None)["core"]
    assert part(None, "Veringbrook\nTX\n109, Kingfisher Ave.\nUS", "veringbrook", "TX", None)["core"] == ["kingfisher"]


def test_no_addresses(spark):
    assert addresses.same_place_pairs(_places(spark, []).where("false")).collect() == []


def test_town_from_query_and_address(spark):
    rows = [
        ("a", "Langanford", None, None, None, None),
        ("b", None, "Saint Olm, FR", None, None, None),
        ("c", None, None, "plumber in Kenergate, IL", None, None),
        ("d", "N/A", "N/A", "home services near me", "885 Alder Street", "885 Alder Street\nLanganford, TX 10109"),
        ("e", None, None, "home services near me", "N/A", "225 Magonlia Pky, Langanforrd, TX, USA"),
        ("f", None, None, "home services near me", None, "12 pl. des Vignerons, 10 Saint-Olm France"),
        ("g", None, None, "home services near me", None, "1 Nowhere Road"),
        ("h", None, None, "home services near me", "3 Kenergate Rd, Langanford", None),
        ("i", None, "near me", "plumber", None, None),
    ]
    d = spark.createDataFrame(rows, "id string, city string, source_location string, source_query string, address string, full_address string")
    d = llm_queries._with_town(d, "id", ["address", "full_address"])
    towns = {r["id"]: r["town"] for r in d.collect()}
    assert towns == {"a": "langanford", "b": "saint olm", "c": "kenergate", "d": "langanford", "e": "langanford", "f": "saint olm", "g": "", "h": "langanford", "i": ""}


def test_short_names_are_linked_when_equal(spark):
    rows = [
        ("a1", "AB Plumbing", "Plumber", "ash", None, "+15550001111"),
        ("a2", "ab plbg", "Plumber", "ash", None, None),
        ("a3", "AC Plumbing", "Plumber", "ash", None, None),
        ("a4", "AB Plumbing", "Plumber", "oak", None, None),
        ("a5", "Tom AB Plumbing", "Plumber", "ash", None, None),
        ("c1", "王府", None, "elm", "wf.example", None),
        ("c2", "王府", None, "elm", None, "+15550002222"),
        ("u1", "Dormileaf", None, "fir", None, None),
        ("u2", "Dormileaff", None, "fir", None, None),
    ]
    d = spark.createDataFrame(rows, "record_id string, name string, category string, town string, website string, phone string")
    of = {r["record_id"]: r["entity"] for r in names.linked_records(names.parsed(d, "name", "category", "town", "website")).collect()}
    assert of["a1"] == of["a2"] == of["a5"] and of["c1"] == of["c2"] and of["u1"] == of["u2"]
    assert len({of["a1"], of["a3"], of["a4"]}) == 3


def test_slips_are_found_as_by_trying_all_words():
    rng = random.Random(5)
    lexicon = names._lexicon()
    words = sorted({w for kind, _, _ in lexicon.kinds for w in kind})
    for w in rng.sample(words, 60):
        for _ in range(4):
            i, c = rng.randrange(len(w)), rng.choice("aeknrstü")
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :]]) or c
            near = [[(d, x, kind[x]) for x in kind if len(x) >= least and x[0] in w[:2] and (d := names.distance(w, x, most := 2 if len(x) >= long else 1)) <= most] for kind, least, long in lexicon.kinds]
            assert lexicon.find(w) == tuple(kind[w] if w in kind else min(n, default=("",))[-1] for (kind, _, _), n in zip(lexicon.kinds, near))
