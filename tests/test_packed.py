from leadloom.operators import packed

SCHEMA = "record_id string, tech string, mail string, source string"


def _fixture(spark):
    rows = [(f"s{i}", v, "a@x.example,b@x.example", "q") for i, v in enumerate(["Kit.js", "Ember Shop", "C+ Runtime", "Brix/3", "Node-Ash", "Payfern"] * 3)]
    rows += [
        ("comma", 'Payfern, "Formbee, Pro" ,Kit.js', "a@x.example b@x.example", "q"),
        ("mixed", "Kit.js\nPayfern | Node-Ash; Brix/3 / Ember Shop", "a@x.example | b@y.example;c@z.example", "q"),
        ("quotes", '"Open ""Vela"" UI", Kit.js', '"a@x.example"', "q"),
        ("brackets", '["Payfern"; "Kit.js"]', '["a@x.example","b@x.example"]', "q"),
        ("empties", "Payfern,, ,Kit.js,", ",a@x.example", "q"),
        ("odd", '6" pipe, Kit.js', "N/A", "q"),
        ("missing", "N/A", None, "q"),
        ("blank", "  ", "none", "q"),
        (None, "Payfern", "a@x.example", "q"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def _items(rows, record, field):
    return [r["item"] for r in sorted(rows, key=lambda r: r["pos"]) if (r["record_id"], r["field_name"]) == (record, field)]


def test_delimiters_are_inferred(spark):
    taken = packed.inferred_delimiters(packed.cells(_fixture(spark), "record_id", ["tech", "mail"]))
    assert "space" in taken["mail"] and "space" not in taken["tech"]
    assert "slash" not in taken["tech"] and "spaced slash" in taken["tech"] and "comma" in taken["tech"]


def test_unpack(spark):
    rows = packed.unpack(_fixture(spark), "record_id", ["tech", "mail"]).collect()
    assert _items(rows, "comma", "tech") == ["Payfern", "Formbee, Pro", "Kit.js"]
    assert _items(rows, "mixed", "tech") == ["Kit.js", "Payfern", "Node-Ash", "Brix/3", "Ember Shop"]
    assert _items(rows, "quotes", "tech") == ['Open "Vela" UI', "Kit.js"]
    assert _items(rows, "brackets", "tech") == ["Payfern", "Kit.js"]
    assert _items(rows, "empties", "tech") == ["Payfern", "Kit.js"]
    assert _items(rows, "odd", "tech") == ['6" pipe', "Kit.js"]
    assert _items(rows, "comma", "mail") == ["a@x.example", "b@x.example"]
    assert _items(rows, "mixed", "mail") == ["a@x.example", "b@y.example", "c@z.example"]
    assert not any(r["record_id"] in ("missing", "blank") for r in rows)
    assert [r["pos"] for r in sorted(rows, key=lambda r: r["pos"]) if r["record_id"] == "empties" and r["field_name"] == "tech"] == [1, 2]


def test_unpack_of_nothing_and_of_a_long_cell(spark):
    assert packed.unpack(spark.createDataFrame([], SCHEMA), "record_id", ["tech", "mail"]).collect() == []
    long = ",".join(f"v{i}" for i in range(20_000)) + ',"' + "x, " * 5_000 + '"'
    d = spark.createDataFrame([("l", long, None, "q"), ("m", "v1,v2", None, "q"), ("n", "v1", None, "q")], SCHEMA)
    assert packed.unpack(d, "record_id", ["tech"]).where("record_id = 'l'").count() == 20_001
