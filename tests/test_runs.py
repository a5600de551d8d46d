import json
import zipfile

import pytest
from pyspark.sql import functions as F

from leadloom.plans import enrich, leads
from leadloom.schema import LEAD_COLUMNS
from leadloom.sources import runs, sinks
from leadloom.streaming import dedup


def test_query_table(spark, tmp_path):
    path = str(tmp_path / "queries")
    q = lambda *names: spark.createDataFrame([(n,) for n in names], "query string")
    runs.register_queries(spark, path, q("a", "b", "b", None), 1.0)
    runs.register_queries(spark, path, q("a", "c"), 2.0)
    runs.mark_queries(spark, path, q("a", "b"), "done", 3.0)
    runs.mark_queries(spark, path, q("b"), "failed", 3.0)
    states = runs.query_states(runs.read_log(spark, path, runs.QUERY_LOG))
    assert {r["query"]: r["status"] for r in states.collect()} == {"a": "done", "b": "pending", "c": "pending"}
    assert [r["query"] for r in runs.pending_queries(states).collect()] == ["b", "c"]
    assert sorted(r["query"] or "" for r in runs.without_done(q("a", "b", None), states).collect()) == ["", "b"]
    runs.count_up(spark, str(tmp_path / "c"), {"x": 2, "y": 1})
    runs.count_up(spark, str(tmp_path / "c"), {"x": 3})
    assert {r["name"]: r["value"] for r in runs.counters(runs.read_log(spark, str(tmp_path / "c"), runs.COUNTER_LOG)).collect()} == {"x": 5, "y": 1}


def test_settings(tmp_path, monkeypatch):
    known = {"job": {"name": "x", "limit": 1, "share": 0.5, "list": []}}
    f = tmp_path / "c.yaml"
    monkeypatch.setenv("WHO", "me")
    f.write_text("job: {name: 'a ${WHO} ${NONE:-b}', share: 1}")
    assert runs.load_settings(str(f), known) == {"job": {"name": "a me b", "limit": 1, "share": 1, "list": []}}
    for bad in ("jobs: {}", "job: {other: 1}", "job: {limit: x}"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            runs.load_settings(str(f), known)


def test_demo_to_whole_leads(spark):
    d = runs.demo_listings(spark, "plumber in Dallas")
    assert d.count() == 3 and runs.trial_listings(spark, 5).select("website").distinct().count() == 5
    pages = spark.createDataFrame([("https://sample1.example.com/", 0, "https://sample1.example.com/", '<a href="https://facebook.com/other">f</a><p>mail jo@sample1.co. Jane Doe, Owner</p>', 200)], "site string, page_order int, url string, html string, status int")
    rows = {r["business_name"]: r for r in enrich.whole_leads(leads.leads_of(d), pages).collect()}
    one, two = rows["Sample Business 1"], rows["Sample Business 2"]
    assert list(one.asDict()) == LEAD_COLUMNS and len(rows) == 3
    assert one["website_status"] == "LIVE" and one["facebook"] == "https://facebook.com/other" and one["decision_maker_name"] == "Jane Doe" and one["phone"] == "+15550001000"
    assert two["website_status"] == "UNKNOWN" and two["emails"] == "N/A" and two["source_keyword"] == "plumber" and two["record_id"].count(":") == 1
    assert one["pitch_hook"].startswith("I noticed Sample Business 1 has 40 reviews and a 4.5 rating")


def test_mail_checks_and_gates(spark):
    d = spark.createDataFrame([(["a@x.co"],), (["b@y.co"],), ([],), (None,)], "emails array<string>")
    results = spark.createDataFrame([("X.co", "PASS", "mx_records=2")], "domain string, status string, reason string")
    assert sorted(map(str, (tuple(r)[1:4] for r in enrich.mail_checks(d, results).select("emails", "mx_status", "mx_reason", "smtp_status").collect()))) == sorted(map(str, [("PASS", "mx_records=2", "Not Checked"), ("INCONCLUSIVE", "not_looked_up", "Not Checked"), (None, None, None), (None, None, None)]))
    assert enrich.mail_checks(d, None).where("mx_status = 'Not Checked'").count() == 2
    g = spark.createDataFrame([("a", "5", "5"), ("b", "20", "20"), ("c", "x", None)], "record_id string, latitude string, longitude string")
    ring = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    assert {r["record_id"] for r in enrich.in_regions(g, [ring]).collect()} == {"a", "c"} and enrich.in_regions(g, []).count() == 3
    h = spark.createDataFrame([([(20, "b"), (10, "z"), (10, "a")],)], "h array<struct<preference: int, host: string>>")
    assert h.select(enrich.hosts_by_preference(F.col("h")).alias("h")).first()["h"] == ["a", "z", "b"]


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([(f"r{i}", f'n "{i}"\nx' if i else None) for i in range(50)], "record_id string, business_name string")
    sinks.append_csv(spark, d, str(tmp_path / "e"))
    sinks.append_csv(spark, d.limit(1), str(tmp_path / "e"))
    assert sinks.row_count(spark, str(tmp_path / "e")) == 51
    with pytest.raises(ValueError):
        sinks.append_csv(spark, d, str(tmp_path / "e"), ["more"])
    numbered = sinks.with_row_index(d.repartition(5), ["record_id"], 100)
    got = [(r["record_id"], r["row_index"]) for r in numbered.orderBy("row_index").collect()]
    assert got == [(x, 100 + i) for i, x in enumerate(sorted(f"r{i}" for i in range(50)))] and sinks.truncated(numbered, 110).count() == 10
    records = spark.createDataFrame([("r1", "committed", 1, json.dumps({"business_name": "A", "gone": 1})), ("r2", "committed", 0, None), ("r3", "seen", None, "{}")], "record_id string, stage string, committed_row long, raw_json string")
    rows = sinks.migrated(records, ["mine"]).orderBy("committed_row").collect()
    assert [(r["record_id"], r["business_name"], r["mine"]) for r in rows] == [("r2", "N/A", "N/A"), ("r1", "A", "N/A")]
    assert sinks.reconciled(d, records).count() == 2
    assert sinks.write_xlsx(d, str(tmp_path / "x.xlsx")) == 50 and b"r49" in zipfile.ZipFile(tmp_path / "x.xlsx").read("xl/worksheets/sheet1.xml")
    assert json.loads(sinks.raw_json(d, ["record_id"]).where("record_id = 'r1'").first()["raw_json"]) == {"record_id": "r1"}


def test_stream_of_five_rules(spark, tmp_path):
    schema = "kgmid string, place_id string, business_name string, website string, phone string, city string, country string, bad boolean"
    first = [("k1", None, "A", "https://a.co", None, "X", "US", False), ("k1", None, "B", None, None, "X", "US", False), ("k9", None, "R", None, None, "X", "US", True)]
    second = [("k1", None, "C", None, None, "X", "US", False), ("k2", None, "A", "https://a.co", None, "X", "US", False), ("k9", None, "R", None, None, "X", "US", False)]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    for i in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*")) if i else None
    dedup.dedup_stream(stream, str(tmp_path / "kept"), str(tmp_path / "ck"), F.col("bad")).awaitTermination()
    kept = runs.read_log(spark, str(tmp_path / "kept"), dedup.KEPT)
    assert sorted(r["kgmid"] for r in kept.collect()) == ["k1", "k9"]
