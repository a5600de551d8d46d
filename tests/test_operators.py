import pytest
from pyspark.sql import functions as F

from leadloom.operators import filters, identity
from leadloom.operators.skew import salted_join
from leadloom.plans import leads
from leadloom.schema import LEAD_COLUMNS
from leadloom.sources import sinks

RECORD = [("https://a.com", "20", "4.5", "a@a.com", "Dallas", None, "yes", "1")]
SCHEMA = "website string, review_count string, rating string, emails string, city string, state string, flag string, one string"


@pytest.mark.parametrize(
    ("given", "kept"),
    [
        ({"include_all": [{"city": "Dallas"}]}, True),
        ({"include_all": [{"city": "Austin"}]}, False),
        ({"include_all": [{"city": "Dallas"}, {"field": "reviews", "op": ">=", "value": 20}]}, True),
        ({"include_all": ["reviews >= 30"]}, False),
        ({"include_any": [{"city": "Austin"}, {"review_count": 20}]}, True),
        ({"exclude_all": [{"city": "Dallas"}]}, False),
        ({"exclude_any": [{"city": "Austin"}]}, True),
        ({"include_all": [{"field": "city", "op": "in", "value": ["Dallas", "Austin"]}]}, True),
        ({"include_all": [{"field": "city", "op": "notin", "value": ["Dallas", "Austin"]}]}, False),
        ({"include_all": ["city != Dallas"]}, False),
        ({"include_all": [{"city": "Austin", "negate": True}]}, True),
        ({"include_all": ["state <= 0"]}, False),
        ({"include_all": [{"field": "state", "op": ">=", "value": 1, "negate": True}]}, True),
        ({"include_all": ["flag > 0"]}, True),
        ({"include_all": [{"field": "one", "op": "in", "value": [1]}]}, True),
        ({"include_all": [{"field": "one", "op": "in", "value": ["1"]}]}, False),
        ({"include_all": [{"field": "flag", "op": "contains", "value": "True"}]}, True),
        ({"include_all": [{"email_found": True}, {"website": "yes"}]}, True),
        ({}, True),
    ],
)
def test_filters(spark, given, kept):
    d = spark.createDataFrame(RECORD, SCHEMA)
    assert (filters.apply(d, given).count() == 1) is kept


def test_conditions_are_refused_early():
    with pytest.raises(ValueError):
        filters.parse("city ~ x")
    with pytest.raises(ValueError):
        filters.parse(3)
    early, late = filters.split({"include_all": [{"city": "x"}, {"email_found": 1}]})
    assert early == {"include_all": [{"city": "x"}]} and late == {"include_all": [{"email_found": 1}]}


def test_identity_ladder(spark):
    rows = [("/g/1", "p", "A", "http://a.com", "555-000-1234", "Dallas"), (None, "p", "A", None, None, None), ("N/A", "N/A", "A", "a.com", None, "Dallas"), (None, None, "A", None, "555-000-1234", None), (None, None, "A", None, None, "Dallas"), (None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "kgmid string, place_id string, business_name string, website string, phone string, city string")
    got = d.select(identity.identity(d.columns).alias("i")).collect()
    assert [r["i"]["key_type"] for r in got] == ["kgmid", "place_id", "domain+city", "phone", "name+city", "none"]
    assert got[-1]["i"]["identity_key"] is None and len(got[0]["i"]["identity_key"]) == 40


def test_first_wins_and_claims(spark):
    d = spark.createDataFrame([("b", "x", "u"), ("a", "x", "u"), ("c", None, "v"), ("d", None, None)], "id string, k string, url string")
    assert sorted(r["id"] for r in identity.first_wins(d, ["k"], ["id"]).collect()) == ["a", "c", "d"]
    claims = {r["id"]: r["url"] for r in identity.first_claims(d, "id", "id", ["url"]).collect()}
    assert claims == {"a": "u", "b": None, "c": "v", "d": None}
    assert sorted(r["id"] for r in identity.unseen(d, spark.createDataFrame([("x",)], "k string"), ["k"]).collect()) == ["c", "d"]


def test_salted_join_splits_hot_keys(spark):
    left = spark.range(500).select(F.lit("h").alias("k"), F.col("id").alias("a")).unionByName(spark.createDataFrame([("c", 1000)], "k string, a long"))
    right = spark.createDataFrame([("h", 1), ("h", 2), ("c", 3), ("z", 4)], "k string, b long")
    got = salted_join(left, right, ["k"], "a", 50)
    assert got.count() == 1001 and got.distinct().count() == 1001


def test_leads_quality_and_export(spark, tmp_path):
    rows = [("q", 1, "Acme", "555-000-1234", "www.acme.com", "Dallas", "US", "4.8 (365)", "N/A", ["Great work", "ok"]), ("q", 2, "Acme", "555-000-1234", "acme.com", "Dallas", "US", "4.8 (365)", None, []), ("q", 3, "", None, None, None, None, "9.9", None, None)]
    listings = spark.createDataFrame(rows, "query string, _position int, business_name string, phone string, website string, city string, country string, rating string, review_count string, _reviews array<string>")
    out = leads.leads_of(listings)
    assert out.count() == 2
    one = out.where("business_name is not null").first()
    assert (one["position"], one["website"], one["phone"], one["rating"], one["review_count"]) == (1, "https://acme.com", "+15550001234", 4.8, 365)
    bad = spark.createDataFrame([(None, "9.9", "x\x00"), ("A", "x", "y"), ("A", "4.5", "y")], "business_name string, rating string, address string")
    assert [r[0] for r in bad.select(leads.quality_issues(bad)).collect()] == [["missing_name", "rating_out_of_range:9.9", "control_chars_in:address"], ["rating_non_numeric"], []]
    sinks.write_csv(out, str(tmp_path / "csv"))
    back = sinks.read_csv(spark, str(tmp_path / "csv"))
    assert back.columns == LEAD_COLUMNS and back.count() == 2 and len(LEAD_COLUMNS) == 72
    with pytest.raises(ValueError):
        leads.export_columns(out, ["city"])


def test_records_are_committed_once_and_streams_too(spark, tmp_path):
    from leadloom.streaming.dedup import commit_stream

    path = str(tmp_path / "records")
    d = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "record_id string, v int")
    assert sinks.commit_records(d, path).count() == 2 and sinks.commit_records(d, path).count() == 0
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "query string, _position int, business_name string, place_id string, city string"
    for i in range(2):
        spark.createDataFrame([("q", 1, "A", "p1", "X"), ("q", 2, "B", f"p{i + 2}", "X")], schema).write.mode("append").json(source)
    stream = commit_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source), target, str(tmp_path / "cp"))
    stream.awaitTermination(120)
    assert spark.read.parquet(target).count() == 3
