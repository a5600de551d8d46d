import pytest
from pyspark.sql import functions as F

from leadloom.functions import places


def test_listing_ids(spark):
    pin = "https://maps.example/maps/place/Acme+Co/@1.0,2.0,17z/data=!1s0x86:0x10!8m2!3d29.8!4d-95.4!16s%2Fg%2F1abcXYZ"
    far = "https://maps.example/maps/place/A/@1.0,2.0,10z/data=!3d29.8!4d-95.4"
    d = spark.createDataFrame([(0, pin), (1, far), (2, None), (3, "https://x.example/maps/@29.8,-95.4,15z")], "i int, u string")
    a, b, c, e = (r["p"] for r in d.select("i", places.listing_ids(F.col("u")).alias("p")).orderBy("i").collect())
    assert (a["place_id"], a["cid"], a["latitude"], a["longitude"], a["kgmid"], a["place_name"]) == ("0x86:0x10", "0x86:0x10", 29.8, -95.4, "1abcXYZ", "Acme+Co")
    assert b["latitude"] is None and c["place_id"] is None and e["latitude"] is None


def test_boxes_and_grids(spark):
    box = places.Box.parse("0,0,0.2,0.2")
    assert places.grid(spark, box, 3).count() == box.cell_count(3) and places.grid(spark, places.Box(0, 0, 0.001, 0.001), 3).collect()[0]["lat"] == 0.0005
    for bad in ("1,2,3", "a,b,c,d", "1,0,0,1", "0,0,91,1", "0,2,1,1"):
        with pytest.raises(ValueError):
            places.Box.parse(bad)


def test_geojson():
    ring = [[0, 0], [10, 0], [10, 10], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}, {"type": "Feature", "geometry": None}]}
    rings = places.geojson_rings(doc)
    assert len(rings) == 3 and rings[0][1] == (0, 10)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("123 Main St, Dallas, TX 75201", ("Dallas", "TX", "75201")),
        ("123 Queen St W, Toronto, ON M5V 3A8, Canada", ("Toronto", "ON", "M5V 3A8")),
        ("10 Rue de Rivoli, 75001 Paris, France", ("Paris", None, "75001")),
        ("Av. Corrientes 1234, Buenos Aires, A1234ABC", ("Buenos Aires", None, "A1234ABC")),
        ("", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_addresses(text, want):
    got = places.address_of(text)
    assert (got["city"], got["region"], got["postal_code"]) == want


def test_decision_makers(spark):
    assert places.decision_maker("Meet the crew. Jane Doe, Owner of it all.") == ("Jane Doe", "Owner")
    assert places.decision_maker("CEO: Hugo Lund-Berg leads.")[0] == "Hugo Lund-Berg" and places.decision_maker("Our Team, Manager") == (None, None)
    d = spark.createDataFrame([("Jane Doe, Owner",), (None,)], "t string")
    assert [tuple(r["p"]) for r in d.select(places.decision_maker_struct(F.col("t")).alias("p")).collect()] == [("Jane Doe", "Owner"), (None, None)]
