import math
import random

import numpy as np
from pyspark.sql import functions as F

from leadloom.functions import geo
from leadloom.operators import spatial


def test_coordinates_in_many_writings(spark):
    rows = [("48.5", 48.5), (" -17.25 ", -17.25), ("52,2029842", 52.2029842), ("48.49504°", 48.49504), ("40.0034668°N", 40.0034668), ("17.41 S", -17.41), ("-17.41 S", -17.41), ("N 5.5", 5.5), ("12 E", None), ("N/A", None), ("unknown", None), ("-", None), ("", None), (None, None), ("90.01", None), ("−3.5", -3.5), (".5", 0.5)]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, a string").select("i", geo.coordinate(F.col("a"), "lat").alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [b for _, b in rows]


def _metres(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(h)))


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    points = {}
    for base in ((0, 0), (48.2, 11.5), (-33.9, 151.2), (89.9999, 10), (-90, 0), (60, 179.9999), (12, -180)):
        for _ in range(25):
            lat = max(-90.0, min(90.0, base[0] + rng.uniform(-0.0008, 0.0008)))
            lon = base[1] + rng.uniform(-0.0008, 0.0008) * (1 if abs(base[0]) < 80 else 90000)
            points[f"p{len(points)}"] = (lat, (lon + 180) % 360 - 180)
    points["twin"] = points["p1"]
    points["east"], points["west"] = (5.0, 180.0), (5.0, -180.0)
    rows = [(k, *v) for k, v in points.items()]
    got = {tuple(r) for r in spatial.near_pairs(spark.createDataFrame(rows, "id string, lat double, lon double"), 50.0).collect()}
    want = {(a, b) for a in points for b in points if a < b and _metres(points[a], points[b]) <= 50.0}
    assert got == want and ("p1", "twin") in got and ("east", "west") in got


def test_near_pairs_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, lat double, lon double")
    assert spatial.near_pairs(empty, 50.0).collect() == []


def test_located_counts_a_record_once(spark):
    d = spark.createDataFrame([("a", "1,5", "2.5", 1), ("a", "1,5", "2.5", 1), ("b", "0", "0.0", 2), (None, "1", "1", 3), ("c", None, "1", 4)], "record_id string, latitude string, longitude string, cell int")
    assert [tuple(r) for r in spatial.located(d, "record_id", "latitude", "longitude").collect()] == [("a", 1.5, 2.5)]


def _inside(lat, lon, ring):
    odd = False
    for p, q in zip(ring, ring[1:] + ring[:1]):
        if (p[0] > lat) != (q[0] > lat) and lon < (q[1] - p[1]) * (lat - p[0]) / (q[0] - p[0]) + p[1]:
            odd = not odd
    return odd


def test_regions_equal_brute_force(spark):
    rng = random.Random(5)
    star = [(10 + r * math.sin(t * math.pi / 5), 20 + r * math.cos(t * math.pi / 5)) for t, r in enumerate([8, 3] * 5)]
    rings = {"star": star, "closed": [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)], "small": [(10.001, 20.0), (10.002, 20.001), (10.0, 20.002)], "line": [(1.0, 1.0), (2.0, 2.0)], "none": None}
    points = {f"p{i}": (rng.uniform(-2, 20), rng.uniform(-2, 30)) for i in range(300)} | {"m": (10.001, 20.001)}
    areas = spark.createDataFrame([(k, None if v is None else [{"lat": a, "lon": b} for a, b in v]) for k, v in rings.items()], "area_id string, ring array<struct<lat double, lon double>>")
    d = spark.createDataFrame([(k, *v) for k, v in points.items()], "id string, lat double, lon double")
    got = {tuple(r) for r in spatial.regions_of_points(d, areas, "area_id", "ring").collect()}
    want = {(p, a) for p, (lat, lon) in points.items() for a, ring in rings.items() if ring and len(ring) > 2 and _inside(lat, lon, ring)}
    assert got == want


def test_cover_ranges_are_sorted_and_apart():
    ring = np.array([(0.0, 0.0), (0.0, 3.0), (2.0, 3.0)])
    ranges = spatial.cover_ring(ring[:, 0], ring[:, 1])
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:])) and any(r[2] for r in ranges)
