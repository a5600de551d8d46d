"""Coordinates, Morton codes, distances and point in polygon as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Bits of each axis in a code; 2^-26 of 180 degrees is 0.3 m.
BITS = 26

_NUMBER = r"^([NSEWnsew])?\s*([+-]?(?:\d+\.?\d*|\.\d+))\s*[°º]?\s*([NSEWnsew])?$"


def coordinate(raw: Column, axis: str) -> Column:
    """Degrees from text, however the decimal mark, degree sign and compass letter are written.

    `axis` is "lat" or "lon". NULL where the text is missing, unreadable, has a letter of the other axis
    or is out of range. A letter S or W makes the number negative.
    """
    text = F.translate(F.trim(F.regexp_replace(raw.cast("string"), r"[\s ]+", " ")), ",−", ".-")
    plus, minus, most = ("N", "S", 90.0) if axis == "lat" else ("E", "W", 180.0)

    def read(t: Column) -> Column:
        letter = F.upper(F.concat(F.regexp_extract(t, _NUMBER, 1), F.regexp_extract(t, _NUMBER, 3)))
        return F.struct(F.regexp_extract(t, _NUMBER, 2).try_cast("double").alias("n"), letter.alias("l"))

    value = F.transform(F.transform(F.array(text), read), lambda r: F.when(r["l"].isin("", plus), r["n"]).when(r["l"] == minus, -F.abs(r["n"])))
    return F.get(F.filter(value, lambda v: v.between(-most, most)), F.lit(0))


def _spread(x: Column) -> Column:
    """x with a zero between any two bits: its binary digits read to the base 4."""
    return F.conv(F.bin(x), 4, 10).cast("long")


def axis_cell(value: Column, least: float, span: float) -> Column:
    """Number of the smallest cell along an axis, from 0 to 2^BITS - 1."""
    return F.least(F.floor((value - least) / span * (1 << BITS)).cast("long"), F.lit((1 << BITS) - 1).cast("long"))


def morton(x: Column, y: Column) -> Column:
    """Position on the Z-order curve of the cell in column x and row y."""
    return _spread(x.cast("long")).bitwiseOR(F.shiftleft(_spread(y.cast("long")), 1))


def code(lat: Column, lon: Column) -> Column:
    return morton(axis_cell(lon, -180.0, 360.0), axis_cell(lat, -90.0, 180.0))


def haversine(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in metres on a sphere."""
    h = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def point_in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd rule over the edges of `ring`, an array of structs lat, lon; closing the ring is optional."""
    n = F.size(ring)

    def crossing(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
        return F.when(spans & (lon < at), 1).otherwise(0)

    crossings = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + crossing(i))
    return F.coalesce(F.when(n >= 3, crossings % 2 == 1), F.lit(False))


def row_bits(radius_m: float) -> int:
    """Bits of the latitude rows that are at least as high as the disc of this radius is wide."""
    return max(0, min(BITS - 1, int(math.floor(math.log2(math.pi * EARTH_M / (2.002 * radius_m))))))
