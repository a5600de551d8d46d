"""Listing URLs, grids of cells, boxes, GeoJSON, address parts and decision makers."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.32


def listing_ids(url: Column) -> Column:
    """A struct of what a listing's URL tells: query, place name, place id, pin and entity id.

    Ids and pin are read from the decoded URL; a pin counts only at a zoom of 15 or closer, 17 where none is written.
    """
    u = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    part = lambda pattern, group=1: F.nullif(F.regexp_extract(u, pattern, group), F.lit(""))
    close = F.coalesce(part(r",(-?\d{1,2})(?:\.\d+)?z").try_cast("int"), F.lit(17)) >= 15
    pin = r"!3d(-?\d+\.\d+)!4d(-?\d+\.\d+)"
    place = part(r"!1s(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)")
    return F.struct(
        part(r"/maps/search/([^/]+)").alias("query"), part(r"/maps/place/([^/]+)").alias("place_name"), place.alias("place_id"), place.alias("cid"),
        F.when(close, part(pin, 1).try_cast("double")).alias("latitude"), F.when(close, part(pin, 2).try_cast("double")).alias("longitude"), part(r"(?i)/g/([0-9a-z_-]+)").alias("kgmid"),
    )


@dataclass(frozen=True)
class Box:
    min_lat: float
    min_lon: float
    max_lat: float
    max_lon: float

    @classmethod
    def parse(cls, text: str) -> Box:
        """A box from "minLat,minLon,maxLat,maxLon"; ValueError where it isn't one."""
        try:
            a, b, c, d = (float(x) for x in text.split(","))
        except ValueError as error:
            raise ValueError(f"not a box of four numbers: {text!r}") from error
        if not (-90 <= a < c <= 90 and -180 <= b < d <= 180):
            raise ValueError(f"not in order or out of range: {text!r}")
        return cls(a, b, c, d)

    def steps(self, km: float) -> tuple[float, float, int, int]:
        """Height and width of a cell in degrees, rows and columns; a box too small for a cell has none."""
        km = km if km > 0 else 1.0
        height = km / KM_PER_DEGREE
        width = km / (KM_PER_DEGREE * max(1e-6, abs(math.cos(math.radians((self.min_lat + self.max_lat) / 2)))))
        count = lambda span, step: max(0, math.floor((span - step / 2) / step) + 1)
        return height, width, count(self.max_lat - self.min_lat, height), count(self.max_lon - self.min_lon, width)

    def cell_count(self, km: float) -> int:
        _, _, rows, columns = self.steps(km)
        return max(1, rows * columns)


def grid(spark: SparkSession, box: Box, km: float) -> DataFrame:
    """(lat, lon) of the centres of the cells that cover a box; its own centre where it is smaller than a cell."""
    height, width, rows, columns = box.steps(km)
    if not rows * columns:
        return spark.range(1).select(F.lit((box.min_lat + box.max_lat) / 2).alias("lat"), F.lit((box.min_lon + box.max_lon) / 2).alias("lon"))
    i = spark.range(rows * columns)
    return i.select((box.min_lat + height * (F.floor(F.col("id") / columns) + 0.5)).alias("lat"), (box.min_lon + width * (F.pmod("id", F.lit(columns)) + 0.5)).alias("lon"))


def geojson_rings(document: str | dict) -> list[list[tuple[float, float]]]:
    """Outer rings as (lat, lon) points of all polygons in a feature collection, a feature or a geometry."""
    doc = json.loads(document) if isinstance(document, str) else document
    if doc.get("type") == "FeatureCollection":
        return [ring for f in doc.get("features", []) for ring in geojson_rings(f)]
    if doc.get("type") == "Feature":
        return geojson_rings(doc.get("geometry") or {})
    points = doc.get("coordinates") or []
    outer = {"Polygon": [points[0]] if points else [], "MultiPolygon": [p[0] for p in points if p], "Point": [[points]] if points else []}.get(doc.get("type"), [])
    return [[(p[1], p[0]) for p in ring] for ring in outer]


# Country names, and the patterns of postal codes that tell a country.
COUNTRIES = {"united states": "US", "usa": "US", "u.s.a.": "US", "us": "US", "canada": "CA", "united kingdom": "GB", "uk": "GB", "great britain": "GB", "england": "GB", "germany": "DE", "deutschland": "DE", "france": "FR", "spain": "ES", "españa": "ES", "russia": "RU", "argentina": "AR", "australia": "AU", "new zealand": "NZ", "austria": "AT", "switzerland": "CH", "italy": "IT", "netherlands": "NL", "ireland": "IE", "mexico": "MX", "brazil": "BR", "india": "IN"}
POSTAL = [("CA", r"\b[A-Z]\d[A-Z] ?\d[A-Z]\d\b"), ("GB", r"\b[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b"), ("AR", r"\b[A-Z]\d{4}[A-Z]{3}\b"), ("US", r"\b\d{5}(?:-\d{4})?\b"), ("", r"\b\d{4,6}\b")]


def address_of(text: str | None) -> dict[str, str | None]:
    """City, region, postal code and country of an address in one line, each None where it isn't told.

    Parts stand between commas, lines, dots and bars. The postal code is the last match in a part that isn't
    the first; the region is an upper-case abbreviation beside it; the city is its part's rest, else the part
    before it.
    """
    out: dict[str, str | None] = {"city": None, "region": None, "postal_code": None, "country": None}
    parts = [p.strip() for p in re.split(r"[,\n·|]", text or "") if p.strip()]
    if not parts:
        return out
    if (land := COUNTRIES.get(parts[-1].lower())) and len(parts) > 1:
        out["country"] = land
        parts = parts[:-1]
    for land, pattern in POSTAL:
        if land and out["country"] not in (None, land):
            continue
        at = next((i for i in range(len(parts) - 1, -1, -1) if re.search(pattern, parts[i]) and (i > 0 or len(parts) == 1)), None)
        if at is not None:
            code = list(re.finditer(pattern, parts[at]))[-1]
            out["postal_code"] = code.group()
            rest = (parts[at][: code.start()] + " " + parts[at][code.end() :]).strip()
            region = re.search(r"\b[A-Z]{2,3}$", rest)
            if region:
                out["region"] = region.group()
                rest = rest[: region.start()].strip()
            before = parts[at - 1] if at > 1 or (at == 1 and not re.search(r"\d", parts[0])) else None
            out["city"] = rest or before
            out["country"] = out["country"] or land or None
            if land == "US" and not out["region"]:
                out["country"] = out["country"] if out["country"] != "US" or (text or "").lower().rstrip(" .").endswith(("united states", "usa", "us")) else None
            return out
    cities = [p for p in parts[1:] if not re.search(r"\d", p)]
    region = next((p for p in cities if re.fullmatch(r"[A-Z]{2,3}", p)), None)
    out["region"], out["city"] = region, next((p for p in cities if p != region), None)
    return out


def address_struct(c: Column) -> Column:
    """address_of() of a column."""

    @F.pandas_udf("struct<city: string, region: string, postal_code: string, country: string>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([address_of(t) for t in texts], columns=["city", "region", "postal_code", "country"])

    return parse(c.cast("string"))


# Titles of those who decide, and words that are no part of a person's name.
TITLES = "Chief Executive Officer|Vice President|Managing Director|General Manager|Co-Founder|CEO|Founder|Owner|President|Principal|Partner|Manager|Director|Proprietor"
NO_PERSON = frozenset("sponsor sponsors main team staff company llc inc co plumbing plumbers services service group about us me him her them our the contact email call meet ask message reach hire home privacy terms street avenue road".split())
_PERSON = r"(?:[A-ZÀ-ÖØ-Ý][\w'’.-]*)(?:\s+[A-ZÀ-ÖØ-Ý][\w'’.-]*){1,3}"
_WITH_TITLE = re.compile(rf"(?P<a>{_PERSON})\s*[,;:\-–—]\s*(?P<t1>(?i:{TITLES}))\b|(?P<t2>(?i:{TITLES}))\s*[,;:\-–—]?\s+(?P<b>{_PERSON})")


def decision_maker(text: str | None) -> tuple[str | None, str | None]:
    """The first name of two to four words that stands beside a title, and the title."""
    for m in _WITH_TITLE.finditer(text or ""):
        name = (m.group("a") or m.group("b")).strip(" .,-")
        words = name.lower().split()
        if 2 <= len(words) <= 4 and len(set(words)) == len(words) and not NO_PERSON & set(words) and not re.search(rf"(?i)\b(?:{TITLES})\b", name):
            return name, m.group("t1") or m.group("t2")
    return None, None


def decision_maker_struct(c: Column) -> Column:
    """decision_maker() of a column."""

    @F.pandas_udf("struct<name: string, title: string>")
    def find(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decision_maker(t) for t in texts], columns=["name", "title"])

    return find(c.cast("string"))
