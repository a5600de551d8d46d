"""Points near other points, and the regions that contain them, by cells of a space-filling curve."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import geo
from leadloom.operators.skew import salted_join

#: Bits a axis of the buckets in which code ranges are joined.
BUCKET_BITS = 8
#: Halvings of a region's box until its boundary cells are left as they are.
DEPTH = 5


def located(df: DataFrame, id_col: str, lat_col: str, lon_col: str) -> DataFrame:
    """(id, lat, lon) of the rows with a usable location, one for an id; both coordinates 0 is none."""
    d = df.select(F.col(id_col).alias("id"), geo.coordinate(F.col(lat_col), "lat").alias("lat"), geo.coordinate(F.col(lon_col), "lon").alias("lon"))
    return d.where(F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~((F.col("lat") == 0) & (F.col("lon") == 0))).dropDuplicates(["id"])


def _column_bits(row: Column, bits: int, radius_m: float) -> Column:
    """Bits of the columns in a row of cells, fewer towards the poles, so that a cell stays wider than a disc."""
    step = 180.0 / (1 << bits)
    edge = F.greatest(F.abs(row * step - 90.0), F.abs((row + 1) * step - 90.0))
    round_m = 2 * math.pi * geo.EARTH_M * F.cos(F.radians(F.least(edge, F.lit(90.0))))
    fit = F.floor(F.log2(F.greatest(round_m / (2.002 * radius_m), F.lit(1.0)))).cast("int")
    return F.least(F.greatest(fit, F.lit(0)), F.lit(bits))


def _cell(row: Column, column: Column, column_bits: Column, bits: int) -> Column:
    """The code at which the cell begins."""
    return geo.morton(column * F.pow(F.lit(2.0), geo.BITS - column_bits).cast("long"), row.cast("long") * (1 << (geo.BITS - bits)))


def near_pairs(points: DataFrame, radius_m: float) -> DataFrame:
    """(id_a, id_b) of all two different points at most `radius_m` apart, id_a the smaller as a string.

    `points` is what located() gives, one row an id. Each point falls into one cell of the Z-order curve;
    its disc is covered by the at most six cells it touches, as no cell is narrower than the disc. Cells and
    cover are joined by the code at which a cell begins, then the great-circle distance decides. Columns are
    wider towards the poles and wrap round at 180 degrees. Cells with very many points are split over tasks.
    """
    bits = geo.row_bits(radius_m)
    rows = 1 << bits
    delta = radius_m / geo.EARTH_M * 1.000001
    lat, lon = F.col("lat"), F.col("lon")
    turns = (lon + 180.0) / 360.0
    own = points.withColumn("row", F.least(F.floor((lat + 90.0) / 180.0 * rows), F.lit(rows - 1)).cast("long"))
    own = own.withColumn("bits", _column_bits(F.col("row"), bits, radius_m)).withColumn("wide", F.pow(F.lit(2.0), F.col("bits")).cast("long"))
    own = own.withColumn("column", F.pmod(F.floor(turns * F.col("wide")), F.col("wide"))).withColumn("cell", _cell(F.col("row"), F.col("column"), F.col("bits"), bits))

    reach = math.degrees(delta)
    half = F.when(F.abs(lat) + reach < 90.0, F.asin(F.least(F.lit(1.0), F.lit(math.sin(delta)) / F.cos(F.radians(lat)))) / (2 * math.pi)).otherwise(F.lit(0.5))
    first = F.greatest(F.floor((lat - reach + 90.0) / 180.0 * rows), F.lit(0)).cast("long")
    last = F.least(F.floor((lat + reach + 90.0) / 180.0 * rows), F.lit(rows - 1)).cast("long")
    cover = points.select(F.col("id").alias("id_b"), lat.alias("lat_b"), lon.alias("lon_b"), turns.alias("turns"), half.alias("half"), F.explode(F.sequence(first, last)).alias("row"))
    cover = cover.withColumn("bits", _column_bits(F.col("row"), bits, radius_m)).withColumn("wide", F.pow(F.lit(2.0), F.col("bits")).cast("long"))
    west, east = F.floor((F.col("turns") - F.col("half")) * F.col("wide")), F.floor((F.col("turns") + F.col("half")) * F.col("wide"))
    cover = cover.withColumn("column", F.explode(F.sequence(west, F.least(east, west + F.col("wide") - 1))))
    cover = cover.select("id_b", "lat_b", "lon_b", _cell(F.col("row"), F.pmod(F.col("column"), F.col("wide")), F.col("bits"), bits).alias("cell"))
    joined = salted_join(own.select(F.col("id").alias("id_a"), lat.alias("lat_a"), lon.alias("lon_a"), "cell"), cover, ["cell"], "id_a")
    near = geo.haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= radius_m
    return joined.where((F.col("id_a") < F.col("id_b")) & near).select("id_a", "id_b")


def _edges_touch(box: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which boxes (n x 4: x0, y0, x1, y1) any of the edges a-b touches."""
    d = b - a
    t0, t1 = np.zeros((len(box), len(a))), np.ones((len(box), len(a)))
    ok = np.ones(t0.shape, bool)
    for axis in (0, 1):
        p, q = a[None, :, axis], d[None, :, axis]
        lo, hi = box[:, axis, None] - p, box[:, axis + 2, None] - p
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = lo / q, hi / q
        flat = np.broadcast_to(q == 0, ok.shape)
        ok &= ~flat | ((lo <= 0) & (hi >= 0))
        t0 = np.where(flat, t0, np.maximum(t0, np.minimum(u, v)))
        t1 = np.where(flat, t1, np.minimum(t1, np.maximum(u, v)))
    return (ok & (t0 <= t1)).any(axis=1)


def _inside(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    spans = (a[None, :, 1] > y[:, None]) != (b[None, :, 1] > y[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b - a)[None, :, 0] * (y[:, None] - a[None, :, 1]) / (b - a)[None, :, 1] + a[None, :, 0]
    return (spans & (x[:, None] < at)).sum(axis=1) % 2 == 1


def _morton_int(x: int, y: int) -> int:
    return sum(((x >> i & 1) << 2 * i) | ((y >> i & 1) << (2 * i + 1)) for i in range(geo.BITS))


def cover_ring(lat: np.ndarray, lon: np.ndarray, depth: int = DEPTH) -> list[tuple[int, int, bool]]:
    """Code ranges (first, last, wholly inside) of quadtree cells that cover a polygon."""
    a = np.column_stack([(lon + 180.0) / 360.0, (lat + 90.0) / 180.0])
    b = np.roll(a, -1, axis=0)
    size = max(float(np.ptp(a[:, 0])), float(np.ptp(a[:, 1])), 2.0**-geo.BITS)
    level = max(0, min(geo.BITS - 1, int(-math.log2(size))))
    stop = min(geo.BITS, level + depth)
    n = 1 << level
    xs = range(max(0, int(a[:, 0].min() * n)), min(n - 1, int(a[:, 0].max() * n)) + 1)
    ys = range(max(0, int(a[:, 1].min() * n)), min(n - 1, int(a[:, 1].max() * n)) + 1)
    cells = np.array([(x, y) for x in xs for y in ys], dtype=np.int64).reshape(-1, 2)
    out: list[tuple[int, int, bool]] = []
    while len(cells):
        side = 0.5**level
        box = np.column_stack([cells * side, (cells + 1) * side])
        touch = _edges_touch(box, a, b)
        whole = ~touch & _inside((cells[:, 0] + 0.5) * side, (cells[:, 1] + 0.5) * side, a, b)
        for some, inside in ((cells[whole], True), (cells[touch] if level == stop else cells[:0], False)):
            for x, y in some.tolist():
                begin = _morton_int(x << (geo.BITS - level), y << (geo.BITS - level))
                out.append((begin, begin + (1 << 2 * (geo.BITS - level)) - 1, inside))
        rest = cells[touch]
        if level == stop:
            break
        cells = np.concatenate([rest * 2 + [dx, dy] for dx in (0, 1) for dy in (0, 1)]) if len(rest) else rest
        level += 1
    out.sort()
    merged: list[tuple[int, int, bool]] = []
    for lo, hi, inside in out:
        if merged and merged[-1][1] + 1 == lo and merged[-1][2] == inside:
            merged[-1] = (merged[-1][0], hi, inside)
        else:
            merged.append((lo, hi, inside))
    return merged


def region_ranges(regions: DataFrame, id_col: str, ring_col: str) -> DataFrame:
    """(region_id, lo, hi, inside): the code ranges of each region; rings of fewer than three points give none."""

    def cover(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for region_id, ring in zip(frame["region_id"], frame["ring"]):
                points = [(p["lat"], p["lon"]) for p in ring if p is not None and p["lat"] is not None and p["lon"] is not None] if ring is not None else []
                if len(points) >= 3:
                    lat, lon = np.array(points, dtype=float).T
                    out += [(region_id, *r) for r in cover_ring(lat, lon)]
            yield pd.DataFrame(out, columns=["region_id", "lo", "hi", "inside"])

    d = regions.select(F.col(id_col).alias("region_id"), F.col(ring_col).alias("ring")).where("region_id is not null")
    return d.mapInPandas(cover, "region_id string, lo long, hi long, inside boolean")


def range_join(points: DataFrame, ranges: DataFrame, point_key: str, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Rows of points whose `code` lies in a range lo..hi.

    Codes are sorted along the curve, so their high bits name a bucket; ranges that span buckets are repeated
    in each. The join is on the bucket, with the range as its condition; hot buckets are split over tasks.
    """
    shift = 2 * (geo.BITS - bucket_bits)
    p = points.withColumn("_bucket", F.shiftright("code", shift))
    r = ranges.withColumn("_bucket", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright("hi", shift))))
    return salted_join(p, r, ["_bucket"], point_key, 100_000).where(F.col("code").between(F.col("lo"), F.col("hi"))).drop("_bucket")


def regions_of_points(points: DataFrame, regions: DataFrame, id_col: str, ring_col: str) -> DataFrame:
    """(id, region_id) of each point of located() and each region whose ring contains it.

    Points in a range that is wholly inside are done; the rest are held against the ring by the even-odd rule.
    """
    coded = points.withColumn("code", geo.code(F.col("lat"), F.col("lon")))
    hits = range_join(coded, region_ranges(regions, id_col, ring_col), "id")
    rings = regions.select(F.col(id_col).alias("region_id"), F.col(ring_col).alias("ring"))
    sure = hits.where("inside").select("id", "region_id")
    edge = hits.where("not inside").join(rings, "region_id").where(geo.point_in_ring(F.col("lat"), F.col("lon"), F.col("ring"))).select("id", "region_id")
    return sure.unionByName(edge)


def within_regions(df: DataFrame, key: str, lat: str, lon: str, regions: DataFrame, region_id: str, ring: str) -> DataFrame:
    """Rows of `df` (unique key) that lie in a region, and those without a readable location, which nothing is known against."""
    points = located(df, key, lat, lon)
    inside = regions_of_points(points, regions, region_id, ring).select(F.col("id").alias(key)).distinct()
    nowhere = df.select(key).join(points.select(F.col("id").alias(key)), key, "left_anti")
    return df.join(inside.unionByName(nowhere), key, "left_semi")
