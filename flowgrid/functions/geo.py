"""Geometry as column expressions: projection, the hexagonal lattice, distances, rings.

Rings are array<struct<x: double, y: double>>; a polygon is an array of rings (the first is the shell,
the others are holes).  Distances and areas are in metres on ETRS89 / UTM; longitudes and latitudes in
degrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 and the UTM constants (fixed values); Krueger's series to the third order.
A, FLATTENING, K0, EASTING = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0
N = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)
ECC = 2 * math.sqrt(N) / (1 + N)


def _atanh(x: Column) -> Column:
    return 0.5 * F.ln((1 + x) / (1 - x))


def utm(lon: Column, lat: Column, zone: int = 31) -> tuple[Column, Column]:
    """Easting and northing in a northern UTM zone, to a fraction of a millimetre within the zone."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(_atanh(s) - ECC * _atanh(ECC * s))
    xi, eta = F.atan2(t, F.cos(lam)), _atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EASTING + K0 * RADIUS * x, K0 * RADIUS * y


def lonlat(x: Column, y: Column, zone: int = 31) -> tuple[Column, Column]:
    """The inverse of utm."""
    xi, eta = y / (K0 * RADIUS), (x - EASTING) / (K0 * RADIUS)
    u, v = xi, eta
    for j, b in enumerate(BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (zone * 6 - 183), F.degrees(phi)


# The lattice: pointy-top hexagons of CELL_AREA over UTM metres, ids of 15 hexadecimal digits.

CELL_AREA = 737_327.0
SIDE = math.sqrt(2 * CELL_AREA / (3 * math.sqrt(3)))
_SHIFT = 1 << 27


def cell_axes(x: Column, y: Column) -> tuple[Column, Column]:
    """Axial coordinates (q, r) of the hexagon around a point, by rounding cube coordinates."""
    q, r = (x * math.sqrt(3) / 3 - y / 3) / SIDE, y * 2 / 3 / SIDE
    s = -q - r
    rq, rr, rs = F.round(q), F.round(r), F.round(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q_out = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    r_out = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return q_out.cast("bigint"), r_out.cast("bigint")


def cell_id(q: Column, r: Column) -> Column:
    return F.lower(F.concat(F.lit("8"), F.lpad(F.hex(q + _SHIFT), 7, "0"), F.lpad(F.hex(r + _SHIFT), 7, "0")))


def cell_of(x: Column, y: Column) -> Column:
    return cell_id(*cell_axes(x, y))


def axes_of(cell: Column) -> tuple[Column, Column]:
    part = lambda at: F.conv(F.substring(cell, at, 7), 16, 10).cast("bigint") - _SHIFT
    return part(2), part(9)


def cell_center(q: Column, r: Column) -> tuple[Column, Column]:
    return SIDE * math.sqrt(3) * (q + r / 2), SIDE * 1.5 * r


def cell_ring(q: Column, r: Column) -> Column:
    """The six corners, counter-clockwise."""
    x, y = cell_center(q, r)
    corner = lambda k: F.struct((x + SIDE * math.sin(k * math.pi / 3)).alias("x"), (y - SIDE * math.cos(k * math.pi / 3)).alias("y"))
    return F.array(*[corner(k) for k in range(6)])


def cells_in_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """array<struct<q, r>> of all cells whose hexagon may touch a box (their centres lie within a side of it)."""
    low, high = F.floor((y0 - SIDE) / (1.5 * SIDE)), F.ceil((y1 + SIDE) / (1.5 * SIDE))
    width = math.sqrt(3) * SIDE

    def row(r: Column) -> Column:
        first, last = F.floor((x0 - SIDE) / width - r / 2), F.ceil((x1 + SIDE) / width - r / 2)
        return F.transform(F.sequence(first.cast("bigint"), last.cast("bigint")), lambda q: F.struct(q.alias("q"), r.cast("bigint").alias("r")))

    return F.flatten(F.transform(F.sequence(low.cast("bigint"), high.cast("bigint")), row))


def as_id(number: Column) -> Column:
    """A numeric cell id as its 15 lower-case hexadecimal digits, and back."""
    return F.lower(F.hex(number))


def as_number(cell: Column) -> Column:
    return F.conv(cell, 16, 10).cast("bigint")


def tile_key(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    return F.floor(x / size).cast("bigint"), F.floor(y / size).cast("bigint")


def quadkey(lon: Column, lat: Column, zoom: int) -> Column:
    """The web-mercator tile that holds a point, as a quadkey."""
    n = 1 << zoom
    at = lambda v: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(v * n))).cast("int")
    s = F.sin(F.radians(lat))
    x, y = at((lon + 180) / 360), at(0.5 - F.ln((1 + s) / (1 - s)) / (4 * math.pi))
    digit = lambda i: F.shiftright(x, i).bitwiseAND(1) + 2 * F.shiftright(y, i).bitwiseAND(1)
    return F.concat(*[digit(i).cast("string") for i in reversed(range(zoom))])


# Distances and rings


def distance(x: Column, y: Column, u: Column, v: Column) -> Column:
    return F.sqrt((x - u) * (x - u) + (y - v) * (y - v))


def edges(ring: Column, closed: bool = True) -> Column:
    """array<struct<a, b>>: the ring's edges, the last one back to the start if it is closed."""
    n = F.size(ring)
    last = n - 1 if closed else n - 2
    pair = lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % n).alias("b"))
    none = F.expr("cast(array() as array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>)")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), pair)).otherwise(none)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column) -> Column:
    return _total(F.transform(edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def area(polygon: Column) -> Column:
    """The shell's area without the holes'."""
    rings = F.transform(polygon, lambda r: F.abs(signed_area(r)))
    return 2 * F.coalesce(F.get(rings, F.lit(0)), F.lit(0.0)) - _total(rings)


def centroid(polygon: Column) -> Column:
    """struct(x, y) of the shell's centroid; the first corner if it has no area."""
    ring = F.get(polygon, F.lit(0))
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    moment = lambda c: _total(F.transform(edges(ring), lambda e: (e["a"][c] + e["b"][c]) * cross(e)))
    a = signed_area(ring)
    first = F.get(ring, F.lit(0))
    of = lambda c: F.when(F.abs(a) > 1e-12, moment(c) / (6 * a)).otherwise(first[c])
    return F.struct(of("x").alias("x"), of("y").alias("y"))


def contains(polygon: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside: an odd number of all rings' edges is crossed to its right."""

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.when(b["y"] != a["y"], b["y"] - a["y"])
        return F.coalesce((spans & (x < at)).cast("int"), F.lit(0))

    count = F.aggregate(F.flatten(F.transform(polygon, lambda r: edges(r))), F.lit(0), lambda n, e: n + crossed(e))
    return count % 2 == 1


def segment_distance(x: Column, y: Column, e: Column) -> Column:
    a, b = e["a"], e["b"]
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length = dx * dx + dy * dy
    t = F.coalesce(((x - a["x"]) * dx + (y - a["y"]) * dy) / F.when(length > 0, length), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return distance(x, y, a["x"] + t * dx, a["y"] + t * dy)


def line_distance(line: Column, x: Column, y: Column) -> Column:
    return F.array_min(F.transform(edges(line, closed=False), lambda e: segment_distance(x, y, e)))


def polygon_distance(polygon: Column, x: Column, y: Column) -> Column:
    """0 inside, else the least distance to an edge."""
    outside = F.array_min(F.transform(F.flatten(F.transform(polygon, lambda r: edges(r))), lambda e: segment_distance(x, y, e)))
    return F.when(contains(polygon, x, y), 0.0).otherwise(outside)


def bounds(polygon: Column) -> Column:
    """struct(x0, y0, x1, y1) of the shell."""
    ring = F.get(polygon, F.lit(0))
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def valid_rings(polygon: Column, least: float = 1e-9) -> Column:
    """The polygon without rings of less than the least area."""
    return F.filter(polygon, lambda r: F.abs(signed_area(r)) > least)


def parse_wkt(wkt: Column) -> Column:
    """Rings (POLYGON), or one ring of vertices (LINESTRING, POINT), from text; null if there are no numbers."""
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    point = lambda p: F.struct(
        F.get(F.split(F.trim(p), r"\s+"), F.lit(0)).try_cast("double").alias("x"), F.get(F.split(F.trim(p), r"\s+"), F.lit(1)).try_cast("double").alias("y")
    )
    return F.when(F.size(rings) > 0, F.transform(rings, lambda r: F.transform(F.split(r, ","), point)))
