"""Distances, projection and polyline measures as column expressions.

Coordinates are WGS84 degrees; a polyline is an array of (lon, lat) structs, a projected one of (x, y).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
EARTH_M = 6371000.0
# WGS84 ellipsoid and the transverse Mercator scale.
SEMI_MAJOR, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_E = 2 * _N**0.5 / (1 + _N)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_KM) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
         * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return F.lit(2 * radius) * F.asin(F.sqrt(a))


def utm_zone(lon: Column) -> Column:
    return F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")


def central_meridian(zone: Column) -> Column:
    return zone.cast("double") * 6 - 183


def project(lon: Column, lat: Column, meridian: Column | float) -> Column:
    """Transverse Mercator metres as a struct (x, y): Krueger series of third order."""
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(_E) * F.atanh(F.lit(_E) * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = F.lit(SCALE * _RADIUS)
    return F.struct((F.lit(500000.0) + k * east).alias("x"), (k * north).alias("y"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; lambda bodies get no common-subexpression pass."""
    return F.transform(F.array(value), body)[0]


def project_line(coords: Column, meridian: Column | float) -> Column:
    """Projected polyline; every intermediate of the series is bound once per point."""
    k = F.lit(SCALE * _RADIUS)

    def angles(p):
        s = F.sin(F.radians(p["lat"]))
        return F.struct(F.sinh(F.atanh(s) - F.lit(_E) * F.atanh(F.lit(_E) * s)).alias("t"),
                        F.radians(p["lon"] - meridian).alias("lam"))

    def sphere(v):
        return F.struct(F.atan2(v["t"], F.cos(v["lam"])).alias("xi"),
                        F.atanh(F.sin(v["lam"]) / F.sqrt(F.lit(1.0) + v["t"] * v["t"])).alias("eta"))

    def plane(v):
        east, north = v["eta"], v["xi"]
        for j, a in enumerate(_ALPHA, 1):
            east = east + F.lit(a) * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
            north = north + F.lit(a) * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
        return F.struct((F.lit(500000.0) + k * east).alias("x"), (k * north).alias("y"))

    return F.transform(F.transform(F.transform(coords, angles), sphere), plane)


def pairs(coords: Column) -> Column:
    """Consecutive point pairs as structs (a, b)."""
    return let(coords, lambda v: F.zip_with(
        F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, F.lit(2), F.size(v)),
        lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def line_km(coords: Column) -> Column:
    """Great-circle length of a polyline in kilometres."""
    return _total(F.transform(pairs(coords), lambda s: haversine(
        s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"])))


def line_metres(xy: Column) -> Column:
    return _total(F.transform(pairs(xy), lambda s: F.hypot(s["b"]["x"] - s["a"]["x"],
                                                          s["b"]["y"] - s["a"]["y"])))


def _flat(s: Column) -> Column:
    return F.hypot(s["b"]["lon"] - s["a"]["lon"], s["b"]["lat"] - s["a"]["lat"])


def centroid(coords: Column) -> Column:
    """Length-weighted centre in degrees; a line without length is its first point."""
    segs = pairs(coords)
    total = _total(F.transform(segs, _flat))

    def axis(c):
        weighted = _total(F.transform(segs, lambda s: _flat(s) * (s["a"][c] + s["b"][c]) / 2))
        return F.when(total > 0, weighted / total).otherwise(coords[0][c])

    return F.struct(axis("lon").alias("lon"), axis("lat").alias("lat"))


def midpoint(coords: Column) -> Column:
    """Point at half of the length (degree space)."""
    segs = pairs(coords)
    half = _total(F.transform(segs, _flat)) / 2
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("lon"),
                     F.lit(None).cast("double").alias("lat"))

    def step(acc, s):
        end = acc["run"] + _flat(s)
        inside = acc["lon"].isNull() & (end >= half) & (_flat(s) > 0)
        f = F.when(_flat(s) > 0, (half - acc["run"]) / _flat(s))
        lon = F.when(inside, s["a"]["lon"] + f * (s["b"]["lon"] - s["a"]["lon"])).otherwise(acc["lon"])
        lat = F.when(inside, s["a"]["lat"] + f * (s["b"]["lat"] - s["a"]["lat"])).otherwise(acc["lat"])
        return F.struct(end.alias("run"), lon.alias("lon"), lat.alias("lat"))

    found = F.aggregate(segs, start, step)
    return F.struct(F.coalesce(found["lon"], coords[0]["lon"]).alias("lon"),
                    F.coalesce(found["lat"], coords[0]["lat"]).alias("lat"))


def snap(v: Column, digits: int = 7) -> Column:
    """Half-even rounding of a coordinate, used as an endpoint key."""
    return F.bround(v, digits)


def point_segment(px: Column, py: Column, a: Column, b: Column) -> Column:
    """Planar distance of a point to the segment a-b (structs with x, y)."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    sq = dx * dx + dy * dy
    u = F.when(sq > 0, ((px - a["x"]) * dx + (py - a["y"]) * dy) / sq).otherwise(F.lit(0.0))
    u = F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0))
    return let(u, lambda w: F.hypot(px - a["x"] - w * dx, py - a["y"] - w * dy))


def point_line(px: Column, py: Column, xy: Column) -> Column:
    """Planar distance of a point to a polyline."""
    return let(F.struct(px.alias("x"), py.alias("y")), lambda p: F.array_min(F.transform(
        pairs(xy), lambda s: point_segment(p["x"], p["y"], s["a"], s["b"]))))


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def segment_segment(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Planar distance of two segments, zero when they cross."""
    crossing = ((_cross(a, b, c) * _cross(a, b, d) < 0) & (_cross(c, d, a) * _cross(c, d, b) < 0))
    ends = F.least(point_segment(a["x"], a["y"], c, d), point_segment(b["x"], b["y"], c, d),
                   point_segment(c["x"], c["y"], a, b), point_segment(d["x"], d["y"], a, b))
    return F.when(crossing, F.lit(0.0)).otherwise(ends)


def segment_line(c: Column, d: Column, xy: Column) -> Column:
    return F.array_min(F.transform(pairs(xy), lambda s: segment_segment(s["a"], s["b"], c, d)))


def dms(degrees: Column | float, minutes: Column | float, seconds: Column | float) -> Column:
    def as_col(v):
        return v if isinstance(v, Column) else F.lit(float(v))
    return as_col(degrees) + as_col(minutes) / 60.0 + as_col(seconds) / 3600.0


def inside_ring(x: Column, y: Column, ring: Column, fx: str = "x", fy: str = "y") -> Column:
    """Even-odd test of a point against a closed ring given without its repeated last point."""
    closed = F.concat(ring, F.array(ring[0]))
    crossings = F.filter(pairs(closed), lambda s: ((s["a"][fy] > y) != (s["b"][fy] > y)) & (
        x < (s["b"][fx] - s["a"][fx]) * (y - s["a"][fy]) / (s["b"][fy] - s["a"][fy]) + s["a"][fx]))
    return F.size(crossings) % 2 == 1


def overlap_share(a: Column, b: Column, ring: Column) -> Column:
    """Share of the segment a-b inside a ring: cut at every edge crossing, keep the inner pieces."""
    closed = pairs(F.concat(ring, F.array(ring[0])))
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]

    def cut(e):
        ex, ey = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        det = dx * ey - dy * ex
        t = ((e["a"]["x"] - a["x"]) * ey - (e["a"]["y"] - a["y"]) * ex) / det
        u = ((e["a"]["x"] - a["x"]) * dy - (e["a"]["y"] - a["y"]) * dx) / det
        return F.when((det != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1), t)

    cuts = F.array_compact(F.transform(closed, cut))
    stops = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts))
    n = F.size(stops)
    pieces = F.zip_with(F.slice(stops, 1, n - 1), F.slice(stops, 2, n), lambda s, e: F.struct(
        s.alias("s"), e.alias("e")))

    def inner(p):
        m = (p["s"] + p["e"]) / 2
        return F.when(inside_ring(a["x"] + m * dx, a["y"] + m * dy, ring), p["e"] - p["s"]).otherwise(0.0)

    return _total(F.transform(pieces, inner))
