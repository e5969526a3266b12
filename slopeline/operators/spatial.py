"""Spatial joins as equi-joins on grid cells with an exact test afterwards."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopeline.functions import geo
from slopeline.operators.ordered import first_rows
from slopeline.session import durable

METRES_PER_DEGREE = 111_320.0


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def box_cells(df: DataFrame, xmin: Column, ymin: Column, xmax: Column, ymax: Column, size: float) -> DataFrame:
    """One row per grid cell the box touches (columns ``_cx``, ``_cy``)."""
    return (df.withColumn("_cx", F.explode(_cells(xmin, xmax, size)))
            .withColumn("_cy", F.explode(_cells(ymin, ymax, size))))


def distance_to(roads: DataFrame, lon: float, lat: float, name: str = "distance_m") -> DataFrame:
    """Metric distance of every road to one point, in the UTM zone of the point."""
    zone = min(max(int((lon + 180) // 6) + 1, 1), 60)
    meridian = zone * 6 - 183.0
    xy = geo.project_line(F.col("coords"), meridian)
    p = geo.project(F.lit(lon), F.lit(lat), meridian)
    return roads.withColumn("_p", p).withColumn(name, geo.point_line(F.col("_p.x"), F.col("_p.y"), xy)).drop("_p")


def nearest_to_point(roads: DataFrame, lon: float, lat: float, n: int = 50, radius_m: float = 2000.0) -> DataFrame:
    """The n nearest roads with a radius flag; the radius does not filter."""
    d = distance_to(roads, lon, lat)
    return d.withColumn("within_search_radius", F.col("distance_m") <= radius_m).orderBy("distance_m", "osm_id").limit(n)


def event_road_distance(event_lon: Column, event_lat: Column, coords: Column) -> Column:
    """Metric distance of an event to a polyline, in the event's UTM zone."""
    meridian = geo.central_meridian(geo.utm_zone(event_lon))
    p = geo.project(event_lon, event_lat, meridian)
    return geo.point_line(p["x"], p["y"], geo.project_line(coords, meridian))


# Least and greatest radius of curvature of the ellipsoid, and the least scale of the projection.
LEAST_RADIUS, GREATEST_RADIUS, LEAST_SCALE = 6_335_439.0, 6_399_594.0, 0.9996
# Bounds of that scale up to so many degrees from the central meridian.
SCALES = ((12.0, 1.03), (25.0, 1.1))
# Cells of one level in a row of the next one are 2 to this power.
LEVEL_BITS = 2


def _cell_bounds(size: str) -> tuple[Column, Column]:
    """Least and greatest projected distance from (_ex, _ey) to points of the cell (_cx, _cy).

    Haversines with the least and greatest differences and the narrowest and widest parallel of the cell, on
    spheres inside and around the ellipsoid. Far from the event's zone there is no upper bound.
    """
    x0, y0 = f"(_cx * {size})", f"(_cy * {size})"
    x1, y1 = f"((_cx + 1) * {size})", f"((_cy + 1) * {size})"
    high, low = f"least(90D, greatest(abs({y0}), abs({y1})))", f"CASE WHEN {y0} <= 0 AND {y1} >= 0 THEN 0D ELSE least(90D, abs({y0}), abs({y1})) END"

    def across(dy: str, dx: str, parallel: str) -> str:
        return (f"2 * asin(sqrt(least(1D, pow(sin(radians({dy}) / 2), 2) + cos(radians(_ey)) * cos(radians({parallel}))"
                f" * pow(sin(radians(least(180D, {dx})) / 2), 2))))")

    near = across(f"greatest(0D, {y0} - _ey, _ey - {y1})", f"greatest(0D, {x0} - _ex, _ex - {x1})", high)
    wide = f"greatest(abs({x0} - _ex), abs({x1} - _ex))"
    far = across(f"least(180D, greatest(abs({y0} - _ey), abs({y1} - _ey)))", wide, low)
    # an event lies within three degrees of its central meridian
    scale = " ".join(f"WHEN {wide} <= {d - 3} THEN {k}D" for d, k in SCALES)
    return F.expr(f"{LEAST_SCALE * LEAST_RADIUS}D * {near}"), F.expr(f"CASE {scale} END * {GREATEST_RADIUS}D * {far}")


def _within_reach(pairs: DataFrame, event: str, n: int, size: float) -> DataFrame:
    """Only the cells that can hold one of the n nearest roads: those no farther than the nearest cells whose
    own roads are n."""
    near, far = _cell_bounds(f"{size!r}D")
    # what the level above gave as reach holds here too
    known = pairs.withColumn("_near", near).where("_reach IS NULL OR _near <= _reach").withColumn("_far", far).drop("_reach")
    order = Window.partitionBy(event).orderBy(F.col("_far").asc_nulls_last(), "_cx", "_cy")
    run = F.sum("_own").over(order.rowsBetween(Window.unboundedPreceding, 0))
    reach = F.min(F.when(F.col("_run") >= n, F.col("_far"))).over(Window.partitionBy(event))
    return known.withColumn("_run", run).withColumn("_reach", reach).where("_reach IS NULL OR _near <= _reach").drop("_near", "_far", "_run", "_own")


def nearest_per_event(events: DataFrame, roads: DataFrame, n: int = 50, *, event: str = "event_id",
                      road: str = "osm_id", radius_m: float = 2000.0) -> DataFrame:
    """Exact n nearest roads of every event (all, if fewer), with rank, distance_m and within_search_radius; the
    radius does not filter, and equal distances go by the road's id.

    Segments are dealt to cells of a size that follows the roads' density, once; coarser cells come from those by
    dividing their numbers. Every event goes down the levels and keeps the occupied cells whose least distance
    does not exceed the greatest distance of cells that surely hold n roads. So an event far from all roads
    reads the nearest cells only, like any other. Events and roads without coordinates take no part.

    Roads with the same coordinates are equally far from everything: they are one shape, which carries its n lowest
    ids, as no other of its roads can be among the n nearest. Events at one place are answered once. An id names one road.
    """
    at, shape = "_at", "_shape"
    segments = F.when(F.size("coords") == 1, F.array(F.struct(F.col("coords")[0].alias("a"), F.col("coords")[0].alias("b")))).otherwise(
        geo.pairs(F.col("coords")))
    lowest = first_rows(roads.where(F.size("coords") > 0).select(road, "coords").distinct(), ["coords"], [road], n)
    shapes = durable(lowest.groupBy("coords").agg(F.array_sort(F.collect_list(road)).alias("_ids")).withColumn(shape, F.monotonically_increasing_id()))
    shaped = shapes.select(shape, F.size("_ids").alias("_roads"), F.posexplode(segments).alias("_i", "_s")).select(
        shape, "_roads", "_i", *[F.col(f"_s.{p}.{c}").alias(f"_{p}{n}") for p in ("a", "b") for c, n in (("lon", "x"), ("lat", "y"))])
    ext = shaped.agg(F.min(F.least("_ax", "_bx")), F.max(F.greatest("_ax", "_bx")), F.min(F.least("_ay", "_by")), F.max(F.greatest("_ay", "_by")),
                     F.sum(F.when(F.col("_i") == 0, F.col("_roads")))).first()
    place = F.struct(F.col("longitude").alias("x"), F.col("latitude").alias("y")).alias(at)
    asking = events.where("longitude IS NOT NULL AND latitude IS NOT NULL").select(event, place).distinct()
    pts = asking.select(at).distinct().select(at, F.col(f"{at}.x").alias("_ex"), F.col(f"{at}.y").alias("_ey"))
    if not ext[4]:
        return asking.limit(0).select(event, F.lit(None).cast(roads.schema[road].dataType).alias(road),
                                   F.lit(None).cast("double").alias("distance_m"), F.lit(0).alias("rank"), F.lit(False).alias("within_search_radius"))
    width, height = max(ext[1] - ext[0], 1e-3), max(ext[3] - ext[2], 1e-3)
    size = (n * width * height / ext[4]) ** 0.5 / 2
    home = (F.col("_i") == 0) & (F.col("_cx") == F.floor(F.col("_ax") / size)) & (F.col("_cy") == F.floor(F.col("_ay") / size))
    fine = durable(box_cells(shaped, F.least("_ax", "_bx"), F.least("_ay", "_by"), F.greatest("_ax", "_bx"), F.greatest("_ay", "_by"), size).select(
        shape, "_ax", "_ay", "_bx", "_by", "_cx", "_cy", F.when(home, F.col("_roads")).otherwise(0).alias("_home")))
    occupied = durable(fine.groupBy("_cx", "_cy").agg(F.sum("_home").alias("_own")))

    def level(k: int) -> DataFrame:
        up = [F.shiftright(c, k * LEVEL_BITS).alias(c) for c in ("_cx", "_cy")]
        return occupied.groupBy(*up).agg(F.sum("_own").alias("_own")) if k else occupied

    levels = max(0, math.ceil(math.log2(max(width, height) / size + 1) / LEVEL_BITS) - 1)
    # a few cells cover the extent at the top
    top = [F.struct(F.lit(r._cx).alias("_cx"), F.lit(r._cy).alias("_cy"), F.lit(r._own).alias("_own")) for r in level(levels).collect()]
    pairs = pts.withColumn("_c", F.explode(F.array(*top))).select(at, "_ex", "_ey", "_c.*", F.lit(None).cast("double").alias("_reach"))
    for k in range(levels, -1, -1):
        pairs = _within_reach(pairs, at, n, size * (1 << k * LEVEL_BITS))
        if k:
            below = level(k - 1).select(F.shiftright("_cx", LEVEL_BITS).alias("_px"), F.shiftright("_cy", LEVEL_BITS).alias("_py"),
                                        F.col("_cx").alias("_nx"), F.col("_cy").alias("_ny"), "_own")
            pairs = pairs.join(below, (F.col("_cx") == F.col("_px")) & (F.col("_cy") == F.col("_py"))).select(
                at, "_ex", "_ey", F.col("_nx").alias("_cx"), F.col("_ny").alias("_cy"), "_own", "_reach")
    # both sides are projected before they meet: a place once, a segment of a cell once per zone that asks for it
    asked = durable(pairs.withColumn("_zone", geo.utm_zone(F.col("_ex"))))
    meridian = geo.central_meridian(F.col("_zone"))
    drawn = fine.join(asked.select("_cx", "_cy", "_zone").distinct(), ["_cx", "_cy"]).select(
        "_cx", "_cy", "_zone", shape, geo.project(F.col("_ax"), F.col("_ay"), meridian).alias("_a"), geo.project(F.col("_bx"), F.col("_by"), meridian).alias("_b"))
    placed = asked.select(at, "_cx", "_cy", "_zone", geo.project(F.col("_ex"), F.col("_ey"), meridian).alias("_p"))
    met = placed.join(drawn, ["_cx", "_cy", "_zone"]).select(
        at, shape, geo.point_segment(F.col("_p.x"), F.col("_p.y"), F.col("_a"), F.col("_b")).alias("distance_m"))
    # of a shape, the segments in reach; of n shapes, the first n roads
    ids = shapes.select(shape, "_ids", F.col("_ids")[0].alias("_low"))
    near = first_rows(met.groupBy(at, shape).agg(F.min("distance_m").alias("distance_m")).join(ids, shape), [at], ["distance_m", "_low"], n)
    found = first_rows(near.select(at, F.explode("_ids").alias(road), "distance_m"), [at], ["distance_m", road], n)
    return asking.join(found, at).select(event, road, "distance_m", "rank", (F.col("distance_m") <= radius_m).alias("within_search_radius"))


def nearby_by_ref(roads: DataFrame, ref: str, lon: float, lat: float, radius_km: float = 30.0, k: int = 8) -> DataFrame:
    """Approximate nearest k roads whose ref contains a text, within a radius (equirectangular)."""
    c = geo.centroid(F.col("coords"))
    d = F.sqrt(F.pow(F.col("_c.lat") - lat, 2) + F.pow((F.col("_c.lon") - lon) * 0.72, 2)) * 111.0
    near = (roads.where(F.lower(F.coalesce("ref", F.lit(""))).contains(ref.lower())).withColumn("_c", c)
            .withColumn("dkm", d).where(F.col("dkm") <= radius_km))
    return near.orderBy("dkm", "osm_id").limit(k).drop("_c")


# Review radii in metres.
EVENT_RADIUS, ANCHOR_RADIUS, CORRIDOR_RADIUS, SEARCH_RADIUS = 1500.0, 350.0, 300.0, 1000.0


def anchor_distances(roads: DataFrame, event: tuple[float, float], a: tuple[float, float], b: tuple[float, float]
                     ) -> DataFrame:
    """Distances of every road to an event, two anchors and the straight corridor between the anchors,
    with the review flags.

    A road file of few megabytes holds a million roads, so they are dealt to all tasks before they are measured.
    Distances are written once: filters on the flags would repeat the geometry for every flag and row.
    """
    zone = min(max(int((event[0] + 180) // 6) + 1, 1), 60)
    meridian = zone * 6 - 183.0
    xy = geo.project_line(F.col("coords"), meridian)
    pt = {n: geo.project(F.lit(p[0]), F.lit(p[1]), meridian) for n, p in (("e", event), ("a", a), ("b", b))}
    dealt = roads.repartition(int(roads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "osm_id")
    base = dealt.withColumn("_xy", xy)
    for n, p in pt.items():
        base = base.withColumn(f"_{n}", p)
    d = lambda n: geo.point_line(F.col(f"_{n}.x"), F.col(f"_{n}.y"), F.col("_xy"))
    out = durable(base.select(
        *roads.columns, d("e").alias("distance_to_event_m"), d("a").alias("distance_to_a_m"),
        d("b").alias("distance_to_b_m"), geo.segment_line(F.col("_a"), F.col("_b"), F.col("_xy")).alias("distance_to_corridor_m")))
    out = out.select(
        "*", (F.col("distance_to_event_m") <= EVENT_RADIUS).alias("near_event"),
        (F.col("distance_to_a_m") <= ANCHOR_RADIUS).alias("near_a"),
        (F.col("distance_to_b_m") <= ANCHOR_RADIUS).alias("near_b"),
        (F.col("distance_to_corridor_m") <= CORRIDOR_RADIUS).alias("corridor_consistent"),
        (F.least("distance_to_event_m", "distance_to_a_m", "distance_to_b_m") <= SEARCH_RADIUS)
        .alias("within_anchor_search_radius"))
    return out.withColumn("near_both", F.col("near_a") & F.col("near_b"))


def coordinate_check(df: DataFrame, lon: Sequence[str], lat: Sequence[str], tolerance_m: float = 10.0) -> DataFrame:
    """Distance between an event's coordinates and the published ones, and whether they agree."""
    meridian = geo.central_meridian(geo.utm_zone(F.col(lon[0])))
    p, q = geo.project(F.col(lon[0]), F.col(lat[0]), meridian), geo.project(F.col(lon[1]), F.col(lat[1]), meridian)
    out = df.withColumn("_p", p).withColumn("_q", q)
    d = F.hypot(F.col("_p.x") - F.col("_q.x"), F.col("_p.y") - F.col("_q.y"))
    return out.withColumn("distance_m", d).withColumn("coordinates_agree", F.col("distance_m") <= tolerance_m).drop(
        "_p", "_q")
