"""Polygon layers as classified grid cells, and the lines that meet them.

A polygon is any set of rings: holes and further parts are rings like the others, and a point is inside where
a ray from it meets an odd number of edges. Edges are dealt to the grid cells they touch; a cell also knows
whether its centre is inside. So a cell without edges is wholly inside or outside, and in the others the edges
of the cell alone decide: the path from its centre to a point crosses no edge of another cell. Polygons of any
size cost the cells that they cover, and no join carries a whole ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeline.functions import geo
from slopeline.operators.spatial import METRES_PER_DEGREE, box_cells

EDGE = ("ax", "ay", "bx", "by")


def edges(layer: DataFrame, name: str, rings: Column, x: str, y: str) -> DataFrame:
    """name, ax, ay, bx, by: the edges of all rings, closed where they are not."""
    one = layer.select(name, F.explode(rings).alias("_r")).where(F.size("_r") > 1)
    e = one.select(name, F.explode(geo.pairs(F.concat("_r", F.slice("_r", 1, 1)))).alias("_e"))
    return e.select(name, *[F.col(f"_e.{p}.{c}").alias(f"{p}{n}") for p in ("a", "b") for c, n in ((x, "x"), (y, "y"))])


def _in_cells(lines: DataFrame, size: float) -> DataFrame:
    return box_cells(lines, F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by"), size)


def cells(shapes: DataFrame, name: str, size: float) -> DataFrame:
    """name, _cx, _cy, odd, edges: every cell that a polygon's inside or border touches. ``odd``: the centre is
    inside; ``edges``: those that touch the cell, empty where the whole cell is inside.

    One row of cells is cut by the crossings of its middle line, two by two.
    """
    middle = (F.col("_cy") + 0.5) * size
    rows = shapes.withColumn("_cy", F.explode(F.sequence(F.floor(F.least("ay", "by") / size), F.floor(F.greatest("ay", "by") / size))))
    met = rows.where((F.col("ay") <= middle) != (F.col("by") <= middle)).select(
        name, "_cy", (F.col("ax") + (middle - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))).alias("x"))
    spans = met.groupBy(name, "_cy").agg(F.sort_array(F.collect_list("x")).alias("xs")).select(
        name, "_cy", F.explode(F.transform(F.expr("sequence(0, size(xs) div 2 - 1)"), lambda i: F.struct(
            F.get("xs", 2 * i).alias("lo"), F.get("xs", 2 * i + 1).alias("hi")))).alias("s"))
    # cells with an odd number of crossings before their centre, by the comparisons of inside_cell
    near = spans.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("s.lo") / size) - 1, F.floor(F.col("s.hi") / size) + 1)))
    centre = (F.col("_cx") + 0.5) * size
    inside = near.where((F.col("s.lo") < centre) & ~(F.col("s.hi") < centre)).select(name, "_cx", "_cy", F.lit(True).alias("odd"))
    border = _in_cells(shapes, size).select(name, "_cx", "_cy", F.struct(*EDGE).alias("edge"))
    both = border.unionByName(inside, allowMissingColumns=True)
    return both.groupBy(name, "_cx", "_cy").agg(F.coalesce(F.bool_or("odd"), F.lit(False)).alias("odd"), F.collect_list("edge").alias("edges"))


def inside_cell(x: str, y: str, size: float) -> Column:
    """Whether a point of the cell of a ``cells`` row is inside: the path goes from the centre along the middle
    line, then straight up or down."""
    cx, cy = f"((_cx + 0.5D) * {size!r}D)", f"((_cy + 0.5D) * {size!r}D)"
    along = f"e.ax + ({cy} - e.ay) / (e.by - e.ay) * (e.bx - e.ax)"
    upright = f"e.ay + ({x} - e.ax) / (e.bx - e.ax) * (e.by - e.ay)"
    return F.expr(f"""odd != ((
        size(filter(edges, e -> (e.ay <= {cy}) != (e.by <= {cy}) AND ({along} < {cx}) != ({along} < {x})))
        + size(filter(edges, e -> (e.ax <= {x}) != (e.bx <= {x}) AND ({upright} < {cy}) != ({upright} < {y})))) % 2 = 1)""")


def _turn(ox: str, oy: str, px: str, py: str, qx: str, qy: str) -> str:
    return f"signum(({px} - {ox}) * ({qy} - {oy}) - ({py} - {oy}) * ({qx} - {ox}))"


#: Whether a segment and one of the edges share a point, ends and overlaps included.
MEETS = f"""exists(edges, e -> least(e.ax, e.bx) <= greatest(ax, bx) AND least(ax, bx) <= greatest(e.ax, e.bx)
    AND least(e.ay, e.by) <= greatest(ay, by) AND least(ay, by) <= greatest(e.ay, e.by)
    AND {_turn("e.ax", "e.ay", "e.bx", "e.by", "ax", "ay")} * {_turn("e.ax", "e.ay", "e.bx", "e.by", "bx", "by")} <= 0
    AND {_turn("ax", "ay", "bx", "by", "e.ax", "e.ay")} * {_turn("ax", "ay", "bx", "by", "e.bx", "e.by")} <= 0)"""
#: Where a piece [_t0, _t1] of a segment crosses the edges, and its ends, in order.
STOPS = """array_sort(concat(array(_t0, _t1), filter(transform(filter(edges, e -> (bx - ax) * (e.by - e.ay) - (by - ay) * (e.bx - e.ax) != 0), e ->
        CASE WHEN ((e.ax - ax) * (by - ay) - (e.ay - ay) * (bx - ax)) / ((bx - ax) * (e.by - e.ay) - (by - ay) * (e.bx - e.ax)) BETWEEN 0 AND 1
            THEN ((e.ax - ax) * (e.by - e.ay) - (e.ay - ay) * (e.bx - e.ax)) / ((bx - ax) * (e.by - e.ay) - (by - ay) * (e.bx - e.ax)) END),
        t -> t > _t0 AND t < _t1)))"""


def touching(lines: DataFrame, layer: DataFrame, line: str, name: str, size: float) -> DataFrame:
    """Distinct (line, name) of segments (line, i, ax, ay, bx, by) and polygons (``cells``) that share a point.

    A line that meets no edge lies on one side, where its first point lies.
    """
    near = _in_cells(lines, size).join(layer.where(F.size("edges") > 0), ["_cx", "_cy"])
    crossing = near.where(F.expr(MEETS)).select(line, name)
    starts = lines.where("i = 0").withColumn("_cx", F.floor(F.col("ax") / size)).withColumn("_cy", F.floor(F.col("ay") / size))
    within = starts.join(layer, ["_cx", "_cy"]).where(inside_cell("ax", "ay", size)).select(line, name)
    return crossing.unionByName(within).distinct()


def lengths_inside(lines: DataFrame, layer: DataFrame, line: str, name: str, size: float) -> DataFrame:
    """(line, name, length): how much of the segments (line, ax, ay, bx, by) lies inside each polygon (``cells``).

    Segments are cut at cell borders. Where a cell has no edges the whole piece counts; elsewhere it is cut at
    the edges of the cell and the parts whose middle is inside count.
    """
    def side(pick: str, p: str, q: str, cell: str, level: bool) -> str:
        ends = [f"(({cell} + {k}) * {size!r}D - {p}) / ({q} - {p})" for k in (0, 1)]
        return f"CASE WHEN {q} != {p} THEN {pick}({', '.join(ends)}) ELSE {int(level)}D END"

    enter, leave = ([side(pick, p, q, cell, level) for p, q, cell in (("ax", "bx", "_cx"), ("ay", "by", "_cy"))]
                    for pick, level in (("least", False), ("greatest", True)))
    pieces = _in_cells(lines, size).selectExpr(line, *EDGE, "_cx", "_cy", f"greatest(0D, {enter[0]}, {enter[1]}) AS _t0",
                                               f"least(1D, {leave[0]}, {leave[1]}) AS _t1").where("_t1 > _t0")
    met = pieces.join(layer, ["_cx", "_cy"]).withColumn("_stops", F.expr(f"CASE WHEN size(edges) = 0 THEN array(_t0, _t1) ELSE {STOPS} END"))
    parts = met.select("*", F.expr("posexplode(slice(_stops, 1, size(_stops) - 1)) AS (_i, _s)")).withColumn("_e", F.expr("_stops[_i + 1]"))
    parts = parts.withColumn("_x", F.expr("ax + (_s + _e) / 2 * (bx - ax)")).withColumn("_y", F.expr("ay + (_s + _e) / 2 * (by - ay)"))
    kept = parts.where(F.when(F.size("edges") == 0, True).otherwise(inside_cell("_x", "_y", size)))
    return kept.groupBy(line, name).agg(F.sum(F.expr("(_e - _s) * hypot(bx - ax, by - ay)")).alias("length"))


def assign_districts(roads: DataFrame, districts: DataFrame, *, meridian: float, cell_degrees: float = 0.25,
                     road: str = "osm_id", district: str = "district_id") -> DataFrame:
    """District holding the longest part of each road, with its length and share; of equal ones the lowest id.

    ``districts`` has ``rings``, an array of rings of (lon, lat), holes and further parts among them, or one
    ``ring``. Districts that share any point with a road, in degrees, are its candidates, also with length 0.
    Lengths are of the projected lines inside the projected rings. A NULL ring, and a road of fewer than two
    points, meets nothing.
    """
    rings = F.col("rings") if "rings" in districts.columns else F.array("ring")
    metres = cell_degrees * METRES_PER_DEGREE
    seg = roads.select(road, F.posexplode(geo.pairs(F.col("coords"))).alias("i", "_s"))
    degrees = seg.select(road, "i", F.col("_s.a.lon").alias("ax"), F.col("_s.a.lat").alias("ay"), F.col("_s.b.lon").alias("bx"), F.col("_s.b.lat").alias("by"))
    on_map = roads.select(road, F.explode(geo.pairs(geo.project_line(F.col("coords"), meridian))).alias("_s"))
    plane = on_map.select(road, *[F.col(f"_s.{p}.{c}").alias(f"{p}{c}") for p in ("a", "b") for c in ("x", "y")])
    shapes = edges(districts, district, rings, "lon", "lat")
    flat = edges(districts.select(district, F.transform(rings, lambda r: geo.project_line(r, meridian)).alias("_rings")), district, F.col("_rings"), "x", "y")
    candidates = touching(degrees, cells(shapes, district, cell_degrees), road, district, cell_degrees)
    inside = lengths_inside(plane, cells(flat, district, metres), road, district, metres)
    per = candidates.join(inside, [road, district], "left").withColumn("length", F.coalesce("length", F.lit(0.0)))
    best = per.groupBy(road).agg(F.min_by(F.struct("length", district), F.struct(-F.col("length"), district)).alias("b"), F.count(F.lit(1)).alias("_n"))
    total = plane.groupBy(road).agg(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("_total"))
    out = roads.select(road).join(total, road, "left").join(best, road, "left")
    share = F.when(F.col("_total") > 0, F.least(F.greatest(F.col("b.length") / F.col("_total"), F.lit(0.0)), F.lit(1.0)))
    return out.select(
        road, F.col(f"b.{district}").alias(district), F.coalesce("b.length", F.lit(0.0)).alias("intersection_length_m"),
        F.coalesce(share, F.lit(0.0)).alias("coverage_ratio"),
        F.when(F.col("_n").isNull(), "unmatched").when(F.col("_n") > 1, "boundary_resolved").otherwise("single")
        .alias("district_match_type"))
