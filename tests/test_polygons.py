"""Polygon layers against plain even-odd tests over all edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeline.operators import polygons

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
SHAPES = {
    "square": [SQUARE], "closed": [[*SQUARE, SQUARE[0]]], "l": [[(10.0, 0.0), (14.0, 0.0), (14.0, 1.0), (11.0, 1.0), (11.0, 4.0), (10.0, 4.0)]],
    "hole": [[(20.0, 0.0), (26.0, 0.0), (26.0, 6.0), (20.0, 6.0)], [(22.0, 2.0), (24.0, 2.0), (24.0, 4.0), (22.0, 4.0)]],
    "parts": [[(30.0, 0.0), (32.0, 0.0), (32.0, 2.0), (30.0, 2.0)], [(33.0, 0.0), (35.0, 0.0), (34.0, 3.0)]], "none": None, "empty": [[]],
}


def star(rng, x, y, n, r):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    return [(x + r * float(k) * np.cos(a), y + r * float(k) * np.sin(a)) for a, k in zip(angle, rng.uniform(0.3, 1, n))]


def ring_edges(rings):
    return [(*a, *b) for r in rings or [] for a, b in zip(r, [*r[1:], *r[:1]])]


def inside(x, y, edges):
    return sum((ay <= y) != (by <= y) and ax + (y - ay) / (by - ay) * (bx - ax) > x for ax, ay, bx, by in edges) % 2 == 1


def length(line, edges):
    total = 0.0
    for (ax, ay), (bx, by) in zip(line, line[1:]):
        stops = [0.0, 1.0]
        for px, py, qx, qy in edges:
            det = (bx - ax) * (qy - py) - (by - ay) * (qx - px)
            if det:
                t, u = ((px - ax) * (qy - py) - (py - ay) * (qx - px)) / det, ((px - ax) * (by - ay) - (py - ay) * (bx - ax)) / det
                stops += [t] * (0 < t < 1 and 0 <= u <= 1)
        stops.sort()
        total += sum((e - s) * np.hypot(bx - ax, by - ay) for s, e in zip(stops, stops[1:]) if inside(ax + (s + e) / 2 * (bx - ax), ay + (s + e) / 2 * (by - ay), edges))
    return total


def tables(spark, shapes, lines):
    layer = spark.createDataFrame(list(shapes.items()), "name string, rings array<array<struct<x:double,y:double>>>")
    segs = [(k, i, *a, *b) for k, line in lines.items() for i, (a, b) in enumerate(zip(line, line[1:]))]
    return (polygons.edges(layer, "name", F.col("rings"), "x", "y"),
            spark.createDataFrame(segs, "line int, i int, ax double, ay double, bx double, by double"))


LINES = {
    1: [(1.0, 1.0), (2.0, 3.0)], 2: [(-1.0, 1.0), (5.0, 1.0)], 3: [(-2.0, 2.0), (0.0, 2.0)], 4: [(-1.0, 0.0), (5.0, 0.0)], 5: [(4.0, 4.0), (6.0, 6.0)],
    6: [(-1.0, 1.0), (1.0, -1.0)], 7: [(9.0, 2.0), (15.0, 2.0)], 8: [(12.0, 2.0), (13.0, 3.0)], 9: [(22.5, 3.0), (23.5, 3.0)], 10: [(21.0, 3.0), (25.0, 3.0)],
    11: [(31.0, 1.0), (34.0, 1.0)], 12: [(32.0, 1.0), (33.0, 0.0)], 13: [(100.0, 100.0), (101.0, 100.0)], 14: [(0.5, 0.5), (0.5, 0.5), (5.0, 0.5)],
    15: [(22.0, 3.0), (23.0, 3.0)],
}


@pytest.mark.parametrize("size", [0.7, 3.0, 50.0])
def test_shapes(spark, size):
    shapes, lines = tables(spark, SHAPES, LINES)
    layer = polygons.cells(shapes, "name", size)
    met = {(r.line, r["name"]) for r in polygons.touching(lines, layer, "line", "name", size).collect()}
    squares = {(k, s) for k in (1, 2, 3, 4, 5, 6, 14) for s in ("square", "closed")}
    assert met == squares | {(7, "l"), (10, "hole"), (15, "hole"), (11, "parts"), (12, "parts")}
    got = {(r.line, r["name"]): r.length for r in polygons.lengths_inside(lines, layer, "line", "name", size).collect()}
    for k, line in LINES.items():
        if k != 4:  # it runs along a border
            for name, rings in SHAPES.items():
                assert got.get((k, name), 0.0) == pytest.approx(length(line, ring_edges(rings)), abs=1e-9)


@pytest.mark.parametrize("size", [0.5, 2.3])
def test_random_rings(spark, size):
    rng = np.random.default_rng(3)
    shapes = {f"p{k}": [star(rng, *rng.uniform(0, 10, 2), int(rng.integers(3, 40)), 3.0) for _ in range(int(rng.integers(1, 4)))] for k in range(12)}
    shapes = {k: [[(float(x), float(y)) for x, y in r] for r in rings] for k, rings in shapes.items()}
    lines = {k: [tuple(map(float, rng.uniform(-2, 12, 2))) for _ in range(int(rng.integers(2, 5)))] for k in range(40)}
    edges, segs = tables(spark, shapes, lines)
    layer = polygons.cells(edges, "name", size)
    got = {(r.line, r["name"]): r.length for r in polygons.lengths_inside(segs, layer, "line", "name", size).collect()}
    met = {(r.line, r["name"]) for r in polygons.touching(segs, layer, "line", "name", size).collect()}
    for k, line in lines.items():
        for name, rings in shapes.items():
            want = length(line, ring_edges(rings))
            assert got.get((k, name), 0.0) == pytest.approx(want, abs=1e-9)
            assert ((k, name) in met) == (want > 0)


def test_districts_keep_touching_roads_and_break_ties(spark):
    deg = lambda x, y: (91.0 + x, 25.0 + y)
    ring = lambda *p: [deg(x, y) for x, y in p]
    districts = spark.createDataFrame([("b", [ring((0, 0), (1, 0), (1, 1), (0, 1))]), ("a", [ring((1, 0), (2, 0), (2, 1), (1, 1))]), ("c", None)],
                                      "district_id string, rings array<array<struct<lon:double,lat:double>>>")
    lines = {1: [deg(-0.5, 0.5), deg(0, 0.5)], 2: [deg(0.5, 0.5), deg(1, 0.5)], 3: [deg(1, 0.25), deg(1, 0.75)], 4: [deg(5, 5), deg(6, 5)],
             5: [deg(0.9, 0.5), deg(1.5, 0.5)], 6: [deg(0.2, 0.2)], 7: None}
    roads = spark.createDataFrame(list(lines.items()), "osm_id int, coords array<struct<lon:double,lat:double>>")
    got = {r.osm_id: r for r in polygons.assign_districts(roads, districts, meridian=93.0).collect()}
    kind = {k: (r.district_id, r.district_match_type, round(r.coverage_ratio, 3)) for k, r in got.items()}
    assert kind[1] == ("b", "single", 0.0) and kind[2][:2] == ("b", "boundary_resolved") and kind[2][2] > 0.99
    assert kind[3][1] == "boundary_resolved" and kind[4] == kind[6] == kind[7] == (None, "unmatched", 0.0)
    assert kind[5][:2] == ("a", "boundary_resolved") and kind[5][2] == pytest.approx(5 / 6, abs=0.001)
