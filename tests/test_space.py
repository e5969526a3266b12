"""Rasters, spatial joins and graphs against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeline.functions import geo
from slopeline.operators import graph, raster, spatial


def pixels(spark, grid):
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(grid)]
    return spark.createDataFrame(rows, "row long, col long, v double")


@pytest.mark.parametrize("tile", [2, 3, 256])
def test_slope_uniform_matches_gradient(spark, tile):
    grid = np.random.default_rng(1).integers(0, 300, (7, 9)).astype(float)
    dy, dx = np.gradient(grid, 90)
    want = np.degrees(np.arctan(np.sqrt(dx**2 + dy**2)))
    for r in raster.slope_uniform(pixels(spark, grid), tile=tile).collect():
        assert r.slope_degrees == pytest.approx(want[r.row, r.col])


def test_slope_geographic(spark):
    step = 1 / 1200
    grid = np.repeat(9.0 * np.arange(5)[:, None], 5, axis=1)
    out = {(r.row, r.col): r.slope_degrees for r in raster.slope_geographic(pixels(spark, grid), 27.0, -step, step).collect()}
    assert out[(2, 2)] == pytest.approx(math.degrees(math.atan(9 / (110574 / 1200))), abs=0.05)
    hole = np.full((5, 5), 100.0)
    hole[2, 2] = -9999.0
    out = {(r.row, r.col): r.slope_degrees for r in raster.slope_geographic(pixels(spark, hole), 27.0, -step, step).collect()}
    assert out[(2, 2)] is None and max(v for v in out.values() if v is not None) < 1.0


def test_single_row_grid_has_no_slope(spark):
    assert all(r.slope_degrees is None for r in raster.slope_uniform(pixels(spark, np.ones((1, 4)))).collect())


def roads(spark, n, seed=4, crowd=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y = (90 + rng.random() * 0.01, 25 + rng.random() * 0.01) if i < crowd else (88 + 10 * rng.random(), 22 + 8 * rng.random())
        rows.append((i, [(float(x), float(y)), (float(x + rng.normal() * .05), float(y + rng.normal() * .05))]))
    return spark.createDataFrame(rows, "osm_id long, coords array<struct<lon:double,lat:double>>")


def test_nearest_per_event_matches_brute_force(spark):
    r = roads(spark, 120, crowd=60)
    ev = spark.createDataFrame([(1, 90.0, 25.0), (2, 97.9, 29.9), (3, 80.0, 10.0)], "event_id long, longitude double, latitude double")
    got = spatial.nearest_per_event(ev, r, 5).collect()
    d = spatial.event_road_distance(F.col("longitude"), F.col("latitude"), F.col("coords"))
    every = ev.crossJoin(r).select("event_id", "osm_id", d.alias("d")).collect()
    for e in (1, 2, 3):
        want = sorted((x.d, x.osm_id) for x in every if x.event_id == e)[:5]
        assert [(x.osm_id) for x in sorted((g for g in got if g.event_id == e), key=lambda g: g.rank)] == [i for _, i in want]


def test_nearest_of_stacked_roads_and_events(spark, monkeypatch):
    """Many roads on the same coordinates and many events at the same place: no pair of them meets more than once."""
    coords = {i: [(88.0 + i % 3, 22.0 + i % 4), (88.05 + i % 3, 22.1 + i % 4)] for i in range(600)}
    r = spark.createDataFrame(list(coords.items()), "osm_id long, coords array<struct<lon:double,lat:double>>")
    ev = spark.createDataFrame([(e, 89.0 + e % 2, 23.3) for e in range(200)], "event_id long, longitude double, latitude double")
    written = []
    real = spatial.durable
    monkeypatch.setattr(spatial, "durable", lambda df: written.append(real(df)) or written[-1])
    got = spatial.nearest_per_event(ev, r, 60).collect()
    assert max(df.count() for df in written) < 600
    d = spatial.event_road_distance(F.col("longitude"), F.col("latitude"), F.col("coords"))
    every = ev.where("event_id < 2").crossJoin(r).select("event_id", "osm_id", d.alias("d")).collect()
    for e in range(200):
        want = sorted((x.d, x.osm_id) for x in every if x.event_id == e % 2)[:60]
        assert [(g.osm_id, g.rank) for g in sorted((g for g in got if g.event_id == e), key=lambda g: g.rank)] == [(i, k + 1) for k, (_, i) in enumerate(want)]


def test_anchor_distances_are_measured_once(spark):
    """Filters on the flags read written distances, and a small file of roads is spread over tasks."""
    out = spatial.anchor_distances(roads(spark, 50).coalesce(1), (93.2, 26.1), (93.0, 26.0), (93.5, 26.3))
    text = out.where("within_anchor_search_radius OR corridor_consistent")._jdf.queryExecution().executedPlan().toString()
    assert "coords" in text and "transform" not in text and "Scan parquet" in text
    assert out.count() == 50 and out.select(F.spark_partition_id()).distinct().count() > 1


def test_overlap_share(spark):
    sq = F.expr("array(named_struct('x',0D,'y',0D), named_struct('x',2D,'y',0D), named_struct('x',2D,'y',2D), named_struct('x',0D,'y',2D))")
    pt = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    df = spark.range(1).select(*[geo.overlap_share(pt(*a), pt(*b), sq).alias(n) for n, a, b in (
        ("half", (1, 1), (3, 1)), ("through", (-1, 1), (3, 1)), ("out", (3, 3), (4, 4)), ("inside", (.5, .5), (1, 1)))])
    assert tuple(df.first()) == pytest.approx((.5, .5, 0.0, 1.0))


def test_projection_known_point(spark):
    # published UTM coordinate of the Eiffel tower, zone 31
    r = spark.range(1).select(geo.project(F.lit(2.2945), F.lit(48.8583), 3.0).alias("p")).first().p
    assert (r.x, r.y) == (pytest.approx(448251.8, abs=1.0), pytest.approx(5411943.8, abs=1.0))


EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (7, 8)]


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0 + (a * 7 + b) % 5) for a, b in pairs], "src long, dst long, cost double")


def test_weak_components_path_and_pairs(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101)]
    out = {r.node: r.component for r in graph.weak_components(edges(spark, chain)).collect()}
    assert {out[i] for i in range(61)} == {0} and out[101] == 100


def test_weak_components_rounds_and_last_task_agree(spark, monkeypatch):
    """A graph with few edges takes no rounds; whatever is left to the last task, the components are the same."""
    chain = edges(spark, [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (200, 200)])
    written = []
    real = graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: written.append(1) or real(df))
    want = {(r.node, r.component) for r in graph.weak_components(chain).collect()}
    assert len(written) == 3 and want == {(i, 0) for i in range(61)} | {(100, 100), (101, 100), (200, 200)}
    for left in (0, 10):
        monkeypatch.setattr(graph, "LAST_EDGES", left)
        assert {(r.node, r.component) for r in graph.weak_components(chain).collect()} == want


def test_strong_component(spark):
    assert sorted(r.node for r in graph.largest_strong_component(edges(spark, EDGES)).collect()) == [1, 2, 3]
    assert graph.largest_strong_component(edges(spark, [(1, 2), (2, 3)])).count() == 1


def test_strong_components_of_many_parts(spark, monkeypatch):
    """Parts are searched together, and of equally large components that with the smallest node is returned."""
    rings = [(100 * p + i, 100 * p + (i + 1) % 5) for p in range(12) for i in range(5)] + [(100 * p + 4, 100 * p + 50) for p in range(12)]
    written = []
    real = graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: written.append(1) or real(df))
    assert sorted(r.node for r in graph.largest_strong_component(edges(spark, rings)).collect()) == [0, 1, 2, 3, 4]
    assert len(written) < 60
    # the part of the best pivot holds two smaller components, another part the largest
    two = [(a, b) for a in range(4) for b in range(4) if a != b] + [(3, 10)] + [(10 + i, 10 + (i + 1) % 3) for i in range(3)]
    assert sorted(r.node for r in graph.largest_strong_component(edges(spark, two + [(30 + i, 30 + (i + 1) % 6) for i in range(6)])).collect()) == list(range(30, 36))


def test_shortest_paths_and_routes(spark):
    e = edges(spark, EDGES).withColumn("base_km", F.col("cost"))
    src = spark.createDataFrame([(1,)], "node long")
    tree = graph.shortest_paths(e, src)
    got = {r.node: r.cost for r in tree.collect()}
    w = {(a, b): 1.0 + (a * 7 + b) % 5 for a, b in EDGES}
    assert got[4] == w[(1, 2)] + w[(2, 3)] + w[(3, 4)] and 7 not in got
    paths = graph.trace_paths(tree, spark.createDataFrame([(5,)], "node long"))
    assert [r.node for r in paths.orderBy(F.desc("steps_to_target")).collect()] == [1, 2, 3, 4, 5]
    nodes = spark.createDataFrame([(i, 90.0 + i, 25.0) for i in range(1, 9)], "id long, lon double, lat double")
    r = graph.route_statistics(graph.route_totals(tree, e).where("node = 5"), nodes).first()
    assert r.valid and r.hops == 4 and r.weighted_cost == got[5]
    assert {r.node: r.hops for r in graph.reachable(e, src).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}


def test_long_routes_by_doubling(spark, monkeypatch):
    """A chain of 150 hops, a hop that is no open edge, and two sources."""
    e = spark.createDataFrame([(i, i + 1, 1.0 + i % 3, 0.5) for i in range(150)], "src long, dst long, cost double, base_km double")
    tree = spark.createDataFrame([(0, None), *[(i, i - 1) for i in range(1, 151)], (500, None), (501, 500)], "node long, parent long")
    written = []
    real = graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: written.append(1) or real(df))
    got = {r.node: r for r in graph.route_totals(tree, e).collect()}
    assert len(written) <= 9 and len(got) == 153
    for i in range(151):
        assert (got[i].source, got[i].hops, got[i].base_km, got[i].cost, got[i].valid) == (0, i, 0.5 * i, sum(1.0 + k % 3 for k in range(i)), True)
    assert (got[501].source, got[501].hops, got[501].valid) == (500, 1, False) and got[500].hops == 0


def test_ways_as_arrays(spark):
    ways = spark.createDataFrame([(1, [5, 6, 7]), (2, [9])], "way_id long, nodes array<bigint>")
    assert sorted((r.pos, r.a, r.b) for r in graph.hops_of_arrays(ways).collect()) == [(1, 5, 6), (2, 6, 7)]


def test_oneway_directions(spark):
    hops = spark.createDataFrame([(w, 1, 1, 2) for w in range(4)], "way_id long, pos long, a long, b long")
    nodes = spark.createDataFrame([(1, 90.0, 25.0), (2, 90.1, 25.0)], "id long, lon double, lat double")
    att = spark.createDataFrame([(0, "Yes", 2.0, False), (1, "-1", 2.0, False), (2, None, 0.0, True)],
                                "way_id long, oneway string, risk_multiplier double, blocked boolean")
    got = sorted((r.way_id, r.src, r.dst) for r in graph.edges_of_ways(hops, nodes, att).collect())
    assert got == [(0, 1, 2), (1, 2, 1), (2, 1, 2), (2, 2, 1), (3, 1, 2), (3, 2, 1)]
