"""Road graph queries over ways derived from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeline.catalog.registry import query
from slopeline.operators import graph
from slopeline.session import durable
from slopeline.sources import derived


def _edges(t):
    return graph.edges_of_ways(derived.way_hops(t), derived.nodes(t), derived.way_attributes(t))


def _costs(t):
    # read by every step of the iterative jobs
    return durable(graph.effective_costs(_edges(t)))


def _open(t):
    return _edges(t).where(~F.col("blocked"))


@query("e24_consecutive_nodes", views="way_seq", sql="""
  SELECT w.way_id, w.pos, w.node AS a, n.node AS b FROM way_seq w JOIN way_seq n ON n.way_id = w.way_id AND n.pos = w.pos + 1""")
def consecutive_nodes(t):
    return derived.way_hops(t)


@query("i1_edge_extraction", views="edge", sql="""
  SELECT way_id, pos, src, dst, direction, highway, risk_multiplier, blocked, round(km, 6) AS base_distance_km FROM edge""")
def edge_extraction(t):
    return _edges(t).select("way_id", "pos", "src", "dst", "direction", "highway", "risk_multiplier", "blocked",
                            F.round("base_distance_km", 6).alias("base_distance_km"))


@query("i2_endpoint_graph", views="polyline_pt segment", sql="""
  WITH len AS (SELECT a.osm_id, sum(2 * 6371.0088e0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat))
      * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km
    FROM polyline_pt a JOIN polyline_pt b ON a.osm_id = b.osm_id AND b.i = a.i + 1 GROUP BY 1),
  e AS (SELECT p.osm_id, format('{:.7f},{:.7f}', p.lon, p.lat) AS u, format('{:.7f},{:.7f}', q.lon, q.lat) AS v
    FROM polyline_pt p JOIN polyline_pt q ON p.osm_id = q.osm_id AND p.i = 1 AND q.i = 4)
  SELECT e.osm_id, d.direction, CASE WHEN d.direction = 'forward' THEN u ELSE v END AS src,
    CASE WHEN d.direction = 'forward' THEN v ELSE u END AS dst, round(km, 6) AS base_distance_km
  FROM e JOIN len USING (osm_id) JOIN segment s USING (osm_id) JOIN (VALUES ('forward'), ('reverse')) d(direction)
    ON coalesce(s.oneway, '') NOT IN ('yes', '-1') OR (s.oneway = 'yes' AND d.direction = 'forward')
    OR (s.oneway = '-1' AND d.direction = 'reverse')""")
def endpoint_graph(t):
    out = graph.edges_of_endpoints(derived.polyline(t).select("osm_id", "oneway", "coords"))
    return out.select("osm_id", "direction", "src", "dst", F.round("base_distance_km", 6).alias("base_distance_km"))


@query("i5_degree_summary", views="edge segment", sql="""
  WITH d AS (SELECT s.osm_id, (SELECT count(*) FROM edge e WHERE e.dst = s.osm_id) AS i,
      (SELECT count(*) FROM edge e WHERE e.src = s.osm_id) AS o FROM segment s)
  SELECT count(*) AS nodes, min(i + o) AS min_degree, max(i + o) AS max_degree, max(i) AS max_in, max(o) AS max_out,
    count(*) FILTER (i + o = 0) AS isolated, count(*) FILTER (i + o = 1) AS degree_1, count(*) FILTER (i + o = 2) AS degree_2,
    count(*) FILTER (i + o >= 3) AS degree_3_plus, (SELECT count(*) FROM edge WHERE src = dst) AS self_loops FROM d""")
def degree_summary(t):
    return graph.degree_summary(_edges(t), derived.nodes(t))


@query("i6_endpoint_sharing", views="edge", sql="""
  WITH d AS (SELECT n, count(*) AS k FROM (SELECT src AS n FROM edge UNION ALL SELECT dst FROM edge) GROUP BY n)
  SELECT count(*) AS unique_endpoints, count(*) FILTER (k > 1) AS reused_endpoints, max(k) AS most_shared FROM d""")
def endpoint_sharing(t):
    return graph.endpoint_sharing(_edges(t))


@query("i7_attribute_qa", views="edge", sql="""
  SELECT count(*) AS edges, count(*) FILTER (highway IS NULL) AS null_highway,
    count(*) FILTER (risk_multiplier IS NULL) AS null_risk_multiplier, count(*) FILTER (km <= 0) AS bad_distance FROM edge""")
def attribute_qa(t):
    return graph.attribute_qa(_edges(t), ["highway", "risk_multiplier"])


@query("i8_effective_edge_cost", views="cost_edge", sql="SELECT src, dst, round(cost, 6) AS cost FROM cost_edge")
def effective_cost(t):
    return graph.effective_costs(_edges(t)).select("src", "dst", F.round("cost", 6).alias("cost"))


COMPONENTS = """
  WITH RECURSIVE u AS (SELECT src AS a, dst AS b FROM edge WHERE NOT blocked
    UNION SELECT dst, src FROM edge WHERE NOT blocked),
  cc(node, component) USING KEY (node) AS (
    SELECT a, min(least(a, b)) FROM u GROUP BY a
    UNION SELECT u.a, min(cc.component) FROM cc JOIN u ON u.b = cc.node JOIN recurring.cc AS r ON r.node = u.a
      WHERE cc.component < r.component GROUP BY u.a)"""


@query("i3_weak_components", views="edge", sql=f"""{COMPONENTS}
  SELECT node, component FROM cc""")
def weak_components(t):
    return graph.weak_components(_open(t))


@query("f6_component_sizes", views="edge", sql=f"""{COMPONENTS}
  SELECT component, count(*) AS size FROM cc GROUP BY 1 ORDER BY size DESC, component LIMIT 20""")
def component_sizes(t):
    return graph.component_sizes(graph.weak_components(_open(t))).orderBy(F.desc("size"), "component").limit(20)


@query("i12_graph_summary", views="edge", sql=f"""{COMPONENTS}
  SELECT (SELECT count(*) FROM cc) AS nodes, (SELECT count(DISTINCT component) FROM cc) AS components,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM cc GROUP BY component)) AS largest_component, count(*) AS edges,
    round(sum(km), 3) AS total_km FROM edge WHERE NOT blocked""")
def graph_summary(t):
    e = durable(_open(t).select("src", "dst", "base_distance_km"))
    return graph.graph_summary(e, graph.weak_components(e)).withColumn("total_km", F.round("total_km", 3))


@query("i3_component_histogram", views="edge segment", sql=f"""{COMPONENTS},
  every AS (SELECT component FROM cc UNION ALL SELECT osm_id FROM segment WHERE osm_id NOT IN (SELECT node FROM cc)),
  sizes AS (SELECT component, count(*) AS size FROM every GROUP BY 1),
  per AS (SELECT size, count(*) AS components, CAST(sum(size) AS BIGINT) AS nodes FROM sizes GROUP BY 1)
  SELECT *, CAST(sum(components) OVER (ORDER BY size DESC) AS BIGINT) AS components_at_least FROM per""")
def component_histogram(t):
    return graph.component_histogram(graph.weak_components(_open(t), derived.nodes(t)))


@query("i12_edges_per_class", views="edge", sql="""
  SELECT coalesce(highway, '(none)') AS class, count(*) AS edges, count(*) FILTER (src = dst) AS self_loops, round(sum(km), 3) AS total_km
  FROM edge GROUP BY 1""")
def edges_per_class(t):
    return graph.edges_per_class(_edges(t)).withColumn("total_km", F.round("total_km", 3))


@query("f6_extreme_nodes", views="edge segment", sql=f"""{COMPONENTS},
  big AS (SELECT component FROM cc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  m AS (SELECT osm_id AS node, lon, lat FROM segment WHERE osm_id IN (SELECT node FROM cc WHERE component IN (SELECT component FROM big)))
  (SELECT 'west' AS side, * FROM m ORDER BY lon, node LIMIT 1) UNION ALL (SELECT 'east', * FROM m ORDER BY lon DESC, node LIMIT 1)
  UNION ALL (SELECT 'south', * FROM m ORDER BY lat, node LIMIT 1) UNION ALL (SELECT 'north', * FROM m ORDER BY lat DESC, node LIMIT 1)""")
def extreme_nodes(t):
    cc = graph.weak_components(_open(t))
    largest = graph.component_sizes(cc).agg(F.min_by("component", F.struct(-F.col("size"), "component")).alias("_big"))
    # the largest component is a single row
    return graph.extreme_nodes(cc.join(F.broadcast(largest), F.col("component") == F.col("_big")), derived.nodes(t))


def _source(costs):
    return costs.agg(F.min("src").alias("node"))


DIST = """
  WITH RECURSIVE sp(node, cost) USING KEY (node) AS (
    SELECT min(src), 0e0 FROM cost_edge
    UNION SELECT e.dst, min(sp.cost + e.cost) FROM sp JOIN cost_edge e ON e.src = sp.node
      LEFT JOIN recurring.sp AS r ON r.node = e.dst WHERE r.cost IS NULL OR sp.cost + e.cost < r.cost GROUP BY e.dst)"""


@query("i9_shortest_path_costs", views="cost_edge", sql=f"{DIST} SELECT node, round(cost, 6) AS cost FROM sp")
def shortest(t):
    c = _costs(t)
    return graph.shortest_paths(c, _source(c)).select("node", F.round("cost", 6).alias("cost"))


@query("i10_reachability", views="cost_edge", sql="""
  WITH RECURSIVE r(node, hops) USING KEY (node) AS (
    SELECT min(src), 0 FROM cost_edge
    UNION SELECT e.dst, min(r.hops) + 1 FROM r JOIN cost_edge e ON e.src = r.node
      LEFT JOIN recurring.r AS k ON k.node = e.dst WHERE k.node IS NULL GROUP BY e.dst)
  SELECT node, CAST(hops AS INT) AS hops FROM r""")
def reachability(t):
    c = _costs(t)
    return graph.reachable(c, _source(c))


@query("i11_route_statistics", views="cost_edge edge segment", sql=f"""{DIST},
  base AS (SELECT src, dst, min(km) AS km FROM edge WHERE NOT blocked GROUP BY 1, 2),
  parent AS (SELECT e.dst AS node, arg_min(e.src, sp.cost + e.cost) AS up FROM sp JOIN cost_edge e ON e.src = sp.node GROUP BY 1),
  walk(target, node, hops, km) AS (
    SELECT node, node, 0, 0e0 FROM sp WHERE cost > 0
    UNION ALL SELECT w.target, p.up, w.hops + 1, w.km + b.km FROM walk w JOIN parent p ON p.node = w.node
      JOIN base b ON b.src = p.up AND b.dst = w.node WHERE w.node <> (SELECT min(src) FROM cost_edge)),
  route AS (SELECT target, max(hops) AS hops, max(km) AS km FROM walk GROUP BY 1),
  s AS (SELECT sp.node AS target, sp.cost, 2 * 6371.0088e0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS straight
    FROM sp JOIN segment b ON b.osm_id = sp.node JOIN segment a ON a.osm_id = (SELECT min(src) FROM cost_edge) WHERE sp.cost > 0)
  SELECT target, round(cost, 6) AS weighted_cost, round(straight, 6) AS straight_km, true AS valid, CAST(hops AS BIGINT) AS hops,
    round(km, 6) AS base_distance_km, CASE WHEN straight > 0 THEN round(km / straight, 6) END AS detour_ratio
  FROM s JOIN route USING (target)""")
def route_stats(t):
    c = _costs(t)
    tree = graph.shortest_paths(c, _source(c))
    out = graph.route_statistics(graph.route_totals(tree, c).where("hops > 0"), derived.nodes(t))
    return out.select("target", "valid", "hops", *[F.round(n, 6).alias(n) for n in (
        "weighted_cost", "straight_km", "base_distance_km", "detour_ratio")])


@query("i4_largest_strong_component", views="cost_edge", sql="""
  WITH RECURSIVE s AS (SELECT min(src) AS n FROM cost_edge),
  reach(seed, node) AS (SELECT n, n FROM s UNION SELECT seed, dst FROM reach JOIN cost_edge ON src = node),
  back(seed, node) AS (SELECT n, n FROM s UNION SELECT seed, src FROM back JOIN cost_edge ON dst = node),
  one AS (SELECT node FROM reach INTERSECT SELECT node FROM back)
  SELECT node FROM one""")
def strong_component(t):
    return graph.largest_strong_component(_costs(t))
