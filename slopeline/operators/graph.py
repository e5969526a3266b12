"""Road graph: edge extraction, degrees, components, reachability and shortest paths.

Iterative jobs keep a frontier or a contracted graph, cut their lineage with a reliable checkpoint in
every round and stop when nothing changes.
"""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeline.functions import geo
from slopeline.operators.ordered import running_sums
from slopeline.operators.quality import count_if
from slopeline.session import discard, durable

# Spellings of a one-way tag.
FORWARD_TAGS, REVERSE_TAGS = ["yes", "1", "true"], ["-1"]


def _directions(oneway: Column) -> Column:
    tag = F.lower(F.trim(F.coalesce(oneway, F.lit(""))))
    return (F.when(tag.isin(FORWARD_TAGS), F.array(F.lit("forward"))).when(tag.isin(REVERSE_TAGS), F.array(F.lit("reverse")))
            .otherwise(F.array(F.lit("forward"), F.lit("reverse"))))


def _directed(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    out = df.withColumn("direction", F.explode(_directions(F.col("oneway"))))
    ahead = F.col("direction") == "forward"
    return out.withColumn("src", F.when(ahead, F.col(a)).otherwise(F.col(b))).withColumn(
        "dst", F.when(ahead, F.col(b)).otherwise(F.col(a)))


def hops_of_arrays(ways: DataFrame, way: str = "way_id", nodes: str = "nodes") -> DataFrame:
    """Consecutive pairs of ways that arrive as node lists; needs no shuffle."""
    pairs = geo.pairs(F.col(nodes))
    return ways.select(way, F.posexplode(pairs).alias("_p", "_h")).select(
        way, (F.col("_p") + 1).cast("bigint").alias("pos"), F.col("_h.a").alias("a"), F.col("_h.b").alias("b"))


def edges_of_ways(hops: DataFrame, nodes: DataFrame, attributes: DataFrame, way: str = "way_id") -> DataFrame:
    """Directed edges with length: missing nodes, self pairs and zero lengths drop; ways without
    attributes get risk 1 and are open."""
    na = nodes.select(F.col("id").alias("a"), F.col("lon").alias("_x1"), F.col("lat").alias("_y1"))
    nb = nodes.select(F.col("id").alias("b"), F.col("lon").alias("_x2"), F.col("lat").alias("_y2"))
    km = geo.haversine(F.col("_x1"), F.col("_y1"), F.col("_x2"), F.col("_y2"))
    # hops come dealt by their way
    known = (hops.where(F.col("a") != F.col("b")).join(attributes, way, "left").join(na, "a").join(nb, "b").withColumn("base_distance_km", km)
             .where("base_distance_km > 0").drop("_x1", "_y1", "_x2", "_y2"))
    known = known.withColumn("risk_multiplier", F.coalesce("risk_multiplier", F.lit(1.0))).withColumn(
        "blocked", F.coalesce("blocked", F.lit(False)))
    return _directed(known).drop("a", "b")


def edges_of_endpoints(roads: DataFrame) -> DataFrame:
    """Directed edges between the snapped end points of polylines."""
    def node(p):
        # adding zero turns a negative zero into zero
        return F.concat_ws(",", *[F.format_string("%.7f", geo.snap(p[c]) + F.lit(0.0)) for c in ("lon", "lat")])
    df = roads.withColumn("_u", node(F.col("coords")[0])).withColumn("_v", node(F.element_at("coords", -1))).withColumn(
        "base_distance_km", geo.line_km(F.col("coords")))
    return _directed(df.where("base_distance_km > 0"), "_u", "_v").drop("_u", "_v", "coords")


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree, degree: both ends in one aggregate."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                             F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return edges.select(ends.alias("e")).groupBy(F.col("e.node").alias("node")).agg(
        F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"),
        F.count(F.lit(1)).alias("degree"))


def degree_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Extremes and class counts of total degree, isolated nodes and self-loops."""
    d = nodes.select(F.col("id").alias("node")).join(degrees(edges), "node", "left").na.fill(
        0, ["in_degree", "out_degree", "degree"])
    one = d.agg(F.count(F.lit(1)).alias("nodes"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"),
                F.max("in_degree").alias("max_in"), F.max("out_degree").alias("max_out"),
                count_if(F.col("degree") == 0).alias("isolated"), count_if(F.col("degree") == 1).alias("degree_1"),
                count_if(F.col("degree") == 2).alias("degree_2"), count_if(F.col("degree") >= 3).alias("degree_3_plus"))
    # two single-row tables
    return one.join(edges.agg(count_if(F.col("src") == F.col("dst")).alias("self_loops")))


def endpoint_sharing(edges: DataFrame) -> DataFrame:
    """How many nodes exist, how many serve several edges, and the busiest one's count."""
    d = degrees(edges)
    return d.agg(F.count(F.lit(1)).alias("unique_endpoints"), count_if(F.col("degree") > 1).alias("reused_endpoints"),
                 F.max("degree").alias("most_shared"))


def attribute_qa(edges: DataFrame, required: list[str]) -> DataFrame:
    """NULL counts of required attributes and bad distances, as one aggregate."""
    return edges.agg(
        F.count(F.lit(1)).alias("edges"), *[count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required],
        count_if(F.col("base_distance_km").isNull() | (F.col("base_distance_km") <= 0)).alias("bad_distance"))


def effective_costs(edges: DataFrame) -> DataFrame:
    """Cheapest open parallel edge per (src, dst); a non-positive risk counts as 1."""
    risk = F.when(F.coalesce(F.col("risk_multiplier"), F.lit(1.0)) > 0, F.coalesce("risk_multiplier", F.lit(1.0))).otherwise(1.0)
    return (edges.where(~F.col("blocked") & (F.col("base_distance_km") > 0))
            .groupBy("src", "dst").agg(F.min(F.col("base_distance_km") * risk).alias("cost"),
                                       F.min("base_distance_km").alias("base_km")))


# A graph with so few edges left is finished in one task: its rounds would be many small jobs.
LAST_EDGES = 20_000


def _representatives(edges: pa.Table) -> pa.Table:
    """u, to: of each node of a few edges one node of its component."""
    root: dict = {}

    def find(v):
        while (up := root.setdefault(v, v)) != v:
            root[v] = root[up]
            v = up
        return v
    for u, v in zip(edges["u"].to_pylist(), edges["v"].to_pylist(), strict=True):
        root[find(u)] = find(v)
    kind = edges.schema.field("u").type
    return pa.table({"u": pa.array(list(root), kind), "to": pa.array([find(v) for v in list(root)], kind)})


def weak_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (its smallest node id).

    Every round hands each node to the best node of its closed neighbourhood under a fresh hash order
    and keeps the edges between different representatives. The graph shrinks by a constant factor per
    round in expectation whatever its shape, and only minima are aggregated, so hubs are no problem.
    Rounds end when at most LAST_EDGES edges are left, which one task joins up; every round removes at least
    one node.
    """
    links = durable(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct())
    live = links.where("u <> v")
    steps: list[DataFrame] = []
    i = 0
    while (left := live.count()) > LAST_EDGES:
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(i)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        best = both.groupBy("u").agg(F.min(order("v")).alias("m"))
        step = durable(best.select("u", F.least(F.col("m"), order("u"))["n"].alias("to")))
        steps.append(step)
        moved = live.join(step.withColumnRenamed("to", "a"), "u").join(
            step.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        smaller = durable(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        discard(live)
        live = smaller
        i += 1
    if left:
        kind = live.schema["u"].dataType.simpleString()
        steps.append(durable(live.groupBy(F.lit(0).alias("_all")).applyInArrow(_representatives, f"u {kind}, to {kind}")))
    everyone = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node")))
    if nodes is not None:
        everyone = everyone.unionByName(nodes.select(F.col("id").alias("node")))
    label = everyone.distinct().withColumn("rep", F.col("node"))
    for step in steps:
        label = label.join(step.withColumnRenamed("u", "rep"), "rep", "left").select(
            "node", F.coalesce("to", "rep").alias("rep"))
    low = label.groupBy("rep").agg(F.min("node").alias("component"))
    out = durable(label.join(low, "rep").select("node", "component"))
    discard(links, live, *steps)
    return out


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def component_histogram(components: DataFrame) -> DataFrame:
    """size, components, nodes, components_at_least: how many components have each size, and that size or more."""
    per = component_sizes(components).groupBy("size").agg(F.count(F.lit(1)).alias("components"), F.sum("size").alias("nodes"))
    return running_sums(per, [], [("size", False)], {"components_at_least": "components"})


def edges_per_class(edges: DataFrame, column: str = "highway") -> DataFrame:
    """Edges, self-loops and kilometres of every road class; edges without one are a class of their own."""
    return edges.groupBy(F.coalesce(F.col(column), F.lit("(none)")).alias("class")).agg(
        F.count(F.lit(1)).alias("edges"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("self_loops"),
        F.sum("base_distance_km").alias("total_km"))


def extreme_nodes(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """side, node, lon, lat: the west-, east-, south- and northernmost of the nodes; of equal ones the lowest id."""
    at = members.select(F.col("node").alias("id")).join(nodes, "id")
    whole = F.struct(F.col("id").alias("node"), "lon", "lat")
    picks = {"west": F.col("lon"), "east": -F.col("lon"), "south": F.col("lat"), "north": -F.col("lat")}
    found = at.agg(*[F.min_by(whole, F.struct(v.alias("v"), "id")).alias(s) for s, v in picks.items()])
    return found.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("n")) for s in picks])).alias("e")).where(
        "e.n IS NOT NULL").select("e.side", "e.n.*")


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, hops: breadth-first levels from the source nodes (column ``node``), until a level finds nothing new."""
    links = durable(edges.select("src", "dst").distinct())
    seen = durable(sources.select("node").distinct().withColumn("hops", F.lit(0)))
    frontier, parts = seen, [seen]
    for i in count(1):
        step = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        fresh = durable(step.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(i)))
        if fresh.isEmpty():
            discard(fresh)
            break
        parts.append(fresh)
        frontier, seen = fresh, seen.unionByName(fresh)
        if len(parts) == 20:
            seen = durable(seen)
            discard(*parts[:-1])
            parts = [seen, fresh]
    out = durable(seen)
    discard(links, *parts)
    return out


# Relaxation steps of one job.
STEPS = 3


def shortest_paths(costs: DataFrame, sources: DataFrame) -> DataFrame:
    """node, cost, parent: least cost from any source, by frontier relaxation.

    Only nodes whose cost improved in the last step relax their edges in the next one. A job takes ``STEPS``
    steps and writes one table; the loop ends when a step improves nothing.
    """
    links = durable(costs.select("src", "dst", F.col("cost").alias("w")))
    node_type = costs.schema["src"].dataType
    best = durable(sources.select("node").distinct().select(
        "node", F.lit(0.0).alias("cost"), F.lit(None).cast(node_type).alias("parent"), F.lit(True).alias("fresh")))

    def relaxed(known: DataFrame) -> DataFrame:
        offer = known.where("fresh").join(links, F.col("node") == F.col("src")).select(
            F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("src").alias("parent"), F.lit(False).alias("old"))
        both = offer.unionByName(known.select("node", "cost", "parent", F.lit(True).alias("old")))
        # of equal costs the known one stays
        new = both.groupBy("node").agg(F.min(F.struct("cost", (~F.col("old")).alias("new"), "parent")).alias("o"))
        return new.select("node", "o.cost", "o.parent", F.col("o.new").alias("fresh"))

    while True:  # costs are positive, so every node settles
        after = best
        for _ in range(STEPS):
            after = relaxed(after)
        after = durable(after)
        discard(best)
        best = after
        if best.where("fresh").isEmpty():
            discard(links)
            return best.drop("fresh")


def trace_paths(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """target, steps_to_target, node: all targets walk back together until the last has met its source."""
    parents = tree.select("node", "parent")
    at = durable(targets.select(F.col("node").alias("target")).join(
        parents.withColumnRenamed("node", "target"), "target").select(
        "target", F.lit(0).alias("steps_to_target"), F.col("target").alias("node"), "parent"))
    parts = at
    for i in count(1):
        up = at.where("parent IS NOT NULL").select("target", F.col("parent").alias("node"))
        at = durable(up.join(parents, "node").select("target", F.lit(i).alias("steps_to_target"), "node", "parent"))
        if at.isEmpty():
            break
        parts = parts.unionByName(at)
    return parts.select("target", "steps_to_target", "node")


def route_totals(tree: DataFrame, costs: DataFrame) -> DataFrame:
    """node, source, hops, base_km, cost, valid: sums over each node's path back to its source.

    Pointers are doubled: after round i a row holds the sums of its first 2^i hops and the node where they end,
    so the longest path needs log2(hops) joins and no path is listed. Rows that have met their source rest.
    A path is valid when every hop is an open edge.
    """
    known = tree.select("node", "parent")
    hops = known.where("parent IS NOT NULL").join(costs.select(F.col("src").alias("parent"), F.col("dst").alias("node"), "base_km", "cost"),
                                                  ["parent", "node"], "left")
    roots = known.where("parent IS NULL").select(F.col("node").alias("root"))
    first = hops.join(roots, F.col("parent") == F.col("root"), "left").select(
        "node", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("hops"), "base_km", "cost", F.col("cost").isNotNull().alias("valid"),
        F.col("root").isNotNull().alias("met"))
    start = roots.select(F.col("root").alias("node"), F.col("root").alias("up"), F.lit(0).cast("bigint").alias("hops"), F.lit(0.0).alias("base_km"),
                         F.lit(0.0).alias("cost"), F.lit(True).alias("valid"), F.lit(True).alias("met"))
    at = durable(first.unionByName(start))
    while not at.where("NOT met").isEmpty():
        a, b = at.where("NOT met").alias("a"), at.alias("b")
        both = lambda c: (F.coalesce(f"a.{c}", F.lit(0.0)) + F.coalesce(f"b.{c}", F.lit(0.0))).alias(c)
        further = a.join(b, F.col("a.up") == F.col("b.node")).select(
            "a.node", "b.up", (F.col("a.hops") + F.col("b.hops")).alias("hops"), both("base_km"), both("cost"),
            (F.col("a.valid") & F.col("b.valid")).alias("valid"), "b.met")
        longer = durable(at.where("met").unionByName(further))
        discard(at)
        at = longer
    return at.select("node", F.col("up").alias("source"), "hops", "base_km", "cost", "valid")


def route_statistics(totals: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per target of ``route_totals``: hops, base distance, weighted cost, straight line, detour ratio, validity."""
    p = nodes.select(F.col("id").alias("source"), F.col("lon").alias("_x1"), F.col("lat").alias("_y1"))
    q = nodes.select(F.col("id").alias("target"), F.col("lon").alias("_x2"), F.col("lat").alias("_y2"))
    routes = totals.select(F.col("node").alias("target"), "source", "hops", F.col("base_km").alias("base_distance_km"), F.col("cost").alias("weighted_cost"), "valid")
    out = routes.join(p, "source").join(q, "target").withColumn(
        "straight_km", geo.haversine(F.col("_x1"), F.col("_y1"), F.col("_x2"), F.col("_y2")))
    return out.withColumn("detour_ratio", F.when(F.col("straight_km") > 0, F.col("base_distance_km") / F.col("straight_km"))
                          ).drop("_x1", "_y1", "_x2", "_y2")


def largest_strong_component(edges: DataFrame) -> DataFrame:
    """Nodes of the largest strongly connected component; of equally large ones, that with the smallest node.

    Nodes without an incoming or outgoing edge are trimmed. In every part that hangs together a pivot with many
    edges is chosen; what it reaches and what reaches it meet in its component. All parts are searched together, so
    rounds do not grow with their number. The components are removed and the search goes on in the parts that can
    still beat the best one.
    """
    live = durable(edges.select("src", "dst").where("src <> dst").distinct())
    best, best_size, best_low = None, 1, None
    while True:  # every round removes a component of each part
        live = _trim(live)
        parts = weak_components(live)
        size = F.count(F.lit(1))
        pivot = F.max_by("node", F.struct(F.col("in_degree") * F.col("out_degree"), "node"))
        found = parts.join(degrees(live), "node").groupBy("component").agg(pivot.alias("pivot"), size.alias("size"))
        # a part's name is its smallest node
        open_ = F.col("size") > best_size
        if best is not None:
            open_ = open_ | ((F.col("size") == best_size) & (F.col("component") < F.lit(best_low)))
        hopeful = durable(found.where(open_))
        if hopeful.isEmpty():
            break
        inside = parts.join(hopeful.select("component"), "component", "left_semi").select("node")
        live = durable(live.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst"))
        start = hopeful.select(F.col("pivot").alias("node"))
        ahead = reachable(live, start).select("node")
        back = reachable(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start).select("node")
        comps = durable(ahead.join(back, "node", "left_semi").join(parts, "node").select("node", "component"))
        first = comps.groupBy("component").agg(size.alias("size"), F.min("node").alias("low")).orderBy(F.desc("size"), "low").first()
        if first["size"] > best_size or (first["size"] == best_size and best is not None and first["low"] < best_low):
            best, best_size, best_low = comps.where(F.col("component") == F.lit(first["component"])).select("node"), first["size"], first["low"]
        live = live.join(comps.select(F.col("node").alias("src")), "src", "left_anti").join(
            comps.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    if best is None:
        # no cycle: every component is a single node
        return edges.select(F.least("src", "dst").alias("node")).agg(F.min("node").alias("node")).where("node IS NOT NULL")
    return best


def _trim(edges: DataFrame) -> DataFrame:
    edges = durable(edges)
    n = edges.count()
    while n:
        src, dst = edges.select(F.col("src").alias("node")).distinct(), edges.select(F.col("dst").alias("node")).distinct()
        inner = src.join(dst, "node", "left_semi")
        edges = durable(edges.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(
            inner.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
        m = edges.count()
        if m == n:
            break
        n = m
    return edges


def graph_summary(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Nodes, edges, components, largest component and total kilometres in one row."""
    sizes = component_sizes(components).agg(F.sum("size").alias("nodes"), F.count(F.lit(1)).alias("components"),
                                            F.max("size").alias("largest_component"))
    # two single-row tables
    return sizes.join(edges.agg(F.count(F.lit(1)).alias("edges"), F.sum("base_distance_km").alias("total_km")))
