"""Input tables of the domain, derived by Spark from the given parquet tables.

Each function takes the table accessor and returns a lazy DataFrame, so every query reads the
given tables and its work grows with them. The SQL twins live in ``catalog/views.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeline.operators.ordered import consecutive
from slopeline.session import dealt

# Road class per part type (one type is left without a known class).
HIGHWAY_BY_TYPE = {
    "STANDARD": "trunk", "SMALL": "track", "PROMO": "primary",
    "LARGE": "motorway", "MEDIUM": "secondary", "ECONOMY": "bridleway",
}
# Offsets of the four points of a derived polyline.
POLYLINE_OFFSETS = [(0.0, 0.0), (0.03, 0.02), (0.05, -0.01), (0.08, 0.015)]


def _as_date(c: str) -> Column:
    return F.col(c).cast("date")


def daily_obs(t) -> DataFrame:
    """Daily series per user; a day with a large error reading has no data."""
    bad = (F.col("event_type") == "error") & (F.col("value") > 100)
    return (t.events.groupBy(F.col("user_id").alias("key"), _as_date("ts").alias("d"))
            .agg(F.when(~F.max(bad), F.sum("value")).alias("v")))


def daily_big(t) -> DataFrame:
    """Daily quantity per supplier, the same shape at a larger size."""
    lines = t.lineitem.select(F.col("l_suppkey").alias("key"), _as_date("l_shipdate").alias("d"), "l_quantity")
    return (dealt(lines, "key", "d").groupBy("key", "d")
            .agg(F.when(F.max("l_quantity") < 50, F.sum("l_quantity")).alias("v")))


def state_rain(t) -> DataFrame:
    """Daily series per state, without error readings."""
    return (t.events.groupBy(F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("key"), _as_date("ts").alias("d"))
            .agg(F.round(F.sum(F.when(F.col("event_type") != "error", F.col("value"))), 6).alias("v")))


def anchor_days(t) -> DataFrame:
    """Every third day of January 2024."""
    days = F.expr("sequence(date'2024-01-04', date'2024-01-28', interval 3 days)")
    return t.spark.range(1).select(F.explode(days).alias("p"))


def users(t) -> DataFrame:
    return t.events.select(F.col("user_id").alias("key")).distinct()


def anchors(t) -> DataFrame:
    """Users x anchor days; the day list is a fixed literal, so no join is needed."""
    days = F.expr("sequence(date'2024-01-04', date'2024-01-28', interval 3 days)")
    return users(t).select("key", F.explode(days).alias("p"))


def hazard(t) -> DataFrame:
    """Large purchases stand in for hazard events on a segment."""
    return (t.events.where((F.col("event_type") == "purchase") & (F.col("value") > 60))
            .select("event_id", F.col("ts").alias("event_time"),
                    F.col("user_id").alias("affected_segment_id"),
                    F.when(F.col("event_id") % 3 == 0, "landslide")
                    .otherwise("flood").alias("event_type"),
                    _spread("event_id", 29, 1000, 88).alias("longitude"),
                    _spread("event_id", 41, 800, 22).alias("latitude"),
                    "value"))


def _spread(key: str, factor: int, modulus: int, base: int) -> Column:
    return F.lit(float(base)) + ((F.col(key) * factor) % modulus).cast("double") / F.lit(100.0)


def segment(t) -> DataFrame:
    """Road segments from parts."""
    k = F.col("p_partkey")
    mapping = F.create_map(*[F.lit(x) for kv in HIGHWAY_BY_TYPE.items() for x in kv])
    return t.part.select(
        k.alias("osm_id"),
        F.concat(F.lit("NH-"), F.substring("p_brand", 7, 10)).alias("ref"),
        F.when(k % 6 != 0, F.initcap("p_name")).alias("name"),
        mapping[F.col("p_type")].alias("highway"),
        F.when(k % 11 != 0, F.col("p_size").cast("double")).alias("slope_degrees"),
        F.when((k % 11 != 0) & (k % 13 != 0), F.col("p_retailprice")).alias("elevation_m"),
        F.when(k % 7 == 1, "yes").when(k % 7 > 1, "no").alias("bridge"),
        F.when(k % 5 == 0, "yes").alias("tunnel"),
        F.when(k % 9 == 0, "grade2").alias("tracktype"),
        (F.lit(0.5) + (k % 50).cast("double") / F.lit(100.0)).alias("coverage_ratio"),
        F.when(k % 5 == 1, "yes").when(k % 5 == 2, "-1").alias("oneway"),
        F.concat(F.lit("S"), (k % 8).cast("string")).alias("state"),
        _spread("p_partkey", 37, 1000, 88).alias("lon"),
        _spread("p_partkey", 53, 800, 22).alias("lat"))


def polyline(t) -> DataFrame:
    """Segments with four-point coordinates, in travel order."""
    points = F.array(*[
        F.struct((F.col("lon") + F.lit(dx)).alias("lon"), (F.col("lat") + F.lit(dy)).alias("lat"))
        for dx, dy in POLYLINE_OFFSETS])
    return segment(t).withColumn("coords", points)


def district(t) -> DataFrame:
    """Nations as 25 rectangles of 2 x 1.6 degrees; the region is the state."""
    x0 = F.lit(88.0) + (F.col("n_nationkey") % 5) * F.lit(2.0)
    y0 = F.lit(22.0) + F.floor(F.col("n_nationkey") / 5) * F.lit(1.6)
    corner = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.6), (0.0, 1.6)]
    ring = F.array(*[F.struct((x0 + F.lit(dx)).alias("lon"), (y0 + F.lit(dy)).alias("lat"))
                     for dx, dy in corner])
    return (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_nationkey").alias("district_id"), F.col("n_name").alias("district"),
                    F.col("r_name").alias("state"), ring.alias("ring")))


# The corners of district shapes in a box of 2 x 1.6 degrees: a rectangle, an L, one with a hole, two parts.
SHAPES = [
    [[(0.0, 0.0), (2.0, 0.0), (2.0, 1.6), (0.0, 1.6)]],
    [[(0.0, 0.0), (2.0, 0.0), (2.0, 0.5), (0.75, 0.5), (0.75, 1.6), (0.0, 1.6)]],
    [[(0.0, 0.0), (2.0, 0.0), (2.0, 1.6), (0.0, 1.6)], [(0.5, 0.25), (1.5, 0.25), (1.5, 1.25), (0.5, 1.25)]],
    [[(0.0, 0.0), (0.75, 0.0), (1.0, 0.8), (0.75, 1.6), (0.0, 1.6)], [(1.25, 0.0), (2.0, 0.0), (2.0, 1.6), (1.25, 1.6)]],
]


def district_shapes(t) -> DataFrame:
    """Nations as districts of four kinds of shape on the boxes of ``district``."""
    x0 = F.lit(88.0) + (F.col("n_nationkey") % 5) * F.lit(2.0)
    y0 = F.lit(22.0) + F.floor(F.col("n_nationkey") / 5) * F.lit(1.6)
    shapes = [F.array(*[F.array(*[F.struct((x0 + F.lit(dx)).alias("lon"), (y0 + F.lit(dy)).alias("lat")) for dx, dy in ring]) for ring in rings])
              for rings in SHAPES]
    rings = shapes[0]
    for k, shape in enumerate(shapes[1:], 1):
        rings = F.when(F.col("n_nationkey") % len(SHAPES) == k, shape).otherwise(rings)
    return t.nation.select(F.col("n_nationkey").alias("district_id"), rings.alias("rings"))


def dem(t) -> DataFrame:
    """Elevation pixels, 40 x 100 cells per layer, -9999 where there is no data."""
    k = F.col("o_orderkey")
    value = ((k % 100) * 3 + F.floor((k % 4000) / 100) * 2
             + F.floor(F.col("o_totalprice") / 50000)).cast("double")
    return t.orders.select(
        F.floor(k / 4000).alias("layer"), F.floor((k % 4000) / 100).alias("row"),
        (k % 100).alias("col"), F.when(k % 53 == 0, F.lit(-9999.0)).otherwise(value).alias("v"))


def rain_pixel(t) -> DataFrame:
    """Daily rain pixels, 16 x 20 cells per day, negative where there is no data."""
    return (t.lineitem.groupBy(
        _as_date("l_shipdate").alias("layer"),
        (F.floor(F.col("l_partkey") / 50) % 16).alias("row"), (F.col("l_partkey") % 20).alias("col"))
        .agg((F.min("l_quantity") - F.lit(3.0)).alias("v")))


def points(t) -> DataFrame:
    """Dated point observations from orders; some lie outside the raster."""
    return t.orders.select(
        F.col("o_orderkey").alias("point_id"), F.col("o_custkey").alias("key"),
        _as_date("o_orderdate").alias("d"),
        _spread("o_orderkey", 31, 1050, 88).alias("lon"),
        _spread("o_orderkey", 17, 800, 22).alias("lat"))


def way_hops(t) -> DataFrame:
    """Consecutive node pairs of the ways: the parts of an order in line order; the line number alone is not unique."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("way_id"), "l_linenumber", "l_partkey", "l_suppkey",
                         F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                                          F.col("l_shipdate")).alias("shipped"),
                         "l_extendedprice", "l_quantity", F.col("l_partkey").alias("node"))
    return consecutive(lines, ["way_id"], ["l_linenumber", "l_partkey", "l_suppkey", "shipped",
                                           "l_extendedprice", "l_quantity"], "node")


def nodes(t) -> DataFrame:
    return segment(t).select(F.col("osm_id").alias("id"), "lon", "lat")


def way_attributes(t) -> DataFrame:
    """Attributes of ways from orders; some ways carry none."""
    k = F.col("o_orderkey")
    return t.orders.where((F.col("o_orderstatus") != "P") | (F.col("o_totalprice") >= 20000)).select(
        k.alias("way_id"), F.col("o_orderpriority").alias("highway"),
        F.when(k % 5 == 1, "yes").when(k % 5 == 2, "-1").alias("oneway"),
        F.when(k % 3 == 0, F.lit(-1.0)).otherwise((k % 4).cast("double")).alias("risk_multiplier"),
        (F.col("o_totalprice") > 40000).alias("blocked"))


def scored(t) -> DataFrame:
    """Scores with deliberate ties over labelled documents."""
    s = F.round((F.col("n_chars") % 97).cast("double") / F.lit(97.0), 2)
    return (t.documents.join(t.labels, "doc_id")
            .select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), s.alias("s"),
                    F.col("lang").alias("window")))


def scored_big(t) -> DataFrame:
    """Row-level scores at fact-table size: eleven tied levels per return window."""
    return t.lineitem.select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        F.round(F.col("l_discount") * 10, 2).alias("s"), F.col("l_linestatus").alias("window"))


def risk_input(t) -> DataFrame:
    """Sample rows with features from orders; some break a rule on purpose."""
    k = F.col("o_orderkey")
    d = lambda c: c.cast("double")
    return t.orders.select(
        k, F.when(k % 997 != 0, F.concat(F.lit("e"), (k % 500).cast("string"))).alias("event_id"),
        F.col("o_custkey").alias("osm_id"), _as_date("o_orderdate").alias("prediction_time"),
        F.when(k % 3 == 0, 1).otherwise(0).alias("label"),
        F.when(k % 3 == 0, "positive").when(k % 3 == 1, "same_road_control")
        .otherwise("observed_open_negative").alias("sample_kind"),
        F.when(k % 3 == 0, "real_confirmed_temporal")
        .when(F.col("o_orderpriority") == "1-URGENT", "assumed_unaffected_real_pool")
        .when(F.col("o_orderpriority") == "2-HIGH", "real_same_road_control")
        .otherwise("real_observed_unaffected").alias("label_source"),
        (d(k % 31) - F.when(k % 401 == 0, 40.0).otherwise(0.0)).alias("rainfall_1day"),
        F.when(k % 89 != 0, d(k % 50) * 3.0).alias("rainfall_3day"),
        F.when(k % 101 == 0, 20000.0).otherwise(d(k % 70) * 4.0).alias("rainfall_7day"),
        (d(k % 90) * 5.0).alias("rainfall_14day"),
        F.when(k % 83 != 0, d(k % 120) * 6.0).alias("rainfall_30day"),
        F.when(k % 7 != 0, d(k % 1000) * 10.0 - 600.0).alias("elevation_m"),
        F.when(k % 6 != 0, d(k % 95)).alias("slope_degrees"),
        (d(k % 200) - 100.0).alias("latitude"), (d(k % 400) - 200.0).alias("longitude"),
        F.when(k % 5 == 0, "teleporter").when(k % 5 == 1, " Trunk").when(k % 5 == 2, "primary").alias("highway"),
        (k % 33).cast("double").alias("rainfall_days_available"),
        F.concat(F.lit("S"), (F.col("o_custkey") % 8).cast("string")).alias("state"),
        F.concat(F.lit("NH"), (F.col("o_custkey") % 25).cast("string")).alias("ref"))


def event_entry(t) -> DataFrame:
    """Collected events as text fields from orders."""
    k = F.col("o_orderkey")
    return t.orders.select(
        F.when(k % 41 != 0, F.concat(F.lit("ev"), (k - k % 2).cast("string"))).alias("event_id"),
        F.when(k % 19 == 0, "13/05/2020").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("event_date"),
        F.when(k % 13 == 0, "storm").when(k % 13 < 6, "landslide").otherwise("flood").alias("event_type"),
        F.when(k % 17 == 0, "Atlantis").when(k % 17 < 9, "Assam").otherwise("Sikkim").alias("state"),
        F.when(k % 23 == 0, " ").otherwise("somewhere").alias("location_name"),
        F.when(k % 29 == 0, "north").otherwise(((k % 140) / 10 + 18).cast("string")).alias("latitude"),
        ((k % 140) / 10 + 86).cast("string").alias("longitude"),
        F.col("o_orderpriority").alias("source"),
        F.when(k % 4 == 0, F.concat(F.lit("NH"), (k % 90).cast("string")))
        .when(k % 4 == 1, F.concat(F.lit("sh "), (k % 90).cast("string"), F.lit("b")))
        .when(k % 4 == 2, F.concat(F.lit("NH  "), (k % 90).cast("string"))).otherwise("MDR7").alias("ref"),
        F.col("o_custkey").alias("osm_id"), k)
