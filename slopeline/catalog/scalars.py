"""Scalar geometry, feature arithmetic, scores, flags and nested values."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeline.catalog.registry import query
from slopeline.functions import geo
from slopeline.functions import scoring as sc
from slopeline.sources import derived

HAVERSINE = """2 * {r} * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2)
    + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))"""


def _tm_sql() -> str:
    n = 1 / 298.257223563 / (2 - 1 / 298.257223563)
    radius = 6378137.0 / (1 + n) * (1 + n * n / 4 + n**4 / 64)
    a = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    east = " + ".join(f"{a[j]!r}::DOUBLE * cos({2*j+2} * xi) * sinh({2*j+2} * eta)" for j in range(3))
    north = " + ".join(f"{a[j]!r}::DOUBLE * sin({2*j+2} * xi) * cosh({2*j+2} * eta)" for j in range(3))
    k = 0.9996 * radius
    return f"""
  tm0 AS (SELECT *, sin(radians(lat)) AS sphi, radians(lon - meridian) AS lam FROM tm_in),
  tm1 AS (SELECT *, sinh(atanh(sphi) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sphi)) AS tt FROM tm0),
  tm2 AS (SELECT *, atan2(tt, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + tt * tt)) AS eta FROM tm1),
  tm AS (SELECT *, 500000 + {k!r}::DOUBLE * (eta + {east}) AS x, {k!r}::DOUBLE * (xi + {north}) AS y FROM tm2)"""


TM_SQL = _tm_sql()


@query("h30_h31_haversine", sql=f"""
  WITH p AS (SELECT o_orderkey, 88e0 + (o_orderkey * 31 % 1050) / 100e0 AS lon,
    22e0 + (o_orderkey * 17 % 800) / 100e0 AS lat, 90e0 AS lon0, 25e0 AS lat0 FROM orders),
  a AS (SELECT o_orderkey, lon, lat FROM p), b AS (SELECT o_orderkey, lon0 AS lon, lat0 AS lat FROM p)
  SELECT a.o_orderkey, round({HAVERSINE.format(r="6371.0088e0", a="a", b="b")}, 6) AS km,
    round({HAVERSINE.format(r="6371000e0", a="a", b="b")}, 3) AS m FROM a JOIN b USING (o_orderkey)""")
def haversines(t):
    p = derived.points(t)
    at = (F.col("lon"), F.col("lat"), F.lit(90.0), F.lit(25.0))
    return p.select(F.col("point_id").alias("o_orderkey"), F.round(geo.haversine(*at), 6).alias("km"),
                    F.round(geo.haversine(*at, radius=geo.EARTH_M), 3).alias("m"))


@query("h32_h33_utm_projection", views="points", sql=f"""
  WITH z AS (SELECT *, CAST(least(greatest(floor((lon + 180) / 6) + 1, 1), 60) AS INT) AS utm_zone FROM points),
  tm_in AS (SELECT *, utm_zone * 6e0 - 183 AS meridian FROM z), {TM_SQL}
  SELECT point_id, utm_zone, round(x, 4) AS x, round(y, 4) AS y FROM tm""")
def utm(t):
    z = derived.points(t).withColumn("utm_zone", geo.utm_zone(F.col("lon")))
    xy = geo.project(F.col("lon"), F.col("lat"), geo.central_meridian(F.col("utm_zone")))
    return z.withColumn("q", xy).select("point_id", "utm_zone", F.round("q.x", 4).alias("x"), F.round("q.y", 4).alias("y"))


@query("h34_polyline_length", views="polyline_pt", sql=f"""
  SELECT a.osm_id, round(sum({HAVERSINE.format(r="6371.0088e0", a="a", b="b")}), 6) AS length_km
  FROM polyline_pt a JOIN polyline_pt b ON b.osm_id = a.osm_id AND b.i = a.i + 1 GROUP BY 1""")
def polyline_length(t):
    return derived.polyline(t).select("osm_id", F.round(geo.line_km(F.col("coords")), 6).alias("length_km"))


@query("h35_h36_midpoint_centroid", views="polyline_seg", sql="""
  WITH s AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS d FROM polyline_seg),
  c AS (SELECT *, sum(d) OVER (PARTITION BY osm_id ORDER BY i) AS e, sum(d) OVER (PARTITION BY osm_id) AS total FROM s),
  m AS (SELECT osm_id, arg_min(x1 + (total / 2 - e + d) / d * (x2 - x1), i) AS mid_lon,
          arg_min(y1 + (total / 2 - e + d) / d * (y2 - y1), i) AS mid_lat FROM c WHERE e >= total / 2 GROUP BY 1)
  SELECT s.osm_id, round(any_value(mid_lon), 6) AS mid_lon, round(any_value(mid_lat), 6) AS mid_lat,
    round(sum(d * (x1 + x2) / 2) / sum(d), 6) AS cen_lon, round(sum(d * (y1 + y2) / 2) / sum(d), 6) AS cen_lat,
    round(arg_min(x1, i), 6) AS start_lon, round(arg_max(x2, i), 6) AS end_lon
  FROM s JOIN m USING (osm_id) GROUP BY s.osm_id""")
def mid_centroid(t):
    df = derived.polyline(t).select("osm_id", "coords", geo.midpoint(F.col("coords")).alias("m"),
                                    geo.centroid(F.col("coords")).alias("c"))
    r = lambda c: F.round(c, 6)
    return df.select("osm_id", r("m.lon").alias("mid_lon"), r("m.lat").alias("mid_lat"), r("c.lon").alias("cen_lon"),
                     r("c.lat").alias("cen_lat"), r(F.col("coords")[0]["lon"]).alias("start_lon"),
                     r(F.element_at("coords", -1)["lon"]).alias("end_lon"))


@query("h37_coordinate_snap", views="segment", sql="""
  SELECT osm_id, round_even(lon * 1e7, 0) / 1e7 AS lon, round_even(lat * 1e7, 0) / 1e7 AS lat FROM segment""")
def snap(t):
    return derived.segment(t).select("osm_id", geo.snap(F.col("lon")).alias("lon"), geo.snap(F.col("lat")).alias("lat"))


RATIOS = {"rain_intensity_1_vs_7": (1, 7), "rain_intensity_3_vs_14": (3, 14), "rain_concentration_3_in_7": (3, 7),
          "rain_trend_1_vs_3": (1, 3), "rain_cumul_ratio_7_vs_30": (7, 30)}


@query("h38_h41_rain_terrain_features", views="risk_input segment", sql=f"""
  SELECT o_orderkey, {", ".join(f"round(rainfall_{a}day / CASE WHEN rainfall_{b}day < 1e-2 THEN 1e-2 ELSE rainfall_{b}day END, 6) AS {n}" for n, (a, b) in RATIOS.items())},
    round(coalesce(slope_degrees, 0) * coalesce(rainfall_7day, 0), 6) AS slope_x_rain7,
    round(coalesce(slope_degrees, 0) * coalesce(rainfall_30day, 0), 6) AS slope_x_rain30,
    round(coalesce(elevation_m, 0) * coalesce(slope_degrees, 0), 6) AS elev_x_slope,
    CAST(elevation_m IS NOT NULL AS INT) AS terrain_known,
    CAST(elevation_m IS NOT NULL AND slope_degrees IS NOT NULL AS INT) AS terrain_known_scoring
  FROM risk_input""")
def rain_terrain(t):
    out = derived.risk_input(t).select("o_orderkey", *sc.rain_features(), *sc.interactions(),
                                       sc.terrain_known_training().alias("terrain_known"),
                                       sc.terrain_known_scoring().alias("terrain_known_scoring"))
    return out.select(*[F.round(c, 6).alias(c) if "rain" in c or "elev" in c else F.col(c) for c in out.columns])


PROXY = """coalesce(p, 4e-1) + CASE WHEN bridge = 'yes' THEN 1e-1 ELSE 0 END + CASE WHEN tunnel = 'yes' THEN 5e-2
    ELSE 0 END + CASE WHEN coverage_ratio < 0.75 THEN 1e-1 ELSE 0 END + CASE WHEN tracktype IS NOT NULL THEN 5e-2
    ELSE 0 END"""


@query("h41_h42_proxy_risk", views="segment", sql=f"""
  SELECT osm_id, CAST(coalesce(bridge, '') <> 'no' AS INT) AS bridge_flag, CAST(coalesce(bridge, '') = 'yes' AS INT)
      AS bridge_strict, round({PROXY}, 6) AS risk_score,
    CAST(CASE WHEN round({PROXY}, 6) < 0.25 THEN 0 WHEN round({PROXY}, 6) < 0.4 THEN 1
      WHEN round({PROXY}, 6) < 0.55 THEN 2 ELSE 3 END AS INT) AS risk_class
  FROM segment LEFT JOIN (VALUES ('motorway', 5e-2), ('trunk', 1e-1), ('primary', 15e-2), ('secondary', 2e-1),
    ('track', 6e-1)) m(h, p) ON m.h = highway""")
def proxy(t):
    score = sc.proxy_risk(F.col("highway"), F.col("bridge"), F.col("tunnel"), F.col("coverage_ratio"), F.col("tracktype"))
    # the score is rounded before it is classed, so that 0.1 + 0.15 is 0.25 in any engine
    return derived.segment(t).select(
        "osm_id", sc.bridge_flag_training(F.col("bridge")).alias("bridge_flag"),
        sc.yes_flag(F.col("bridge")).alias("bridge_strict"), F.round(score, 6).alias("risk_score")).withColumn(
        "risk_class", sc.risk_class(F.col("risk_score")))


@query("h43_aspect_category", views="risk_input", sql="""
  SELECT o_orderkey, CASE WHEN elevation_m IS NULL THEN 'NODATA' ELSE
      (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[CAST(floor(((o_orderkey % 720) / 2e0 + 22.5) / 45) AS INT) % 8 + 1]
      END AS aspect_category FROM risk_input""")
def aspect_categories(t):
    a = F.when(F.col("elevation_m").isNotNull(), (F.col("o_orderkey") % 720) / F.lit(2.0))
    return derived.risk_input(t).select("o_orderkey", sc.aspect_category(a).alias("aspect_category"))


@query("h26_h27_freshness", sql="""
  WITH b AS (SELECT event_id, ts AS p, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1
      THEN ts + INTERVAL 1 HOUR ELSE ts - to_hours(CAST(floor(value) AS BIGINT)) END AS o,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Z' WHEN 2 THEN '+05:30'
      ELSE '-0400' END AS iso FROM events),
  h AS (SELECT *, epoch(p - o) / 3600 AS h FROM b)
  SELECT event_id, round(h, 3) AS age_hours, CASE WHEN o IS NULL THEN 'MISSING_METADATA' WHEN h < 0
      THEN 'INVALID_FUTURE_OBSERVATION' WHEN h <= 48 THEN 'FRESH' WHEN h <= 168 THEN 'STALE' ELSE 'EXPIRED' END AS status,
    regexp_matches(iso, '(Z|[+-]\\d{2}:?\\d{2})$') AS has_zone,
    CASE event_id % 4 WHEN 1 THEN CAST(epoch(date_trunc('second', p)) AS BIGINT)
      WHEN 2 THEN CAST(epoch(date_trunc('second', p)) AS BIGINT) - 19800
      WHEN 3 THEN CAST(epoch(date_trunc('second', p)) AS BIGINT) + 14400 END AS epoch_s
  FROM h""")
def freshness(t):
    from slopeline.functions.zoned import parse_zoned, zoned_ok
    k = F.col("event_id")
    observed = (F.when(k % 10 == 0, None).when(k % 10 == 1, F.col("ts") + F.expr("interval 1 hour"))
                .otherwise(F.expr("timestampadd(HOUR, -cast(floor(value) as bigint), ts)")))
    zone = F.when(k % 4 == 0, "").when(k % 4 == 1, "Z").when(k % 4 == 2, "+05:30").otherwise("-0400")
    df = t.events.select("event_id", "ts", observed.alias("o"),
                         F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone).alias("iso"))
    return df.select("event_id", F.round(sc.age_hours(F.col("ts"), F.col("o")), 3).alias("age_hours"),
                     sc.freshness(F.col("ts"), F.col("o")).alias("status"), zoned_ok(F.col("iso")).alias("has_zone"),
                     F.unix_timestamp(parse_zoned(F.col("iso"))).alias("epoch_s"))


@query("h29_window_end", views="risk_input", sql="""
  SELECT o_orderkey, CAST(prediction_time + 7 AS DATE) AS observation_window_end FROM risk_input""")
def window_ends(t):
    from slopeline.functions.season import window_end
    return derived.risk_input(t).select("o_orderkey", window_end(F.col("prediction_time")).alias("observation_window_end"))


CAL_X, CAL_Y = [0.05, 0.2, 0.4, 0.7, 0.95], [0.01, 0.15, 0.5, 0.62, 0.99]


def _cal_sql(v: str) -> str:
    f = lambda z: f"CAST({z!r} AS FLOAT)"
    arms = " ".join(
        f"WHEN {v} <= {f(x1)} THEN CAST(CAST(CAST(CAST({f(y1)} - {f(y0)} AS DOUBLE) / CAST({f(x1)} - {f(x0)} AS DOUBLE) "
        f"AS FLOAT) * ({v} - {f(x0)}) AS FLOAT) + {f(y0)} AS FLOAT)"
        for x0, x1, y0, y1 in zip(CAL_X, CAL_X[1:], CAL_Y, CAL_Y[1:]))
    return f"CASE WHEN {v} <= {f(CAL_X[0])} THEN {f(CAL_Y[0])} {arms} ELSE {f(CAL_Y[-1])} END"


@query("h49_h51_calibrate_band_decide", sql=f"""
  WITH v AS (SELECT o_orderkey, CAST(o_totalprice / 500000 AS FLOAT) AS v FROM orders),
  c AS (SELECT o_orderkey, CAST({_cal_sql("v")} AS DOUBLE) AS p FROM v)
  SELECT o_orderkey, round(p, 6) AS calibrated, CASE WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.4 THEN 'MEDIUM' ELSE 'LOW'
    END AS risk_level, CASE WHEN p >= 0.55 THEN 'ALERT' ELSE 'NO_ALERT' END AS operating_decision FROM c""")
def calibrated(t):
    p = sc.calibrate(F.col("o_totalprice") / 500000, CAL_X, CAL_Y)
    return t.orders.select("o_orderkey", p.alias("p")).select(
        "o_orderkey", F.round("p", 6).alias("calibrated"), sc.risk_band(F.col("p")).alias("risk_level"),
        sc.decision(F.col("p"), 0.55).alias("operating_decision"))


OOD = {"rainfall_30day": (12.0, 600.0), "slope_degrees": (2.0, 80.0), "elevation_m": (0.0, None), "rainfall_7day": (0.0, 260.0)}


@query("h52_h53_confidence_flags", views="risk_input", sql="""
  WITH b AS (SELECT o_orderkey, concat_ws(',', CASE WHEN rainfall_30day NOT BETWEEN 12 AND 600 THEN 'rainfall_30day' END,
      CASE WHEN rainfall_7day NOT BETWEEN 0 AND 260 THEN 'rainfall_7day' END,
      CASE WHEN slope_degrees NOT BETWEEN 2 AND 80 THEN 'slope_degrees' END) AS ood,
    CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 10 WHEN 2 THEN 100 ELSE 200 END AS h,
    elevation_m IS NULL OR slope_degrees IS NULL AS no_terrain FROM risk_input),
  f AS (SELECT *, concat_ws(',', CASE WHEN h IS NULL THEN 'WEATHER_FRESHNESS_UNKNOWN' WHEN h > 168 THEN 'WEATHER_EXPIRED'
      WHEN h > 48 THEN 'WEATHER_STALE' END, CASE WHEN ood <> '' THEN 'OUT_OF_DISTRIBUTION' END,
      CASE WHEN no_terrain THEN 'MISSING_TERRAIN' END) AS flags FROM b)
  SELECT o_orderkey, ood AS ood_features, flags AS confidence_flags, flags <> '' AS low_confidence FROM f""")
def confidence(t):
    k = F.col("o_orderkey")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    hours = F.when(k % 4 == 1, 10).when(k % 4 == 2, 100).when(k % 4 == 3, 200)
    observed = F.timestamp_add("HOUR", -hours, now)
    df = derived.risk_input(t).withColumn("ood", sc.ood_features(OOD)).withColumn(
        "flags", sc.confidence_flags(sc.freshness(now, observed), F.size("ood"), sc.terrain_known_scoring()))
    return df.select("o_orderkey", F.array_join("ood", ",").alias("ood_features"),
                     F.array_join("flags", ",").alias("confidence_flags"), (F.size("flags") > 0).alias("low_confidence"))


@query("h54_dms_coordinates", sql="""
  SELECT o_orderkey, round(o_orderkey % 30 + (o_orderkey % 60) / 60e0 + (o_orderkey % 3600) / 60e0 / 3600, 9) AS lat,
    abs((o_orderkey % 30 + (o_orderkey % 60) / 60e0 + (o_orderkey % 3600) / 60e0 / 3600) - 27.5) <= 1e-9 AS matches
  FROM orders""")
def dms_coordinates(t):
    k = F.col("o_orderkey")
    lat = geo.dms((k % 30).cast("double"), (k % 60).cast("double"), (k % 3600) / F.lit(60.0))
    return t.orders.select("o_orderkey", F.round(lat, 9).alias("lat"), (F.abs(lat - 27.5) <= 1e-9).alias("matches"))


@query("h55_neighbour_slope", sql="""
  WITH e AS (SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 70 * 1e0 END,
      CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 90 * 2e0 END, CASE WHEN o_orderkey % 2 > 0 THEN 15e0 END,
      CASE WHEN o_orderkey % 4 = 3 THEN o_orderkey % 11 * 3e0 END], lambda x: x IS NOT NULL) AS l FROM orders)
  SELECT o_orderkey, round(CASE WHEN len(l) >= 2 THEN degrees(atan((list_max(l) - list_min(l)) / 100)) END, 6)
    AS slope_degrees FROM e""")
def neighbour(t):
    k = F.col("o_orderkey")
    d = lambda c: c.cast("double")
    e = F.array(F.when(k % 3 > 0, d(k % 70)), F.when(k % 5 > 0, d(k % 90) * 2), F.when(k % 2 > 0, 15.0),
                F.when(k % 4 == 3, d(k % 11) * 3))
    return t.orders.select("o_orderkey", F.round(sc.neighbour_slope(e), 6).alias("slope_degrees"))


@query("h56_sorted_map_json", sql="""
  SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '","user":"'
    || user_id || '"}' AS j FROM events""")
def map_json(t):
    m = F.from_json("props", "k int")
    obj = F.to_json(F.struct(m["k"].alias("k"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("user")))
    pairs = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"))
    # the map form sorts its keys; the struct form carries the number as a number
    tail = F.substr(sc.sorted_map_json(pairs), F.lit(2))
    head = F.substr(obj, F.lit(1), F.length(F.concat(F.lit('{"k":'), m["k"].cast("string"))))
    return t.events.select("event_id", F.concat(head, F.lit(","), tail).alias("j"))


@query("h57_feed_segment_mapping", sql="""
  SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS segment_no, user_id AS road_id,
    round(coalesce(CASE WHEN event_type <> 'error' THEN value END, 0), 4) AS disruption_probability FROM events""")
def feed_segment(t):
    from slopeline.plans.feed import api_segments
    seg = F.struct(F.get_json_object("props", "$.k").cast("int").alias("segment_no"), F.col("user_id").alias("osm_id"),
                   F.when(F.col("event_type") != "error", F.round("value", 4)).alias("disruption_probability"))
    docs = t.events.select("event_id", F.to_json(F.struct(F.array(seg).alias("segments"))).alias("doc"))
    return api_segments(docs, "doc", "segment_no int, osm_id bigint, disruption_probability double",
                        rename={"osm_id": "road_id"}, zero=["disruption_probability"], keep=["event_id"])


@query("h58_contribution_records", views="risk_input", sql="""
  SELECT o_orderkey, 'slope=' || coalesce(CAST(CAST(slope_degrees AS INT) AS VARCHAR), 'null') || ' c='
    || CAST(CAST(round(coalesce(slope_degrees, 0) * 1e6 / 7) AS BIGINT) AS VARCHAR) AS rec FROM risk_input""")
def contributions(t):
    rec = sc.contribution_records(["slope"], [F.col("slope_degrees")], [F.coalesce("slope_degrees", F.lit(0.0)) / 7])[0]
    return derived.risk_input(t).select(
        "o_orderkey", F.concat(rec["feature"], F.lit("="), F.coalesce(rec["value"].cast("int").cast("string"), F.lit("null")),
                               F.lit(" c="), F.round(rec["contribution"] * 1e6).cast("bigint").cast("string")).alias("rec"))


@query("h59_distinct_value_lists", views="risk_input", sql="""
  SELECT label, string_agg(DISTINCT label_source, ',' ORDER BY label_source) AS sources FROM risk_input GROUP BY label""")
def value_lists(t):
    return derived.risk_input(t).groupBy("label").agg(
        F.array_join(F.sort_array(F.collect_set("label_source")), ",").alias("sources"))
