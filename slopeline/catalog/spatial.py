"""Raster and vector joins over segments, pixels and districts."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeline.catalog.registry import query
from slopeline.catalog.scalars import TM_SQL
from slopeline.functions import scoring as sc
from slopeline.operators import polygons, raster, spatial
from slopeline.operators.ordered import rank_rows
from slopeline.sources import derived


@query("c14_rain_sampling_nearest", views="points rain_pixel", sql="""
  SELECT p.point_id, p.d, CASE WHEN r.v >= 0 THEN r.v END AS rain FROM points p LEFT JOIN rain_pixel r
    ON r.layer = p.d AND r.col = CAST(round_even((p.lon - 88) / 5e-1, 0) AS BIGINT)
   AND r.row = CAST(round_even((p.lat - 30) / -5e-1, 0) AS BIGINT)""")
def rain_sampling(t):
    row, col = raster.pixel_of(F.col("lon"), F.col("lat"), 88.0, 30.0, 0.5, -0.5, nearest=True)
    p = derived.points(t).select("point_id", "d", "lon", "lat")
    return raster.sample_pixels(p, derived.rain_pixel(t), row, col, {"d": "layer"}, "rain").drop("lon", "lat")


@query("c15_terrain_sampling_floor", views="points dem", sql="""
  SELECT p.point_id, d.v AS elevation_m FROM points p LEFT JOIN dem d ON d.layer = p.point_id // 4000
    AND d.col = CAST(floor((p.lon - 88) / 1e-1) AS BIGINT) AND d.row = CAST(floor((p.lat - 30) / -2e-1) AS BIGINT)""")
def terrain_sampling(t):
    row, col = raster.pixel_of(F.col("lon"), F.col("lat"), 88.0, 30.0, 0.1, -0.2, nearest=False)
    p = derived.points(t).select("point_id", F.floor(F.col("point_id") / 4000).alias("layer"), "lon", "lat")
    return raster.sample_pixels(p, derived.dem(t), row, col, {"layer": "layer"}, "elevation_m", clean=False).drop(
        "layer", "lon", "lat")


GRAD_SQL = """
  g AS (SELECT d.layer, d.row, d.col, d.v, d.h, (w.row IS NOT NULL) AS hw, w.v AS w, (e.row IS NOT NULL) AS he, e.v AS e,
      (n.row IS NOT NULL) AS hn, n.v AS n, (s.row IS NOT NULL) AS hs, s.v AS s
    FROM z d LEFT JOIN z w ON w.layer = d.layer AND w.row = d.row AND w.col = d.col - 1
    LEFT JOIN z e ON e.layer = d.layer AND e.row = d.row AND e.col = d.col + 1
    LEFT JOIN z n ON n.layer = d.layer AND n.row = d.row - 1 AND n.col = d.col
    LEFT JOIN z s ON s.layer = d.layer AND s.row = d.row + 1 AND s.col = d.col),
  k AS (SELECT *, CASE WHEN hw AND he THEN (e - w) / 2 WHEN he THEN e - v WHEN hw THEN v - w END AS gx,
      CASE WHEN hn AND hs THEN (s - n) / 2 WHEN hs THEN s - v WHEN hn THEN v - n END AS gy FROM g)"""


@query("e20_slope_uniform_grid", views="dem", sql=f"""
  WITH z AS (SELECT *, 0 AS h FROM dem), {GRAD_SQL}
  SELECT layer, row, col, v, round(degrees(atan(sqrt(pow(gx / 90, 2) + pow(gy / 90, 2)))), 6) AS slope_degrees FROM k""")
def slope_uniform(t):
    return raster.slope_uniform(derived.dem(t), ["layer"], tile=16).withColumn(
        "slope_degrees", F.round("slope_degrees", 6))


@query("e21_slope_geographic_grid", views="dem", sql=f"""
  WITH z AS (SELECT layer, row, col, CASE WHEN v <> -9999 THEN v END AS v, 0 AS h FROM dem), {GRAD_SQL}
  SELECT layer, row, col, v, round(CASE WHEN v IS NOT NULL THEN degrees(atan(sqrt(
      pow(gx / (1e-1 * 111320 * cos(radians(30 + (row + 5e-1) * -2e-1))), 2) + pow(gy / (2e-1 * 110574), 2)))) END, 6)
    AS slope_degrees FROM k""")
def slope_geographic(t):
    return raster.slope_geographic(derived.dem(t), 30.0, -0.2, 0.1, ["layer"]).withColumn(
        "slope_degrees", F.round("slope_degrees", 6))


@query("e22_aspect_grid", views="dem", sql=f"""
  WITH z AS (SELECT *, 0 AS h FROM dem), {GRAD_SQL}, a AS (SELECT *, 90 - degrees(atan2(-gy, gx)) AS a FROM k)
  SELECT layer, row, col, v, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) AS aspect_degrees FROM a""")
def aspect_grid(t):
    return raster.aspect(derived.dem(t), ["layer"], tile=32).withColumn("aspect_degrees", F.round("aspect_degrees", 6))


@query("g7_mosaic_first_valid", views="dem", sql="""
  SELECT row, col, arg_min(v, layer) FILTER (v <> -9999) AS v FROM dem GROUP BY row, col""")
def mosaic(t):
    return raster.mosaic(derived.dem(t), "layer")


@query("c11_e7_road_district_overlap", views="polyline_seg district_edge", sql=f"""
  WITH tm_in AS (SELECT osm_id AS id, i, k, CASE k WHEN 1 THEN x1 ELSE x2 END AS lon, CASE k WHEN 1 THEN y1 ELSE y2 END
      AS lat, 93e0 AS meridian FROM polyline_seg, (VALUES (1), (2)) v(k)
    UNION ALL SELECT -1 - district_id, e, k, CASE k WHEN 1 THEN lon1 ELSE lon2 END, CASE k WHEN 1 THEN lat1 ELSE lat2 END, 93e0
      FROM district_edge, (VALUES (1), (2)) v(k)), {TM_SQL},
  seg AS (SELECT a.id, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, a.lon AS alon, a.lat AS alat, b.lon AS blon, b.lat AS blat,
      sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS len
    FROM tm a JOIN tm b ON a.id = b.id AND a.i = b.i AND a.k = 1 AND b.k = 2),
  edge AS (SELECT CAST(-1 - id AS INT) AS district_id, ax AS px, ay AS py, bx AS qx, by_ AS qy, alon AS plon, alat AS plat, blon AS qlon, blat AS qlat FROM seg WHERE id < 0),
  near AS (SELECT s.*, e.* FROM seg s JOIN edge e ON s.id >= 0 AND s.alon >= 88 - 1 AND e.district_id IN (
      SELECT district_id FROM edge GROUP BY 1 HAVING min(plon) - 0.05 <= greatest(alon, blon) AND max(plon) + 0.05 >= least(alon, blon)
        AND min(plat) - 0.05 <= greatest(alat, blat) AND max(plat) + 0.05 >= least(alat, blat))),
  turns AS (SELECT *, sign((qlon - plon) * (alat - plat) - (qlat - plat) * (alon - plon)) AS a1, sign((qlon - plon) * (blat - plat) - (qlat - plat) * (blon - plon)) AS b1,
      sign((blon - alon) * (plat - alat) - (blat - alat) * (plon - alon)) AS p1, sign((blon - alon) * (qlat - alat) - (blat - alat) * (qlon - alon)) AS q1 FROM near),
  touch AS (SELECT id, district_id, bool_or(a1 * b1 <= 0 AND p1 * q1 <= 0 AND least(plon, qlon) <= greatest(alon, blon) AND least(alon, blon) <= greatest(plon, qlon)
      AND least(plat, qlat) <= greatest(alat, blat) AND least(alat, blat) <= greatest(plat, qlat))
      OR count(*) FILTER (i = 1 AND (plat <= alat) <> (qlat <= alat) AND plon + (alat - plat) / (qlat - plat) * (qlon - plon) > alon) % 2 = 1 AS meets
    FROM turns GROUP BY 1, 2),
  cuts AS (SELECT id, i, district_id, ((px - ax) * (qy - py) - (py - ay) * (qx - px)) / ((bx - ax) * (qy - py) - (by_ - ay) * (qx - px)) AS t,
      ((px - ax) * (by_ - ay) - (py - ay) * (bx - ax)) / ((bx - ax) * (qy - py) - (by_ - ay) * (qx - px)) AS u
    FROM near WHERE (bx - ax) * (qy - py) - (by_ - ay) * (qx - px) <> 0),
  stops AS (SELECT DISTINCT id, i, district_id, t FROM (
      SELECT id, i, district_id, t FROM cuts WHERE t > 0 AND t < 1 AND u BETWEEN 0 AND 1
      UNION ALL SELECT DISTINCT id, i, district_id, unnest([0e0, 1e0]) FROM near)),
  part AS (SELECT *, lead(t) OVER (PARTITION BY id, i, district_id ORDER BY t) AS t2 FROM stops),
  middle AS (SELECT p.id, p.i, p.district_id, t, t2, len, ax + (t + t2) / 2 * (bx - ax) AS mx, ay + (t + t2) / 2 * (by_ - ay) AS my
    FROM part p JOIN seg s ON s.id = p.id AND s.i = p.i WHERE t2 IS NOT NULL),
  inner_ AS (SELECT m.id, m.i, m.district_id, t, any_value((t2 - t) * len) AS part_m FROM middle m JOIN edge e ON e.district_id = m.district_id
    WHERE (py <= my) <> (qy <= my) AND px + (my - py) / (qy - py) * (qx - px) > mx GROUP BY 1, 2, 3, 4 HAVING count(*) % 2 = 1),
  per AS (SELECT t.id AS osm_id, t.district_id, coalesce(sum(part_m), 0) AS inside FROM touch t LEFT JOIN inner_ n ON n.id = t.id AND n.district_id = t.district_id
    WHERE meets GROUP BY 1, 2),
  best AS (SELECT *, row_number() OVER (PARTITION BY osm_id ORDER BY round(inside, 6) DESC, district_id) AS rk,
      count(*) OVER (PARTITION BY osm_id) AS n FROM per),
  tot AS (SELECT id AS osm_id, sum(len) AS total FROM seg WHERE id >= 0 GROUP BY 1)
  SELECT t.osm_id, b.district_id, round(coalesce(inside, 0), 3) AS intersection_length_m,
    round(coalesce(least(coalesce(inside, 0) / total, 1), 0), 6) AS coverage_ratio,
    CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'boundary_resolved' ELSE 'single' END AS district_match_type
  FROM tot t LEFT JOIN best b ON b.osm_id = t.osm_id AND rk = 1""")
def district_overlap(t):
    out = polygons.assign_districts(derived.polyline(t).select("osm_id", "coords"), derived.district_shapes(t), meridian=93.0)
    return out.withColumn("intersection_length_m", F.round("intersection_length_m", 3)).withColumn(
        "coverage_ratio", F.round("coverage_ratio", 6))


def _dist_sql(px: str, py: str) -> str:
    u = f"greatest(0, least(1, (({px} - ax) * (bx - ax) + ({py} - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2))))"
    return f"sqrt(pow({px} - ax - {u} * (bx - ax), 2) + pow({py} - ay - {u} * (by_ - ay), 2))"


POINT = (92.37, 25.91)


@query("f1_nearest_to_one_event", views="polyline_pt", sql=f"""
  WITH tm_in AS (SELECT osm_id, i, lon, lat, 93e0 AS meridian FROM polyline_pt UNION ALL
    SELECT -1, 0, {POINT[0]!r}::DOUBLE, {POINT[1]!r}::DOUBLE, 93e0), {TM_SQL},
  s AS (SELECT a.osm_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM tm a JOIN tm b ON a.osm_id = b.osm_id
    AND b.i = a.i + 1), p AS (SELECT x AS px, y AS py FROM tm WHERE osm_id = -1)
  SELECT osm_id, round(min({_dist_sql("px", "py")}), 4) AS distance_m, min({_dist_sql("px", "py")}) <= 20000
    AS within_search_radius FROM s, p GROUP BY 1 ORDER BY min({_dist_sql("px", "py")}), 1 LIMIT 50""")
def nearest_one(t):
    out = spatial.nearest_to_point(derived.polyline(t).select("osm_id", "coords"), *POINT, n=50, radius_m=20000.0)
    return out.select("osm_id", F.round("distance_m", 4).alias("distance_m"), "within_search_radius")


EVENT_DIST = f"""
  WITH tm_in AS (SELECT e.event_id, p.osm_id, p.i, p.lon, p.lat,
      least(greatest(floor((e.longitude + 180) / 6) + 1, 1), 60) * 6 - 183 AS meridian FROM hazard e, polyline_pt p
    UNION ALL SELECT event_id, -1, 0, longitude, latitude, least(greatest(floor((longitude + 180) / 6) + 1, 1), 60) * 6
      - 183 FROM hazard), {TM_SQL},
  s AS (SELECT a.event_id, a.osm_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM tm a JOIN tm b
    ON a.event_id = b.event_id AND a.osm_id = b.osm_id AND b.i = a.i + 1),
  p AS (SELECT event_id, x AS px, y AS py FROM tm WHERE osm_id = -1),
  d AS (SELECT event_id, osm_id, min({_dist_sql("px", "py")}) AS m FROM s JOIN p USING (event_id) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY m, osm_id) AS rk FROM d)"""


@query("c12_nearest_roads_per_event", views="hazard polyline_pt", sql=f"""{EVENT_DIST}
  SELECT event_id, osm_id, CAST(rk AS INT) AS rank, round(m, 3) AS distance_m, m <= 5000 AS within_search_radius
  FROM r WHERE rk <= 10""")
def nearest_events(t):
    out = spatial.nearest_per_event(derived.hazard(t), derived.polyline(t), n=10, radius_m=5000.0)
    return out.select("event_id", "osm_id", "rank", F.round("distance_m", 3).alias("distance_m"), "within_search_radius")


@query("c13_f2_nearest_by_ref", views="polyline_seg segment", sql="""
  WITH s AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS d FROM polyline_seg),
  c AS (SELECT osm_id, sum(d * (x1 + x2) / 2) / sum(d) AS cx, sum(d * (y1 + y2) / 2) / sum(d) AS cy FROM s GROUP BY 1),
  k AS (SELECT osm_id, ref, sqrt(pow(cy - 26, 2) + pow((cx - 93) * 0.72, 2)) * 111 AS dkm FROM c JOIN segment USING (osm_id)
        WHERE contains(lower(ref), 'nh-1'))
  SELECT osm_id, ref, round(dkm, 6) AS dkm FROM k WHERE dkm <= 150 ORDER BY k.dkm, osm_id LIMIT 8""")
def by_ref(t):
    out = spatial.nearby_by_ref(derived.polyline(t), "NH-1", 93.0, 26.0, radius_km=150.0)
    return out.select("osm_id", "ref", F.round("dkm", 6).alias("dkm"))


EVENT, ANCHOR_A, ANCHOR_B = (93.2, 26.1), (93.0, 26.0), (93.5, 26.3)
ANCHOR_CTE = f"""
  WITH tm_in AS (SELECT osm_id, i, lon, lat, 93e0 AS meridian FROM polyline_pt UNION ALL SELECT -k, 0, x, y, 93e0
    FROM (VALUES (1, {EVENT[0]!r}::DOUBLE, {EVENT[1]!r}::DOUBLE), (2, {ANCHOR_A[0]!r}::DOUBLE, {ANCHOR_A[1]!r}::DOUBLE),
      (3, {ANCHOR_B[0]!r}::DOUBLE, {ANCHOR_B[1]!r}::DOUBLE)) v(k, x, y)), {TM_SQL},
  s AS (SELECT a.osm_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM tm a JOIN tm b ON a.osm_id = b.osm_id
    AND b.i = a.i + 1),
  p AS (SELECT max(x) FILTER (osm_id = -1) AS ex, max(y) FILTER (osm_id = -1) AS ey, max(x) FILTER (osm_id = -2) AS px,
    max(y) FILTER (osm_id = -2) AS py, max(x) FILTER (osm_id = -3) AS qx, max(y) FILTER (osm_id = -3) AS qy FROM tm),
  c AS (SELECT osm_id, {_dist_sql("ex", "ey")} AS de, {_dist_sql("px", "py")} AS da, {_dist_sql("qx", "qy")} AS db,
    ((bx - ax) * (py - ay) - (by_ - ay) * (px - ax)) * ((bx - ax) * (qy - ay) - (by_ - ay) * (qx - ax)) < 0
    AND ((qx - px) * (ay - py) - (qy - py) * (ax - px)) * ((qx - px) * (by_ - py) - (qy - py) * (bx - px)) < 0 AS crosses,
    sqrt(pow(ax - px - greatest(0, least(1, ((ax - px) * (qx - px) + (ay - py) * (qy - py)) / (pow(qx - px, 2)
      + pow(qy - py, 2)))) * (qx - px), 2) + pow(ay - py - greatest(0, least(1, ((ax - px) * (qx - px) + (ay - py)
      * (qy - py)) / (pow(qx - px, 2) + pow(qy - py, 2)))) * (qy - py), 2)) AS ea,
    sqrt(pow(bx - px - greatest(0, least(1, ((bx - px) * (qx - px) + (by_ - py) * (qy - py)) / (pow(qx - px, 2)
      + pow(qy - py, 2)))) * (qx - px), 2) + pow(by_ - py - greatest(0, least(1, ((bx - px) * (qx - px) + (by_ - py)
      * (qy - py)) / (pow(qx - px, 2) + pow(qy - py, 2)))) * (qy - py), 2)) AS eb FROM s, p),
  m AS (SELECT osm_id, min(de) AS de, min(da) AS da, min(db) AS db, min(CASE WHEN crosses THEN 0 ELSE
    least(da, db, ea, eb) END) AS dc FROM c GROUP BY 1),
  f AS (SELECT m.*, de <= 1500 AS near_event, da <= 350 AS near_a, db <= 350 AS near_b, dc <= 300 AS corridor,
    least(de, da, db) <= 1000 AS within FROM m)"""


@query("c16_multi_anchor_distances", views="polyline_pt", sql=f"""{ANCHOR_CTE}
  SELECT osm_id, round(de, 3) AS distance_to_event_m, round(da, 3) AS distance_to_a_m, round(db, 3) AS distance_to_b_m,
    round(dc, 3) AS distance_to_corridor_m, near_event, near_a, near_b, corridor AS corridor_consistent,
    within AS within_anchor_search_radius, near_a AND near_b AS near_both FROM f""")
def anchors(t):
    out = spatial.anchor_distances(derived.polyline(t).select("osm_id", "coords"), EVENT, ANCHOR_A, ANCHOR_B).drop("coords")
    return out.select(*[F.round(c, 3).alias(c) if c.startswith("distance") else F.col(c) for c in out.columns])


PLAUSIBLE = ["motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service"]


def _evidence(t):
    d = spatial.anchor_distances(derived.polyline(t), EVENT, ANCHOR_A, ANCHOR_B)
    # 'ring' and 'widget' are the place words of the derived names
    name_match = sc.two_place_match(F.col("name"), F.col("ref"), ["ring", "bolt"], ["small", "large"])
    return d.withColumn("plausible_highway", F.coalesce(F.lower("highway").isin(PLAUSIBLE), F.lit(False))).withColumn(
        "source_name_match", name_match)


EVIDENCE = """, v AS (SELECT f.*, s.highway, coalesce(lower(s.highway) IN ('motorway', 'trunk', 'primary', 'secondary',
      'tertiary', 'unclassified', 'residential', 'service'), false) AS plausible, lower(coalesce(s.name, '')) AS nm,
    lower(coalesce(s.name, '') || ' ' || s.ref) AS tx FROM f JOIN segment s USING (osm_id)),
  w AS (SELECT *, (contains(tx, 'ring') OR contains(tx, 'bolt')) AND (contains(tx, 'small') OR contains(tx, 'large')) AS hit,
    CASE WHEN near_a AND near_b THEN 5 ELSE 0 END + CASE WHEN corridor THEN 3 ELSE 0 END + CASE WHEN near_a THEN 2 ELSE 0 END
    + CASE WHEN near_b THEN 2 ELSE 0 END + CASE WHEN near_event THEN 1 ELSE 0 END + CASE WHEN plausible THEN 1 ELSE 0 END
    + CASE WHEN contains(nm, 'ring') OR contains(nm, 'bolt') THEN 4 ELSE 0 END
    + CASE WHEN contains(nm, 'small') OR contains(nm, 'large') THEN 4 ELSE 0 END
    + CASE WHEN contains(nm, 'ring') AND (contains(nm, 'small') OR contains(nm, 'large')) THEN 6 ELSE 0 END AS score
    FROM v)"""


@query("h44_h48_e8_identity_ranking", views="polyline_pt segment", sql=f"""{ANCHOR_CTE}{EVIDENCE},
  k AS (SELECT *, CASE WHEN hit THEN 'SOURCE_NAME_MATCH_REQUIRES_REVIEW' WHEN corridor AND plausible THEN
    'CORRIDOR_CANDIDATE' ELSE 'OUTSIDE_REVIEW' END AS resolution_status FROM w
    WHERE within OR (corridor AND plausible) OR hit)
  SELECT osm_id, CAST(score AS INT) AS identity_evidence_score, resolution_status, row_number() OVER (ORDER BY hit DESC,
    (near_a AND near_b) DESC, corridor DESC, score DESC, da, de, osm_id) AS candidate_rank FROM k""")
def identity_ranking(t):
    e = _evidence(t)
    e = e.withColumn("identity_evidence_score", sc.identity_score(F.col("name"), ["ring", "bolt"], ["small", "large"])).withColumn(
        "resolution_status", sc.resolution_status(F.col("source_name_match")))
    kept = e.where(F.col("within_anchor_search_radius") | F.col("source_name_match")
                   | (F.col("corridor_consistent") & F.col("plausible_highway")))
    flags = kept.select("osm_id", "identity_evidence_score", "resolution_status", "distance_to_a_m", "distance_to_event_m",
                        *[F.col(c).cast("int").alias(c) for c in ("source_name_match", "near_both", "corridor_consistent")])
    ranked = rank_rows(flags, [], [("source_name_match", False), ("near_both", False), ("corridor_consistent", False),
                                   ("identity_evidence_score", False), "distance_to_a_m", "distance_to_event_m", "osm_id"],
                       "candidate_rank")
    return ranked.select("osm_id", "identity_evidence_score", "resolution_status", "candidate_rank")


@query("h45_e9_historical_review_ranking", views="polyline_pt segment", sql=f"""{ANCHOR_CTE}{EVIDENCE},
  k AS (SELECT *, least(da, db) <= 300 AND de <= 1500 AS cor FROM w),
  z AS (SELECT *, CASE WHEN near_event THEN 1 ELSE 0 END + CASE WHEN near_a THEN 2 ELSE 0 END + CASE WHEN near_b THEN 2
    ELSE 0 END + CASE WHEN cor THEN 2 ELSE 0 END + CASE WHEN hit THEN 5 ELSE 0 END AS sc2 FROM k)
  SELECT osm_id, CAST(sc2 AS INT) AS identity_evidence_score, CASE WHEN near_a AND near_b THEN 'BOTH_BRIDGE_CANDIDATE'
      WHEN hit THEN 'SOURCE_NAME_MATCH' WHEN cor THEN 'CORRIDOR_CANDIDATE' ELSE 'OUTSIDE_REVIEW' END AS resolution_status,
    row_number() OVER (ORDER BY hit DESC, cor DESC, sc2 DESC, (near_a AND near_b) DESC, da, de, osm_id) AS candidate_rank
  FROM z""")
def historical_ranking(t):
    near = F.least("distance_to_a_m", "distance_to_b_m") <= spatial.CORRIDOR_RADIUS
    e = _evidence(t).withColumn("corridor_consistent", near & F.col("near_event"))
    e = e.select("osm_id", sc.identity_score_review(F.col("source_name_match")).alias("identity_evidence_score"),
                 sc.review_status(F.col("source_name_match")).alias("resolution_status"), "distance_to_a_m",
                 "distance_to_event_m",
                 *[F.col(c).cast("int").alias(c) for c in ("source_name_match", "near_both", "corridor_consistent")])
    ranked = rank_rows(e, [], [("source_name_match", False), ("corridor_consistent", False), ("identity_evidence_score", False),
                               ("near_both", False), "distance_to_a_m", "distance_to_event_m", "osm_id"], "candidate_rank")
    return ranked.select("osm_id", "identity_evidence_score", "resolution_status", "candidate_rank")


@query("h46_confirmation_score", views="polyline_pt segment", sql=f"""{ANCHOR_CTE}{EVIDENCE}
  SELECT osm_id, CAST(CASE WHEN plausible THEN 1 ELSE 0 END + CASE WHEN de <= 1000 THEN 1 ELSE 0 END
    + CASE WHEN da <= 250 THEN 2 ELSE 0 END + CASE WHEN da <= 100 THEN 1 ELSE 0 END AS INT) AS evidence_score FROM w""")
def confirmation(t):
    return _evidence(t).select("osm_id", sc.confirmation_score(
        F.col("highway"), F.col("distance_to_event_m"), F.col("distance_to_a_m")).alias("evidence_score"))


@query("c17_coordinate_cross_check", views="hazard", sql=f"""
  WITH tm_in AS (SELECT event_id, k, longitude + k * (event_id % 5) / 30000e0 AS lon, latitude + k * (event_id % 3) / 30000e0
      AS lat, least(greatest(floor((longitude + 180) / 6) + 1, 1), 60) * 6 - 183 AS meridian
    FROM hazard, (VALUES (0), (1)) v(k)), {TM_SQL}
  SELECT a.event_id, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) AS distance_m,
    sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 10 AS coordinates_agree
  FROM tm a JOIN tm b ON a.event_id = b.event_id AND a.k = 0 AND b.k = 1""")
def cross_check(t):
    e = F.col("event_id")
    df = derived.hazard(t).select(
        "event_id", "longitude", "latitude", (F.col("longitude") + (e % 5) / F.lit(30000.0)).alias("lon2"),
        (F.col("latitude") + (e % 3) / F.lit(30000.0)).alias("lat2"))
    out = spatial.coordinate_check(df, ["longitude", "lon2"], ["latitude", "lat2"])
    return out.select("event_id", F.round("distance_m", 4).alias("distance_m"), "coordinates_agree")
