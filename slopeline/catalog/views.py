"""SQL text of the derived views, and its composition into one query."""

from __future__ import annotations

from slopeline.sources.derived import SHAPES


def shape_edges() -> str:
    """The edges of the district shapes as rows of a VALUES list."""
    rows = [(k, *a, *b) for k, rings in enumerate(SHAPES) for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True)]
    return ", ".join(f"({k}, {', '.join(f'{v!r}::DOUBLE' for v in values)})" for k, *values in rows)


# name -> (views it reads, SQL)
VIEWS: dict[str, tuple[str, str]] = {
    "daily_obs": ("", """
        SELECT user_id AS key, CAST(ts AS DATE) AS d,
               CASE WHEN count(*) FILTER (event_type = 'error' AND value > 100) = 0
                    THEN sum(value) END AS v
        FROM events GROUP BY 1, 2"""),
    "daily_big": ("", """
        SELECT l_suppkey AS key, CAST(l_shipdate AS DATE) AS d,
               CASE WHEN max(l_quantity) < 50 THEN sum(l_quantity) END AS v
        FROM lineitem GROUP BY 1, 2"""),
    "state_rain": ("", """
        SELECT 'S' || (user_id % 8) AS key, CAST(ts AS DATE) AS d, round(sum(value) FILTER (event_type <> 'error'), 6) AS v
        FROM events GROUP BY 1, 2"""),
    "users": ("", "SELECT DISTINCT user_id AS key FROM events"),
    "anchor_days": ("", """
        SELECT CAST(x AS DATE) AS p
        FROM generate_series(DATE '2024-01-04', DATE '2024-01-28', INTERVAL 3 DAY) g(x)"""),
    "anchors": ("users anchor_days", "SELECT key, p FROM users CROSS JOIN anchor_days"),
    "hazard": ("", """
        SELECT event_id, ts AS event_time, user_id AS affected_segment_id,
               CASE WHEN event_id % 3 = 0 THEN 'landslide' ELSE 'flood' END AS event_type,
               88e0 + (event_id * 29 % 1000) / 100e0 AS longitude,
               22e0 + (event_id * 41 % 800) / 100e0 AS latitude, value
        FROM events WHERE event_type = 'purchase' AND value > 60"""),
    "segment": ("", """
        SELECT p_partkey AS osm_id, 'NH-' || substr(p_brand, 7) AS ref,
               CASE WHEN p_partkey % 6 <> 0 THEN
                 array_to_string(list_transform(string_split(p_name, ' '),
                   lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') END AS name,
               CASE p_type WHEN 'STANDARD' THEN 'trunk' WHEN 'SMALL' THEN 'track'
                 WHEN 'PROMO' THEN 'primary' WHEN 'LARGE' THEN 'motorway'
                 WHEN 'MEDIUM' THEN 'secondary' WHEN 'ECONOMY' THEN 'bridleway' END AS highway,
               CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS DOUBLE) END AS slope_degrees,
               CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 THEN p_retailprice END
                 AS elevation_m,
               CASE WHEN p_partkey % 7 = 1 THEN 'yes' WHEN p_partkey % 7 > 1 THEN 'no' END AS bridge,
               CASE WHEN p_partkey % 5 = 0 THEN 'yes' END AS tunnel,
               CASE WHEN p_partkey % 9 = 0 THEN 'grade2' END AS tracktype,
               5e-1 + (p_partkey % 50) / 100e0 AS coverage_ratio,
               CASE p_partkey % 5 WHEN 1 THEN 'yes' WHEN 2 THEN '-1' END AS oneway,
               'S' || (p_partkey % 8) AS state,
               88e0 + (p_partkey * 37 % 1000) / 100e0 AS lon,
               22e0 + (p_partkey * 53 % 800) / 100e0 AS lat
        FROM part"""),
    "polyline_pt": ("segment", """
        SELECT osm_id, i, lon + dx AS lon, lat + dy AS lat FROM segment
        CROSS JOIN (VALUES (1, 0e0, 0e0), (2, 3e-2, 2e-2), (3, 5e-2, -1e-2), (4, 8e-2, 15e-3))
          o(i, dx, dy)"""),
    "polyline_seg": ("polyline_pt", """
        SELECT a.osm_id, a.i, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2
        FROM polyline_pt a JOIN polyline_pt b ON a.osm_id = b.osm_id AND b.i = a.i + 1"""),
    "district": ("", """
        SELECT n_nationkey AS district_id, n_name AS district, r_name AS state,
               88e0 + (n_nationkey % 5) * 2e0 AS x0, 22e0 + (n_nationkey // 5) * 16e-1 AS y0,
               88e0 + (n_nationkey % 5) * 2e0 + 2e0 AS x1,
               22e0 + (n_nationkey // 5) * 16e-1 + 16e-1 AS y1
        FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "district_edge": ("", f"""
        SELECT n_nationkey AS district_id, row_number() OVER () AS e,
               88e0 + (n_nationkey % 5) * 2e0 + ax AS lon1, 22e0 + (n_nationkey // 5) * 16e-1 + ay AS lat1,
               88e0 + (n_nationkey % 5) * 2e0 + bx AS lon2, 22e0 + (n_nationkey // 5) * 16e-1 + by_ AS lat2
        FROM nation JOIN (VALUES {shape_edges()}) s(kind, ax, ay, bx, by_) ON kind = n_nationkey % 4"""),
    "dem": ("", """
        SELECT o_orderkey // 4000 AS layer, (o_orderkey % 4000) // 100 AS row,
               o_orderkey % 100 AS col,
               CASE WHEN o_orderkey % 53 = 0 THEN -9999e0 ELSE
                 CAST((o_orderkey % 100) * 3 + ((o_orderkey % 4000) // 100) * 2
                   + floor(o_totalprice / 50000) AS DOUBLE) END AS v
        FROM orders"""),
    "rain_pixel": ("", """
        SELECT CAST(l_shipdate AS DATE) AS layer, (l_partkey // 50) % 16 AS row,
               l_partkey % 20 AS col, min(l_quantity) - 3e0 AS v
        FROM lineitem GROUP BY 1, 2, 3"""),
    "points": ("", """
        SELECT o_orderkey AS point_id, o_custkey AS key, CAST(o_orderdate AS DATE) AS d,
               88e0 + (o_orderkey * 31 % 1050) / 100e0 AS lon,
               22e0 + (o_orderkey * 17 % 800) / 100e0 AS lat
        FROM orders"""),
    "way_seq": ("", """
        SELECT l_orderkey AS way_id, l_partkey AS node,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
                 l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS pos
        FROM lineitem"""),
    "way_attributes": ("", """
        SELECT o_orderkey AS way_id, o_orderpriority AS highway,
               CASE o_orderkey % 5 WHEN 1 THEN 'yes' WHEN 2 THEN '-1' END AS oneway,
               CASE WHEN o_orderkey % 3 = 0 THEN -1e0 ELSE CAST(o_orderkey % 4 AS DOUBLE) END
                 AS risk_multiplier,
               o_totalprice > 40000 AS blocked
        FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice >= 20000"""),
    "hop": ("way_seq segment", """
        SELECT w.way_id, w.pos, w.node AS a, n.node AS b,
               2 * 6371.0088e0 * asin(sqrt(
                 pow(sin(radians(sb.lat - sa.lat) / 2), 2)
                 + cos(radians(sa.lat)) * cos(radians(sb.lat))
                 * pow(sin(radians(sb.lon - sa.lon) / 2), 2))) AS km
        FROM way_seq w JOIN way_seq n ON n.way_id = w.way_id AND n.pos = w.pos + 1
        JOIN segment sa ON sa.osm_id = w.node JOIN segment sb ON sb.osm_id = n.node
        WHERE w.node <> n.node"""),
    "edge": ("hop way_attributes", """
        SELECT h.way_id, h.pos, h.km, a.highway, coalesce(a.risk_multiplier, 1e0) AS risk_multiplier,
               coalesce(a.blocked, false) AS blocked, d.direction,
               CASE WHEN d.direction = 'forward' THEN h.a ELSE h.b END AS src,
               CASE WHEN d.direction = 'forward' THEN h.b ELSE h.a END AS dst
        FROM hop h LEFT JOIN way_attributes a ON a.way_id = h.way_id
        JOIN (VALUES ('forward'), ('reverse')) d(direction)
          ON (coalesce(a.oneway, '') NOT IN ('yes', '-1'))
          OR (a.oneway = 'yes' AND d.direction = 'forward')
          OR (a.oneway = '-1' AND d.direction = 'reverse')
        WHERE h.km > 0"""),
    "cost_edge": ("edge", """
        SELECT src, dst, min(km * CASE WHEN risk_multiplier <= 0 THEN 1 ELSE risk_multiplier END)
                 AS cost
        FROM edge WHERE NOT blocked GROUP BY 1, 2"""),
    "risk_input": ("", """
        SELECT o_orderkey, CASE WHEN o_orderkey % 997 <> 0 THEN 'e' || (o_orderkey % 500) END AS event_id,
          o_custkey AS osm_id, CAST(o_orderdate AS DATE) AS prediction_time,
          CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS label,
          CASE o_orderkey % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'same_road_control'
            ELSE 'observed_open_negative' END AS sample_kind,
          CASE WHEN o_orderkey % 3 = 0 THEN 'real_confirmed_temporal'
            WHEN o_orderpriority = '1-URGENT' THEN 'assumed_unaffected_real_pool'
            WHEN o_orderpriority = '2-HIGH' THEN 'real_same_road_control'
            ELSE 'real_observed_unaffected' END AS label_source,
          o_orderkey % 31 - CASE WHEN o_orderkey % 401 = 0 THEN 40e0 ELSE 0e0 END AS rainfall_1day,
          CASE WHEN o_orderkey % 89 <> 0 THEN o_orderkey % 50 * 3e0 END AS rainfall_3day,
          CASE WHEN o_orderkey % 101 = 0 THEN 20000e0 ELSE o_orderkey % 70 * 4e0 END AS rainfall_7day,
          o_orderkey % 90 * 5e0 AS rainfall_14day,
          CASE WHEN o_orderkey % 83 <> 0 THEN o_orderkey % 120 * 6e0 END AS rainfall_30day,
          CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 1000 * 10e0 - 600e0 END AS elevation_m,
          CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 95 AS DOUBLE) END AS slope_degrees,
          o_orderkey % 200 - 100e0 AS latitude, o_orderkey % 400 - 200e0 AS longitude,
          CASE o_orderkey % 5 WHEN 0 THEN 'teleporter' WHEN 1 THEN ' Trunk' WHEN 2 THEN 'primary' END
            AS highway,
          CAST(o_orderkey % 33 AS DOUBLE) AS rainfall_days_available,
          'S' || (o_custkey % 8) AS state, 'NH' || (o_custkey % 25) AS ref
        FROM orders"""),
    "event_entry": ("", """
        SELECT CASE WHEN o_orderkey % 41 <> 0 THEN 'ev' || (o_orderkey - o_orderkey % 2) END AS event_id,
          CASE WHEN o_orderkey % 19 = 0 THEN '13/05/2020' ELSE strftime(o_orderdate, '%Y-%m-%d') END
            AS event_date,
          CASE WHEN o_orderkey % 13 = 0 THEN 'storm' WHEN o_orderkey % 13 < 6 THEN 'landslide'
            ELSE 'flood' END AS event_type,
          CASE WHEN o_orderkey % 17 = 0 THEN 'Atlantis' WHEN o_orderkey % 17 < 9 THEN 'Assam'
            ELSE 'Sikkim' END AS state,
          CASE WHEN o_orderkey % 23 = 0 THEN ' ' ELSE 'somewhere' END AS location_name,
          CASE WHEN o_orderkey % 29 = 0 THEN 'north' ELSE CAST(o_orderkey % 140 / 10e0 + 18 AS VARCHAR) END
            AS latitude,
          CAST(o_orderkey % 140 / 10e0 + 86 AS VARCHAR) AS longitude, o_orderpriority AS source,
          CASE o_orderkey % 4 WHEN 0 THEN 'NH' || (o_orderkey % 90)
            WHEN 1 THEN 'sh ' || (o_orderkey % 90) || 'b' WHEN 2 THEN 'NH  ' || (o_orderkey % 90)
            ELSE 'MDR7' END AS ref,
          o_custkey AS osm_id, o_orderkey
        FROM orders"""),
    "scored": ("", """
        SELECT d.doc_id AS id, quality AS y, round(CAST(n_chars % 97 AS DOUBLE) / 97, 2) AS s,
               lang AS "window"
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""),
    "scored_big": ("", """
        SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, round(l_discount * 10, 2) AS s,
               l_linestatus AS "window"
        FROM lineitem"""),
}


def with_views(names: list[str], sql: str) -> str:
    """Prefix ``sql`` with the named views and everything they read, in dependency order."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        deps, _ = VIEWS[name]
        for dep in deps.split():
            visit(dep)
        done.append(name)

    for name in names:
        visit(name)
    if not done:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in done)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[len('WITH '):]}"
    return f"WITH {ctes}\n{body}"
