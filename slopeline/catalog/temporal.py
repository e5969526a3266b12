"""Trailing windows, point-in-time joins, labels, calendar features and chronological splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeline.catalog.registry import query
from slopeline.operators import asof, intervals, windows
from slopeline.sources import derived

TRAILING_SQL = """
  SELECT a.key, a.p,
    {cols}
  FROM {anchors} a LEFT JOIN {daily} o
    ON o.key = a.key AND o.d >= a.p - 30 AND o.d < a.p
  GROUP BY a.key, a.p"""


def _strict(w: int) -> str:
    f = f"FILTER (o.d >= a.p - {w})"
    return (f"round(CASE WHEN count(o.v) {f} = count(o.d) {f} THEN sum(o.v) {f} END, 6) "
            f"AS rainfall_{w}day")


def _partial(w: int) -> str:
    return f"round(sum(o.v) FILTER (o.d >= a.p - {w}), 6) AS partial_{w}day"


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names or c.startswith(("rainfall_", "partial_"))
                       and c != "rainfall_days_available" else F.col(c) for c in df.columns])


DAYS = "CAST(count(o.v) AS BIGINT) AS rainfall_days_available"
STRICT = ", ".join(_strict(w) for w in windows.WINDOWS)
PARTIAL = ", ".join(_partial(w) for w in windows.WINDOWS)


@query("flagship_rain_by_label", views="anchors daily_obs hazard", sql=f"""
  WITH feat AS ({TRAILING_SQL.format(cols=STRICT + ", " + DAYS, anchors="anchors", daily="daily_obs")}),
  lab AS (
    SELECT a.key, a.p, CAST(count(h.event_id) > 0 AS INT) AS label,
           epoch(min(h.event_time) - CAST(a.p AS TIMESTAMP)) AS lead
    FROM anchors a LEFT JOIN hazard h ON h.affected_segment_id = a.key
      AND h.event_time > CAST(a.p AS TIMESTAMP)
      AND h.event_time <= CAST(a.p AS TIMESTAMP) + INTERVAL 7 DAY
    GROUP BY 1, 2)
  SELECT label, count(*) AS samples, round(avg(rainfall_7day), 6) AS avg_rain_7day,
         round(avg(rainfall_30day), 6) AS avg_rain_30day,
         round(avg(rainfall_days_available), 6) AS avg_days, round(avg(lead), 3) AS avg_lead_seconds
  FROM feat JOIN lab USING (key, p) GROUP BY label""")
def flagship(t):
    anchors = derived.anchors(t)
    feats = windows.trailing_features(derived.daily_obs(t), anchors)
    labels = intervals.label_samples(anchors, derived.hazard(t), segment="key", prediction="p")
    return (feats.join(labels, ["key", "p"]).groupBy("label").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.avg("rainfall_7day"), 6).alias("avg_rain_7day"),
        F.round(F.avg("rainfall_30day"), 6).alias("avg_rain_30day"),
        F.round(F.avg("rainfall_days_available"), 6).alias("avg_days"),
        F.round(F.avg("lead_seconds"), 3).alias("avg_lead_seconds")))


@query("e1_e3_e4_trailing_strict", views="daily_obs",
       sql=TRAILING_SQL.format(cols=STRICT + ", " + DAYS, daily="daily_obs",
                               anchors="(SELECT key, d AS p FROM daily_obs)"))
def trailing_strict(t):
    return _rounded(windows.trailing_features(derived.daily_obs(t)))


@query("e2_trailing_partial", views="daily_obs",
       sql=TRAILING_SQL.format(cols=PARTIAL, daily="daily_obs",
                               anchors="(SELECT key, d AS p FROM daily_obs)"))
def trailing_partial(t):
    out = windows.trailing_features(derived.daily_obs(t), partial_prefix="partial_")
    return _rounded(out.select("key", "p", *[f"partial_{w}day" for w in windows.WINDOWS]))


@query("e5_anchored_features", views="daily_obs anchors",
       sql=TRAILING_SQL.format(cols=STRICT + ", " + DAYS, anchors="anchors", daily="daily_obs")
       + " HAVING count(o.d) > 0")
def anchored(t):
    return _rounded(windows.trailing_features(derived.daily_obs(t), derived.anchors(t),
                                              require_lookback=True))


@query("e3_trailing_at_fact_scale", views="daily_big",
       sql=TRAILING_SQL.format(cols=STRICT + ", " + DAYS, daily="daily_big",
                               anchors="(SELECT key, d AS p FROM daily_big)"))
def trailing_big(t):
    return _rounded(windows.trailing_features(derived.daily_big(t)))


@query("c5_d1_horizon_labels", views="anchors hazard", sql="""
  SELECT a.key, a.p, CAST(count(h.event_id) > 0 AS INT) AS label,
         count(h.event_id) AS matching_event_count,
         strftime(min(h.event_time), '%Y-%m-%d %H:%M:%S.%f') AS earliest_event_time,
         round(epoch(min(h.event_time) - CAST(a.p AS TIMESTAMP)), 6) AS lead_seconds
  FROM anchors a LEFT JOIN hazard h ON h.affected_segment_id = a.key
    AND h.event_time > CAST(a.p AS TIMESTAMP)
    AND h.event_time <= CAST(a.p AS TIMESTAMP) + INTERVAL 7 DAY
  GROUP BY 1, 2""")
def horizon_labels(t):
    out = intervals.label_samples(derived.anchors(t), derived.hazard(t), segment="key", prediction="p")
    return out.select("key", "p", "label", "matching_event_count",
                      F.date_format("earliest_event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
                      .alias("earliest_event_time"),
                      F.round("lead_seconds", 6).alias("lead_seconds"))


READINGS = "SELECT user_id AS key, ts AS t, event_id, value, event_type FROM events"


def _readings(t):
    return t.events.select(F.col("user_id").alias("key"), F.col("ts").alias("t"), "event_id", "value",
                           "event_type")


@query("c3_asof_backward", views="anchors", sql=f"""
  WITH obs AS ({READINGS})
  SELECT a.key, a.p, o.event_id, o.value, strftime(o.t, '%Y-%m-%d %H:%M:%S.%f') AS feature_latest_ts
  FROM (SELECT *, CAST(p AS TIMESTAMP) AS pt FROM anchors) a
  ASOF LEFT JOIN obs o ON o.key = a.key AND o.t <= a.pt""")
def asof_backward(t):
    out = asof.asof_join(derived.anchors(t), _readings(t), cols=["event_id", "value"])
    out = asof.guard_no_future(out, "p", "feature_latest_ts")
    return out.withColumn("feature_latest_ts",
                          F.date_format("feature_latest_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("e6_c3_asof_keep_last_ties", views="", sql="""
  WITH o AS (SELECT l_suppkey AS key, CAST(l_shipdate AS DATE) AS t, l_orderkey, l_partkey, l_quantity
             FROM lineitem),
  last AS (SELECT key, t, max({'a': l_orderkey, 'b': l_partkey, 'c': l_quantity}) AS r FROM o GROUP BY 1, 2),
  s AS (SELECT o_orderkey, o_custkey % 100 AS key, CAST(o_orderdate AS DATE) AS p FROM orders)
  SELECT s.o_orderkey, s.key, s.p, last.t AS feature_latest_ts, last.r.a AS l_orderkey,
         last.r.b AS l_partkey, last.r.c AS l_quantity
  FROM s ASOF LEFT JOIN last ON last.key = s.key AND last.t <= s.p""")
def asof_ties(t):
    obs = t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_shipdate").cast("date").alias("t"),
                            "l_orderkey", "l_partkey", "l_quantity")
    smp = t.orders.select("o_orderkey", (F.col("o_custkey") % 100).alias("key"),
                          F.col("o_orderdate").cast("date").alias("p"))
    return asof.asof_join(smp, obs, cols=["l_orderkey", "l_partkey", "l_quantity"])


@query("c4_asof_forward_pin", views="anchors hazard", sql="""
  WITH f AS (SELECT DISTINCT affected_segment_id AS key, CAST(event_time AS DATE) AS t FROM hazard)
  SELECT a.key, a.p, f.t AS pinned, CAST(f.t - a.p AS INT) AS gap_days,
         coalesce(f.t - a.p <= 7, false) AS pin_ok
  FROM anchors a ASOF LEFT JOIN f ON f.key = a.key AND f.t >= a.p""")
def asof_forward(t):
    days = derived.hazard(t).select(F.col("affected_segment_id").alias("key"),
                                    F.col("event_time").cast("date").alias("t"))
    return asof.forward_pin(derived.anchors(t), days)


@query("c9_segment_dates", views="users anchor_days",
       sql="SELECT key, p FROM users, anchor_days")
def segment_dates(t):
    return derived.anchors(t)


SEASON_SQL = """
  SELECT o_orderkey, CASE WHEN month(d) BETWEEN 6 AND 9 THEN 'monsoon'
           WHEN month(d) BETWEEN 3 AND 5 THEN 'pre_monsoon'
           WHEN month(d) >= 10 THEN 'post_monsoon' ELSE 'winter' END AS season,
    CAST(CASE WHEN month(d) < 3 THEN 1 WHEN month(d) < 6 THEN 2 WHEN month(d) < 10 THEN 3 ELSE 4 END
      AS INT) AS season_ordinal,
    CAST(month(d) AS INT) AS month, CAST(month(d) BETWEEN 6 AND 9 AS INT) AS monsoon_active,
    CAST(month(d) BETWEEN 3 AND 5 AS INT) AS pre_monsoon,
    round(sin(2 * pi() * (dayofyear(d) - 1) / 365e0), 9) AS seasonal_sin,
    round(cos(2 * pi() * (dayofyear(d) - 1) / 365e0), 9) AS seasonal_cos,
    CAST(make_date(2000, month(d), day(d)) - DATE '2000-06-01' AS INT) AS days_into_monsoon,
    CAST(d + 7 AS DATE) AS window_end
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"""


@query("h20_h23_season_features", sql=SEASON_SQL)
def season_features(t):
    from slopeline.functions import season as s
    d = F.col("d")
    base = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return base.select(
        "o_orderkey", s.season(d).alias("season"), s.season_ordinal(d).alias("season_ordinal"),
        F.month(d).alias("month"), s.monsoon_active(d).alias("monsoon_active"),
        s.pre_monsoon(d).alias("pre_monsoon"), F.round(s.seasonal_sin(d), 9).alias("seasonal_sin"),
        F.round(s.seasonal_cos(d), 9).alias("seasonal_cos"),
        s.days_into_monsoon(d).alias("days_into_monsoon"), s.window_end(d).alias("window_end"))


def _dated_hazard(t):
    return derived.hazard(t).select("event_id", F.col("affected_segment_id").alias("osm_id"),
                                    F.col("event_time").cast("date").alias("event_date"))


@query("h24_sample_times", views="hazard", sql="""
  SELECT event_id, affected_segment_id AS osm_id, CAST(event_time AS DATE) AS event_date,
         CAST(CAST(event_time AS DATE) - o AS DATE) AS prediction_time, label, sample_kind
  FROM hazard, (VALUES (1, 1, 'positive'), (3, 1, 'positive'), (7, 1, 'positive'),
                       (14, 0, 'same_road_control')) v(o, label, sample_kind)""")
def sample_times(t):
    from slopeline.operators.sampling import event_samples
    return event_samples(_dated_hazard(t))


@query("h25_lookback_dates", views="hazard", sql="""
  SELECT DISTINCT CAST(CAST(event_time AS DATE) - o - k AS DATE) AS d
  FROM hazard, (VALUES (1), (3), (7), (14)) v(o), (SELECT CAST(k AS INT) AS k FROM generate_series(1, 30) g(k))""")
def needed_dates(t):
    from slopeline.operators.sampling import sample_dates
    return windows.lookback_dates(sample_dates(_dated_hazard(t)))


@query("h25_prediction_dates", views="hazard", sql="""
  SELECT DISTINCT CAST(CAST(event_time AS DATE) - o AS DATE) AS p
  FROM hazard, (VALUES (1), (3), (7), (14)) v(o)""")
def prediction_dates(t):
    from slopeline.operators.sampling import sample_dates
    return sample_dates(_dated_hazard(t))


@query("h28_days_since_newest", sql="""
  SELECT CAST(DATE '2024-02-05' - max(CAST(ts AS DATE)) AS INT) AS days_since_newest,
         CAST(max(ts) AS DATE) AS newest FROM events""")
def days_since_newest(t):
    newest = F.max(F.col("ts").cast("date"))
    return t.events.agg(F.datediff(F.lit("2024-02-05").cast("date"), newest).alias("days_since_newest"),
                        newest.alias("newest"))


@query("j1_temporal_split", sql="""
  SELECT split, count(*) AS n, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day
  FROM (SELECT ts, CASE WHEN ts >= TIMESTAMP '2024-01-28' THEN 'gap'
          WHEN ts < TIMESTAMP '2024-01-10' THEN 'train' WHEN ts < TIMESTAMP '2024-01-16' THEN 'validation'
          WHEN ts < TIMESTAMP '2024-01-18' THEN 'gap' ELSE 'test' END AS split FROM events)
  GROUP BY split""")
def chronological(t):
    from slopeline.operators.splits import temporal_split
    s = temporal_split(F.col("ts"), "2024-01-10", "2024-01-16", "2024-01-18", "2024-01-28")
    return (t.events.select("ts", s.alias("split")).groupBy("split")
            .agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("date").alias("first_day"),
                 F.max("ts").cast("date").alias("last_day")))


@query("j2_geographic_split", sql="""
  SELECT c_mktsegment, CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'train'
           WHEN c_mktsegment = 'MACHINERY' THEN 'test' ELSE 'holdout' END AS split, count(*) AS n
  FROM customer GROUP BY 1, 2""")
def geographic(t):
    from slopeline.operators.splits import geographic_split
    s = geographic_split(F.col("c_mktsegment"), ["BUILDING", "HOUSEHOLD"], ["MACHINERY"])
    return t.customer.groupBy("c_mktsegment", s.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("j3_monotonic_violations", sql="""
  WITH m AS (SELECT CASE WHEN event_id % 500 = 3 THEN 'test' WHEN ts < TIMESTAMP '2024-01-10' THEN 'train'
                      WHEN ts < TIMESTAMP '2024-01-20' THEN 'validation' ELSE 'test' END AS split, ts
             FROM events),
  b AS (SELECT split, min(ts) AS lo, max(ts) AS hi FROM m GROUP BY 1)
  SELECT y.split, 'overlap' AS problem FROM b x JOIN b y
    ON (x.split, y.split) IN (('train', 'validation'), ('validation', 'test')) AND y.lo < x.hi""")
def monotonic(t):
    from slopeline.operators.splits import monotonic_violations, temporal_split
    s = F.when(F.col("event_id") % 500 == 3, "test").otherwise(
        temporal_split(F.col("ts"), "2024-01-10", "2024-01-20"))
    return monotonic_violations(t.events.select("ts", s.alias("split")), "ts", "split")


@query("j4_future_leakage_rows", sql="""
  SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate""")
def future_leakage(t):
    j = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"),
                        F.col("l_orderkey") == F.col("o_orderkey"))
    return asof.leakage_rows(j, "o_orderdate", "l_shipdate").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")


@query("j5_two_class_splits", sql="""
  SELECT split, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, min(label) < max(label) AS two_class
  FROM (SELECT CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'train' WHEN ts < TIMESTAMP '2024-01-20'
          THEN 'validation' ELSE 'test' END AS split, CAST(event_type = 'error' AS INT) AS label FROM events)
  GROUP BY split""")
def two_class_splits(t):
    from slopeline.operators.splits import temporal_split, two_class
    df = t.events.select(temporal_split(F.col("ts"), "2024-01-10", "2024-01-20").alias("split"),
                         (F.col("event_type") == "error").cast("int").alias("label"))
    return two_class(df)


@query("j6_stratified_split", sql="""
  SELECT c_mktsegment, split, count(*) AS n FROM (
    SELECT c_mktsegment, CASE WHEN i * 10 < n * 7 THEN 'train' WHEN i * 10 < n * 8 THEN 'validation'
             ELSE 'test' END AS split
    FROM (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i,
                 count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)) GROUP BY 1, 2""")
def stratified(t):
    from slopeline.operators.splits import stratified_split
    out = stratified_split(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey",
                           {"train": 0.7, "validation": 0.1, "test": 0.2})
    return out.groupBy("c_mktsegment", "split").agg(F.count(F.lit(1)).alias("n"))


@query("e19_corridor_draw_counts", views="segment hazard", sql="""
  WITH ev AS (SELECT DISTINCT h.event_id, s.ref FROM hazard h JOIN segment s
              ON s.osm_id = h.affected_segment_id),
  pool AS (SELECT ref, count(*) AS n FROM segment
           WHERE osm_id NOT IN (SELECT affected_segment_id FROM hazard) GROUP BY ref),
  k AS (SELECT ref, event_id, row_number() OVER (PARTITION BY ref ORDER BY event_id) AS turn FROM ev)
  SELECT k.ref, k.event_id, least(4, pool.n - 4 * (turn - 1)) AS drawn, least(4, pool.n - 4 * (turn - 1))
    AS distinct_roads
  FROM k JOIN pool USING (ref) WHERE pool.n > 4 * (turn - 1)""")
def corridor_counts(t):
    from slopeline.operators.sampling import corridor_draw
    roads = derived.segment(t)
    hz = derived.hazard(t).select("event_id", F.col("affected_segment_id").alias("osm_id"))
    ev = hz.join(roads.select("osm_id", "ref"), "osm_id")
    drawn = corridor_draw(ev, roads, hz)
    return drawn.groupBy("ref", "event_id").agg(F.count(F.lit(1)).alias("drawn"),
                                                F.countDistinct("osm_id").alias("distinct_roads"))


@query("e16_split_by_events", views="hazard", sql="""
  WITH s AS (SELECT affected_segment_id AS g, CAST(event_time AS DATE) AS p,
                    CAST(value > 100 AS INT) AS label FROM hazard),
  e AS (SELECT g, min(p) AS f FROM s GROUP BY g),
  grp AS (SELECT f, count(*) AS n, sum(count(*)) OVER (ORDER BY f) AS cum FROM e GROUP BY f),
  tot AS (SELECT max(cum) AS n FROM grp),
  tst AS (SELECT min(f) AS f, min(cum - grp.n) AS start FROM grp, tot WHERE cum > tot.n - 3),
  v0 AS (SELECT min(cum - grp.n) AS start FROM grp, tst WHERE cum > tst.start - 3),
  cls AS (SELECT cum - grp.n AS start, max(label) AS hi, min(label) AS lo
          FROM grp JOIN e USING (f) JOIN s USING (g) GROUP BY 1),
  v AS (SELECT max(c.start) AS start FROM cls c, v0, tst WHERE c.start <= v0.start
        AND (SELECT max(hi) FROM cls d WHERE d.start >= c.start AND d.start < tst.start) = 1
        AND (SELECT min(lo) FROM cls d WHERE d.start >= c.start AND d.start < tst.start) = 0),
  vf AS (SELECT f FROM grp, v WHERE cum - grp.n = v.start)
  SELECT g, CASE WHEN e.f < vf.f THEN 'train' WHEN e.f < tst.f THEN 'validation' ELSE 'test' END AS split
  FROM e, vf, tst""")
def event_split(t):
    from slopeline.operators.splits import split_by_events
    df = derived.hazard(t).select(
        F.col("affected_segment_id").alias("g"), F.col("event_time").cast("date").alias("p"),
        (F.col("value") > 100).cast("int").alias("label"))
    return split_by_events(df, 3, 3, event="g", time="p")


@query("e17_fold_layout", views="hazard", sql="""
  WITH e AS (SELECT affected_segment_id AS g, min(CAST(event_time AS DATE)) AS f FROM hazard GROUP BY 1),
  n AS (SELECT count(DISTINCT f) AS n FROM e)
  SELECT CAST(k AS BIGINT) AS train_upto, CAST(k + 1 AS BIGINT) AS val_upto,
         CAST(k + 2 AS BIGINT) AS test_group FROM n, generate_series(4, n.n - 2) s(k)""")
def fold_layout(t):
    from slopeline.operators.splits import event_groups, expanding_folds
    df = derived.hazard(t).select(
        F.col("affected_segment_id").alias("g"), F.col("event_time").cast("date").alias("p"),
        F.lit(1).alias("label"))
    return expanding_folds(event_groups(df, "g", "p"))
