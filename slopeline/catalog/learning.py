"""Model training, scoring, cross-validation, feeds, traces and readiness."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from slopeline.catalog.assembly import _fresh_path
from slopeline.catalog.quality import BOOKKEEPING
from slopeline.catalog.registry import query
from slopeline.functions.scoring import calibrate, decision, risk_band
from slopeline.operators import metrics
from slopeline.operators.isotonic import isotonic_steps
from slopeline.plans import audit, dataset, folds, model, scoring
from slopeline.session import durable, spread
from slopeline.sources import derived, files, sinks

INPUTS = ["elevation_m", "slope_degrees", "rainfall_1day", "rainfall_3day", "rainfall_7day", "rainfall_14day",
          "rainfall_30day"]


def labelled(t, rows=None):
    """Valid scoring rows with a learnable label and a chronological split by date."""
    valid, _ = scoring.validate_inputs(derived.risk_input(t) if rows is None else rows, BOOKKEEPING)
    rows = scoring.derive_inputs(valid).where("event_id IS NOT NULL")
    steep = F.coalesce("slope_degrees", F.lit(0.0)) * F.col("rainfall_7day") > 5000
    cut = F.lit("2000-01-01").cast("date")
    return rows.withColumn("label", steep.cast("int")).withColumn(
        "split", F.when(F.col("prediction_time") < cut, "train").when(F.year("prediction_time") == 2000, "validation")
        .otherwise("test"))


def parts(t, *more):
    """Training, validation and test rows: key, label, split, the inputs and the columns named in ``more``."""
    rows = durable(labelled(t).select("o_orderkey", "label", "split", *INPUTS, *more))
    return tuple(rows.where(F.col("split") == s) for s in ("train", "validation", "test"))


@query("j7_preprocess")
def preprocess(t):
    rows = derived.segment(t)
    pipe = model.preprocess(rows, ["slope_degrees", "elevation_m"], ["highway", "bridge", "state"])
    out = pipe.fit(rows).transform(rows)
    return out.select("osm_id", F.array_join(F.transform(vector_to_array("features"), lambda x: x.cast("string")), ",")
                      .alias("features"))


@query("j8_j13_boosted_scores")
def boosted(t):
    train, val, test = parts(t)
    fitted = model.fit_boosted(train, val, INPUTS, maxIter=20, stepSize=0.1)
    out = scoring.score_table(fitted, test, INPUTS, threshold=0.5)
    return out.select("o_orderkey", "label", F.round("raw_probability", 6).alias("raw_probability"), "risk_level",
                      "operating_decision")


@query("j9_logistic_baseline")
def logistic(t):
    train, _, test = parts(t)
    s = model.score(model.fit_logistic(train, INPUTS), test, INPUTS)
    return metrics.ranking_metrics(s.select(F.col("label").alias("y"), F.col("raw_probability").alias("s")), [])


@query("j11_isotonic_calibration")
def isotonic(t):
    train, val, test = parts(t)
    fitted = model.fit_logistic(train, INPUTS)
    xy = model.fit_calibration(model.score(fitted, val, INPUTS))
    s = model.score(fitted, test, INPUTS, xy)
    return metrics.evaluate(s.select(F.col("label").alias("y"), F.col("calibrated_probability").alias("s")), [])


@query("j11_isotonic_values", views="scored", sql="""
  WITH level AS (SELECT s, sum(y) AS total, count(*) AS n FROM scored GROUP BY 1),
  run AS (SELECT *, row_number() OVER w AS i, sum(total) OVER w AS t, sum(n) OVER w AS c FROM level WINDOW w AS (ORDER BY s ROWS UNBOUNDED PRECEDING)),
  mean AS (SELECT a.i AS first, b.i AS last, (b.t - a.t + a.total) / (b.c - a.c + a.n) AS m FROM run a JOIN run b ON b.i >= a.i),
  least_ AS (SELECT first, i, min(m) AS m FROM mean JOIN (SELECT i FROM run) r ON first <= i AND last >= i GROUP BY 1, 2)
  SELECT id, round(v, 5) AS calibrated FROM scored JOIN run USING (s) JOIN (SELECT i, max(m) AS v FROM least_ GROUP BY 1) USING (i)""")
def isotonic_values(t):
    rows = derived.scored(t)
    xs, ys = isotonic_steps(rows, "y", "s")
    return rows.select("id", F.round(calibrate(F.col("s"), xs, ys), 5).alias("calibrated"))


@query("j12_multiclass_proxy")
def multiclass(t):
    rows = dataset.proxy_dataset(derived.segment(t))
    fitted = model.fit_multiclass(rows, ["coverage_ratio", "slope_degrees"], ["highway", "bridge", "tunnel", "tracktype"],
                                  trees=10, depth=6)
    out = fitted.transform(rows).select("risk_class", F.col("prediction").cast("int").alias("predicted"))
    return metrics.confusion_table(out, "risk_class", "predicted")


@query("j14_linear_factors")
def factors(t):
    train, _, test = parts(t)
    out = model.linear_factors(model.fit_logistic(train, INPUTS), test, INPUTS)
    return out.select("o_orderkey", F.to_json("top_contributing_factors").alias("factors"))


def yearly(t):
    return labelled(t, spread(derived.risk_input(t), "o_orderkey")).withColumn("month", F.trunc("prediction_time", "year")).withColumn("event_id", F.col("month").cast("string"))


@query("e17_d25_grouped_cv")
def grouped_cv(t):
    oof = folds.expanding_scores(yearly(t), INPUTS, time="month", min_train=3)
    return metrics.pooled_folds(oof, y="label", s="raw_probability")


def newton_sql(rows: str, steps: int) -> str:
    """CTEs of the balanced logistic fit with ridge 1 on one standardised feature, for every fold of ``rows`` (fold, y, x):
    n0 to n<steps> hold the fold, intercept a and slope b after each Newton step."""
    out = [f"""stats AS (SELECT fold, avg(x) AS mu, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sd, count(*) / (2e0 * sum(y)) AS w1,
        count(*) / (2e0 * (count(*) - sum(y))) AS w0 FROM {rows} GROUP BY 1 HAVING sum(y) BETWEEN 1 AND count(*) - 1),
    std AS (SELECT fold, y, (x - mu) / sd AS z, CASE WHEN y = 1 THEN w1 ELSE w0 END AS w FROM {rows} JOIN stats USING (fold)),
    n0 AS (SELECT fold, 0e0 AS a, 0e0 AS b FROM stats)"""]
    for k in range(steps):
        out.append(f"""s{k} AS (SELECT fold, any_value(a) AS a, any_value(b) AS b, sum(w * (p - y)) AS ga, sum(w * (p - y) * z) + any_value(b) AS gb, sum(w * p * (1 - p)) AS haa,
        sum(w * p * (1 - p) * z) AS hab, sum(w * p * (1 - p) * z * z) + 1 AS hbb FROM (SELECT *, 1 / (1 + exp(-(a + b * z))) AS p FROM std JOIN n{k} USING (fold)) GROUP BY 1),
    n{k + 1} AS (SELECT fold, a - (ga * hbb - gb * hab) / (haa * hbb - hab * hab) AS a, b - (gb * haa - ga * hab) / (haa * hbb - hab * hab) AS b FROM s{k})""")
    return ",\n    ".join(out)


CV_ROWS = """SELECT o_orderkey, state, prediction_time, rainfall_7day AS x, rainfall_30day AS x30, CAST(coalesce(slope_degrees, 0) * rainfall_7day > 5000 AS INT) AS y
    FROM risk_input WHERE event_id IS NOT NULL AND o_orderkey % 997 <> 0 AND rainfall_1day >= 0 AND rainfall_3day IS NOT NULL AND rainfall_7day <= 10000
      AND rainfall_30day IS NOT NULL AND o_orderkey % 5 <> 0 AND (slope_degrees IS NULL OR slope_degrees <= 90) AND (elevation_m IS NULL OR elevation_m BETWEEN -500 AND 9000)
      AND abs(latitude) <= 90 AND abs(longitude) <= 180 AND rainfall_days_available <= 30"""


@query("e18_corridor_scores", views="risk_input", sql=f"""
  WITH r AS ({CV_ROWS}), f AS (SELECT DISTINCT state AS fold FROM r), train AS (SELECT fold, y, x FROM f JOIN r ON state <> fold),
    {newton_sql("train", 12)}
  SELECT o_orderkey, state, CAST(y AS DOUBLE) AS label, round(coalesce(1 / (1 + exp(-(a + b * (x - mu) / sd))), 0.5), 5) AS raw_probability,
    round(coalesce((SELECT count(*) FILTER (o.x <= r.x) / greatest(count(*), 1) FROM r o WHERE o.state <> r.state), 0), 6) AS rainfall_7day_percentile,
    round(coalesce((SELECT count(*) FILTER (o.x30 <= r.x30) / greatest(count(*), 1) FROM r o WHERE o.state <> r.state), 0), 6) AS rainfall_30day_percentile
  FROM r LEFT JOIN n12 ON n12.fold = state LEFT JOIN stats ON stats.fold = state""")
def corridor_scores(t):
    out = folds.leave_one_out_scores(labelled(t), ["rainfall_7day"], "state", baselines=["rainfall_7day", "rainfall_30day"], key=["o_orderkey"])
    return out.select("o_orderkey", "state", "label", *[F.round(c, d).alias(c) for c, d in (
        ("raw_probability", 5), ("rainfall_7day_percentile", 6), ("rainfall_30day_percentile", 6))])


@query("e17_fold_scores", views="risk_input", sql=f"""
  WITH r AS (SELECT *, dense_rank() OVER (ORDER BY year(prediction_time)) AS g FROM ({CV_ROWS})),
    f AS (SELECT CAST(k AS INT) AS fold FROM (SELECT max(g) AS n FROM r), generate_series(3, n - 2) s(k)), train AS (SELECT fold, y, x FROM f JOIN r ON g <= fold),
    {newton_sql("train", 12)}
  SELECT o_orderkey, fold, CAST(y AS DOUBLE) AS label, round(1 / (1 + exp(-(a + b * (x - mu) / sd))), 5) AS raw_probability
  FROM r JOIN n12 ON fold = g - 2 JOIN stats USING (fold)""")
def fold_scores(t):
    out = folds.expanding_scores(yearly(t), ["rainfall_7day"], time="month", min_train=3, key=["o_orderkey"])
    return out.select("o_orderkey", "fold", "label", F.round("raw_probability", 5).alias("raw_probability"))


@query("e18_leave_one_corridor_out")
def corridor_cv(t):
    oof = folds.leave_one_out_scores(labelled(t), INPUTS, "state")
    return metrics.ranking_metrics(oof.withColumnRenamed("state", "fold"), ["fold"], "label", "raw_probability")


@query("j24_risk_feed")
def risk_feed(t):
    train, _, test = parts(t)
    fitted = model.fit_logistic(train, INPUTS)
    rows = derived.risk_input(t)
    # before the rules, so that these are worked out for the rows of one year only; a join would let them pass below it
    newest = rows.where(F.year("prediction_time") == F.lit(rows.agg(F.max(F.year("prediction_time"))).first()[0]))
    seen = F.timestamp_add("HOUR", -(F.col("o_orderkey") % 200).cast("int"), F.col("prediction_time").cast("timestamp_ntz"))
    out = scoring.risk_feed(newest.withColumn("observed_at", seen), fitted, INPUTS, ignore=BOOKKEEPING, window=["ref"], key="o_orderkey",
                            profile={"rainfall_30day": (12.0, 600.0)}, observed="observed_at")
    return out.select("feed_position", "freshness", "ref", "o_orderkey", "disruption_probability", "risk_level",
                      F.array_join("confidence_flags", ",").alias("flags"), "operating_decision")


#: A released model of the corridor feed: parameters of the query, and the same numbers in its twin.
RELEASED = model.FrozenLogistic(
    weights={"rainfall_7day": 0.0004, "rainfall_30day": 0.0001, "slope_degrees": 0.03, "elevation_m": 0.0002, "slope_x_rain7": 0.000005},
    fills={"rainfall_7day": 0.0, "rainfall_30day": 0.0, "slope_degrees": 20.0, "elevation_m": 1000.0, "slope_x_rain7": 0.0}, intercept=-1.25)
FEED_FIELDS = ["osm_id", "latitude", "longitude", "highway", "elevation_m", "slope_degrees"]
_RAIN = ", ".join(f"""CASE WHEN count(*) FILTER (v IS NULL AND d >= n - {w}) = 0 THEN sum(v) FILTER (d >= n - {w}) END AS r{w}""" for w in (1, 3, 7, 14, 30))


@query("j24_corridor_feed", views="segment state_rain", sql=f"""
  WITH newest AS (SELECT max(d) AS n FROM state_rain),
  rain AS (SELECT key, n, {_RAIN}, max(d) FILTER (v IS NOT NULL) AS seen FROM state_rain, newest WHERE d BETWEEN n - 30 AND n - 1 GROUP BY key, n),
  road AS (SELECT * FROM segment WHERE osm_id IN (SELECT min(osm_id) FROM segment GROUP BY ref)),
  valid AS (SELECT * FROM road JOIN rain ON state = key
    WHERE least(r1, r3, r7, r14, r30) >= 0 AND greatest(r1, r3, r7, r14, r30) <= 10000
      AND r1 + r3 + r7 + r14 + r30 IS NOT NULL AND (highway IS NULL OR highway <> 'bridleway')
      AND coalesce(slope_degrees BETWEEN 0 AND 90, true) AND coalesce(elevation_m BETWEEN -500 AND 9000, true)),
  scored AS (SELECT *, 1 / (1 + exp(-(-125e-2 + r7 * 4e-4 + r30 * 1e-4 + coalesce(slope_degrees, 20e0) * 3e-2 + coalesce(elevation_m, 1000e0) * 2e-4
      + coalesce(slope_degrees, 0) * r7 * 5e-6))) AS p FROM valid),
  level AS (SELECT *, round(p, 4) AS q, CASE WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM scored),
  placed AS (SELECT *, row_number() OVER (ORDER BY q DESC, osm_id) AS place, count(*) OVER () AS total FROM level)
  SELECT place AS feed_position, ref, osm_id, state, n AS prediction_time, round(r1, 2) AS rainfall_1day, round(r30, 2) AS rainfall_30day,
    q AS disruption_probability, risk_level,
    array_to_string(list_filter([
      CASE WHEN date_diff('hour', CAST(seen AS TIMESTAMP), CAST(n AS TIMESTAMP)) <= 48 THEN NULL
        WHEN date_diff('hour', CAST(seen AS TIMESTAMP), CAST(n AS TIMESTAMP)) <= 168 THEN 'WEATHER_STALE' ELSE 'WEATHER_EXPIRED' END,
      CASE WHEN r30 NOT BETWEEN 500 AND 4000 THEN 'OUT_OF_DISTRIBUTION' END,
      CASE WHEN slope_degrees IS NULL OR elevation_m IS NULL THEN 'MISSING_TERRAIN' END], lambda x : x IS NOT NULL), ',') AS flags,
    CASE WHEN risk_level = 'HIGH' OR place <= greatest(1, least(total, CAST(floor(total * 0.3) AS BIGINT))) THEN 'ALERT' ELSE 'NO_ALERT' END AS operating_decision
  FROM placed""")
def corridor_feed(t):
    roads = derived.segment(t).select("ref", "state", *[F.col({"latitude": "lat", "longitude": "lon"}.get(c, c)).alias(c) for c in FEED_FIELDS])
    rows = scoring.feed_inputs(derived.segment(t), roads, derived.state_rain(t))
    out = scoring.risk_feed(rows, RELEASED, list(RELEASED.weights), ignore=["ref", "state", "prediction_time"], profile={"rainfall_30day": (500.0, 4000.0)},
                            observed="observed_at")
    return out.select("feed_position", "ref", "osm_id", "state", "prediction_time", F.round("rainfall_1day", 2).alias("rainfall_1day"),
                      F.round("rainfall_30day", 2).alias("rainfall_30day"), "disruption_probability", "risk_level",
                      F.array_join("confidence_flags", ",").alias("flags"), "operating_decision")


def traces(t):
    """Trace-like rows from orders: stream, model version, level and probability."""
    p = F.round(F.col("o_totalprice") / 500000, 4)
    return t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "production").when(F.col("o_orderstatus") == "F", "demo")
        .otherwise("test").alias("trace_stream"), F.col("o_orderpriority").alias("model_version"),
        p.alias("calibrated_probability"), risk_band(p).alias("risk_level"), decision(p, 0.55).alias("operating_decision"),
        F.col("o_orderdate").alias("inference_timestamp"))


TRACES = """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'production' WHEN 'F' THEN 'demo' ELSE 'test' END AS trace_stream,
    o_orderpriority AS model_version, round(o_totalprice / 500000, 4) AS p, o_orderdate AS ts,
    CASE WHEN round(o_totalprice / 500000, 4) >= 0.7 THEN 'HIGH' WHEN round(o_totalprice / 500000, 4) >= 0.4 THEN 'MEDIUM'
      ELSE 'LOW' END AS risk_level FROM orders"""


@query("a20_b24_trace_log_filter", sql=f"""
  SELECT o_orderkey, risk_level FROM ({TRACES}) WHERE trace_stream = 'production' AND ts >= TIMESTAMP '1996-01-01'
    AND ts <= TIMESTAMP '1999-12-31' AND risk_level = 'HIGH' AND model_version = '1-URGENT'""")
def trace_filter(t):
    path = _fresh_path(t, "traces")
    sinks.append_traces(traces(t), path)
    out = sinks.read_traces(t.spark, path, start="1996-01-01", end="1999-12-31", model_version="1-URGENT", risk_level="HIGH",
                            stream="production")
    return out.select("o_orderkey", "risk_level")


@query("d26_trace_summary", sql=f"""
  SELECT risk_level, model_version, CAST(GROUPING(risk_level, model_version) AS INT) AS "grouping", count(*) AS n, CAST(min(ts) AS DATE) AS "first", CAST(max(ts) AS DATE) AS "last",
    round(avg(p), 6) AS avg_probability FROM ({TRACES}) GROUP BY GROUPING SETS ((), (risk_level), (model_version))""")
def trace_summary(t):
    out = sinks.trace_summary(traces(t))
    return out.select("risk_level", "model_version", "grouping", "n", F.col("first").cast("date").alias("first"),
                      F.col("last").cast("date").alias("last"), F.round("avg_probability", 6).alias("avg_probability"))


@query("h56_a20_trace_records")
def trace_records(t):
    train, _, test = parts(t, "osm_id", "ref", "state", "prediction_time", "terrain_known")
    fitted = model.fit_logistic(train, INPUTS)
    s = model.linear_factors(fitted, scoring.score_table(fitted, test, INPUTS, threshold=0.5), INPUTS)
    s = scoring.quality_flags(s, {}, F.col("prediction_time").cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"))
    rows = s.withColumn("road_segment_id", F.col("osm_id").cast("string")).withColumn("district", F.lit(None).cast("string")
                        ).withColumn("prediction_timestamp", F.col("prediction_time").cast("string"))
    out = sinks.trace_rows(rows, stream="demo", model_version="m1", dataset_version="d1", policy_version="p1", features=INPUTS,
                           threshold=0.5)
    return out.drop("prediction_id", "inference_timestamp")


def _manifest(t):
    m = files.build_manifest(files.file_inventory(t.spark, t.folder).where("extension = 'parquet'"), t.folder)
    return files.verify_manifest(m, m)


@query("j17_readiness_table")
def readiness(t):
    from slopeline.operators.quality import sample_kind_violations
    rows = derived.risk_input(t).withColumn("road_segment_id", F.col("osm_id").cast("string"))
    ev = t.orders.groupBy(F.concat(F.lit("e"), (F.col("o_orderkey") % 480).cast("string")).alias("event_id")).agg(
        F.max(F.col("o_orderdate").cast("date")).alias("event_date"))
    m = rows.agg(F.countDistinct("event_id").alias("n_test_events"), F.countDistinct("state").alias("n_val_events"),
                 F.avg("rainfall_14day").alias("brier"), F.lit(False).alias("gate_passed"))
    return audit.readiness(rows, sample_kind_violations(rows, ev), m, _manifest(t))


@query("j18_monitoring_decision", views="hazard risk_input", sql="""
  WITH d AS (SELECT CAST(DATE '2024-02-05' - max(CAST(ts AS DATE)) AS INT) AS days_since_newest, (SELECT count(*) FROM hazard
    WHERE 'e' || (event_id % 700) NOT IN (SELECT event_id FROM risk_input WHERE event_id IS NOT NULL)) AS events_not_in_dataset FROM events)
  SELECT *, CAST(0 AS BIGINT) AS bad_files,
    CASE WHEN days_since_newest > 3 OR events_not_in_dataset > 0 THEN 'ACTION_REQUIRED' ELSE 'OK' END AS decision FROM d""")
def monitoring(t):
    ev = derived.hazard(t).select(F.concat(F.lit("e"), (F.col("event_id") % 700).cast("string")).alias("event_id"))
    stale = ev.join(derived.risk_input(t).select("event_id"), "event_id", "left_anti")
    return audit.monitoring(t.events, "ts", stale, _manifest(t), "2024-02-05")


@query("h57_f3_feed_lines")
def feed_lines(t):
    from slopeline.plans.feed import feed_row_json
    rows = traces(t).orderBy(F.desc("calibrated_probability"), "o_orderkey")
    return rows.select("o_orderkey", feed_row_json(["o_orderkey", "calibrated_probability", "risk_level", "operating_decision"])
                       .alias("line"))
