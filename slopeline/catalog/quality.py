"""Filters, validators, missingness, profiles and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeline.catalog.registry import query
from slopeline.functions import scoring as sc
from slopeline.functions import validate as va
from slopeline.operators import missing, quality
from slopeline.operators.intervals import qualifying_events
from slopeline.operators.windows import clean_reading
from slopeline.sources import derived


def flat(df, column: str, sep: str = "; "):
    """An array column as one text column, for value comparison."""
    return df.withColumn(column, F.array_join(column, sep))


@query("b2_state_filter", sql="""
  SELECT c_custkey, c_mktsegment FROM customer WHERE upper(coalesce(c_mktsegment, '')) = 'BUILDING'""")
def state_filter(t):
    from slopeline.operators.lookup import rows_of
    return rows_of(t.customer, "c_mktsegment", "Building").select("c_custkey", "c_mktsegment")


@query("b3_class_filter_counts", views="segment", sql="""
  SELECT lower(coalesce(highway, '')) IN ('trunk', 'primary') AS kept, count(*) AS n
  FROM segment GROUP BY 1""")
def class_filter(t):
    from slopeline.operators.lookup import in_classes
    kept = in_classes(F.col("highway"), ["Trunk", "PRIMARY"])
    return derived.segment(t).groupBy(kept.alias("kept")).agg(F.count(F.lit(1)).alias("n"))


@query("b4_sentinel_mask", views="rain_pixel", sql="""
  SELECT layer, row, col, CASE WHEN v >= 0 THEN v END AS v FROM rain_pixel""")
def sentinel(t):
    return derived.rain_pixel(t).withColumn("v", clean_reading(F.col("v")))


@query("b5_b6_qualifying_events", sql="""
  SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS event_day, o_orderpriority AS event_type
  FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def qualifying(t):
    ev = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "not a date").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("event_time"),
        F.col("o_orderpriority").alias("event_type"))
    out = qualifying_events(ev, ["1-URGENT", "2-HIGH"])
    return out.select("o_orderkey", F.date_format("event_time", "yyyy-MM-dd").alias("event_day"), "event_type")


@query("b7_b8_number_coercion", sql="""
  SELECT event_id, TRY_CAST(CASE event_id % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST(user_id AS VARCHAR)
           WHEN 2 THEN json_extract_string(props, '$.k') END AS DOUBLE) AS number,
         coalesce(TRY_CAST(CASE event_id % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST(user_id AS VARCHAR)
           WHEN 2 THEN json_extract_string(props, '$.k') END AS DOUBLE), -1) AS safe
  FROM events""")
def coercion(t):
    e = F.col("event_id") % 4
    raw = (F.when(e == 0, "n/a").when(e == 1, F.col("user_id").cast("string"))
           .when(e == 2, F.get_json_object("props", "$.k")).otherwise("NaN"))
    return t.events.select("event_id", raw.alias("raw")).select(
        "event_id", sc.to_number(F.col("raw")).alias("number"), sc.safe_number(F.col("raw"), -1).alias("safe"))


FEATS = ["elevation_m", "slope_degrees", "rainfall_3day", "rainfall_30day"]


@query("b9_drop_any", views="risk_input", sql=f"""
  SELECT o_orderkey, {", ".join(FEATS)} FROM risk_input WHERE {" AND ".join(f"{c} IS NOT NULL" for c in FEATS)}""")
def drop_any(t):
    return missing.apply_strategy(derived.risk_input(t).select("o_orderkey", *FEATS), FEATS, "drop_any")


@query("b10_drop_all", views="risk_input", sql="""
  SELECT o_orderkey, elevation_m, slope_degrees FROM risk_input
  WHERE elevation_m IS NOT NULL OR slope_degrees IS NOT NULL""")
def drop_all(t):
    return missing.apply_strategy(derived.risk_input(t).select("o_orderkey", *FEATS[:2]), FEATS[:2], "drop_all")


@query("b11_b12_missing_flags", views="risk_input", sql=f"""
  SELECT o_orderkey, {", ".join(FEATS)},
    {", ".join(f"CAST({c} IS NULL AS INT) AS is_missing_{c}" for c in FEATS)} FROM risk_input""")
def flags(t):
    return missing.apply_strategy(derived.risk_input(t).select("o_orderkey", *FEATS), FEATS, "native_flag")


@query("d2_missing_rates", views="risk_input", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(CAST({c} IS NULL AS INT)), 9) AS missing_rate FROM risk_input"
    for c in FEATS))
def missing_rates(t):
    return missing.missing_rates(derived.risk_input(t), FEATS).withColumn(
        "missing_rate", F.round("missing_rate", 9))


@query("d3_coverage_by_group", views="segment", sql=" UNION ALL ".join(f"""
  SELECT ref AS "group", '{c}' AS feature, round(count({c}) / count(*), 9) AS observed_rate,
         count({c}) AS n_obs, count(*) AS n_group FROM segment GROUP BY ref"""
    for c in ("elevation_m", "slope_degrees", "bridge")))
def coverage(t):
    return missing.coverage_by_group(derived.segment(t), "ref", ["elevation_m", "slope_degrees", "bridge"]
                                     ).withColumn("observed_rate", F.round("observed_rate", 9))


@query("d4_testable_groups", sql="""
  SELECT o_custkey FROM orders GROUP BY o_custkey
  HAVING count(CASE WHEN o_orderstatus = 'P' THEN 1 END) > 0 AND count(CASE WHEN o_totalprice > 4e5 THEN 1 END) > 0""")
def testable(t):
    df = t.orders.select("o_custkey", F.when(F.col("o_orderstatus") == "P", 1.0).alias("a"),
                         F.when(F.col("o_totalprice") > 4e5, 1.0).alias("b"))
    return missing.testable_groups(df, "o_custkey", ["a", "b"])


@query("d5_impute_in_group", views="risk_input", sql="""
  SELECT o_orderkey, osm_id, round(coalesce(r.elevation_m, m.e), 6) AS elevation_m,
         round(coalesce(r.slope_degrees, m.s), 6) AS slope_degrees
  FROM risk_input r JOIN (SELECT osm_id, avg(elevation_m) AS e, avg(slope_degrees) AS s FROM risk_input
                          GROUP BY osm_id) m USING (osm_id)""")
def impute(t):
    df = derived.risk_input(t).select("o_orderkey", "osm_id", *FEATS[:2])
    out = missing.apply_strategy(df, FEATS[:2], "impute_in_group", "osm_id")
    return out.select("o_orderkey", "osm_id", *[F.round(c, 6).alias(c) for c in FEATS[:2]])


@query("d6_retention", views="risk_input", sql=f"""
  SELECT count(*) AS original_rows, count(*) FILTER ({" AND ".join(f"{c} IS NOT NULL" for c in FEATS)})
      AS retained_rows,
    round(count(*) FILTER ({" AND ".join(f"{c} IS NOT NULL" for c in FEATS)}) / count(*), 9) AS retention_rate
  FROM risk_input""")
def retention(t):
    df = derived.risk_input(t)
    return missing.retention(df, missing.apply_strategy(df, FEATS, "drop_any")).withColumn(
        "retention_rate", F.round("retention_rate", 9))


DATASET_RULES = """
  SELECT concat_ws('; ',
    CASE WHEN count(*) FILTER (event_id IS NULL OR osm_id IS NULL OR prediction_time IS NULL) > 0
      THEN 'sample identity contains null values' END,
    CASE WHEN (SELECT count(*) FROM (SELECT 1 FROM risk_input GROUP BY event_id, osm_id, prediction_time
               HAVING count(*) > 1)) > 0 THEN 'duplicate event/road/prediction samples detected' END,
    CASE WHEN count(*) FILTER (label NOT IN (0, 1)) > 0 THEN 'labels must be binary' END,
    CASE WHEN count(*) FILTER (rainfall_1day < 0 OR rainfall_3day < 0 OR rainfall_7day < 0
      OR rainfall_14day < 0 OR rainfall_30day < 0) > 0 THEN 'negative rainfall values detected' END,
    CASE WHEN count(*) FILTER (slope_degrees < 0 OR slope_degrees > 90) > 0
      THEN 'slope outside [0, 90] degrees' END{extra}) AS errors
  FROM risk_input"""


@query("b13_dataset_validator", views="risk_input", sql=DATASET_RULES.format(extra=""))
def dataset_rules(t):
    return flat(quality.dataset_errors(derived.risk_input(t)), "errors")


@query("b14_production_validator", views="risk_input", sql=DATASET_RULES.format(extra=""",
    CASE WHEN count(*) FILTER (label_source NOT IN ('real_confirmed_temporal', 'real_observed_unaffected')) > 0
      THEN 'unsupported label_source values: ' || (SELECT string_agg(DISTINCT label_source, ', '
        ORDER BY label_source) FROM risk_input WHERE label_source NOT IN ('real_confirmed_temporal',
        'real_observed_unaffected')) END"""))
def production_rules(t):
    return flat(quality.dataset_errors(derived.risk_input(t), [quality.POSITIVE_SOURCE,
                                                               quality.NEGATIVE_SOURCE]), "errors")


RAIN_SQL = ", ".join(f"""
    CASE WHEN {c} IS NULL THEN '{c} is required and must be finite' END,
    CASE WHEN {c} < 0 THEN '{c} cannot be negative' END,
    CASE WHEN {c} > 10000 THEN '{c} exceeds the supported physical maximum of 10000 mm' END"""
    for c in va.RAINFALL)
TERRAIN_SQL = """
    CASE WHEN slope_degrees < 0 OR slope_degrees > 90 THEN 'slope_degrees must be between 0 and 90' END,
    CASE WHEN elevation_m < -500 OR elevation_m > 9000
      THEN 'elevation_m is outside the supported physical range' END,
    CASE WHEN rainfall_days_available > 30 THEN 'rainfall_days_available must be between 0 and 30' END"""
BOOKKEEPING = ["o_orderkey", "event_id", "prediction_time", "label", "sample_kind", "label_source", "state",
               "ref", "osm_id"]


@query("b15_scoring_input_validator", views="risk_input", sql=f"""
  SELECT o_orderkey, concat_ws('; ',
    CASE WHEN abs(latitude) > 90 THEN 'latitude must be between -90 and 90' END,
    CASE WHEN abs(longitude) > 180 THEN 'longitude must be between -180 and 180' END,
    CASE WHEN highway = 'teleporter' THEN 'highway is not a supported road category' END,
    {RAIN_SQL}, {TERRAIN_SQL}) AS errors FROM risk_input""")
def scoring_inputs(t):
    df = derived.risk_input(t)
    return flat(df.select("o_orderkey", va.scoring_errors(df, ignore=BOOKKEEPING).alias("errors")), "errors")


@query("b15_scoring_text_fields", views="risk_input", sql=f"""
  WITH r AS (SELECT * REPLACE (CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN NULL
    ELSE rainfall_7day END AS rainfall_7day) FROM risk_input)
  SELECT o_orderkey, concat_ws('; ', {RAIN_SQL}, {TERRAIN_SQL}) AS errors FROM r""")
def scoring_text_inputs(t):
    k, v = F.col("o_orderkey"), F.col("rainfall_7day").cast("string")
    typed = F.when(k % 11 == 0, "abc").when(k % 13 == 0, "").when(k % 17 == 0, "NaN").otherwise(v)
    df = derived.risk_input(t).withColumn("rainfall_7day", typed)
    return flat(df.select("o_orderkey", va.scoring_errors(df, BOOKKEEPING, metadata=False).alias("errors")), "errors")


@query("b16_request_validator", views="risk_input", sql=f"""
  SELECT o_orderkey, concat_ws('; ', {RAIN_SQL}, {TERRAIN_SQL}) AS errors FROM risk_input""")
def request_inputs(t):
    df = derived.risk_input(t)
    return flat(df.select("o_orderkey", va.scoring_errors(df, BOOKKEEPING, metadata=False).alias("errors")),
                "errors")


@query("b17_segment_id_format", sql="""
  SELECT page_id, lower(trim(s)) <> 'unknown' AND regexp_matches(trim(s), '^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$')
    AS ok FROM (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN ' Unknown ' WHEN page_id % 10 = 1 THEN url
      ELSE ' ' || regexp_extract(url, '//([^/]+)/', 1) || ':' || page_id END AS s FROM pages)""")
def segment_ids(t):
    k = F.col("page_id")
    s = (F.when(k % 10 == 0, " Unknown ").when(k % 10 == 1, F.col("url"))
         .otherwise(F.concat(F.lit(" "), F.regexp_extract("url", "//([^/]+)/", 1), F.lit(":"), k.cast("string"))))
    return t.pages.select("page_id", va.road_id_ok(s).alias("ok"))


@query("b18_event_entry_validator", views="event_entry", sql="""
  SELECT o_orderkey, concat_ws('; ',
    CASE WHEN event_id IS NULL THEN 'Missing required field: event_id' END,
    CASE WHEN trim(location_name) = '' THEN 'Missing required field: location_name' END,
    CASE WHEN TRY_CAST(try_strptime(event_date, '%Y-%m-%d') AS DATE) IS NULL
      THEN 'event_date must be in YYYY-MM-DD format' END,
    CASE WHEN TRY_CAST(latitude AS DOUBLE) IS NULL THEN 'latitude must be numeric' END,
    CASE WHEN TRY_CAST(latitude AS DOUBLE) NOT BETWEEN 21 AND 30 THEN 'latitude outside 21-30' END,
    CASE WHEN TRY_CAST(longitude AS DOUBLE) NOT BETWEEN 88 AND 98 THEN 'longitude outside 88-98' END,
    CASE WHEN state = 'Atlantis' THEN 'state is not listed' END,
    CASE WHEN event_type = 'storm'
      THEN 'event_type must be one of: [''landslide'', ''flood'', ''earthquake'', ''cyclone'']' END) AS errors
  FROM event_entry""")
def event_entries(t):
    from slopeline.functions.text import STATES
    df = derived.event_entry(t)
    return flat(df.select("o_orderkey", va.event_entry_errors(STATES).alias("errors")), "errors")


@query("b19_confirmed_event_validator", views="event_entry", sql="""
  SELECT e.o_orderkey, concat_ws('; ', CASE WHEN i.n > 1 THEN 'event_id already exists' END,
      CASE WHEN d IS NULL THEN 'event_date is not an ISO date' END,
      CASE WHEN d < DATE '2017-01-01' THEN 'event_date is before 2017-01-01' END,
      CASE WHEN NOT regexp_matches(ref, '(?i)^(NH|SH|NH\\s|SH\\s)\\d+[A-Z]?$')
        THEN 'ref is not a national or state highway' END) AS errors,
    r.n > 1 AS repeated_road
  FROM (SELECT *, TRY_CAST(try_strptime(event_date, '%Y-%m-%d') AS DATE) AS d FROM event_entry) e
  LEFT JOIN (SELECT event_id, count(*) AS n FROM event_entry GROUP BY 1) i ON i.event_id = e.event_id
  LEFT JOIN (SELECT osm_id, count(*) AS n FROM event_entry GROUP BY 1) r ON r.osm_id = e.osm_id""")
def confirmed_events(t):
    from slopeline.operators.lookup import confirmed_event_errors
    out = confirmed_event_errors(derived.event_entry(t))
    return flat(out.select("o_orderkey", "errors", "repeated_road"), "errors")


@query("b20_registry_validator", sql="""
  WITH s AS (SELECT conv_id, turn, role, CASE WHEN turn = 3 THEN NULL ELSE role END AS source_id,
      CASE WHEN length(text) % 5 = 0 THEN NULL ELSE text END AS url FROM conversations)
  SELECT s.conv_id, turn, concat_ws('; ', CASE WHEN s.source_id IS NULL THEN 'source_id is missing' END,
    CASE WHEN d.n > 1 THEN 'source_id is not unique' END,
    CASE WHEN url IS NULL THEN 'url is missing' END) AS errors
  FROM s LEFT JOIN (SELECT conv_id, source_id, count(*) AS n FROM s WHERE source_id IS NOT NULL GROUP BY 1, 2) d
    ON d.conv_id = s.conv_id AND d.source_id = s.source_id""")
def registry_rules(t):
    from slopeline.operators.lookup import registry_errors
    item = F.struct("turn", F.when(F.col("turn") != 3, F.col("role")).alias("source_id"),
                    F.when(F.length("text") % 5 != 0, F.col("text")).alias("url"))
    # one single-entry document per row: ids must be unique over all documents of a registry
    reg = t.conversations.select("conv_id", F.array(item).alias("sources"))
    out = registry_errors(reg, "conv_id", "sources", ["url"])
    return flat(out.select("conv_id", "entry.turn", "errors"), "errors")


@query("b21_geometry_qa", views="polyline_pt", sql="""
  WITH g AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN 0
      WHEN p_partkey % 23 = 0 THEN 1 ELSE 4 END AS n FROM part)
  SELECT count(*) AS rows, count(*) FILTER (n IS NULL) AS null_geometries,
    count(*) FILTER (n = 0) AS empty_geometries, count(*) FILTER (n = 1) AS invalid_geometries,
    CASE WHEN bool_or(n IS NULL OR n < 2) THEN 'FAIL' ELSE 'PASS' END AS status FROM g""")
def geometries(t):
    k = F.col("osm_id")
    c = (F.when(k % 17 == 0, None).when(k % 19 == 0, F.slice("coords", 1, 0))
         .when(k % 23 == 0, F.slice("coords", 1, 1)).otherwise(F.col("coords")))
    return quality.geometry_qa(derived.polyline(t).select(c.alias("coords")))


@query("b22_sample_kind_violations", views="risk_input", sql="""
  WITH ev AS (SELECT 'e' || (o_orderkey % 480) AS event_id, max(CAST(o_orderdate AS DATE)) AS ed FROM orders
              GROUP BY 1)
  SELECT r.event_id, prediction_time, sample_kind,
    CASE WHEN ed IS NULL THEN 'event date unavailable'
      WHEN sample_kind = 'positive' THEN 'positive event outside future horizon'
      ELSE 'known event falls inside negative horizon' END AS reason
  FROM risk_input r LEFT JOIN ev ON ev.event_id = r.event_id
  WHERE sample_kind <> 'observed_open_negative' AND (ed IS NULL
    OR (sample_kind = 'positive' AND NOT (prediction_time < ed AND ed <= prediction_time + 7))
    OR (sample_kind = 'same_road_control' AND ed <= prediction_time + 7))""")
def kind_violations(t):
    ev = t.orders.groupBy(F.concat(F.lit("e"), (F.col("o_orderkey") % 480).cast("string")).alias("event_id")).agg(
        F.max(F.col("o_orderdate").cast("date")).alias("event_date"))
    return quality.sample_kind_violations(derived.risk_input(t), ev)


@query("d7_value_counts", sql="""
  SELECT coalesce(lang, 'null') AS lang, count(*) AS n FROM documents GROUP BY lang""")
def value_counts(t):
    return quality.value_counts(t.documents, "lang", include_null=True).withColumn(
        "lang", F.coalesce("lang", F.lit("null")))


@query("d8_class_distribution", sql="""
  SELECT c AS class, count(l_returnflag) AS n, round(100e0 * count(l_returnflag)
    / (SELECT count(*) FROM lineitem), 9) AS percent
  FROM (VALUES ('A'), ('N'), ('R'), ('X')) v(c) LEFT JOIN lineitem ON l_returnflag = c GROUP BY c""")
def class_distribution(t):
    return quality.class_distribution(t.lineitem, "l_returnflag", ["A", "N", "R", "X"]).withColumn(
        "percent", F.round("percent", 9))


SEG_COLS = ["name", "highway", "slope_degrees", "elevation_m", "bridge", "tunnel", "tracktype", "oneway"]


@query("d9_null_report", views="segment", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count FROM segment HAVING count(*) > count({c})"
    for c in SEG_COLS + ["ref", "lon"]))
def null_report(t):
    return quality.null_report(derived.segment(t).select(*SEG_COLS, "ref", "lon"))


@query("a13_table_profile", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{ty}' AS data_type, count(*) AS row_count, count(*) - count({c}) AS null_count "
    "FROM orders" for c, ty in [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                                ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]))
def table_profile(t):
    return quality.table_profile(t.orders)


@query("d10_balance_counts", views="risk_input", sql="""
  SELECT CASE WHEN label = 1 THEN 'pos' ELSE 'neg' END AS side, ref, count(*) AS n FROM risk_input GROUP BY 1, 2""")
def balance(t):
    side = F.when(F.col("label") == 1, "pos").otherwise("neg")
    return derived.risk_input(t).groupBy(side.alias("side"), "ref").agg(F.count(F.lit(1)).alias("n"))


@query("d11_feature_profile", views="risk_input", sql=" UNION ALL ".join(f"""
  SELECT '{c}' AS feature, round(avg(CAST({c} IS NULL AS INT)), 9) AS missing_rate, min({c}) AS "min",
    round(quantile_cont({c}, 0.01), 6) AS p01, round(quantile_cont({c}, 0.99), 6) AS p99, max({c}) AS "max"
  FROM risk_input""" for c in FEATS))
def feature_profile(t):
    out = quality.feature_profile(derived.risk_input(t), FEATS)
    return out.select("feature", F.round("missing_rate", 9).alias("missing_rate"), "min",
                      F.round("p01", 6).alias("p01"), F.round("p99", 6).alias("p99"), "max")


@query("d12_d14_audit_counts", views="risk_input", sql="""
  SELECT count(*) AS samples, count(DISTINCT event_id) AS events, count(DISTINCT osm_id) AS roads,
    count(DISTINCT state) AS states, count(DISTINCT ref) AS corridors, count(*) FILTER (label = 1) AS positives,
    count(*) FILTER (label = 0) AS negatives,
    CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_id, osm_id, prediction_time FROM risk_input))
      AS BIGINT) AS duplicate_rows
  FROM risk_input""")
def audit_counts(t):
    df = derived.risk_input(t)
    # two single-row tables
    return quality.audit_counts(df).join(quality.duplicate_rows(df, ["event_id", "osm_id", "prediction_time"]))


@query("d13_events_per_group", views="risk_input", sql="""
  SELECT state, ref, count(DISTINCT event_id) AS events FROM risk_input GROUP BY 1, 2""")
def events_per_group(t):
    return derived.risk_input(t).groupBy("state", "ref").agg(F.countDistinct("event_id").alias("events"))


@query("d15_label_sources", views="risk_input", sql="""
  SELECT count(*) AS negatives,
    count(*) FILTER (label_source = 'assumed_unaffected_real_pool') AS assumed_negatives,
    count(*) FILTER (label_source = 'real_observed_unaffected') AS confirmed_negatives,
    round(count(*) FILTER (label_source = 'real_observed_unaffected') / count(*), 9) AS confirmed_fraction
  FROM risk_input WHERE label = 0""")
def label_sources(t):
    return quality.label_source_counts(derived.risk_input(t)).withColumn(
        "confirmed_fraction", F.round("confirmed_fraction", 9))


@query("j19_negative_label_gate", views="risk_input", sql="""
  SELECT count(*) FILTER (label_source NOT IN ('source_confirmed_unaffected', 'real_observed_unaffected'))
      AS inadmissible_negatives,
    count(*) FILTER (label_source = 'assumed_unaffected_real_pool') AS assumed_negatives,
    CASE WHEN bool_or(label_source NOT IN ('source_confirmed_unaffected', 'real_observed_unaffected')) THEN 'FAIL' ELSE 'PASS' END AS status
  FROM risk_input WHERE label = 0""")
def negative_gate(t):
    return quality.negative_label_gate(derived.risk_input(t))


@query("d16_group_representative", views="segment", sql="""
  SELECT ref, min(osm_id) AS osm_id, arg_min(state, osm_id) AS state, arg_min(highway, osm_id) AS highway
  FROM segment WHERE highway IS NOT NULL GROUP BY ref""")
def representative(t):
    from slopeline.operators.ordered import one_per_group
    return one_per_group(derived.segment(t).where("highway IS NOT NULL").select(
        "ref", "osm_id", "state", "highway"), ["ref"], ["osm_id"])


@query("d17_describe_by_label", sql="""
  SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean,
    round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS "min", max(l_extendedprice) AS "max",
    round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
    round(quantile_cont(l_extendedprice, 0.75), 6) AS p75
  FROM lineitem GROUP BY l_returnflag""")
def describe(t):
    out = quality.describe_by(t.lineitem, "l_returnflag", "l_extendedprice")
    return out.select("l_returnflag", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
                      "min", "max", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")])


@query("d27_coverage_means", views="risk_input", sql="""
  SELECT round(avg(CAST(rainfall_3day IS NOT NULL AS INT)), 4) AS rain3,
    round(avg(CAST(rainfall_30day IS NOT NULL AS INT)), 4) AS rain30,
    round(avg(CAST(slope_degrees IS NOT NULL AS INT)) FILTER (label = 1), 4) AS slope_pos
  FROM risk_input""")
def coverage_means(t):
    known = lambda c: F.col(c).isNotNull().cast("int")
    return derived.risk_input(t).agg(
        F.round(F.avg(known("rainfall_3day")), 4).alias("rain3"),
        F.round(F.avg(known("rainfall_30day")), 4).alias("rain30"),
        F.round(F.avg(F.when(F.col("label") == 1, known("slope_degrees"))), 4).alias("slope_pos"))


@query("d28_total_bounds", views="polyline_pt", sql="""
  SELECT round(min(lon), 9) AS min_lon, round(min(lat), 9) AS min_lat, round(max(lon), 9) AS max_lon,
    round(max(lat), 9) AS max_lat FROM polyline_pt""")
def total_bounds(t):
    lon, lat = F.col("coords.lon"), F.col("coords.lat")
    return derived.polyline(t).agg(
        F.round(F.min(F.array_min(lon)), 9).alias("min_lon"), F.round(F.min(F.array_min(lat)), 9).alias("min_lat"),
        F.round(F.max(F.array_max(lon)), 9).alias("max_lon"), F.round(F.max(F.array_max(lat)), 9).alias("max_lat"))


@query("d30_confirmation_gate", views="risk_input", sql="""
  WITH f AS (SELECT state AS file, count(*) FILTER (label = 1 AND label_source LIKE '%confirmed%') AS confirmed,
      count(*) FILTER (sample_kind IN ('positive', 'observed_open_negative')) AS supported, count(*) AS rows
    FROM risk_input GROUP BY 1)
  SELECT file, confirmed, supported, rows, CASE WHEN confirmed > 0 THEN 'READY'
    WHEN supported > 0 THEN 'REVIEW_REQUIRED' ELSE 'BLOCKED' END AS decision FROM f""")
def confirmation_gate(t):
    from slopeline.plans.audit import confirmation_gate as gate
    df = derived.risk_input(t)
    return gate(df, "state", (F.col("label") == 1) & F.col("label_source").contains("confirmed"),
                F.col("sample_kind").isin("positive", "observed_open_negative")).withColumnRenamed("state", "file")


@query("d31_observation_quality", sql="""
  SELECT count(*) FILTER (lower(o_orderpriority) LIKE '%low%') AS corridor_only_rows,
    count(*) FILTER (lower(o_orderpriority) LIKE '%high%') AS segment_rows,
    count(*) FILTER (o_orderstatus = 'P') AS clearance_or_reopening_rows FROM orders""")
def observation_quality(t):
    df = t.orders.select(
        F.when(F.col("o_orderpriority").contains("LOW"), "Corridor-wide")
        .when(F.col("o_orderpriority").contains("HIGH"), "segment").otherwise("point").alias("observation_scope"),
        F.when(F.col("o_orderstatus") == "P", "Reopened").otherwise("open").alias("observation_status"))
    return quality.observation_quality(df)


@query("a14_column_roles", sql="""
  SELECT column_name, normalised, role, (SELECT count(*) FROM orders) AS row_count,
    CASE WHEN column_name = 'notes' THEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') ELSE 0 END AS null_count
  FROM (VALUES ('Event Date', 'event_date', 'date'),
    ('Lat.DD', 'lat_dd', 'latitude'), ('lng', 'lng', 'longitude'), ('Hazard-Type', 'hazard_type', 'event_type'),
    ('notes', 'notes', NULL)) v(column_name, normalised, role)""")
def column_roles(t):
    df = t.orders.select(F.col("o_orderdate").alias("Event Date"), F.col("o_totalprice").alias("Lat.DD"),
                         F.col("o_totalprice").alias("lng"), F.col("o_orderstatus").alias("Hazard-Type"),
                         F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("notes"))
    # the roles come from the schema, their use from the rows
    profile = quality.table_profile(df).select("column_name", "row_count", "null_count")
    return quality.column_roles(df).join(profile, "column_name")
