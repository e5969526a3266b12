"""Equi-joins, semi and anti joins, unions and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeline.catalog.registry import query
from slopeline.functions import scoring as sc
from slopeline.operators import lookup, sets
from slopeline.sources import derived


@query("c1_static_join", views="risk_input segment", sql="""
  SELECT r.o_orderkey, r.osm_id, s.highway, s.coverage_ratio, s.bridge
  FROM risk_input r LEFT JOIN segment s ON s.osm_id = r.osm_id""")
def static_join(t):
    return lookup.join_static(derived.risk_input(t).select("o_orderkey", "osm_id"), derived.segment(t), ["osm_id"],
                              ["highway", "coverage_ratio", "bridge"])


@query("c2_composite_join", views="daily_obs anchors", sql="""
  SELECT a.key, a.p, round(o.v, 6) AS v FROM anchors a LEFT JOIN daily_obs o ON o.key = a.key AND o.d = a.p""")
def composite_join(t):
    obs = derived.daily_obs(t).withColumnRenamed("d", "p").withColumn("v", F.round("v", 6))
    return lookup.join_static(derived.anchors(t), obs, ["key", "p"])


@query("c6_semi_join", views="hazard segment", sql="""
  SELECT osm_id, ref FROM segment WHERE osm_id IN (SELECT affected_segment_id FROM hazard)""")
def semi(t):
    ids = derived.hazard(t).select(F.col("affected_segment_id").alias("osm_id"))
    return derived.segment(t).select("osm_id", "ref").join(ids, "osm_id", "left_semi")


@query("c7_anti_join", views="hazard segment", sql="""
  SELECT osm_id, ref FROM segment WHERE osm_id NOT IN (SELECT affected_segment_id FROM hazard)""")
def anti(t):
    ids = derived.hazard(t).select(F.col("affected_segment_id").alias("osm_id"))
    return derived.segment(t).select("osm_id", "ref").join(ids, "osm_id", "left_anti")


KEY7 = ["event_id", "osm_id", "sample_kind", "label_source", "state", "ref", "highway"]


@query("c8_composite_anti_join", views="risk_input", sql=f"""
  SELECT o_orderkey FROM risk_input a WHERE label = 0 AND NOT EXISTS (SELECT 1 FROM risk_input b
    WHERE b.label = 0 AND b.rainfall_1day > 15 AND {" AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in KEY7)})""")
def composite_anti(t):
    r = derived.risk_input(t).where("label = 0")
    return lookup.anti_join_nullsafe(r, r.where("rainfall_1day > 15"), KEY7).select("o_orderkey")


@query("c10_class_prior_lookup", views="segment", sql="""
  SELECT osm_id, coalesce(m.p, 4e-1) AS highway_prior FROM segment LEFT JOIN (VALUES ('motorway', 5e-2),
    ('trunk', 1e-1), ('primary', 15e-2), ('secondary', 2e-1), ('track', 6e-1)) m(h, p) ON m.h = highway""")
def class_prior(t):
    return derived.segment(t).select("osm_id", sc.highway_prior(F.col("highway")).alias("highway_prior"))


@query("c18_events_missing_from_dataset", views="hazard risk_input", sql="""
  SELECT event_id FROM hazard WHERE 'e' || (event_id % 700) NOT IN
    (SELECT event_id FROM risk_input WHERE event_id IS NOT NULL)""")
def stale_events(t):
    ev = derived.hazard(t).select("event_id", F.concat(F.lit("e"), (F.col("event_id") % 700).cast("string")).alias("k"))
    known = derived.risk_input(t).select(F.col("event_id").alias("k"))
    return ev.join(known, "k", "left_anti").select("event_id")


@query("c19_attribute_replacement", views="segment", sql="""
  SELECT s.osm_id, s.ref, f.elevation_m, f.slope_degrees FROM segment s LEFT JOIN (
    SELECT s_suppkey AS osm_id, s_acctbal AS elevation_m, CAST(s_nationkey AS DOUBLE) AS slope_degrees FROM supplier) f
    ON f.osm_id = s.osm_id""")
def attribute_replacement(t):
    fresh = t.supplier.select(F.col("s_suppkey").alias("osm_id"), F.col("s_acctbal").alias("elevation_m"),
                              F.col("s_nationkey").cast("double").alias("slope_degrees"))
    base = derived.segment(t).select("osm_id", "ref", "elevation_m", "slope_degrees")
    return lookup.replace_columns(base, fresh, "osm_id", ["elevation_m", "slope_degrees"])


@query("f7_first_unseen_observation", views="risk_input", sql="""
  SELECT o_orderkey, osm_id FROM risk_input r WHERE osm_id NOT IN (SELECT osm_id FROM risk_input WHERE label = 1
      AND rainfall_1day > 25) AND rainfall_3day IS NOT NULL AND slope_degrees IS NOT NULL AND elevation_m IS NOT NULL
  ORDER BY o_orderkey LIMIT 1""")
def first_unseen(t):
    r = derived.risk_input(t)
    known = r.where("label = 1 AND rainfall_1day > 25").select("osm_id")
    return (r.join(known, "osm_id", "left_anti").dropna("any", subset=["rainfall_3day", "slope_degrees", "elevation_m"])
            .orderBy("o_orderkey").limit(1).select("o_orderkey", "osm_id"))


@query("g1_concatenate", sql="""
  SELECT o_orderkey AS id, o_totalprice AS amount, o_orderstatus AS status FROM orders
  UNION ALL SELECT c_custkey, c_acctbal, NULL FROM customer""")
def concat(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"),
                        F.col("o_orderstatus").alias("status"))
    return sets.concatenate(a, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount")))


@query("g2_dedupe_on_keys", sql="""
  SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL""")
def dedupe(t):
    return t.lineitem.select("l_orderkey", "l_linenumber").dropDuplicates(["l_orderkey", "l_linenumber"])


@query("g3_key_difference", sql="""
  SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45""")
def difference(t):
    used = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return sets.key_difference(t.part, used, "p_partkey")


@query("g4_key_intersection", sql="""
  SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'
  INTERSECT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'""")
def intersection(t):
    first = F.lit("1996-01-01").cast("timestamp_ntz")
    last = F.lit("2001-01-01").cast("timestamp_ntz")
    return sets.key_intersection(t.orders.where(F.col("o_orderdate") < first),
                                 t.orders.where(F.col("o_orderdate") >= last), "o_custkey")


OBS = ["osm_id", "ref", "prediction_time"]


@query("g5_reissued_append", views="risk_input", sql="""
  WITH ex AS (SELECT 'old_' || o_orderkey AS observation_id, osm_id, ref, prediction_time FROM risk_input WHERE label = 0),
  inc AS (SELECT 'new_' || o_orderkey AS observation_id, osm_id, ref, prediction_time FROM risk_input
          WHERE sample_kind <> 'observed_open_negative'),
  kept AS (SELECT * FROM ex WHERE NOT (observation_id LIKE '%7' AND EXISTS (SELECT 1 FROM inc WHERE inc.osm_id = ex.osm_id
    AND inc.ref = ex.ref AND inc.prediction_time = ex.prediction_time)))
  SELECT * FROM kept UNION ALL SELECT * FROM inc WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.osm_id = inc.osm_id
    AND kept.ref = inc.ref AND kept.prediction_time = inc.prediction_time)""")
def reissued(t):
    r = derived.risk_input(t)
    ident = lambda p: F.concat(F.lit(p), F.col("o_orderkey").cast("string")).alias("observation_id")
    ex = r.where("label = 0").select(ident("old_"), *OBS)
    inc = r.where("sample_kind <> 'observed_open_negative'").select(ident("new_"), *OBS)
    return sets.reissue(ex, inc, OBS, F.col("observation_id").endswith("7"))


@query("g6_append_if_absent", sql="""
  SELECT o_custkey AS event_id FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_custkey NOT IN
    (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def append_absent(t):
    o = t.orders.select(F.col("o_custkey").alias("event_id"), "o_orderpriority")
    return sets.append_if_absent(o.where("o_orderpriority = '1-URGENT'").select("event_id"),
                                 o.where("o_orderpriority = '2-HIGH'").select("event_id"), ["event_id"])
