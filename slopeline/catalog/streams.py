"""Monitoring streams run to completion over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeline.catalog.assembly import _fresh_path
from slopeline.catalog.registry import query
from slopeline.functions.scoring import decision, risk_band
from slopeline.streaming import monitor


def _events(t):
    return monitor.file_stream(t.spark, t.folder, "events.parquet", t.events.schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _scored(df):
    p = F.round(F.least(F.col("value") / 200, F.lit(1.0)), 6)
    return df.withColumn("p", p).withColumn("risk_level", risk_band(F.col("p"))).withColumn(
        "operating_decision", decision(F.col("p"), 0.55))


def _level(v: str) -> str:
    return f"CASE WHEN {v} >= 0.7 THEN 'HIGH' WHEN {v} >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"


P_SQL = "SELECT *, round(least(value / 200, 1), 6) AS p FROM events"


@query("k1_trace_stream", sql=f"""
  SELECT event_id, p, {_level("p")} AS risk_level, CASE WHEN p >= 0.55 THEN 'ALERT' ELSE 'NO_ALERT' END AS operating_decision
  FROM ({P_SQL})""")
def trace_stream(t):
    path, cp = _fresh_path(t, "k1"), _fresh_path(t, "k1-cp")
    out = monitor.trace_stream(_events(t), _scored, "ts", "event_id").select("event_id", "p", "risk_level", "operating_decision")
    monitor.run_to_table(out, path, cp)
    return t.spark.read.parquet(path)


@query("k2_daily_alert_load", sql=f"""
  SELECT CAST(ts AS DATE) AS day, count(*) AS predictions, count(*) FILTER (p >= 0.55) AS alerts, count(*) FILTER (p >= 0.7) AS high,
    round(avg(p), 6) AS mean_probability, round(stddev_samp(p), 6) AS std_probability,
    round(count(*) FILTER (p >= 0.55) / count(*), 6) AS alert_rate FROM ({P_SQL}) GROUP BY 1""")
def alert_load(t):
    path, cp = _fresh_path(t, "k2"), _fresh_path(t, "k2-cp")
    monitor.run_updates(monitor.daily_alert_load(_scored(_events(t)), "ts", "p", "risk_level"), path, cp)
    out = monitor.latest_updates(t.spark, path, ["day"])
    return out.select(*[F.round(c, 6).alias(c) if c.endswith(("probability", "rate")) else F.col(c) for c in out.columns])


@query("k3_late_input_suppression", sql="""
  SELECT event_id, user_id FROM events WHERE floor(value) <= 168""")
def late_inputs(t):
    path, cp = _fresh_path(t, "k3"), _fresh_path(t, "k3-cp")
    ev = _events(t).withColumn("observed_at", F.expr("timestampadd(HOUR, -cast(floor(value) as bigint), ts)"))
    monitor.run_to_table(monitor.suppress_late(ev, "observed_at", "ts", ["event_id"]).select("event_id", "user_id"), path, cp)
    return t.spark.read.parquet(path)


@query("k4_delayed_labels", sql="""
  SELECT p.event_id, h.event_id AS hazard_id, round(epoch(h.ts - p.ts), 3) AS lead_seconds FROM events p JOIN events h
    ON h.user_id = p.user_id AND h.ts > p.ts AND h.ts <= p.ts + INTERVAL 7 DAY
  WHERE p.event_type = 'signup' AND h.event_type = 'purchase' AND h.value > 60""")
def delayed_labels(t):
    path, cp = _fresh_path(t, "k4"), _fresh_path(t, "k4-cp")
    e = _events(t)
    p = e.where("event_type = 'signup'").select("event_id", "user_id", "ts")
    h = e.where("event_type = 'purchase' AND value > 60").select(F.col("event_id").alias("hazard_id"), F.col("user_id").alias("seg"),
                                                                 F.col("ts").alias("hts"))
    j = monitor.delayed_labels(p, h, segment="user_id", prediction_time="ts", event_segment="seg", event_time="hts")
    lead = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("hts")) / F.lit(1e6)
    monitor.run_to_table(j.select("event_id", "hazard_id", F.round(lead, 3).alias("lead_seconds")), path, cp)
    return t.spark.read.parquet(path)


@query("k5_population_stability", sql="""
  WITH b AS (SELECT (CASE WHEN value >= 10 THEN 1 ELSE 0 END) + (CASE WHEN value >= 25 THEN 1 ELSE 0 END)
      + (CASE WHEN value >= 50 THEN 1 ELSE 0 END) + (CASE WHEN value >= 100 THEN 1 ELSE 0 END) AS k,
      ts < TIMESTAMP '2024-01-10' AS base FROM events),
  c AS (SELECT k, count(*) FILTER (base) AS e, count(*) FILTER (NOT base) AS a FROM b GROUP BY k),
  s AS (SELECT greatest(e / (SELECT sum(e) FROM c), 1e-6) AS p, greatest(a / (SELECT sum(a) FROM c), 1e-6) AS q FROM c),
  r AS (SELECT sum((q - p) * ln(q / p)) AS psi FROM s)
  SELECT round(psi, 9) AS psi, CASE WHEN psi > 0.25 THEN 'REVIEW' WHEN psi > 0.1 THEN 'WARN' ELSE 'OK' END AS status FROM r""")
def drift(t):
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    out = monitor.population_stability(t.events.where(F.col("ts") < cut), t.events.where(F.col("ts") >= cut), "value",
                                       [10, 25, 50, 100])
    return out.withColumn("psi", F.round("psi", 9))
