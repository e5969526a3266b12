"""Metrics, thresholds, alert policies, top-k and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeline.catalog.registry import query
from slopeline.functions.scoring import risk_band
from slopeline.operators import alerts, metrics
from slopeline.operators.ordered import first_rows, rank_rows
from slopeline.sources import derived


def rounded(df, *columns, digits: int = 9):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


RANK_SQL = """
  WITH b AS (SELECT "window" AS w, y, s FROM {src}),
  l AS (SELECT w, s, count(*) AS n, sum(y) AS pos FROM b GROUP BY 1, 2),
  c AS (SELECT *, sum(n) OVER (PARTITION BY w ORDER BY s) AS cum,
          sum(n) OVER (PARTITION BY w ORDER BY s DESC) AS at_least,
          sum(pos) OVER (PARTITION BY w ORDER BY s DESC) AS tp FROM l),
  g AS (SELECT w, sum(n) AS total, sum(pos) AS p, sum(pos * (cum - (n - 1) / 2)) AS ranks,
          sum(pos * (tp / at_least)) AS ap FROM c GROUP BY w)
  SELECT w AS "window", CAST(total AS BIGINT) AS n, CAST(p AS BIGINT) AS n_pos,
    round(CASE WHEN p > 0 AND p < total THEN (ranks - p * (p + 1) / 2) / (p * (total - p)) END, 9) AS roc_auc,
    round(CASE WHEN p > 0 THEN ap / p ELSE 0 END, 9) AS avg_precision
  FROM g"""


@query("d19_d20_auc_average_precision", views="scored", sql=RANK_SQL.format(src="scored"))
def auc_ap(t):
    return rounded(metrics.ranking_metrics(derived.scored(t), ["window"]), "roc_auc", "avg_precision")


@query("d19_d20_ranking_at_fact_scale", views="scored_big", sql=RANK_SQL.format(src="scored_big"))
def auc_ap_big(t):
    return rounded(metrics.ranking_metrics(derived.scored_big(t), ["window"]), "roc_auc", "avg_precision")


@query("d18_d21_classification_metrics", views="scored", sql="""
  WITH c AS (SELECT "window", count(*) FILTER (s >= 0.5 AND y = 1) AS tp, count(*) FILTER (s >= 0.5 AND y = 0) AS fp,
      count(*) FILTER (s < 0.5 AND y = 1) AS fn, count(*) FILTER (s < 0.5 AND y = 0) AS tn,
      avg(pow(s - y, 2)) AS brier,
      avg(CASE WHEN y = 1 THEN -ln(greatest(s, 1e-15)) ELSE -ln(1 - least(s, 1 - 1e-15)) END) AS log_loss
    FROM scored GROUP BY 1)
  SELECT "window", tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
    round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
    round(fn / nullif(fn + tp, 0), 9) AS false_negative_rate,
    round((tn + fp) / nullif(tp + fp + fn + tn, 0), 9) AS negative_rate,
    round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 9) AS balanced_accuracy,
    round(brier, 9) AS brier, round(log_loss, 6) AS log_loss FROM c""")
def classification(t):
    df = derived.scored(t)
    out = metrics.classification_metrics(df, ["window"]).join(metrics.probability_losses(df, ["window"]), "window")
    out = rounded(out, "log_loss", digits=6)
    return rounded(out, "precision", "recall", "f1", "false_negative_rate", "negative_rate", "balanced_accuracy",
                   "brier")


@query("d22_recall_at_fraction", views="scored", sql="""
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY s DESC, id) AS rk,
      count(*) OVER (PARTITION BY "window") AS n, sum(y) OVER (PARTITION BY "window") AS p FROM scored)
  SELECT "window", f AS fraction, CAST(max(greatest(1, ceil(n * f))) AS BIGINT) AS n_selected,
    count(*) FILTER (y = 1 AND rk <= greatest(1, ceil(n * f))) AS positives_found,
    round(count(*) FILTER (y = 1 AND rk <= greatest(1, ceil(n * f))) / nullif(max(p), 0), 9) AS recall
  FROM r, (VALUES (1e-1), (25e-2)) v(f) GROUP BY 1, 2""")
def recall_fraction(t):
    return rounded(metrics.recall_at_fraction(derived.scored(t), ["window"]), "recall")


PRED = "CASE WHEN o_totalprice > 4e5 THEN '1-URGENT' WHEN o_totalprice > 3e5 THEN '2-HIGH' ELSE '5-LOW' END"


@query("d23_multiclass_per_class", sql=f"""
  WITH b AS (SELECT o_orderpriority AS a, {PRED} AS p FROM orders),
  k AS (SELECT DISTINCT a AS class FROM b UNION SELECT DISTINCT p FROM b),
  m AS (SELECT class, count(*) FILTER (a = class AND p = class) AS tp, count(*) FILTER (a = class) AS sup,
          count(*) FILTER (p = class) AS pr FROM k, b GROUP BY class)
  SELECT class, sup AS support, round(CASE WHEN pr > 0 THEN tp / pr ELSE 0 END, 9) AS precision,
    round(CASE WHEN sup > 0 THEN tp / sup ELSE 0 END, 9) AS recall,
    round(CASE WHEN pr + sup > 0 THEN 2 * tp / (pr + sup) ELSE 0 END, 9) AS f1 FROM m""")
def multiclass(t):
    per, _ = metrics.multiclass_metrics(_priority_predictions(t), "a", "p")
    return rounded(per, "precision", "recall", "f1")


def _priority_predictions(t):
    p = F.when(F.col("o_totalprice") > 4e5, "1-URGENT").when(F.col("o_totalprice") > 3e5, "2-HIGH").otherwise("5-LOW")
    return t.orders.select(F.col("o_orderpriority").alias("a"), p.alias("p"))


@query("d23_multiclass_overall", sql=f"""
  WITH b AS (SELECT o_orderpriority AS a, {PRED} AS p FROM orders),
  k AS (SELECT DISTINCT a AS class FROM b UNION SELECT DISTINCT p FROM b),
  m AS (SELECT class, count(*) FILTER (a = class AND p = class) AS tp, count(*) FILTER (a = class) AS sup,
          count(*) FILTER (p = class) AS pr FROM k, b GROUP BY class),
  f AS (SELECT *, 2 * tp / (pr + sup) AS f1 FROM m)
  SELECT round(sum(tp) / sum(sup), 9) AS accuracy, round(avg(f1), 9) AS macro_f1,
    round(sum(f1 * sup) / sum(sup), 9) AS weighted_f1 FROM f""")
def multiclass_overall(t):
    _, overall = metrics.multiclass_metrics(_priority_predictions(t), "a", "p")
    return rounded(overall, "accuracy", "macro_f1", "weighted_f1")


# orders with a tied score, their label, window and fold
ALERT_ROWS = """SELECT o_orderkey AS id, o_orderpriority AS "window", round(o_totalprice / 500000, 2) AS s,
    CAST(o_orderstatus = 'F' AS INT) AS y, CAST(o_orderdate AS DATE) AS d, o_custkey % 7 AS fold FROM orders"""


def _alert_rows(t):
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("window"),
        F.round(F.col("o_totalprice") / 500000, 2).alias("s"), (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.col("o_orderdate").cast("date").alias("d"), (F.col("o_custkey") % 7).alias("fold"))


AUC_BY = """(SELECT {g}, (sum(pos * (cum - (n - 1) / 2)) - sum(pos) * (sum(pos) + 1) / 2)
      / (sum(pos) * (sum(n) - sum(pos))) AS auc
    FROM (SELECT {g}, s, count(*) AS n, sum(y) AS pos, sum(count(*)) OVER (PARTITION BY {g} ORDER BY s) AS cum
          FROM {src} GROUP BY {g}, s) GROUP BY {g})"""


@query("d24_overfit_gap", sql=f"""
  WITH a AS ({ALERT_ROWS}), b AS (SELECT *, CASE WHEN fold < 5 THEN 'train' ELSE 'validation' END AS split FROM a),
  m AS {AUC_BY.format(g="split", src="b")}
  SELECT round(max(auc) FILTER (split = 'train'), 9) AS train_roc_auc,
    round(max(auc) FILTER (split = 'validation'), 9) AS validation_roc_auc,
    round(max(auc) FILTER (split = 'train') - max(auc) FILTER (split = 'validation'), 9) AS generalization_gap,
    max(auc) FILTER (split = 'train') - max(auc) FILTER (split = 'validation') > 0.2 AS overfit_warning FROM m""")
def overfit(t):
    df = _alert_rows(t).withColumn("split", F.when(F.col("fold") < 5, "train").otherwise("validation"))
    return rounded(metrics.overfit_gap(df), "train_roc_auc", "validation_roc_auc", "generalization_gap")


@query("d25_pooled_folds", sql=f"""
  WITH a AS ({ALERT_ROWS}), one AS (SELECT *, 1 AS g FROM a),
  f AS {AUC_BY.format(g="fold", src="a")}, p AS {AUC_BY.format(g="g", src="one")},
  ap AS (SELECT sum(pos * (tp / m)) / sum(pos) AS ap FROM (SELECT s, sum(y) AS pos,
      sum(sum(y)) OVER (ORDER BY s DESC) AS tp, sum(count(*)) OVER (ORDER BY s DESC) AS m FROM a GROUP BY s))
  SELECT (SELECT count(*) FROM a) AS pooled_n_samples, (SELECT CAST(sum(y) AS BIGINT) FROM a) AS pooled_n_positives,
    round((SELECT auc FROM p), 9) AS pooled_roc_auc, round((SELECT ap FROM ap), 9) AS pooled_avg_precision,
    count(*) AS n_folds, count(auc) AS n_two_class_folds, round(avg(auc), 9) AS two_class_fold_mean_roc_auc,
    round(min(auc), 9) AS roc_auc_min, round(max(auc), 9) AS roc_auc_max, round(stddev_pop(auc), 9) AS roc_auc_std
  FROM f""")
def pooled(t):
    out = metrics.pooled_folds(_alert_rows(t))
    return rounded(out, *[c for c in out.columns if "auc" in c or "precision" in c])


@query("d29_median_lead_time", views="anchors hazard", sql="""
  WITH l AS (SELECT a.key, a.p, min(epoch(h.event_time - CAST(a.p AS TIMESTAMP))) AS lead
    FROM anchors a JOIN hazard h ON h.affected_segment_id = a.key AND h.event_time > CAST(a.p AS TIMESTAMP)
      AND h.event_time <= CAST(a.p AS TIMESTAMP) + INTERVAL 7 DAY GROUP BY 1, 2)
  SELECT round(quantile_cont(lead, 0.5), 3) AS median_lead FROM l WHERE key % 10 >= 5""")
def median_lead(t):
    from slopeline.operators.intervals import label_samples
    labels = label_samples(derived.anchors(t), derived.hazard(t), segment="key", prediction="p")
    scored = labels.withColumn("s", (F.col("key") % 10).cast("double") / 10)
    return rounded(metrics.median_lead(scored, "lead_seconds", "label", "s"), "median_lead", digits=3)


TOPK = """
  WITH a AS ({src}), r AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY s DESC, id) AS rk,
    count(*) OVER (PARTITION BY "window") AS n FROM a)
  SELECT id, "window", s, rk <= greatest(1, least(n, floor(n * 0.3))) AS alert{extra} FROM r"""


@query("e11_window_top_k", sql=TOPK.format(src=ALERT_ROWS, extra=""))
def window_top_k(t):
    return alerts.window_top_k(_alert_rows(t).select("id", "window", "s"), ["window"])


@query("e12_high_band_floor", views="scored", sql=f"""
  WITH k AS ({TOPK.format(src='SELECT id, "window", s FROM scored', extra="").strip()})
  SELECT "window", count(*) AS n, count(*) FILTER (alert OR s >= 0.7) AS alerts,
    round(count(*) FILTER (alert OR s >= 0.7) / count(*), 9) AS window_alert_rate FROM k GROUP BY "window" """)
def high_floor(t):
    top = alerts.window_top_k(derived.scored(t).select("id", "window", "s"), ["window"])
    out = alerts.with_high_floor(top.withColumn("risk_level", risk_band(F.col("s"))))
    n = F.count(F.when(F.col("operating_decision") == "ALERT", 1))
    return rounded(out.groupBy("window").agg(F.count(F.lit(1)).alias("n"), n.alias("alerts"),
                                             (n / F.count(F.lit(1))).alias("window_alert_rate")), "window_alert_rate")


@query("e13_top_k_threshold", sql=f"""
  WITH a AS ({ALERT_ROWS}), l AS (SELECT "window", s, count(*) AS c FROM a GROUP BY 1, 2),
  r AS (SELECT *, sum(c) OVER (PARTITION BY "window" ORDER BY s DESC) AS cum,
          sum(c) OVER (PARTITION BY "window") AS n FROM l)
  SELECT "window", CAST(max(n) AS BIGINT) AS n, min(s) FILTER (cum <= floor(n * 0.3)) AS threshold,
    CAST(coalesce(max(cum) FILTER (cum <= floor(n * 0.3)), 0) AS BIGINT) AS selected,
    round(coalesce(max(cum) FILTER (cum <= floor(n * 0.3)), 0) / max(n), 9) AS alert_rate
  FROM r GROUP BY "window" """)
def top_k_threshold(t):
    return rounded(alerts.top_k_threshold(_alert_rows(t), ["window"]), "alert_rate")


def _sweep_sql(src: str, budget: str, end: str) -> str:
    return f"""
  WITH a AS ({src}), g AS (SELECT "window" AS w, count(*) AS n, sum(y) AS pos FROM a GROUP BY 1),
  t AS (SELECT DISTINCT "window" AS w, s AS t FROM a UNION ALL SELECT w, 'infinity'::DOUBLE FROM g),
  c AS (SELECT t.w, t.t, g.n, g.pos, count(a.s) AS m, coalesce(sum(a.y), 0) AS tp
        FROM t JOIN g USING (w) LEFT JOIN a ON a."window" = t.w AND a.s >= t.t GROUP BY ALL),
  k AS (SELECT *, CASE WHEN m > 0 THEN tp / m ELSE 0 END AS p, tp / pos AS r, 2 * tp / (m + pos) AS f, m / n AS a
        FROM c),
  z AS (SELECT *, CASE WHEN r >= 0.7 THEN 1 WHEN p >= 0.3 THEN 2 ELSE 3 END AS tier FROM k WHERE {budget}),
  o AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY tier,
          CASE WHEN tier = 1 THEN p ELSE r END DESC, CASE WHEN tier = 1 THEN f ELSE p END DESC,
          CASE WHEN tier = 1 THEN t ELSE f END DESC, a DESC) AS rk FROM z)
  SELECT w AS "window", CASE tier WHEN 1 THEN 'target_recall_met_max_precision{end}'
      WHEN 2 THEN 'max_recall_with_precision_floor{end}' ELSE 'max_recall_precision_floor_unavailable{end}' END
      AS strategy, CASE WHEN t < 'infinity'::DOUBLE THEN t END AS threshold, round(p, 9) AS precision,
    round(r, 9) AS recall, round(f, 9) AS f1, round(a, 9) AS alert_rate, r >= 0.7 AS feasible
  FROM o WHERE rk = 1"""


SWEEP_COLUMNS = ["precision", "recall", "f1", "alert_rate"]


@query("e14_recall_threshold", views="scored", sql=_sweep_sql('SELECT "window", y, s FROM scored', "true", ""))
def recall_threshold(t):
    return rounded(alerts.recall_threshold(derived.scored(t), ["window"]), *SWEEP_COLUMNS)


@query("e14_recall_threshold_with_budget", sql=_sweep_sql(ALERT_ROWS, "a <= 0.3", "_with_alert_budget"))
def recall_threshold_budget(t):
    return rounded(alerts.recall_threshold(_alert_rows(t), ["window"], max_rate=0.3), *SWEEP_COLUMNS)


@query("e15_percentile_score", sql="""
  WITH tr AS (SELECT o_totalprice AS v, count(*) AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
  cum AS (SELECT v, sum(c) OVER (ORDER BY v) AS cum FROM tr), n AS (SELECT sum(c) AS n FROM tr)
  SELECT o.o_orderkey, round(coalesce(cum.cum, 0) / n.n, 9) AS score
  FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F') o ASOF LEFT JOIN cum ON cum.v <= o.o_totalprice, n""")
def percentile_score(t):
    train = t.orders.where("o_orderstatus = 'F'").select("o_totalprice")
    rows = t.orders.where("o_orderstatus <> 'F'").select("o_orderkey", "o_totalprice")
    out = alerts.percentile_scores(train, rows, "o_totalprice")
    return rounded(out.drop("o_totalprice"), "score")


@query("j10_majority_and_percentile_baselines", sql=f"""
  WITH a AS ({ALERT_ROWS}), one AS (SELECT *, 1 AS g FROM a), m AS {AUC_BY.format(g="g", src="one")}
  SELECT 'majority_no_disruption' AS baseline, 0.5 AS roc_auc, round((SELECT avg(y) FROM a), 9) AS avg_precision
  UNION ALL SELECT 'score_percentile', round((SELECT auc FROM m), 9), round((SELECT sum(pos * (tp / k)) / sum(pos)
    FROM (SELECT s, sum(y) AS pos, sum(sum(y)) OVER (ORDER BY s DESC) AS tp, sum(count(*)) OVER (ORDER BY s DESC) AS k
          FROM a GROUP BY s)), 9)""".replace("0.5 AS roc_auc", "5e-1 AS roc_auc"))
def baselines(t):
    a = _alert_rows(t)
    pct = alerts.percentile_scores(a.select("s"), a.select("y", "s"), "s", "score").select("y", F.col("score").alias("s"))
    rows = (pct.withColumn("baseline", F.lit("score_percentile"))
            .unionByName(a.select("y", F.lit(0.0).alias("s"), F.lit("majority_no_disruption").alias("baseline"))))
    return rounded(metrics.ranking_metrics(rows, ["baseline"]).drop("n", "n_pos"), "roc_auc", "avg_precision")


GATE_METRICS = f"""
  WITH a AS ({ALERT_ROWS}), m AS {AUC_BY.format(g='"window"', src="a")},
  e AS (SELECT "window", count(DISTINCT d) AS events, count(*) FILTER (s >= 0.5 AND y = 1) / sum(y) AS recall
        FROM a GROUP BY 1),
  p AS (SELECT "window", sum(pos * (tp / k)) / sum(pos) AS ap FROM (SELECT "window", s, sum(y) AS pos,
      sum(sum(y)) OVER (PARTITION BY "window" ORDER BY s DESC) AS tp,
      sum(count(*)) OVER (PARTITION BY "window" ORDER BY s DESC) AS k FROM a GROUP BY 1, 2) GROUP BY 1)"""


@query("j15_evidence_gates", sql=f"""{GATE_METRICS}
  SELECT "window", gate, events >= ev AND auc >= ra AND ap >= pa AND (rc IS NULL OR recall >= rc) AS passed,
    CASE WHEN events >= ev AND auc >= ra AND ap >= pa AND (rc IS NULL OR recall >= rc) THEN good ELSE bad END AS status,
    CAST(events < ev AS INT) + CAST(auc < ra AS INT) + CAST(ap < pa AS INT)
      + CAST(coalesce(recall < rc, false) AS INT) AS n_reasons
  FROM m JOIN e USING ("window") JOIN p USING ("window"), (VALUES
    ('demo', 3, 0.65, 0.5, NULL, 'HACKATHON_DEMO_READY_LIMITED_CONFIDENCE', 'DEMO_GATE_FAILED'),
    ('production', 30, 0.75, 0.6, 0.7, 'PRODUCTION_READY_EVIDENCE_SUPPORTED', 'NOT_PRODUCTION_READY'))
    v(gate, ev, ra, pa, rc, good, bad)""")
def gates(t):
    a = _alert_rows(t)
    m = (metrics.ranking_metrics(a, ["window"]).join(metrics.classification_metrics(a, ["window"]).select("window", "recall"), "window")
         .join(a.groupBy("window").agg(F.countDistinct("d").alias("events")), "window"))
    return alerts.evidence_gates(m, ["window"]).select("window", "gate", "passed", "status",
                                                       F.size("reasons").alias("n_reasons"))


@query("j16_baseline_comparison", sql=f"""{GATE_METRICS},
  x AS (SELECT m."window" AS w, auc, ap FROM m JOIN p USING ("window")), o AS (SELECT * FROM x WHERE w = '5-LOW')
  SELECT count(*) AS comparable, count(*) FILTER (o.auc > x.auc AND o.ap > x.ap) AS beaten,
    bool_and(o.auc > x.auc AND o.ap > x.ap) AS beats_all FROM x, o WHERE x.w <> '5-LOW'""")
def comparison(t):
    m = metrics.ranking_metrics(_alert_rows(t), ["window"])
    return alerts.baseline_comparison(m.where(F.col("window") == "5-LOW"), m.where(F.col("window") != "5-LOW"))


@query("e10_priority_ranking", views="segment", sql="""
  WITH b AS (SELECT osm_id, ref, (CASE WHEN contains(lower(coalesce(name, '')), 'ring') OR contains(lower(ref), '12')
        THEN 100e0 ELSE 0e0 END) + (CASE WHEN bridge = 'yes' THEN 50e0 ELSE 0e0 END)
      + (CASE WHEN highway IN ('trunk', 'primary', 'secondary', 'tertiary') THEN 30e0 ELSE 0e0 END)
      - osm_id / 1000e0 * 10 AS priority_score FROM segment)
  SELECT osm_id, ref, round(priority_score, 6) AS priority_score,
    row_number() OVER (PARTITION BY ref ORDER BY priority_score DESC, osm_id) AS candidate_rank FROM b""")
def priority_ranking(t):
    from slopeline.functions.scoring import priority_score, yes_flag
    from slopeline.functions.text import has_any
    named = has_any(F.col("name"), ["ring"]) | has_any(F.col("ref"), ["12"])
    df = derived.segment(t).select("osm_id", "ref", priority_score(
        named, yes_flag(F.col("bridge")), F.col("highway"), F.col("osm_id").cast("double")).alias("priority_score"))
    return rounded(rank_rows(df, ["ref"], [("priority_score", False), "osm_id"], "candidate_rank"),
                   "priority_score", digits=6)


@query("f3_feed_order", views="scored", sql="""
  SELECT id, s, row_number() OVER (ORDER BY s DESC, id) AS position FROM scored""")
def feed_order(t):
    return rank_rows(derived.scored(t).select("id", "s"), [], [("s", False), "id"], "position")


@query("f5_most_common_values", sql="""
  SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20""")
def most_common(t):
    return (t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "l_partkey").limit(20))


@query("f4_top_factors_in_row", views="risk_input", sql="""
  WITH f AS (SELECT o_orderkey, unnest(['slope', 'elev', 'rain1', 'rain7', 'rain14', 'lat', 'lon']) AS feature,
      unnest([slope_degrees / 95 - 0.5, elevation_m / 9400 - 0.5, rainfall_1day / 31, rainfall_7day / 20000 - 0.25,
        rainfall_14day / 450 - 0.5, latitude / 100, -longitude / 200]) AS c, unnest([1, 2, 3, 4, 5, 6, 7]) AS i
    FROM risk_input),
  r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(round(coalesce(c, 0), 6)) DESC, i) AS rk FROM f)
  SELECT o_orderkey, string_agg(feature, ',' ORDER BY rk) AS top FROM r WHERE rk <= 5 GROUP BY 1""")
def factors(t):
    from slopeline.functions.scoring import contribution_records, top_factors
    terms = {"slope": F.col("slope_degrees") / 95 - 0.5, "elev": F.col("elevation_m") / 9400 - 0.5,
             "rain1": F.col("rainfall_1day") / 31, "rain7": F.col("rainfall_7day") / 20000 - 0.25,
             "rain14": F.col("rainfall_14day") / 450 - 0.5, "lat": F.col("latitude") / 100,
             "lon": -F.col("longitude") / 200}
    values = [F.coalesce(c, F.lit(0.0)) for c in terms.values()]
    rec = contribution_records(list(terms), values, values)
    return derived.risk_input(t).select(
        "o_orderkey", F.array_join(F.transform(top_factors(rec), lambda f: f["feature"]), ",").alias("top"))


@query("f6_top_rows_per_group", views="segment", sql="""
  SELECT state, osm_id, lon FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY lon, osm_id) AS rk
    FROM segment) WHERE rk <= 3""")
def top_rows(t):
    return first_rows(derived.segment(t).select("state", "osm_id", "lon"), ["state"], ["lon", "osm_id"], 3).drop("rank")
