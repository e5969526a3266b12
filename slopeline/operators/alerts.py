"""Alert policies and operating thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeline.operators.metrics import _same, score_levels
from slopeline.operators.ordered import rank_rows, running_sums

# Policy defaults.
ALERT_SHARE = 0.30
TARGET_RECALL = 0.70
PRECISION_FLOOR = 0.30


def _share(value: float) -> float:
    if not 0 <= value <= 1:
        raise ValueError("an alert share must be between 0 and 1")
    return float(value)


def window_top_k(df: DataFrame, window: Sequence[str], s: str = "s", seq: str = "id",
                 share: float = ALERT_SHARE, name: str = "alert") -> DataFrame:
    """Alert the best max(1, floor(n*share)) rows of each window by rank; ties by ``seq``."""
    share, window = _share(share), list(window)
    ranked = rank_rows(df, window, [(s, False), seq], "_rank")
    n = df.groupBy(*window).agg(F.count(F.lit(1)).alias("_n"))
    keyed = n.select(*[F.col(b).alias(f"_g_{b}") for b in window], "_n")
    k = F.greatest(F.lit(1), F.least(F.col("_n"), F.floor(F.col("_n") * F.lit(share))))
    return ranked.join(keyed, _same(window, "_g_")).select(*df.columns, (F.col("_rank") <= k).alias(name))


def with_high_floor(df: DataFrame, level: str = "risk_level", alert: str = "alert",
                    name: str = "operating_decision") -> DataFrame:
    """HIGH rows alert whatever their rank."""
    return df.withColumn(name, F.when((F.col(level) == "HIGH") | F.col(alert), "ALERT").otherwise("NO_ALERT"))


def top_k_threshold(df: DataFrame, by: Sequence[str], s: str = "s", rate: float = ALERT_SHARE) -> DataFrame:
    """Lowest score whose tie group still fits floor(n*rate); NULL when none fits.

    Rows without a finite score count for n but are never selected.
    """
    rate, by = _share(rate), list(by)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    finite_rows = df.where(F.col(s).isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")))
    lv = finite_rows.groupBy(*by, F.col(s).alias("score")).agg(F.count(F.lit(1)).alias("c"))
    ran = running_sums(lv, by, [("score", False)], {"cum": "c"})
    keyed = n.select(*[F.col(b).alias(f"_g_{b}") for b in by], "n")
    fits = F.col("cum") <= F.floor(F.col("n") * F.lit(rate))
    j = ran.join(keyed, _same(by, "_g_"))
    return j.groupBy(*by).agg(
        F.max("n").alias("n"), F.min(F.when(fits, F.col("score"))).alias("threshold"),
        F.coalesce(F.max(F.when(fits, F.col("cum"))), F.lit(0)).alias("selected")).withColumn(
        "alert_rate", F.col("selected") / F.col("n"))


def recall_threshold(df: DataFrame, by: Sequence[str], y: str = "y", s: str = "s",
                     target: float = TARGET_RECALL, floor: float = PRECISION_FLOOR,
                     max_rate: float | None = None) -> DataFrame:
    """Operating point per group: recall target first, then precision; alert budget when given.

    Candidates are the distinct scores and 'alert nobody' (threshold NULL). Each policy tier is the
    maximum of one ordered key, so a group needs no sort of its candidates.
    """
    by = list(by)
    lv = score_levels(df, by, y, s).select(*by, F.col("score").cast("double").alias("t"),
                                           F.col("at_least").alias("m"), F.col("pos_at_least").alias("tp"),
                                           "total", "total_pos")
    nobody = lv.groupBy(*by).agg(F.max("total").alias("total"), F.max("total_pos").alias("total_pos")).select(
        *by, F.lit(float("inf")).alias("t"), F.lit(0).cast("bigint").alias("m"),
        F.lit(0).cast("bigint").alias("tp"), "total", "total_pos")
    z = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = lv.unionByName(nobody).select(
        *by, "t", "total_pos", z(F.col("tp"), F.col("m")).alias("p"), z(F.col("tp"), F.col("total_pos")).alias("r"),
        z(2 * F.col("tp"), F.col("m") + F.col("total_pos")).alias("f"), (F.col("m") / F.col("total")).alias("a"))
    budget = F.lit(True) if max_rate is None else F.col("a") <= F.lit(_share(max_rate))
    full = F.struct("t", "p", "r", "f", "a")
    on_target = budget & (F.col("r") >= target)
    on_floor = budget & (F.col("p") >= floor)
    late = F.struct("r", "p", "f", "a")
    best = c.groupBy(*by).agg(
        F.max("total_pos").alias("pos"),
        F.max_by(full, F.when(on_target, F.struct("p", "f", "t"))).alias("b1"),
        F.max_by(full, F.when(on_floor, late)).alias("b2"), F.max_by(full, F.when(budget, late)).alias("b3"),
        F.bool_or(on_target).alias("h1"), F.bool_or(on_floor).alias("h2"))
    end = "" if max_rate is None else "_with_alert_budget"
    chosen = F.when(F.col("h1"), F.col("b1")).when(F.col("h2"), F.col("b2")).otherwise(F.col("b3"))
    strategy = (F.when(F.col("pos") == 0, "default_no_validation_positives")
                .when(F.col("h1"), "target_recall_met_max_precision" + end)
                .when(F.col("h2"), "max_recall_with_precision_floor" + end)
                .otherwise("max_recall_precision_floor_unavailable" + end))
    out = best.select(*by, strategy.alias("strategy"), F.col("pos"), chosen.alias("c"))
    some = F.col("pos") > 0
    return out.select(
        *by, "strategy",
        F.when(~some, 0.5).when(F.col("c.t") < float("inf"), F.col("c.t")).alias("threshold"),
        F.when(some, F.col("c.p")).alias("precision"), F.when(some, F.col("c.r")).alias("recall"),
        F.when(some, F.col("c.f")).alias("f1"), F.when(some, F.col("c.a")).alias("alert_rate"),
        F.when(some, F.col("c.r") >= target).alias("feasible"))


def percentile_scores(train: DataFrame, rows: DataFrame, value: str, name: str = "score") -> DataFrame:
    """Share of the training values that are <= each row's value; 0 for an unknown value."""
    counts = (train.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c")))
    wanted = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(value).alias("_v")).distinct()
    levels = counts.unionByName(wanted.withColumn("_c", F.lit(0).cast("bigint"))).groupBy("_v").agg(
        F.sum("_c").alias("_c"))
    ran = running_sums(levels, [], ["_v"], {"_cum": "_c"})
    total = counts.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_n"))
    # the total is a single row
    share = ran.join(total).select("_v", (F.col("_cum") / F.greatest("_n", F.lit(1))).alias(name))
    return (rows.join(share, F.col(value) == F.col("_v"), "left").drop("_v")
            .withColumn(name, F.coalesce(name, F.lit(0.0))))


# Evidence gates (test events, ROC-AUC, average precision, recall).
GATES = {"demo": {"events": 3, "roc_auc": 0.65, "avg_precision": 0.50},
         "production": {"events": 30, "recall": 0.70, "roc_auc": 0.75, "avg_precision": 0.60}}
GATE_TEXT = {"events": "test events", "roc_auc": "test ROC-AUC", "avg_precision": "test avg_precision",
             "recall": "test recall"}
GATE_STATUS = {"demo": ("HACKATHON_DEMO_READY_LIMITED_CONFIDENCE", "DEMO_GATE_FAILED"),
               "production": ("PRODUCTION_READY_EVIDENCE_SUPPORTED", "NOT_PRODUCTION_READY")}


def evidence_gates(metrics: DataFrame, by: Sequence[str], chronological: bool = True) -> DataFrame:
    """Per group and gate: passed, status and every failed requirement."""
    items = []
    for gate, needs in GATES.items():
        reasons = [F.when(F.lit(not chronological), "test split is not chronological-future")]
        for c in ("events", "roc_auc", "avg_precision", "recall"):
            if c in needs:
                v = F.coalesce(F.col(c), F.lit(0))
                reasons.append(F.when(v < needs[c], F.concat(
                    F.lit(f"{GATE_TEXT[c]} "), v.cast("string"), F.lit(f" < {needs[c]}"))))
        items.append(F.struct(F.lit(gate).alias("gate"), F.array_compact(F.array(*reasons)).alias("reasons")))
    out = metrics.select(*by, F.explode(F.array(*items)).alias("g")).select(*by, "g.gate", "g.reasons")
    passed = F.size("reasons") == 0
    status = None
    for gate, (good, bad) in GATE_STATUS.items():
        cond = F.col("gate") == gate
        value = F.when(passed, good).otherwise(bad)
        status = F.when(cond, value) if status is None else status.when(cond, value)
    return out.withColumn("passed", passed).withColumn("status", status)


def baseline_comparison(model: DataFrame, baselines: DataFrame) -> DataFrame:
    """Whether the single model row beats each comparable baseline, and all of them."""
    m = model.select(F.col("roc_auc").alias("_a"), F.col("avg_precision").alias("_p"))
    comparable = baselines.where("roc_auc IS NOT NULL AND avg_precision IS NOT NULL")
    # the model side is a single row
    j = comparable.join(m)
    beats = (F.col("_a") > F.col("roc_auc")) & (F.col("_p") > F.col("avg_precision"))
    return j.agg(F.count(F.lit(1)).alias("comparable"), F.count(F.when(beats, 1)).alias("beaten"),
                 F.coalesce(F.bool_and(beats), F.lit(False)).alias("beats_all"))
