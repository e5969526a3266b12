"""Readiness, confirmation and monitoring decisions over audit numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeline.operators.quality import count_if


def confirmation_gate(df: DataFrame, source: str, confirmed: Column, supported: Column) -> DataFrame:
    """Per source: confirmed and supported rows, and READY, REVIEW_REQUIRED or BLOCKED."""
    per = df.groupBy(source).agg(count_if(confirmed).alias("confirmed"), count_if(supported).alias("supported"),
                                 F.count(F.lit(1)).alias("rows"))
    return per.withColumn("decision", F.when(F.col("confirmed") > 0, "READY")
                          .when(F.col("supported") > 0, "REVIEW_REQUIRED").otherwise("BLOCKED"))


ALLOWED_NEGATIVES = ["source_confirmed_unaffected", "real_observed_unaffected"]
# Production floors of the readiness table.
COVERAGE_FLOOR, TEST_EVENTS_FLOOR, VALIDATION_EVENTS_FLOOR = 0.95, 30, 10


def readiness(dataset: DataFrame, violations: DataFrame, model: DataFrame, manifest: DataFrame) -> DataFrame:
    """check, status: the acceptance table.

    ``model`` is one row (n_test_events, n_val_events, brier, gate_passed); ``manifest`` has a status
    column per file. Every input is reduced to one row before they meet.
    """
    neg = F.col("label") == 0
    one = dataset.agg(
        F.avg(F.col("rainfall_30day").isNotNull().cast("int")).alias("rain"),
        F.avg(F.col("slope_degrees").isNotNull().cast("int")).alias("terrain"),
        count_if(neg & ~F.coalesce(F.col("label_source").isin(ALLOWED_NEGATIVES), F.lit(False))).alias("bad_negatives"),
        count_if(neg & F.col("label_source").isin(ALLOWED_NEGATIVES)).alias("good_negatives"),
        count_if(F.col("road_segment_id").isNull()).alias("no_identity"))
    v = violations.agg(F.count(F.lit(1)).alias("violations"))
    m = manifest.agg(count_if(F.col("status") != "OK").alias("bad_files"), F.count(F.lit(1)).alias("files"))
    row = one.join(v).join(m).join(model)
    ok = lambda c: F.when(F.coalesce(c, F.lit(False)), "PASS").otherwise("FAIL")
    checks = [
        ("DATA", ok((F.col("rain") >= COVERAGE_FLOOR) & (F.col("terrain") >= COVERAGE_FLOOR))),
        ("LABELS", ok((F.col("bad_negatives") == 0) & (F.col("good_negatives") >= 1))),
        ("GEOSPATIAL_PIPELINE", ok(F.col("no_identity") == 0)),
        ("TEMPORAL_PIPELINE", ok(F.col("violations") == 0)), ("LEAKAGE", ok(F.col("violations") == 0)),
        ("VALIDATION", ok(F.col("n_test_events") >= TEST_EVENTS_FLOOR)), ("MODEL", ok(F.col("gate_passed"))),
        ("CALIBRATION", ok(F.col("brier").isNotNull() & (F.col("n_val_events") >= VALIDATION_EVENTS_FLOOR))),
        ("ROBUSTNESS", F.lit("PARTIAL")),
        ("INPUT_INTEGRITY", ok((F.col("files") > 0) & (F.col("bad_files") == 0)))]
    items = F.array(*[F.struct(F.lit(n).alias("check"), c.alias("status")) for n, c in checks])
    return row.select(F.explode(items).alias("i")).select("i.*")


def monitoring(observations: DataFrame, time: str, stale_events: DataFrame, manifest: DataFrame, today: str,
               max_days: int = 3) -> DataFrame:
    """One row: days since the newest observation, unbuilt events, bad files and the decision."""
    days = observations.agg(F.datediff(F.lit(today).cast("date"), F.max(F.col(time).cast("date"))).alias("days_since_newest"))
    ev = stale_events.agg(F.count(F.lit(1)).alias("events_not_in_dataset"))
    files = manifest.agg(count_if(F.col("status") != "OK").alias("bad_files"))
    # three single-row tables
    row = days.join(ev).join(files)
    fails = (F.coalesce(F.col("days_since_newest") > max_days, F.lit(True)) | (F.col("events_not_in_dataset") > 0)
             | (F.col("bad_files") > 0))
    return row.withColumn("decision", F.when(fails, "ACTION_REQUIRED").otherwise("OK"))
