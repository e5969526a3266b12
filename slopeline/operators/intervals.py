"""Horizon labels: events in ``(prediction_time, prediction_time + horizon]`` of the same segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopeline.operators.asof import DAY_SECONDS, micros, time_slices
from slopeline.schema import require_rows


def qualifying_events(events: DataFrame, types: Sequence[str] | None = None, required: bool = False) -> DataFrame:
    """Events with a parsable time and, when given, one of the wanted types. ``required``: reading them fails
    when no event has a parsable time."""
    timed = events.withColumn("event_time", F.expr("try_cast(event_time AS timestamp_ntz)"))
    for c in ("event_type", "affected_segment_id", "latitude", "longitude"):
        if c not in timed.columns:
            timed = timed.withColumn(c, F.lit(None).cast("string"))
    timed = timed.where(F.col("event_time").isNotNull())
    if required:
        timed = require_rows(timed, "no event has a usable time")
    return timed if types is None else timed.where(F.col("event_type").isin(list(types)))


def label_samples(samples: DataFrame, events: DataFrame, *, segment: str = "road_segment_id",
                  prediction: str = "prediction_time", event_segment: str = "affected_segment_id",
                  event_time: str = "event_time", horizon_days: float = 7,
                  slice_seconds: int | None = None) -> DataFrame:
    """label, matching_event_count, earliest_event_time and lead seconds per distinct sample.

    No sample meets its events one by one. Event counts are run-summed over time and read at both
    ends of the horizon, so the cost is linear in samples plus events even when one segment owns a
    third of both; slices of time split such a segment over tasks.
    """
    horizon = int(horizon_days * DAY_SECONDS * 1_000_000)
    ev = (events.where(F.col(event_segment).isNotNull() & F.col(event_time).isNotNull())
          .groupBy(F.col(event_segment).alias("_k"), micros(F.col(event_time)).alias("_m"))
          .agg(F.count(F.lit(1)).alias("_n")))
    smp = samples.select(F.col(segment).alias("_k"), micros(F.col(prediction)).alias("_p"),
                         F.col(prediction).alias("_pt")).distinct()
    probes = smp.select(
        "_k", "_p", "_pt",
        F.explode(F.array(F.struct(F.col("_p").alias("m"), F.lit(-1).alias("sign")),
                          F.struct((F.col("_p") + horizon).alias("m"), F.lit(1).alias("sign"))))
        .alias("_e")).select("_k", "_p", "_pt", F.col("_e.m").alias("_m"), F.col("_e.sign").alias("_sign"))
    both = (ev.withColumn("_side", F.lit(0))
            .unionByName(probes.withColumn("_side", F.lit(1)), allowMissingColumns=True))
    both, sliced = time_slices(both, "_k", "_m", slice_seconds)
    w = Window.partitionBy("_k", "_slice").orderBy("_m", "_side")
    event_at = F.when(F.col("_n").isNotNull(), F.col("_m"))
    local = both.select(
        "*",
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                   F.lit(0)).alias("_seen"),
        F.first(event_at, ignorenulls=True).over(
            w.rowsBetween(1, Window.unboundedFollowing)).alias("_next"))
    probed = local.where(F.col("_sign").isNotNull())
    if sliced:
        probed = _with_carry(probed, both, event_at)
    else:
        probed = probed.select("*", F.lit(0).alias("_before"), F.lit(None).cast("bigint").alias("_later"))
    counted = probed.groupBy("_k", "_p", "_pt").agg(
        F.sum(F.col("_sign") * (F.col("_seen") + F.col("_before"))).alias("c"),
        F.max(F.when(F.col("_sign") < 0, F.coalesce("_next", "_later"))).alias("_first"))
    hit = F.col("c") > 0
    return counted.select(
        F.col("_k").alias(segment), F.col("_pt").alias(prediction),
        hit.cast("int").alias("label"), F.col("c").alias("matching_event_count"),
        F.when(hit, F.timestamp_add("MICROSECOND", F.col("_first"),
                                    F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
        .alias("earliest_event_time"),
        F.when(hit, (F.col("_first") - F.col("_p")) / F.lit(1e6)).alias("lead_seconds"))


def _with_carry(probed: DataFrame, both: DataFrame, event_at: Column) -> DataFrame:
    """Adds the events of earlier slices and the first event of later ones."""
    per_slice = both.groupBy("_k", "_slice").agg(
        F.sum("_n").alias("_n"), F.min(event_at).alias("_first"))
    across = Window.partitionBy("_k").orderBy("_slice")
    carry = per_slice.select(
        "_k", "_slice",
        F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
        F.first("_first", ignorenulls=True).over(
            across.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    # samples without a segment keep their row, with no events
    at = carry.select(F.col("_k").alias("_ck"), F.col("_slice").alias("_cs"), "_before", "_later")
    return probed.join(at, F.col("_k").eqNullSafe(F.col("_ck")) & F.col("_slice").eqNullSafe(F.col("_cs"))).drop("_ck", "_cs")
