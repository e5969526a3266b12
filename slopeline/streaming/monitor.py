"""Monitoring jobs over the prediction stream: trace log, alert load, late input, delayed labels, drift."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopeline.functions.scoring import STALE_HOURS

# The state horizon equals the freshness expiry.
WATERMARK = f"{STALE_HOURS // 24} days"


def file_stream(spark: SparkSession, folder: str, file_glob: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything available to a parquet table, exactly once, then stop."""
    q = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write updated aggregates, one folder per batch; a replayed batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of every key written by ``run_updates``."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def trace_stream(predictions: DataFrame, score: Callable[[DataFrame], DataFrame], time: str, key: str) -> DataFrame:
    """Score a stream row by row and keep one trace per prediction id inside the watermark."""
    return score(predictions.withWatermark(time, WATERMARK).dropDuplicatesWithinWatermark([key]))


def daily_alert_load(predictions: DataFrame, time: str, probability: str, level: str) -> DataFrame:
    """Per day: predictions, alerts, HIGH count, mean and standard deviation of the probability."""
    day = F.window(F.col(time), "1 day")
    return (predictions.withWatermark(time, WATERMARK).groupBy(day.alias("w")).agg(
        F.count(F.lit(1)).alias("predictions"), F.count(F.when(F.col("operating_decision") == "ALERT", 1)).alias("alerts"),
        F.count(F.when(F.col(level) == "HIGH", 1)).alias("high"), F.avg(probability).alias("mean_probability"),
        F.stddev_samp(probability).alias("std_probability"))
        .select(F.col("w.start").cast("date").alias("day"), "predictions", "alerts", "high", "mean_probability",
                "std_probability").withColumn("alert_rate", F.col("alerts") / F.col("predictions")))


def suppress_late(inputs: DataFrame, observed: str, received: str, key: list[str]) -> DataFrame:
    """Drop inputs that expired before they arrived and repeats of the same key inside the watermark."""
    age = F.timestamp_diff("SECOND", F.col(observed), F.col(received))
    return inputs.where(age <= STALE_HOURS * 3600).withWatermark(received, WATERMARK).dropDuplicatesWithinWatermark(key)


def delayed_labels(predictions: DataFrame, events: DataFrame, *, segment: str, prediction_time: str, event_segment: str,
                   event_time: str, horizon_days: int = 7) -> DataFrame:
    """Predictions with the later events of their segment inside the horizon (stream-stream join)."""
    p = predictions.withWatermark(prediction_time, WATERMARK)
    e = events.withWatermark(event_time, WATERMARK)
    on = ((F.col(segment) == F.col(event_segment)) & (F.col(event_time) > F.col(prediction_time))
          & (F.col(event_time) <= F.col(prediction_time) + F.expr(f"interval {horizon_days} days")))
    return p.join(e, on)


def population_stability(expected: DataFrame, actual: DataFrame, value: str, bounds: list[float], floor: float = 1e-6
                         ) -> DataFrame:
    """One row: PSI over fixed bucket bounds, and its reading."""
    bucket = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= F.col(value)))
    side = lambda df, n: df.where(F.col(value).isNotNull()).select(bucket.alias("bucket"), F.lit(n).alias("side"))
    counts = side(expected, "e").unionByName(side(actual, "a")).groupBy("bucket").agg(
        F.count(F.when(F.col("side") == "e", 1)).alias("e"), F.count(F.when(F.col("side") == "a", 1)).alias("a"))
    totals = counts.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    # the totals are a single row
    share = counts.join(totals).select(F.greatest(F.col("e") / F.col("te"), F.lit(floor)).alias("p"),
                                       F.greatest(F.col("a") / F.col("ta"), F.lit(floor)).alias("q"))
    out = share.agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))
    return out.withColumn("status", F.when(F.col("psi") > 0.25, "REVIEW").when(F.col("psi") > 0.10, "WARN").otherwise("OK"))
