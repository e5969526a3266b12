"""Writers: tables, reports as lines, GeoJSON features and the append-only trace log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeline.functions.scoring import sorted_map_json

TRACE_STREAMS = ["production", "demo", "test"]


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Immutable parquet output: an existing target is an error."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def report_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row with explicit nulls; NaN and infinities are null."""
    clean = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.simpleString() in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        clean.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    report_lines(df).write.mode("errorifexists").text(path)


def geojson_feature(coords: Column, properties: Sequence[str]) -> Column:
    """A LineString feature as JSON text."""
    line = F.transform(coords, lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.struct(F.lit("LineString").alias("type"), line.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"),
                              geometry.alias("geometry")), {"ignoreNullFields": "false"})


def write_geojson_lines(df: DataFrame, path: str, coords: str, properties: Sequence[str]) -> None:
    """Newline-delimited GeoJSON: one feature per line, so the file can be split."""
    df.select(geojson_feature(F.col(coords), properties).alias("value")).write.mode("errorifexists").text(path)


def trace_rows(scored: DataFrame, *, stream: str, model_version: str, dataset_version: str, policy_version: str,
               features: Sequence[str], threshold: float, horizon_days: int = 7) -> DataFrame:
    """The 24-column trace record of every scored row."""
    if stream not in TRACE_STREAMS:
        raise ValueError(f"unknown trace stream {stream!r}")
    values = F.create_map(*[c for n in features for c in (F.lit(n), F.col(n).cast("double"))])
    names = F.lit('["' + '","'.join(sorted(features)) + '"]')
    return scored.select(
        F.expr("uuid()").alias("prediction_id"), F.lit("PREDICTION").alias("record_type"),
        F.lit(stream).alias("trace_stream"), "road_segment_id", "ref", "state", "district", "prediction_timestamp",
        F.lit(horizon_days).alias("prediction_horizon_days"), F.lit(model_version).alias("model_version"),
        F.lit(dataset_version).alias("dataset_version"), F.sha2(names, 256).alias("feature_version"),
        sorted_map_json(values).alias("input_features"), "raw_probability", "calibrated_probability",
        F.col("calibrated_probability").alias("disruption_probability"), "risk_level",
        F.lit(policy_version).alias("risk_policy_version"), "operating_decision",
        F.to_json(F.struct("confidence_flags", (F.size("confidence_flags") > 0).alias("low_confidence"))).alias("data_quality"),
        F.lit("{}").alias("input_references"), F.lit(float(threshold)).alias("threshold"),
        F.to_json("top_contributing_factors").alias("top_contributing_factors"),
        F.current_timestamp().alias("inference_timestamp"))


def append_traces(traces: DataFrame, path: str) -> None:
    """Append-only log, one folder per stream."""
    traces.write.mode("append").partitionBy("trace_stream").parquet(path)


def read_traces(spark: SparkSession, path: str, *, start: str | None = None, end: str | None = None,
                model_version: str | None = None, risk_level: str | None = None, stream: str | None = None) -> DataFrame:
    return filter_traces(spark.read.parquet(path), start=start, end=end, model_version=model_version,
                         risk_level=risk_level, stream=stream)


def filter_traces(df: DataFrame, *, start: str | None = None, end: str | None = None, model_version: str | None = None,
                  risk_level: str | None = None, stream: str | None = None, time: str = "inference_timestamp") -> DataFrame:
    """Optional filters; the date range is inclusive and compares timestamps."""
    if stream is not None:
        if stream not in TRACE_STREAMS:
            raise ValueError(f"unknown trace stream {stream!r}")
        df = df.where(F.col("trace_stream") == stream)
    kind = df.schema[time].dataType
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end).cast(kind))
    if model_version is not None:
        df = df.where(F.col("model_version") == model_version)
    if risk_level is not None:
        df = df.where(F.col("risk_level") == risk_level)
    return df


def trace_summary(df: DataFrame, time: str = "inference_timestamp") -> DataFrame:
    """Totals, range and mean probability: overall (grouping 3), per risk level (1) and per model (2), in one pass."""
    sets = [[], [F.col("risk_level")], [F.col("model_version")]]
    return df.groupingSets(sets, "risk_level", "model_version").agg(
        F.grouping_id().cast("int").alias("grouping"), F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"),
        F.avg("calibrated_probability").alias("avg_probability"))
