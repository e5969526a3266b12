"""Batch scoring: validate, derive, score, calibrate, band, flag and decide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeline.functions import scoring as sc
from slopeline.functions import validate as va
from slopeline.functions.season import seasonal_features
from slopeline.operators.alerts import ALERT_SHARE, window_top_k, with_high_floor
from slopeline.operators.ordered import one_per_group, rank_rows
from slopeline.operators.windows import LOOKBACK_DAYS, trailing_features
from slopeline.plans.model import FrozenLogistic, score
from slopeline.schema import nan_to_null
from slopeline.session import durable


def validate_inputs(df: DataFrame, ignore: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their errors)."""
    checked = df.withColumn("errors", va.scoring_errors(df, ignore))
    return df.where(va.scoring_valid(df, ignore)), checked.where(F.size("errors") > 0)


def derive_inputs(df: DataFrame, prediction: str = "prediction_time") -> DataFrame:
    """Model features from observations; supplied derived values are never trusted."""
    base = df.drop(*[c for c in va.DERIVED if c in df.columns])
    return base.select("*", *sc.rain_features(), *sc.interactions(), sc.terrain_known_scoring().alias("terrain_known"),
                       *seasonal_features(F.col(prediction)))


def quality_flags(df: DataFrame, profile: dict[str, tuple[float | None, float | None]], prediction: Column,
                  observed: Column) -> DataFrame:
    fresh = sc.freshness(prediction, observed)
    out = df.withColumn("ood_features", sc.ood_features(profile)).withColumn("freshness", fresh)
    out = out.withColumn("confidence_flags", sc.confidence_flags(F.col("freshness"), F.size("ood_features"),
                                                                 F.col("terrain_known")))
    return out.withColumn("low_confidence", F.size("confidence_flags") > 0)


def score_table(model: PipelineModel, df: DataFrame, features: Sequence[str], *, threshold: float,
                calibration=None) -> DataFrame:
    """Probability, band and threshold decision of prepared rows."""
    out = score(model, df, features, calibration)
    p = F.col("calibrated_probability")
    return out.withColumn("risk_level", sc.risk_band(p)).withColumn("operating_decision", sc.decision(p, threshold))


def risk_feed(segments: DataFrame, model: PipelineModel | FrozenLogistic, features: Sequence[str], *, ignore: Sequence[str],
              window: Sequence[str] = (), share: float = ALERT_SHARE, calibration=None,
              profile: dict[str, tuple[float | None, float | None]] | None = None, key: str = "osm_id",
              observed: str | None = None) -> DataFrame:
    """Scored segments of one emission in feed order: rank alerts within each window, HIGH always alerts.

    Invalid segments are left out, as the feed skips them. NaN inputs are unknown. ``observed``: the column
    of the newest observation's time, from which the freshness follows; unknown without it.
    feed_position counts from 1 by falling probability, unknown ones last.

    The valid rows and the scores are written: the rule expressions would otherwise ride through every join
    and window above them, and the model would run once for each ranking.
    """
    ok = va.scoring_valid(segments, [*ignore, *([observed] if observed else [])], nan_is_null=True)
    valid = durable(nan_to_null(segments.where(ok)))
    ready = derive_inputs(valid)
    seen = F.col(observed).cast("timestamp_ntz") if observed else F.lit(None).cast("timestamp_ntz")
    flagged = quality_flags(ready, profile or {}, F.col("prediction_time").cast("timestamp_ntz"), seen)
    scored = score(model, flagged, features, calibration).withColumn(
        "disruption_probability", F.round("calibrated_probability", 4))
    banded = durable(scored.withColumn("risk_level", sc.risk_band(F.col("calibrated_probability"))))
    alerted = window_top_k(banded, window, "disruption_probability", key, share)
    return rank_rows(with_high_floor(alerted).drop("alert"), [], [("disruption_probability", False), key], "feed_position")


def representative_segments(dataset: DataFrame, corridor: str = "ref", road: str = "osm_id") -> DataFrame:
    """One road per corridor: the lowest id."""
    return one_per_group(dataset.select(corridor, road).distinct(), [corridor], [road])


def feed_inputs(dataset: DataFrame, roads: DataFrame, daily: DataFrame, *, corridor: str = "ref", road: str = "osm_id",
                place: str = "state") -> DataFrame:
    """The rows of an emission: one road per corridor of the dataset with its attributes, and the rainfall of its
    place (``daily``: key, d, v) in the windows before the newest day, which is the prediction time.

    observed_at is the last day before that with a reading. A place without readings has unknown rainfall.
    """
    newest = daily.agg(F.max("d").alias("_newest"))
    # one row
    near = daily.join(F.broadcast(newest), F.col("d").between(F.date_sub("_newest", LOOKBACK_DAYS), F.date_sub("_newest", 1)))
    places = roads.join(representative_segments(dataset, corridor, road), [corridor, road]).select(*roads.columns)
    at = places.select(F.col(place).alias("key")).distinct().join(F.broadcast(newest)).withColumnRenamed("_newest", "prediction_time")
    rain = trailing_features(near.select("key", "d", "v"), at, anchor="prediction_time").withColumnRenamed("key", place)
    last = near.where(F.col("v").isNotNull()).groupBy(F.col("key").alias(place)).agg(F.max("d").alias("observed_at"))
    return places.join(rain, place, "left").join(last, place, "left")
