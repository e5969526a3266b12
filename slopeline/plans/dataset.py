"""Training dataset assembly: samples joined with road, terrain, identity and rainfall attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeline.functions import scoring as sc
from slopeline.functions.season import seasonal_features
from slopeline.functions.validate import RAINFALL
from slopeline.operators.asof import asof_join, guard_no_future
from slopeline.operators.lookup import join_static
from slopeline.operators.ordered import one_per_group
from slopeline.operators.quality import NEGATIVE_SOURCE, POSITIVE_SOURCE
from slopeline.operators.sampling import CORRIDOR_OFFSET, corridor_draw, event_samples
from slopeline.operators.sets import concatenate
from slopeline.schema import require_columns

RATIOS = ["rain_intensity_1_vs_7", "rain_intensity_3_vs_14", "rain_concentration_3_in_7", "rain_trend_1_vs_3",
          "rain_cumul_ratio_7_vs_30"]
SEASONAL = ["month", "seasonal_sin", "seasonal_cos", "monsoon_active", "days_into_monsoon"]
# Columns of the dataset, in order, and the model inputs among them.
COLUMNS = ["event_id", "osm_id", "road_segment_id", "ref", "highway", "district", "state", "prediction_time", "label",
           "sample_kind", "label_source", "elevation_m", "slope_degrees", *RAINFALL, "rainfall_days_available",
           "highway_prior", "bridge_flag", *RATIOS, "terrain_known", "slope_x_rain7", "slope_x_rain30", "elev_x_slope",
           *SEASONAL]
FEATURES = ["elevation_m", "slope_degrees", *RAINFALL, "rainfall_days_available", "highway_prior", "bridge_flag", *RATIOS,
            "terrain_known", "slope_x_rain7", "slope_x_rain30", "elev_x_slope", *SEASONAL]


def road_attributes(roads: DataFrame, terrain: DataFrame, identity: DataFrame | None = None) -> DataFrame:
    """One row per road with terrain and stable id."""
    require_columns(roads, ["osm_id", "ref", "highway", "district", "state", "bridge"], "roads")
    rd = roads.select("osm_id", "ref", "highway", "district", "state", "bridge").join(
        terrain.select("osm_id", "elevation_m", "slope_degrees"), "osm_id", "left")
    if identity is None:
        return rd.withColumn("road_segment_id", F.lit(None).cast("string"))
    return rd.join(identity.select("osm_id", "road_segment_id"), "osm_id", "left")


def positive_samples(events: DataFrame, controls: bool) -> DataFrame:
    s = event_samples(events.select("event_id", "osm_id", "ref", "event_date"))
    s = s if controls else s.where("label = 1")
    source = F.when(F.col("label") == 1, POSITIVE_SOURCE).otherwise("real_same_road_control")
    return s.drop("event_date").withColumn("label_source", source)


def observed_negatives(observations: DataFrame) -> DataFrame:
    return observations.select(
        F.col("observation_id").alias("event_id"), "osm_id", "ref", "prediction_time", F.lit(0).alias("label"),
        F.lit("observed_open_negative").alias("sample_kind"), F.lit(NEGATIVE_SOURCE).alias("label_source"))


def add_features(samples: DataFrame, roads: DataFrame, rain: DataFrame) -> DataFrame:
    """Road, rain and calendar features of every sample, in dataset column order.

    Both sides of each join are unique per key, so no sample is lost or multiplied.
    """
    ds = join_static(samples, roads.drop("ref"), ["osm_id"])
    ds = join_static(ds, rain.select("osm_id", "prediction_time", *RAINFALL, "rainfall_days_available"),
                     ["osm_id", "prediction_time"])
    ds = ds.select("*", sc.highway_prior(F.col("highway")).alias("highway_prior"),
                   sc.bridge_flag_training(F.col("bridge")).alias("bridge_flag"), *sc.rain_features(), *sc.interactions(),
                   sc.terrain_known_training().alias("terrain_known"), *seasonal_features(F.col("prediction_time")))
    return ds.select(*COLUMNS)


def production_dataset(events: DataFrame, observations: DataFrame, roads: DataFrame, rain: DataFrame) -> DataFrame:
    """Admissible labels only: confirmed positives and every observed negative."""
    samples = concatenate(positive_samples(events, controls=False), observed_negatives(observations))
    return add_features(samples, roads, rain)


def exploratory_samples(events: DataFrame, observations: DataFrame, roads: DataFrame, seed: int = 2026) -> DataFrame:
    """Positives, same-road controls, first observation per known unconfirmed road, corridor draws."""
    confirmed = events.select("osm_id").distinct()
    known = roads.select("osm_id")
    obs = observations.join(confirmed, "osm_id", "left_anti").join(known, "osm_id", "left_semi")
    first = one_per_group(obs.select("osm_id", "prediction_time", "observation_id", "ref"), ["osm_id"],
                          ["observation_id"])
    negatives = observed_negatives(first)
    excluded = confirmed.unionByName(first.select("osm_id"))
    trunk = roads.where("highway = 'trunk'")
    drawn = corridor_draw(events, trunk, excluded, seed=seed).join(
        events.select("event_id", "event_date").distinct(), "event_id")
    corridor = drawn.select("event_id", "osm_id", "ref", F.date_sub("event_date", CORRIDOR_OFFSET).alias("prediction_time"),
                            F.lit(0).alias("label"), F.lit("corridor_negative").alias("sample_kind"),
                            F.lit("assumed_unaffected_real_pool").alias("label_source"))
    return concatenate(positive_samples(events, controls=True), negatives, corridor)


def exploratory_dataset(events: DataFrame, observations: DataFrame, roads: DataFrame, rain: DataFrame,
                        seed: int = 2026) -> DataFrame:
    return add_features(exploratory_samples(events, observations, roads, seed), roads, rain)


def static_dataset(events: DataFrame, roads: DataFrame, seed: int = 2026) -> DataFrame:
    """Static features of confirmed roads and capped trunk draws of their corridors."""
    confirmed = events.select("osm_id").distinct()
    pos = roads.join(confirmed, "osm_id", "left_semi").withColumn("is_affected", F.lit(1)).withColumn(
        "label_source", F.lit("real_confirmed"))
    turns = pos.select("ref", F.col("osm_id").alias("event_id"))
    drawn = corridor_draw(turns, roads.where("highway = 'trunk'"), confirmed, seed=seed).select("osm_id")
    neg = roads.join(drawn, "osm_id", "left_semi").withColumn("is_affected", F.lit(0)).withColumn(
        "label_source", F.lit("assumed_unaffected_real_pool"))
    ds = concatenate(pos, neg)
    return ds.select("osm_id", "ref", "highway", "district", "state", "elevation_m", "slope_degrees",
                     sc.highway_prior(F.col("highway")).alias("highway_prior"),
                     sc.bridge_flag_training(F.col("bridge")).alias("bridge_flag"), "is_affected", "label_source")


def design_matrix(rain: DataFrame, terrain: DataFrame, base: DataFrame, dates: Sequence[str], *,
                  road_sample: int | None = None, seed: int = 2026) -> DataFrame:
    """Roads x prediction dates with terrain and the latest earlier rainfall row.

    ``road_sample`` keeps that many roads in hash order.
    """
    roads = rain.select("osm_id").distinct()
    if road_sample is not None:
        roads = roads.orderBy(F.xxhash64("osm_id", F.lit(seed)), "osm_id").limit(road_sample)
    days = F.explode(F.array(*[F.lit(d).cast("date") for d in dates]))
    samples = join_static(roads.select("osm_id", days.alias("prediction_time")), terrain, ["osm_id"],
                          ["elevation_m", "slope_degrees"])
    out = asof_join(samples, rain, key="osm_id", on="prediction_time", time="feature_date", cols=RAINFALL)
    out = guard_no_future(out, "prediction_time", "feature_latest_ts")
    return join_static(out, base.select("osm_id", "state", "district").distinct(), ["osm_id"])


def proxy_dataset(roads: DataFrame) -> DataFrame:
    """Development table with the proxy score and its four classes."""
    score = sc.proxy_risk(F.col("highway"), F.col("bridge"), F.col("tunnel"), F.col("coverage_ratio"), F.col("tracktype"))
    return roads.select(
        "*", sc.highway_prior(F.col("highway")).alias("road_risk_prior"), F.round(score, 6).alias("risk_score")).withColumn(
        "risk_class", sc.risk_class(F.col("risk_score")))
