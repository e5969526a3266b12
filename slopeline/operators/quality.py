"""Table profiles, value counts, dataset checks and audits, each as few aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopeline.functions.validate import RAINFALL
from slopeline.operators.missing import long_form
from slopeline.operators.ordered import exact_quantiles
from slopeline.schema import finite, require_columns

# Label sources admitted to production training.
POSITIVE_SOURCE = "real_confirmed_temporal"
NEGATIVE_SOURCE = "real_observed_unaffected"
ALLOWED_NEGATIVE = ["source_confirmed_unaffected", "real_observed_unaffected"]
ASSUMED_NEGATIVE = "assumed_unaffected_real_pool"
CONFIRMED_PATTERN = r"(?i)confirmed_unaffected|real_observed_unaffected"


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def table_profile(df: DataFrame) -> DataFrame:
    """column, type, rows and NULL count per column, from one aggregate."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c.replace('`', '``')}`")).alias(f"k_{i}")
                                                 for i, c in enumerate(df.columns)])
    items = F.array(*[F.struct(F.lit(f.name).alias("column_name"),
                               F.lit(f.dataType.simpleString()).alias("data_type"),
                               F.col("n").alias("row_count"),
                               (F.col("n") - F.col(f"k_{i}")).alias("null_count"))
                      for i, f in enumerate(df.schema.fields)])
    return one.select(F.explode(items).alias("i")).select("i.*")


def value_counts(df: DataFrame, column: str, include_null: bool = False) -> DataFrame:
    kept = df if include_null else df.where(F.col(column).isNotNull())
    return kept.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, label: str, classes: Sequence) -> DataFrame:
    """Count and percentage of every listed class, zeros included."""
    one = df.agg(*[count_if(F.col(label) == c).alias(f"n_{i}") for i, c in enumerate(classes)],
                 F.count(F.lit(1)).alias("total"))
    items = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"n_{i}").alias("n"),
                               F.when(F.col("total") > 0, F.lit(100.0) * F.col(f"n_{i}") / F.col("total"))
                               .alias("percent")) for i, c in enumerate(classes)])
    return one.select(F.explode(items).alias("i")).select("i.*")


def null_report(df: DataFrame) -> DataFrame:
    """Columns that have NULLs, most first."""
    return (table_profile(df).where("null_count > 0").select("column_name", "null_count")
            .orderBy(F.desc("null_count"), "column_name"))


def feature_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """missing_rate, min, p01, p99, max per feature; quantiles are exact and linear."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    rates = long_form(rates, [], columns, "missing_rate")
    values = long_form(df, [], columns).where(finite(F.col("value")))
    q = exact_quantiles(values, ["feature"], "value", {"min": 0.0, "p01": 0.01, "p99": 0.99, "max": 1.0})
    return rates.join(q, "feature", "left")


def describe_by(df: DataFrame, group: str, column: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a column per group."""
    base = df.groupBy(group).agg(F.count(column).alias("n"), F.avg(column).alias("mean"),
                                 F.stddev_samp(column).alias("std"), F.min(column).alias("min"),
                                 F.max(column).alias("max"))
    q = exact_quantiles(df.select(group, column), [group], column, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return base.join(q, group, "left")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of rows beyond the first of each key."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows")))


def dataset_errors(df: DataFrame, sources: Sequence[str] | None = None) -> DataFrame:
    """One row: every violated dataset rule in ``errors`` (empty when the dataset is valid)."""
    key = ["event_id", "osm_id", "prediction_time"]
    require_columns(df, [*key, "label", "slope_degrees", *RAINFALL], "dataset")
    bad_source = ~F.coalesce(F.col("label_source").isin(list(sources)), F.lit(False)) if sources is not None else None
    per_key = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(F.col("label").isNotNull() & ~F.col("label").isin(0, 1)).alias("bad_label"),
        count_if(F.least(*[F.col(c) for c in RAINFALL]) < 0).alias("bad_rain"),
        count_if((F.col("slope_degrees") < 0) | (F.col("slope_degrees") > 90)).alias("bad_slope"))
    total = per_key.agg(
        count_if(F.greatest(*[F.col(c).isNull() for c in key])).alias("null_key"),
        count_if(F.col("n") > 1).alias("dup"), F.sum("bad_label").alias("bad_label"),
        F.sum("bad_rain").alias("bad_rain"), F.sum("bad_slope").alias("bad_slope"))
    rules = [("null_key", "sample identity contains null values"),
             ("dup", "duplicate event/road/prediction samples detected"),
             ("bad_label", "labels must be binary"), ("bad_rain", "negative rainfall values detected"),
             ("bad_slope", "slope outside [0, 90] degrees")]
    out = [F.when(F.col(c) > 0, m) for c, m in rules]
    if sources is not None:
        # one name per source reaches the message; two single-row tables
        names = df.where(bad_source).groupBy(F.coalesce(F.col("label_source"), F.lit("null")).alias("s")).count()
        total = total.join(names.agg(F.array_sort(F.collect_list("s")).alias("bad_sources")))
        out.append(F.when(F.size("bad_sources") > 0, F.concat(
            F.lit("unsupported label_source values: "), F.array_join("bad_sources", ", "))))
    return total.select(F.array_compact(F.array(*out)).alias("errors"))


def label_source_counts(df: DataFrame) -> DataFrame:
    """Assumed and confirmed negatives, and the confirmed share."""
    neg = F.col("label") == 0
    confirmed = count_if(neg & F.col("label_source").rlike(CONFIRMED_PATTERN))
    return df.agg(count_if(neg).alias("negatives"),
                  count_if(neg & (F.col("label_source") == ASSUMED_NEGATIVE)).alias("assumed_negatives"),
                  confirmed.alias("confirmed_negatives"),
                  F.when(count_if(neg) > 0, confirmed / count_if(neg)).alias("confirmed_fraction"))


def negative_label_gate(df: DataFrame) -> DataFrame:
    """FAIL when any negative comes from an inadmissible source."""
    bad = count_if((F.col("label") == 0) & ~F.coalesce(F.col("label_source").isin(ALLOWED_NEGATIVE),
                                                       F.lit(False)))
    return df.agg(bad.alias("inadmissible_negatives"),
                  count_if((F.col("label") == 0) & (F.col("label_source") == ASSUMED_NEGATIVE))
                  .alias("assumed_negatives")).withColumn(
        "status", F.when(F.col("inadmissible_negatives") > 0, "FAIL").otherwise("PASS"))


def observation_quality(df: DataFrame, scope: str = "observation_scope",
                        status: str = "observation_status") -> DataFrame:
    """Rows by scope and status quality of observed negatives."""
    return df.agg(count_if(F.lower(scope).contains("corridor")).alias("corridor_only_rows"),
                  count_if(F.lower(scope).contains("segment")).alias("segment_rows"),
                  count_if(F.lower(status).rlike("clear|reopen")).alias("clearance_or_reopening_rows"))


def audit_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("samples"), F.countDistinct("event_id").alias("events"),
        F.countDistinct("osm_id").alias("roads"), F.countDistinct("state").alias("states"),
        F.countDistinct("ref").alias("corridors"), count_if(F.col("label") == 1).alias("positives"),
        count_if(F.col("label") == 0).alias("negatives"))


def sample_kind_violations(df: DataFrame, events: DataFrame, horizon_days: int = 7) -> DataFrame:
    """Positives outside the horizon, controls inside it, samples of unknown events."""
    ev = events.select("event_id", F.col("event_date").alias("_ed"))
    j = df.where(F.coalesce(F.col("sample_kind") != "observed_open_negative", F.lit(True))).join(
        ev, "event_id", "left")
    end = F.date_add("prediction_time", horizon_days)
    reason = (F.when(F.col("_ed").isNull(), "event date unavailable")
              .when((F.col("sample_kind") == "positive")
                    & ~((F.col("prediction_time") < F.col("_ed")) & (F.col("_ed") <= end)),
                    "positive event outside future horizon")
              .when((F.col("sample_kind") == "same_road_control") & (F.col("_ed") <= end),
                    "known event falls inside negative horizon"))
    return j.withColumn("reason", reason).where("reason IS NOT NULL").select(
        "event_id", "prediction_time", "sample_kind", "reason")


def geometry_qa(df: DataFrame, coords: str = "coords") -> DataFrame:
    c = F.col(coords)
    broken = F.exists(c, lambda p: p["lon"].isNull() | p["lat"].isNull() | F.isnan(p["lon"])
                      | F.isnan(p["lat"]))
    out = df.agg(F.count(F.lit(1)).alias("rows"), count_if(c.isNull()).alias("null_geometries"),
                 count_if(F.size(c) == 0).alias("empty_geometries"),
                 count_if(c.isNotNull() & ((F.size(c) == 1) | broken)).alias("invalid_geometries"))
    bad = F.col("null_geometries") + F.col("empty_geometries") + F.col("invalid_geometries")
    return out.withColumn("status", F.when(bad > 0, "FAIL").otherwise("PASS"))


# Normalised column names that play each role.
COLUMN_ROLES = {
    "date": ["date", "event_date", "incident_date", "occurrence_date", "occurred_at", "timestamp",
             "datetime", "event_datetime", "start_date", "end_date", "year"],
    "latitude": ["lat", "latitude", "y", "y_coord", "lat_dd"],
    "longitude": ["lon", "lng", "longitude", "x", "x_coord", "lon_dd"],
    "event_type": ["event_type", "incident_type", "hazard_type", "hazard", "type", "landslide_type"],
    "severity": ["severity", "severity_level", "damage_level", "impact", "magnitude"],
}


def column_roles(df: DataFrame) -> DataFrame:
    """Roles of each column by its normalised name, read from the schema alone."""
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in df.columns], "column_name string")
    norm = F.translate(F.translate(F.lower(F.trim("column_name")), " -/.", "____"), "()", "")
    role = None
    for r, words in COLUMN_ROLES.items():
        cond = F.col("normalised").isin(words)
        role = F.when(cond, r) if role is None else role.when(cond, r)
    return names.withColumn("normalised", norm).withColumn("role", role)


def label_readiness(roles: DataFrame, has_geometry: bool = False) -> DataFrame:
    def has(r):
        return F.coalesce(F.bool_or(F.col("role") == r), F.lit(False))
    geo = F.lit(has_geometry) | (has("latitude") & has("longitude"))
    return roles.agg(geo.alias("geometry_available"), has("date").alias("event_date_available"),
                     has("event_type").alias("event_type_available"),
                     has("severity").alias("severity_available"),
                     geo.alias("ready_for_road_mapping"),
                     (geo & has("date")).alias("ready_for_training_labels"))


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
