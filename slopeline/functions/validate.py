"""Row validators that return every violated rule as an array of messages."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopeline.functions.scoring import HIGHWAY_PRIOR
from slopeline.schema import finite

RAINFALL = [f"rainfall_{n}day" for n in (1, 3, 7, 14, 30)]
# Physical bounds of scoring inputs.
MAX_RAINFALL_MM = 10000
ELEVATION_RANGE = (-500, 9000)
SLOPE_RANGE = (0, 90)
MAX_DAYS = 30
# The largest finite double.
MAX_NUMBER = sys.float_info.max
# Fields a scoring request may carry.
METADATA = ["osm_id", "road_segment_id", "latitude", "longitude", "highway", "road_type", "category",
            "highway_prior", "bridge_flag", "rainfall_days_available"]
DERIVED = ["terrain_known", "rain_intensity_1_vs_7", "rain_intensity_3_vs_14", "rain_concentration_3_in_7",
           "rain_trend_1_vs_3", "rain_cumul_ratio_7_vs_30", "slope_x_rain7", "slope_x_rain30",
           "elev_x_slope", "month", "seasonal_sin", "seasonal_cos", "monsoon_active", "days_into_monsoon"]
ROAD_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
# Road references accepted for a confirmed event, and the first accepted day.
CONFIRMED_REF = r"(?i)^(NH|SH|NH\s|SH\s)\d+[A-Z]?$"
FIRST_EVENT_DAY = "2017-01-01"
# Bounds, types and states of a collected event entry.
LAT_RANGE, LON_RANGE = (21.0, 30.0), (88.0, 98.0)
EVENT_TYPES = ["landslide", "flood", "earthquake", "cyclone"]

Rule = tuple[Column, str]


def messages(rules: Sequence[Rule]) -> Column:
    """Messages of all rules whose condition holds (an unknown condition does not hold)."""
    return F.array_compact(F.array(*[F.when(cond, msg) for cond, msg in rules]))


def road_id_ok(x: Column) -> Column:
    v = F.trim(x.cast("string"))
    return F.coalesce((F.lower(v) != "unknown") & v.rlike(ROAD_ID), F.lit(False))


def unknown_fields(columns: Sequence[str]) -> list[str]:
    allowed = {*RAINFALL, "elevation_m", "slope_degrees", *METADATA, *DERIVED}
    return sorted(set(columns) - allowed)


def scoring_rules(columns: Sequence[str], metadata: bool = True) -> list[Rule]:
    """Rules for the columns of a scoring table; ``metadata=False`` is the narrower request form."""
    rules: list[Rule] = []
    number = lambda c: c.try_cast("double")  # noqa: E731  fields may arrive as text
    extra = unknown_fields(columns)
    if extra:
        rules.append((F.lit(True), f"unknown input fields: {extra}"))
    bounds = {"latitude": 90, "longitude": 180}
    for name, limit in bounds.items():
        if metadata and name in columns:
            c = F.col(name)
            rules.append((~finite(c), f"{name} must be a finite scalar"))
            rules.append((finite(c) & (F.abs(number(c)) > limit), f"{name} must be between -{limit} and {limit}"))
    for name in ("highway", "road_type", "category"):
        if metadata and name in columns:
            v = F.lower(F.trim(F.col(name)))
            rules.append((F.col(name).isNotNull() & ~v.isin(list(HIGHWAY_PRIOR)),
                          f"{name} is not a supported road category"))
    for name in RAINFALL:
        c = F.col(name)
        rules.append((~finite(c), f"{name} is required and must be finite"))
        rules.append((finite(c) & (number(c) < 0), f"{name} cannot be negative"))
        rules.append((finite(c) & (number(c) > MAX_RAINFALL_MM),
                      f"{name} exceeds the supported physical maximum of {MAX_RAINFALL_MM} mm"))
    for name in ("elevation_m", "slope_degrees"):
        c = F.col(name)
        rules.append((c.isNotNull() & ~finite(c), f"{name} must be finite or null"))
    slope, elev = F.col("slope_degrees"), F.col("elevation_m")
    rules.append((finite(slope) & ~number(slope).between(*SLOPE_RANGE), "slope_degrees must be between 0 and 90"))
    rules.append((finite(elev) & ~number(elev).between(*ELEVATION_RANGE),
                  "elevation_m is outside the supported physical range"))
    for name in ("highway_prior", "bridge_flag", "rainfall_days_available"):
        if name in columns:
            c = F.col(name)
            rules.append((c.isNotNull() & ~finite(c), f"{name} must be finite or null"))
            rules.append((finite(c) & (number(c) < 0), f"{name} cannot be negative"))
    if "rainfall_days_available" in columns:
        c = F.col("rainfall_days_available")
        rules.append((finite(c) & (number(c) > MAX_DAYS), "rainfall_days_available must be between 0 and 30"))
    return rules


def scoring_errors(df: DataFrame, ignore: Sequence[str] = (), metadata: bool = True) -> Column:
    """All messages of a row; columns in ``ignore`` are bookkeeping, not inputs."""
    return messages(scoring_rules([c for c in df.columns if c not in ignore], metadata))


def scoring_valid(df: DataFrame, ignore: Sequence[str] = (), metadata: bool = True, nan_is_null: bool = False) -> Column:
    """Whether a row breaks no rule of ``scoring_errors``; never NULL. ``nan_is_null``: as after ``nan_to_null``.

    One comparison for each column: an unknown or NaN value lies in no range. The messages of all rules, under a filter that
    Spark moves down to where the columns are computed, are more code than the JVM compiles.
    """
    columns = [c for c in df.columns if c not in ignore]
    within = lambda c, lo, hi: F.coalesce(F.col(c).try_cast("double").between(lo, hi), F.lit(False))
    fractional = {f.name for f in df.schema.fields if nan_is_null and isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    absent = lambda c: F.col(c).isNull() | F.isnan(c) if c in fractional else F.col(c).isNull()
    rules = [F.lit(not unknown_fields(columns))]
    if metadata:
        rules += [within(c, -limit, limit) for c, limit in (("latitude", 90), ("longitude", 180)) if c in columns]
        rules += [absent(c) | F.lower(F.trim(F.col(c))).isin(list(HIGHWAY_PRIOR)) for c in ("highway", "road_type", "category") if c in columns]
    rules += [within(c, 0, MAX_RAINFALL_MM) for c in RAINFALL]
    rules += [absent(c) | within(c, *span) for c, span in (("slope_degrees", SLOPE_RANGE), ("elevation_m", ELEVATION_RANGE))]
    rules += [absent(c) | within(c, 0, MAX_DAYS if c == "rainfall_days_available" else MAX_NUMBER)
              for c in ("highway_prior", "bridge_flag", "rainfall_days_available") if c in columns]
    return reduce(and_, rules)


def event_entry_errors(states: Sequence[str], types: Sequence[str] = EVENT_TYPES) -> Column:
    """Problems of a collected event whose fields arrive as text."""
    required = ["event_id", "event_date", "event_type", "state", "location_name", "latitude", "longitude",
                "source"]
    rules: list[Rule] = [(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", f"Missing required field: {c}")
                         for c in required]
    day = F.col("event_date")
    rules.append((day.isNotNull() & F.expr("try_to_date(event_date, 'yyyy-MM-dd')").isNull(),
                  "event_date must be in YYYY-MM-DD format"))
    for name, (lo, hi) in (("latitude", LAT_RANGE), ("longitude", LON_RANGE)):
        v = F.col(name).try_cast("double")
        rules.append((F.col(name).isNotNull() & v.isNull(), f"{name} must be numeric"))
        rules.append((v.isNotNull() & ~v.between(lo, hi), f"{name} outside {lo:g}-{hi:g}"))
    rules.append((F.col("state").isNotNull() & ~F.col("state").isin(list(states)), "state is not listed"))
    rules.append((F.col("event_type").isNotNull() & ~F.col("event_type").isin(list(types)),
                  f"event_type must be one of: {list(types)}"))
    return messages(rules)
