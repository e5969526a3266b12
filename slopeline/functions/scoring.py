"""Feature arithmetic, evidence scores, risk bands, calibration and confidence flags."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from slopeline.functions.geo import let
from slopeline.functions.text import has_all_groups, has_any, normalise
from slopeline.schema import finite

# Prior of each road class, and of any other class.
HIGHWAY_PRIOR = {
    "motorway": 0.05, "trunk": 0.10, "primary": 0.15, "secondary": 0.20,
    "tertiary": 0.25, "tertiary_link": 0.25, "secondary_link": 0.20,
    "primary_link": 0.15, "residential": 0.30, "living_street": 0.35,
    "service": 0.40, "unclassified": 0.45, "road": 0.45, "track": 0.60,
}
DEFAULT_PRIOR = 0.40
# Smallest denominator of the rain ratios.
RATIO_FLOOR = 0.01
# Band limits and freshness limits in hours.
HIGH_AT, LOW_BELOW = 0.7, 0.4
FRESH_HOURS, STALE_HOURS = 48, 168
# Road classes that count as evidence in a confirmation.
CONFIRMABLE = ["motorway", "trunk", "primary", "secondary", "tertiary", "unclassified",
               "residential", "service"]
MAJOR = ["trunk", "primary", "secondary", "tertiary"]
# Upper slope of each compass bin.
COMPASS = [(22.5, "N"), (67.5, "NE"), (112.5, "E"), (157.5, "SE"), (202.5, "S"), (247.5, "SW"),
           (292.5, "W"), (337.5, "NW")]


def safe_number(x: Column, default: float = 0.0) -> Column:
    v = x.try_cast("double") if hasattr(x, "try_cast") else x.cast("double")
    return F.when(finite(v), v).otherwise(F.lit(float(default)))


def to_number(x: Column) -> Column:
    """Number or NULL; malformed text, NaN and infinities are NULL."""
    v = x.try_cast("double")
    return F.when(finite(v), v)


def highway_prior(highway: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in HIGHWAY_PRIOR.items() for v in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.coalesce(highway, F.lit("")))),
                      F.lit(DEFAULT_PRIOR))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient with a floored denominator; an unknown denominator stays unknown."""
    return numerator / F.when(denominator.isNotNull(), F.greatest(denominator, F.lit(RATIO_FLOOR)))


def rain_features() -> list[Column]:
    r1, r3, r7, r14, r30 = [F.col(f"rainfall_{n}day") for n in (1, 3, 7, 14, 30)]
    return [ratio(r1, r7).alias("rain_intensity_1_vs_7"), ratio(r3, r14).alias("rain_intensity_3_vs_14"),
            ratio(r3, r7).alias("rain_concentration_3_in_7"), ratio(r1, r3).alias("rain_trend_1_vs_3"),
            ratio(r7, r30).alias("rain_cumul_ratio_7_vs_30")]


def interactions() -> list[Column]:
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    slope = z("slope_degrees")
    return [(slope * z("rainfall_7day")).alias("slope_x_rain7"),
            (slope * z("rainfall_30day")).alias("slope_x_rain30"),
            (z("elevation_m") * slope).alias("elev_x_slope")]


def terrain_known_training() -> Column:
    return F.col("elevation_m").isNotNull().cast("int")


def terrain_known_scoring() -> Column:
    return (F.col("elevation_m").isNotNull() & F.col("slope_degrees").isNotNull()).cast("int")


def bridge_flag_training(bridge: Column) -> Column:
    """1 unless the tag says 'no'; an absent tag counts as a bridge, as the training tables have it."""
    return (F.lower(F.coalesce(bridge, F.lit(""))) != "no").cast("int")


def yes_flag(tag: Column) -> Column:
    return F.lower(F.coalesce(tag, F.lit(""))).isin("yes", "true", "1").cast("int")


def proxy_risk(highway: Column, bridge: Column, tunnel: Column, coverage: Column,
               tracktype: Column) -> Column:
    score = (highway_prior(highway) + F.when(yes_flag(bridge) == 1, 0.10).otherwise(0.0)
             + F.when(yes_flag(tunnel) == 1, 0.05).otherwise(0.0)
             + F.when(coverage < 0.75, 0.10).otherwise(0.0)
             + F.when(tracktype.isNotNull(), 0.05).otherwise(0.0))
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def risk_class(score: Column) -> Column:
    return F.when(score < 0.25, 0).when(score < 0.40, 1).when(score < 0.55, 2).otherwise(3)


def aspect_category(aspect: Column) -> Column:
    out = F.when(aspect.isNull() | F.isnan(aspect), "NODATA").when(aspect >= 337.5, "N")
    for bound, label in COMPASS:
        out = out.when(aspect < bound, label)
    return out


def _points(*terms: tuple[Column, int]) -> Column:
    out = F.lit(0)
    for cond, n in terms:
        out = out + F.when(cond, n).otherwise(0)
    return out


def identity_score(name: Column, place_a: Sequence[str], place_b: Sequence[str]) -> Column:
    """Rank of candidate evidence: distances to both anchors and the corridor, class, naming."""
    text = normalise(name)
    in_a, in_b = has_any(text, place_a), has_any(text, place_b)
    strict_a = has_any(text, place_a[:1])
    return _points((F.col("near_both"), 5), (F.col("corridor_consistent"), 3), (F.col("near_a"), 2),
                   (F.col("near_b"), 2), (F.col("near_event"), 1), (F.col("plausible_highway"), 1),
                   (in_a, 4), (in_b, 4), (strict_a & in_b, 6))


def identity_score_review(name_match: Column) -> Column:
    """Evidence variant of the historical review."""
    return _points((F.col("near_event"), 1), (F.col("near_a"), 2), (F.col("near_b"), 2),
                   (F.col("corridor_consistent"), 2), (name_match, 5))


def review_status(name_match: Column) -> Column:
    return (F.when(F.col("near_both"), "BOTH_BRIDGE_CANDIDATE").when(name_match, "SOURCE_NAME_MATCH")
            .when(F.col("corridor_consistent"), "CORRIDOR_CANDIDATE").otherwise("OUTSIDE_REVIEW"))


def resolution_status(name_match: Column) -> Column:
    """A name match overrides a corridor candidate."""
    corridor = F.col("corridor_consistent") & F.col("plausible_highway")
    return (F.when(name_match, "SOURCE_NAME_MATCH_REQUIRES_REVIEW")
            .when(corridor, "CORRIDOR_CANDIDATE").otherwise("OUTSIDE_REVIEW"))


def two_place_match(name: Column, ref: Column, place_a: Sequence[str], place_b: Sequence[str]) -> Column:
    text = F.concat_ws(" ", normalise(name), normalise(ref))
    return has_all_groups(text, [place_a, place_b])


def confirmation_score(highway: Column, event_m: Column, bridge_m: Column) -> Column:
    cls = F.lower(F.trim(F.coalesce(highway, F.lit("")))).isin(CONFIRMABLE)
    return _points((cls, 1), (event_m <= 1000, 1), (bridge_m <= 250, 2), (bridge_m <= 100, 1))


def priority_score(named: Column, bridge_flag: Column, highway: Column, distance_m: Column) -> Column:
    return (F.when(named, 100.0).otherwise(0.0) + F.when(bridge_flag == 1, 50.0).otherwise(0.0)
            + F.when(highway.isin(MAJOR), 30.0).otherwise(0.0) - distance_m / 1000.0 * 10.0)


def risk_band(p: Column, high: float = HIGH_AT, low: float = LOW_BELOW) -> Column:
    return F.when(p >= high, "HIGH").when(p >= low, "MEDIUM").otherwise("LOW")


def decision(p: Column, threshold: Column | float) -> Column:
    return F.when(p >= threshold, "ALERT").otherwise("NO_ALERT")


def calibrate(p: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise-linear map in single precision, flat beyond the ends."""
    if len(xs) != len(ys) or not xs:
        raise ValueError("calibration needs as many x as y thresholds, at least one")
    f = lambda v: F.lit(float(v)).cast("float")
    if len(xs) == 1:
        return F.when(p.isNotNull(), f(ys[0])).cast("double")
    v = F.least(F.greatest(p.cast("float"), f(xs[0])), f(xs[-1]))
    x, y = np.asarray(xs, np.float32), np.asarray(ys, np.float32)
    rises = np.flatnonzero(x[1:] > x[:-1])
    if not len(rises):
        return F.when(p.isNotNull(), f(ys[0])).cast("double")
    # every step is rounded to single precision; the tables are literals, and a row finds its step by halving
    slope = (y[rises + 1] - y[rises]) / (x[rises + 1] - x[rises])
    table = {n: F.lit(a.tolist()).cast("array<float>") for n, a in (
        ("to", x[rises + 1]), ("x", x[rises]), ("y", y[rises]), ("slope", slope))}
    halvings = F.sequence(F.lit(1), F.lit(max(1, len(rises).bit_length())))

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        below = F.get(table["to"], middle) < span["v"]
        return F.struct(F.when(below, F.least(middle + 1, span["hi"])).otherwise(span["lo"]).alias("lo"),
                        F.when(below, span["hi"]).otherwise(middle).alias("hi"), span["v"].alias("v"))

    def read(v: Column) -> Column:
        start = F.struct(F.lit(0).alias("lo"), F.lit(len(rises) - 1).alias("hi"), v.alias("v"))
        return F.aggregate(halvings, start, halve, lambda span: F.when(v <= f(xs[0]), f(ys[0])).otherwise(
            F.get(table["slope"], span["lo"]) * (v - F.get(table["x"], span["lo"])) + F.get(table["y"], span["lo"])))

    return F.when(p.isNotNull(), let(v, read)).cast("double")


def age_hours(prediction: Column, observed: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", observed, prediction) / F.lit(3.6e9)


def freshness(prediction: Column, observed: Column) -> Column:
    h = age_hours(prediction, observed)
    return (F.when(observed.isNull(), "MISSING_METADATA").when(h < 0, "INVALID_FUTURE_OBSERVATION")
            .when(h <= FRESH_HOURS, "FRESH").when(h <= STALE_HOURS, "STALE").otherwise("EXPIRED"))


def confidence_flags(freshness_status: Column, n_ood: Column, terrain_known: Column) -> Column:
    return F.array_compact(F.array(
        F.when(freshness_status == "MISSING_METADATA", "WEATHER_FRESHNESS_UNKNOWN")
        .when(freshness_status != "FRESH", F.concat(F.lit("WEATHER_"), freshness_status)),
        F.when(n_ood > 0, "OUT_OF_DISTRIBUTION"), F.when(terrain_known == 0, "MISSING_TERRAIN")))


def ood_features(profile: dict[str, tuple[float | None, float | None]]) -> Column:
    """Sorted names of the features outside their profile bounds (bounds are model constants)."""
    bad = [F.when(finite(F.col(n)) & ~F.col(n).between(lo, hi), n)
           for n, (lo, hi) in sorted(profile.items()) if lo is not None and hi is not None]
    return F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")


def top_factors(factors: Column, n: int = 5) -> Column:
    """First n contributions by absolute size, equal sizes in input order."""
    tagged = F.transform(factors, lambda f, i: F.struct(
        (-F.abs(f["contribution"])).alias("o"), i.alias("i"), f.alias("f")))
    return F.slice(F.transform(F.array_sort(tagged), lambda x: x["f"]), 1, n)


def contribution_records(names: Sequence[str], values: Sequence[Column],
                         contributions: Sequence[Column]) -> Column:
    return F.array(*[
        F.struct(F.lit(n).alias("feature"), F.round(v, 6).alias("value"),
                 F.round(c, 6).alias("contribution")) for n, v, c in zip(names, values, contributions)])


def sorted_map_json(m: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def neighbour_slope(elevations: Column, metres: float = 100.0) -> Column:
    """Slope from the spread of at least two known neighbour elevations."""
    known = F.array_compact(elevations)
    spread = F.array_max(known) - F.array_min(known)
    return F.when(F.size(known) >= 2, F.degrees(F.atan(spread / metres)))
