"""Trailing calendar windows over daily series, and anchored features (no day leaks forward)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopeline.session import dealt

# The window lengths in days.
WINDOWS = (1, 3, 7, 14, 30)
LOOKBACK_DAYS = 30


def clean_reading(value: Column) -> Column:
    """Sentinel mask: a negative reading is unknown, a valid zero stays zero."""
    return F.when(value >= 0, value)


def _day_number(c: str) -> Column:
    return F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))


def trailing_features(daily: DataFrame, anchors: DataFrame | None = None, *, key: str = "key",
                      day: str = "d", value: str = "v", anchor: str = "p",
                      windows: Sequence[int] = WINDOWS, lookback: int | None = None,
                      prefix: str = "rainfall_", partial_prefix: str | None = None,
                      require_lookback: bool = False) -> DataFrame:
    """Sums over days [-W, -1] before each anchor, per key.

    ``prefix`` columns are strict: NULL when a present day of the window has no value or when no
    day is present. ``partial_prefix`` columns (optional) sum the known days and are NULL only when
    none is known. Without ``anchors`` every observed day is its own anchor. A day without a row is
    absent, not unknown. ``rainfall_days_available`` counts known days of the lookback.

    Series are cut into blocks of days, each with a halo of the preceding lookback, so a window
    task holds at most two blocks of one key however hot the key is; one shuffle on (key, block)
    serves all windows, and the five frames share one sort. The tasks' number follows the input.
    """
    lookback = lookback or max(max(windows), LOOKBACK_DAYS)
    block = max(lookback, 64)
    obs = (daily.groupBy(F.col(key), F.col(day).alias("_d"))
           .agg(F.sum(value).alias("_v"), F.count(value).alias("_known"),
                F.count(F.lit(1)).alias("_present")))
    n = _day_number("_d")
    home = F.floor(n / block)
    reach = F.floor((n + lookback) / block)
    obs = obs.select(key, "_d", "_v", "_known", "_present", n.alias("_n"),
                     F.explode(F.when(reach > home, F.array(home, reach))
                               .otherwise(F.array(home))).alias("_block"), home.alias("_home"))
    if anchors is None:
        rows = obs.withColumn("_is_anchor", F.col("_block") == F.col("_home"))
    else:
        wanted = anchors.select(key, F.col(anchor).alias("_d")).distinct()
        wanted = wanted.withColumn("_n", _day_number("_d"))
        wanted = wanted.withColumn("_block", F.floor(F.col("_n") / block)).withColumn(
            "_is_anchor", F.lit(True))
        rows = obs.withColumn("_is_anchor", F.lit(False)).unionByName(
            wanted, allowMissingColumns=True)
    rows = dealt(rows, key, "_block")
    order = Window.partitionBy(key, "_block").orderBy("_n")
    out = []
    for w in windows:
        frame = order.rangeBetween(-w, -1)
        total, known = F.sum("_v").over(frame), F.sum("_known").over(frame)
        present = F.sum("_present").over(frame)
        out.append(F.when(known == present, total).alias(f"{prefix}{w}day"))
        if partial_prefix is not None:
            out.append(total.alias(f"{partial_prefix}{w}day"))
    look = order.rangeBetween(-lookback, -1)
    out.append(F.coalesce(F.sum("_known").over(look), F.lit(0)).alias("rainfall_days_available"))
    out.append(F.sum("_present").over(look).alias("_lookback_rows"))
    result = rows.select(key, F.col("_d").alias(anchor), "_is_anchor", *out).where("_is_anchor")
    if require_lookback:
        result = result.where(F.col("_lookback_rows") > 0)
    return result.drop("_is_anchor", "_lookback_rows")


def lookback_dates(anchors: DataFrame, anchor: str = "p", days: int = LOOKBACK_DAYS) -> DataFrame:
    """Distinct calendar days needed to compute the features of all anchors."""
    return (anchors.select(F.col(anchor)).distinct()
            .select(F.explode(F.sequence(F.date_sub(anchor, days), F.date_sub(anchor, 1))).alias("d"))
            .distinct())
