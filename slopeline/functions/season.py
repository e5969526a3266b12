"""Calendar features of a prediction date; all depend on the date alone."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def season(d: Column) -> Column:
    m = F.month(d)
    return (F.when(m.between(6, 9), "monsoon").when(m.between(3, 5), "pre_monsoon")
            .when(m >= 10, "post_monsoon").otherwise("winter"))


def season_ordinal(d: Column) -> Column:
    m = F.month(d)
    return (F.when(m.between(6, 9), 3).when(m.between(3, 5), 2).when(m >= 10, 4).otherwise(1))


def monsoon_active(d: Column) -> Column:
    return F.month(d).between(6, 9).cast("int")


def pre_monsoon(d: Column) -> Column:
    return F.month(d).between(3, 5).cast("int")


def _phase(d: Column) -> Column:
    # the first day of the year is phase zero
    return F.lit(2 * math.pi) * (F.dayofyear(d) - 1) / F.lit(365.0)


def seasonal_sin(d: Column) -> Column:
    return F.sin(_phase(d))


def seasonal_cos(d: Column) -> Column:
    return F.cos(_phase(d))


def days_into_monsoon(d: Column) -> Column:
    """Days since June 1 on one leap calendar, so that equal calendar days agree in every year."""
    return F.datediff(F.make_date(F.lit(2000), F.month(d), F.dayofmonth(d)),
                      F.lit("2000-06-01").cast("date"))


def seasonal_features(d: Column) -> list[Column]:
    return [F.month(d).alias("month"), seasonal_sin(d).alias("seasonal_sin"),
            seasonal_cos(d).alias("seasonal_cos"), monsoon_active(d).alias("monsoon_active"),
            days_into_monsoon(d).alias("days_into_monsoon")]


def window_end(prediction: Column, horizon_days: int = 7) -> Column:
    return F.date_add(prediction, horizon_days)
