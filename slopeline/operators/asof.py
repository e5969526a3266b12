"""Point-in-time joins: the nearest earlier (or later) observation of the same key.

Both sides meet once, hashed on the key and a slice of its time. Keys with more rows than a window task should
sort have several slices (``ordered``); the nearest observation of other slices then comes from a carry table
with one row per key and slice, so a hot key is spread over its slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopeline.operators import ordered

DAY_SECONDS = 86_400
EPOCH = "1970-01-01 00:00:00"


def micros(value: Column) -> Column:
    """Microseconds since 1970 of a date or zone-less timestamp, in any session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), value.cast("timestamp_ntz"))


def time_slices(df: DataFrame, key: str, micro: str, slice_seconds: int | None = None) -> tuple[DataFrame, bool]:
    """Adds ``_slice`` and tells whether there may be more than one of them.

    Slices follow the density of the key's rows; equal times always share a slice.
    """
    if slice_seconds is not None:
        return df.withColumn("_slice", F.floor(F.col(micro) / (slice_seconds * 1_000_000))), True
    if ordered.is_small(df):
        return df.withColumn("_slice", F.lit(0)), False
    return ordered.with_slices(df, [key], [micro]), True


def unique_observations(obs: DataFrame, key: str, time: str, cols: Sequence[str],
                        seq: str | None = None) -> DataFrame:
    """One row per (key, time): the last by ``seq`` (or by value), as a partial aggregate.

    Observations without a key or time belong to nobody.
    """
    payload = F.struct(*cols)
    best = F.max_by(payload, F.col(seq)) if seq else F.max(payload)
    return (obs.where(F.col(time).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key), F.col(time).alias("_t"))
            .agg(best.alias("_o")))


def asof_join(samples: DataFrame, observations: DataFrame, *, key: str = "key", on: str = "p",
              time: str = "t", cols: Sequence[str], seq: str | None = None,
              direction: str = "backward", slice_seconds: int | None = None,
              found_time: str = "feature_latest_ts") -> DataFrame:
    """Keep every sample row and add the nearest observation with ``t <= on`` (or ``t >= on``).

    A sample without a key or time matches nothing.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be 'backward' or 'forward'")
    back = direction == "backward"
    obs = unique_observations(observations, key, time, cols, seq)
    left = samples.select(F.col(key).alias("_k"), micros(F.col(on)).alias("_m"),
                          F.struct(*samples.columns).alias("_row"))
    right = obs.select(F.col(key).alias("_k"), micros(F.col("_t")).alias("_m"),
                       F.struct(F.col("_t").alias("t"), F.col("_o").alias("o")).alias("_hit"))
    # at equal times an observation must be visible to the sample
    both = (right.withColumn("_side", F.lit(0 if back else 1))
            .unionByName(left.withColumn("_side", F.lit(1 if back else 0)), allowMissingColumns=True))
    both, sliced = time_slices(both, "_k", "_m", slice_seconds)
    w = Window.partitionBy("_k", "_slice").orderBy("_m", "_side")
    if back:
        local = F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        local = F.first("_hit", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    local = F.when(F.col("_m").isNotNull(), local)
    probed = both.withColumn("_h", local).where(F.col("_row").isNotNull())

    def output(df: DataFrame) -> DataFrame:
        return df.select("_row.*", *[F.col(f"_h.o.{c}").alias(c) for c in cols], F.col("_h.t").alias(found_time))

    if not sliced:
        return output(probed)
    pick = F.max_by if back else F.min_by
    edge = both.groupBy("_k", "_slice").agg(pick("_hit", F.when(F.col("_hit").isNotNull(),
                                                                F.col("_m"))).alias("_edge"))
    across = Window.partitionBy("_k").orderBy("_slice")
    if back:
        carried = F.last("_edge", ignorenulls=True).over(
            across.rowsBetween(Window.unboundedPreceding, -1))
    else:
        carried = F.first("_edge", ignorenulls=True).over(
            across.rowsBetween(1, Window.unboundedFollowing))
    carry = edge.select("_k", "_slice", carried.alias("_carry"))
    return output(probed.join(carry, ["_k", "_slice"], "left").withColumn(
        "_h", F.when(F.col("_m").isNotNull(), F.coalesce("_h", "_carry"))))


def forward_pin(samples: DataFrame, observations: DataFrame, *, key: str = "key", on: str = "p",
                time: str = "t", tolerance_days: int = 7, name: str = "pinned") -> DataFrame:
    """First observation date on or after each sample date, with the gap and whether it is allowed.

    Rows with ``pin_ok`` false are the error table of the caller.
    """
    seen = observations.select(key, F.col(time), F.lit(1).alias("_seen"))
    joined = asof_join(samples, seen, key=key, on=on, time=time, cols=["_seen"],
                       direction="forward", found_time=name).drop("_seen")
    gap = F.datediff(F.col(name), F.col(on))
    return joined.withColumn("gap_days", gap).withColumn(
        "pin_ok", F.coalesce(gap <= tolerance_days, F.lit(False)))


def leakage_rows(df: DataFrame, prediction: str, feature_time: str) -> DataFrame:
    """Rows whose features are newer than their prediction time; NULL means static and safe."""
    return df.where(F.col(feature_time) > F.col(prediction))


def guard_no_future(df: DataFrame, prediction: str, feature_time: str) -> DataFrame:
    """Fail the job at the first row whose features are newer than its prediction time."""
    bad = F.col(feature_time) > F.col(prediction)
    checked = F.when(bad, F.raise_error(F.lit("temporal leakage: a feature is newer than its sample")))
    # the check rides on the time column itself, so pruning cannot drop it
    return df.withColumn(feature_time, F.coalesce(checked.cast(df.schema[feature_time].dataType),
                                                  F.col(feature_time)))
