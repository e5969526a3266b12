"""Missingness strategies and coverage gates; NULL means unknown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("drop_any", "drop_all", "native", "flag", "native_flag", "impute_in_group")


def long_form(df: DataFrame, keep: Sequence[str], columns: Sequence[str], value: str = "value",
              name: str = "feature") -> DataFrame:
    """One row per (row, column) with the value as double; text that is no number is unknown."""
    items = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).try_cast("double").alias(value))
                      for c in columns])
    return df.select(*keep, F.explode(items).alias("_i")).select(*keep, f"_i.{name}", f"_i.{value}")


def _stack(aggregated: DataFrame, keep: Sequence[str], columns: Sequence[str],
           parts: Sequence[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{p}_{c}").alias(p) for p in parts])
                      for c in columns])
    return aggregated.select(*keep, F.explode(items).alias("_i")).select(*keep, "_i.*")


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, missing_rate: one aggregate over the table, then one row per column."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(f"missing_rate_{c}") for c in columns])
    return _stack(one, [], columns, ["missing_rate"])


def coverage_by_group(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Observed rate per group and feature; rows without a group are left out."""
    per = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n_group"), *[F.count(c).alias(f"n_obs_{c}") for c in columns])
    out = _stack(per, [group, "n_group"], columns, ["n_obs"])
    return out.select(F.col(group).alias("group"), "feature",
                      (F.col("n_obs") / F.col("n_group")).alias("observed_rate"), "n_obs", "n_group")


def testable_groups(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Groups with at least one value for every feature."""
    return (df.where(F.col(group).isNotNull()).groupBy(group)
            .agg(F.least(*[F.count(c) for c in columns], F.lit(1).cast("bigint")).alias("_seen"))
            .where("_seen > 0").select(group))


def apply_strategy(df: DataFrame, columns: Sequence[str], strategy: str, group: str | None = None,
                   flag_prefix: str = "is_missing") -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown missingness strategy {strategy!r}")
    if strategy == "drop_any":
        return df.dropna("any", subset=list(columns))
    if strategy == "drop_all":
        return df.dropna("all", subset=list(columns))
    if strategy == "native":
        return df
    if strategy in ("flag", "native_flag"):
        return df.select("*", *[F.col(c).isNull().cast("int").alias(f"{flag_prefix}_{c}") for c in columns])
    if group is None or group not in df.columns:
        raise ValueError("impute_in_group needs the group column")
    # means are a partial aggregate joined back; a window would put a whole group into one task
    means = df.groupBy(F.col(group).alias("_g")).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    joined = df.join(means, F.col(group) == F.col("_g"), "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_mean_{c}")).alias(c) if c in columns else F.col(c)
                           for c in df.columns])


def retention(before: DataFrame, after: DataFrame) -> DataFrame:
    n = before.agg(F.count(F.lit(1)).alias("original_rows"))
    m = after.agg(F.count(F.lit(1)).alias("retained_rows"))
    # two single-row aggregates
    return n.join(m).withColumn("retention_rate", F.when(
        F.col("original_rows") > 0, F.col("retained_rows") / F.col("original_rows")).otherwise(0.0))
