"""Plan-time schema contracts and NULL conventions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, columns: Iterable[str], context: str = "table") -> DataFrame:
    """Fail before any job runs when a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{context}: required columns are missing: {missing}")
    return df


def forbid_columns(df: DataFrame, columns: Iterable[str], context: str = "feature table") -> DataFrame:
    """Fail before any job runs when a leakage column is present."""
    present = sorted(set(columns) & set(df.columns))
    if present:
        raise ValueError(f"{context}: columns would leak the target: {present}")
    return df


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN is ordinary data in Spark; unknown is always NULL here."""
    chosen = set(columns) if columns is not None else {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns
    ])


def finite(value: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite; text that is no number is not."""
    v = value.try_cast("double")
    return F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """``df``, failing the job that reads it with ``message`` when it has no row.

    The check is a branch of the same plan, a count that yields no row or the error, so nothing runs before.
    """
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    failed = n.where(F.when(F.col("_n") == 0, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(False)))
    return df.unionByName(failed.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))
