"""Filters and checks that compare a row with a list, a count or a small rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeline.functions.validate import CONFIRMED_REF, FIRST_EVENT_DAY, messages
from slopeline.schema import require_rows


def equals_ignoring_case(c: Column, value: str) -> Column:
    return F.upper(F.coalesce(c, F.lit(""))) == value.upper()


def rows_of(df: DataFrame, column: str, value: str) -> DataFrame:
    """The rows whose column equals a text, ignoring case; reading them fails when there is none."""
    return require_rows(df.where(equals_ignoring_case(F.col(column), value)), f"no row with {column} = {value!r}")


def in_classes(c: Column, classes: Sequence[str]) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).isin([x.lower() for x in classes])


def with_key_count(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Rows with the size of their key group; NULL for a NULL key.

    Counts are a partial aggregate joined back, so a hot key is never gathered in one task.
    """
    counts = df.dropna("any", subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    return df.join(counts, list(key), "left")


def confirmed_event_errors(df: DataFrame) -> DataFrame:
    """Problems of confirmed events; a road already used elsewhere is only a warning column."""
    counted = with_key_count(with_key_count(df, ["event_id"], "_ids"), ["osm_id"], "_roads")
    day = F.expr("try_to_date(event_date, 'yyyy-MM-dd')")
    rules = [(F.col("_ids") > 1, "event_id already exists"), (day.isNull(), "event_date is not an ISO date"),
             (day < F.lit(FIRST_EVENT_DAY).cast("date"), f"event_date is before {FIRST_EVENT_DAY}"),
             (~F.col("ref").rlike(CONFIRMED_REF), "ref is not a national or state highway")]
    return counted.select(*df.columns, messages(rules).alias("errors"),
                          (F.col("_roads") > 1).alias("repeated_road"))


def registry_errors(df: DataFrame, registry: str, entries: str, required: Sequence[str],
                    key: str = "source_id") -> DataFrame:
    """Problems of the entries nested in registry documents."""
    rows = df.select(registry, F.explode(entries).alias("entry")).withColumn(key, F.col(f"entry.{key}"))
    counted = with_key_count(rows, [registry, key], "_n")
    rules = [(F.col(key).isNull() | (F.trim(key) == ""), f"{key} is missing"),
             (F.col("_n") > 1, f"{key} is not unique")]
    rules += [(F.col(f"entry.{c}").isNull(), f"{c} is missing") for c in required]
    return counted.select(registry, "entry", messages(rules).alias("errors"))


def require_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key; a duplicate key fails the job instead of multiplying rows downstream."""
    rest = [c for c in df.columns if c not in key]
    one = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(*rest)).alias("_r"))
    ok = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"duplicate key in {list(key)}")).cast("boolean"))
    return one.where(F.coalesce(ok, F.lit(True))).select(*key, "_r.*")


def join_static(samples: DataFrame, static: DataFrame, key: Sequence[str],
                columns: Sequence[str] | None = None) -> DataFrame:
    """Left join of per-key attributes; AQE broadcasts them when they are small at run time."""
    side = static if columns is None else static.select(*key, *columns)
    return samples.join(require_unique(side, key), list(key), "left")


def replace_columns(df: DataFrame, fresh: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Take ``columns`` from ``fresh`` for every row; keys it lacks become NULL."""
    out = df.drop(*columns).join(require_unique(fresh.select(key, *columns), [key]), key, "left")
    return out.select(*df.columns)


def anti_join_nullsafe(df: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose composite key, NULLs included, is not among the known ones."""
    k = known.select(*[F.col(c).alias(f"_k_{c}") for c in key]).distinct()
    cond = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key]
    return df.join(k, cond, "left_anti")
