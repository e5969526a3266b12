"""Unions, differences and idempotent appends by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeline.operators.lookup import anti_join_nullsafe
from slopeline.operators.ordered import one_per_group


def concatenate(*tables: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side is NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def append_if_absent(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Existing rows plus incoming rows whose key is new; of repeats inside incoming the smallest row stays."""
    key = list(key)
    rest = [c for c in incoming.columns if c not in key]
    once = one_per_group(incoming, key, rest) if rest else incoming.distinct()
    fresh = anti_join_nullsafe(once, existing, key)
    return concatenate(existing, fresh)


def reissue(existing: DataFrame, incoming: DataFrame, key: Sequence[str], legacy: Column) -> DataFrame:
    """Drop legacy rows whose content comes again under a new id, then add the unseen incoming rows."""
    issued = incoming.select(*[F.col(c).alias(f"_k_{c}") for c in key]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key]
    current = existing.where(~F.coalesce(legacy, F.lit(False)))
    # only legacy rows are looked up; all others pass without a join
    old = existing.where(F.coalesce(legacy, F.lit(False))).join(issued, same, "left_anti")
    kept = current.unionByName(old)
    return concatenate(kept, anti_join_nullsafe(incoming, kept, key))


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def key_intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_semi")
