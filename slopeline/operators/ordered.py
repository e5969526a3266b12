"""Running sums, ranks, quantiles over an order, without one task per group.

A plain ``Window.partitionBy(group)`` sends a whole group to one task, so a group holding a third of the rows
stalls the job. Groups are therefore cut into slices of their own order. One row in ``PICK_ONE_IN``, chosen by
the hash of its order key, is gathered per group; every ``PICKS_PER_SLICE``-th of them in order is a bound, so
slices hold about two million rows whatever the size of the group, and most groups have no bound at all.
Windows run inside ``(group, slice)``; the totals of earlier slices, one row per slice, are added by a join on
the same key. The choice is a function of the rows, so every reading of the plan cuts alike, and all of it is part of the
plan: building a query runs no job. Inputs too small for a hot group keep the plain window, with the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopeline.session import input_bytes

# One order item: a column name, or (column name, ascending).
OrderItem = str | tuple[str, bool]

# One row in so many is a candidate bound; so many candidates make a slice.
PICK_ONE_IN = 65_536
PICKS_PER_SLICE = 32
# Bounds are searched in stretches of so many.
STRETCH = 128
# Inputs of so many bytes hold no group that a window task could not sort.
SMALL_BYTES = 64 << 20


def _items(order: Sequence[OrderItem]) -> list[tuple[str, bool]]:
    return [(o, True) if isinstance(o, str) else o for o in order]


def _values(df: DataFrame, order: Sequence[OrderItem]) -> list[tuple[Column, bool]]:
    """Sort values in which every unknown (NULL or NaN) is NULL."""
    def known(c: str) -> Column:
        fractional = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
        return F.when(~F.isnan(c), F.col(c)) if fractional else F.col(c)
    return [(known(c), asc) for c, asc in _items(order)]


def sort_columns(df: DataFrame, order: Sequence[OrderItem]) -> list[Column]:
    """Unknown values come last, whatever the direction."""
    return [v.asc_nulls_last() if asc else v.desc_nulls_last() for v, asc in _values(df, order)]


def is_small(df: DataFrame) -> bool:
    """Whether the tables below ``df`` are too small for a hot group; reads their sizes only."""
    return input_bytes(df) <= SMALL_BYTES


def _compared(left: Column, right: Column, directions: Sequence[bool]) -> Column:
    """-1, 0 or 1: the order of two key structs, unknown fields last."""
    result = F.lit(0)
    for i, asc in reversed(list(enumerate(directions))):
        a, b = left[f"k{i}"], right[f"k{i}"]
        less = -1 if asc else 1
        result = (F.when(a.isNull() & b.isNull(), result).when(a.isNull(), 1).when(b.isNull(), -1)
                  .when(a < b, less).when(a > b, -less).otherwise(result))
    return result


def slice_bounds(df: DataFrame, by: Sequence[str], order: Sequence[OrderItem]) -> DataFrame:
    """``_b_<key>``, ``__bounds`` and ``__coarse``: the cuts of every group large enough to have one.

    A group of n rows sends about n / PICK_ONE_IN keys and gets n / (PICK_ONE_IN * PICKS_PER_SLICE) bounds.
    """
    values = _values(df, order)
    directions = [asc for _, asc in values]
    names = [f"k{i}" for i in range(len(values))]
    keys = df.select(*[F.col(b).alias(f"_b_{b}") for b in by], *[v.alias(n) for (v, _), n in zip(values, names, strict=True)])
    place = F.xxhash64(*[f"_b_{b}" for b in by], *names)
    picked = keys.where(F.pmod(place, F.lit(PICK_ONE_IN)) == 0)
    met = picked.groupBy(*[f"_b_{b}" for b in by]).agg(F.collect_list(F.struct(*names)).alias("_p")).where(F.size("_p") >= PICKS_PER_SLICE)
    in_order = F.array_sort("_p", lambda a, b: _compared(a, b, directions))
    cuts = met.withColumn("_p", in_order).withColumn("__bounds", F.transform(
        F.expr(f"sequence(1, size(_p) div {PICKS_PER_SLICE})"), lambda i: F.element_at("_p", (i * PICKS_PER_SLICE).cast("int"))))
    coarse = F.filter("__bounds", lambda _, i: (i + 1) % STRETCH == 0)
    return cuts.withColumn("__coarse", coarse).drop("_p")


def with_slices(df: DataFrame, by: Sequence[str], order: Sequence[OrderItem], name: str = "_slice") -> DataFrame:
    """Add a slice number that never decreases along ``order`` in a group; equal keys share a slice."""
    by = list(by)
    values = _values(df, order)
    directions = [asc for _, asc in values]
    cuts = slice_bounds(df, by, order)
    # without a group there is one row of bounds, or none
    joined = (df.join(cuts, [F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by], "left") if by
              else df.join(F.broadcast(cuts), F.lit(True), "left"))
    mine = F.struct(*[v.alias(f"k{i}") for i, (v, _) in enumerate(values)])

    def reached(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda b: _compared(b, mine, directions) <= 0))

    passed = joined.withColumn("__passed", F.when(F.col("__bounds").isNotNull(), reached(F.col("__coarse")) * STRETCH).otherwise(0))
    within = reached(F.slice("__bounds", F.col("__passed") + 1, STRETCH))
    number = F.when(F.col("__bounds").isNull(), 0).otherwise(F.col("__passed") + within)
    return passed.select(*df.columns, number.alias(name))


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[OrderItem],
                 sums: dict[str, str | Column]) -> DataFrame:
    """Add, per output name, the inclusive running sum of its column along ``order`` in each group.

    ``order`` must be unique inside a group; unknown values (NULL or NaN) come last.
    """
    by = list(by)
    values = {n: (F.col(c) if isinstance(c, str) else c) for n, c in sums.items()}
    if is_small(df):
        whole = Window.partitionBy(*by).orderBy(*sort_columns(df, order)).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(v).over(whole).alias(n) for n, v in values.items()])
    sliced = with_slices(df, by, order)
    inner = Window.partitionBy(*by, "_slice").orderBy(*sort_columns(df, order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    totals = sliced.groupBy(*by, "_slice").agg(
        *[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    across = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(b).alias(f"_b_{b}") for b in by], F.col("_slice").alias("_s"),
        *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_c_{n}") for n in values])
    local = sliced.select("*", *[F.sum(v).over(inner).alias(f"_l_{n}") for n, v in values.items()])
    match = [F.col("_slice") == F.col("_s")] + [F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by]
    joined = local.join(carry, match, "inner")
    return joined.select(
        *[c for c in df.columns],
        *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in values])


def rank_rows(df: DataFrame, by: Sequence[str], order: Sequence[OrderItem], name: str = "rank") -> DataFrame:
    """Row number 1..n per group along a unique order, for groups of any size."""
    return running_sums(df, by, order, {name: F.lit(1).cast("bigint")})


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[OrderItem], n: int,
               name: str = "rank") -> DataFrame:
    """The first ``n`` rows per group; ``n`` is a small constant of the operator.

    Spark plans this as a group limit before the shuffle, so a task ships at most ``n`` rows
    per group.
    """
    w = Window.partitionBy(*by).orderBy(*sort_columns(df, order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def one_per_group(df: DataFrame, by: Sequence[str], order: Sequence[OrderItem]) -> DataFrame:
    """The first row of every group along ``order``, by a partially aggregated minimum.

    Descending items that are not numbers have no value to take the minimum of; they go by a group limit.
    """
    by = list(by)
    rest = [c for c in df.columns if c not in by]
    if any(not asc and not isinstance(df.schema[c].dataType, T.NumericType) for c, asc in _items(order)):
        return first_rows(df, by, order, 1, "_rank").drop("_rank")
    keys = [k for i, (v, asc) in enumerate(_values(df, order)) for k in (
        v.isNull().alias(f"u{i}"), (v if asc else -v).alias(f"k{i}"))]
    best = F.min_by(F.struct(*rest), F.struct(*keys))
    return (df.groupBy(*by).agg(best.alias("_r"))
            .select(*[F.col(c) if c in by else F.col(f"_r.{c}").alias(c) for c in df.columns]))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str,
                    probabilities: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of the non-null values per group.

    Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here distinct
    values are counted, run-summed in slices, and only the rows around the wanted ranks remain.
    """
    by = list(by)
    counts = (df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    ran = running_sums(counts, by, ["_v"], {"_hi": "_n"})
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    keyed = total.select(*[F.col(b).alias(f"_q_{b}") for b in by], "_total")
    match = [F.col(b).eqNullSafe(F.col(f"_q_{b}")) for b in by] or F.lit(True)
    placed = ran.join(keyed, match, "inner")
    aggs = []
    for name, p in probabilities.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.floor(pos) + 1, F.ceil(pos) + 1

        def at(rank):
            return F.max(F.when((F.col("_hi") >= rank) & (F.col("_hi") - F.col("_n") < rank),
                                F.col("_v")))

        frac = F.max(pos - F.floor(pos))
        aggs.append((at(lo) + (at(hi) - at(lo)) * frac).alias(name))
    return placed.groupBy(*by).agg(*aggs)


def consecutive(df: DataFrame, by: Sequence[str], order: Sequence[OrderItem],
                value: str) -> DataFrame:
    """Consecutive pairs (by..., pos, a, b) of ``value`` along an order in each group; rows equal in all of it
    have equal values.

    The next value is read in the window that numbers the rows, so rows are shuffled once. Only groups large enough
    to have bounds go another way: their equal rows are counted, numbered in slices, and neighbours meet by position.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(*sort_columns(df, order))
    pairs = [*by, F.row_number().over(w).cast("bigint").alias("pos"), F.col(value).alias("a"), F.lead(value).over(w).alias("b")]
    if is_small(df):
        return df.select(*pairs).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    # one row for each group of millions
    cut = F.broadcast(slice_bounds(df, by, order).select(*[f"_b_{b}" for b in by]))
    large = [F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by] or F.lit(True)
    whole = df.join(cut, large, "left_anti").select(*pairs)
    same = [*by, *[c for c, _ in _items(order) if c not in by]]
    counted = df.join(cut, large, "left_semi").groupBy(*same).agg(F.max(value).alias("_v"), F.count(F.lit(1)).alias("_copies"))
    lines = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).drop("_copies")
    ranked = rank_rows(lines, by, [*order, "_copy"], "pos").select(*by, "pos", "_v")
    role = F.explode(F.array(F.struct(F.col("pos").alias("p"), F.lit(0).alias("r")),
                             F.struct((F.col("pos") - 1).alias("p"), F.lit(1).alias("r"))))
    met = ranked.select(*by, "_v", role.alias("_e")).groupBy(*by, F.col("_e.p").alias("pos")).agg(
        F.max(F.when(F.col("_e.r") == 0, F.col("_v"))).alias("a"),
        F.max(F.when(F.col("_e.r") == 1, F.col("_v"))).alias("b"))
    return whole.unionByName(met).where(F.col("a").isNotNull() & F.col("b").isNotNull())
