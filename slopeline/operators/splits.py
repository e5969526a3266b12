"""Chronological, geographic, grouped and stratified splits, with their checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopeline.operators.ordered import rank_rows, running_sums

ORDER = ("train", "validation", "test")


def temporal_split(time: Column, train_until: str, validation_until: str | None = None,
                   gap_until: str | None = None, withhold_from: str | None = None) -> Column:
    """Half-open membership by time; ``[validation_until, gap_until)`` and the tail are 'gap'."""

    def ts(s: str) -> Column:
        return F.lit(s).cast("timestamp_ntz")

    t = time.cast("timestamp_ntz")
    if gap_until is not None and validation_until is None:
        raise ValueError("a gap needs a validation period before it")
    rest = F.when(t < ts(train_until), "train")
    if withhold_from is not None:
        rest = F.when(t >= ts(withhold_from), "gap").when(t < ts(train_until), "train")
    if validation_until is not None:
        rest = rest.when(t < ts(validation_until), "validation")
    if gap_until is not None:
        rest = rest.when(t < ts(gap_until), "gap")
    return rest.otherwise("test")


def geographic_split(group: Column, train: Sequence[str], test: Sequence[str],
                     holdout: str | None = None) -> Column:
    """Groups nobody named are held out; naming one twice is an error."""
    both = set(train) & set(test)
    if both:
        raise ValueError(f"groups are both train and test: {sorted(both)}")
    out = F.when(F.lit(False), "holdout")
    if holdout is not None:
        out = F.when(group == holdout, "holdout")
    return (out.when(group.isin(list(train)), "train").when(group.isin(list(test)), "test")
            .otherwise("holdout"))


def monotonic_violations(df: DataFrame, time: str, split: str) -> DataFrame:
    """Adjacent present splits that overlap in time, and labels that are not a split (as rows)."""
    position = reduce(lambda acc, i: acc.when(F.col("split") == ORDER[i], i),
                      range(1, len(ORDER)), F.when(F.col("split") == ORDER[0], 0))
    bounds = (df.groupBy(F.col(split).alias("split")).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
              .withColumn("pos", position))
    # a handful of rows: one per split label
    w = Window.partitionBy(F.col("pos").isNotNull()).orderBy("pos")
    checked = bounds.withColumn("previous_hi", F.lag("hi").over(w))
    problem = (F.when(F.col("pos").isNull() & ~F.col("split").isin("gap", "holdout"), "unknown_label")
               .when(F.col("pos").isNotNull() & (F.col("lo") < F.col("previous_hi")), "overlap"))
    return checked.withColumn("problem", problem).where("problem IS NOT NULL").select("split", "problem")


def event_groups(df: DataFrame, event: str = "event_id", time: str = "prediction_time",
                 label: str = "label") -> DataFrame:
    """Events grouped by their first prediction time: group number, sizes and classes."""
    per_event = df.groupBy(event).agg(
        F.min(time).alias("first_time"), F.max(F.col(label)).alias("hi"), F.min(F.col(label)).alias("lo"))
    groups = per_event.groupBy("first_time").agg(
        F.count(F.lit(1)).alias("n_events"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    ordered = running_sums(groups, [], ["first_time"],
                           {"cum_events": "n_events", "group_no": F.lit(1).cast("bigint")})
    return ordered


def split_by_events(df: DataFrame, n_validation: int, n_test: int, event: str = "event_id",
                    time: str = "prediction_time", label: str = "label") -> DataFrame:
    """Event-disjoint chronological split; events of one date stay together.

    The test boundary is the last whole group start at or before ``n - n_test`` events. Validation
    starts likewise and moves backward over whole groups until it holds both classes. Only four
    numbers reach the driver; membership is a comparison on the event's first time.
    """
    groups = event_groups(df, event, time, label)
    starts = groups.withColumn("start", F.col("cum_events") - F.col("n_events"))
    total = groups.agg(F.max("cum_events").alias("n")).first()["n"] or 0

    def boundary(target: int) -> tuple[int, object]:
        # the group that crosses the target begins the later part
        if target >= total:
            return total, None
        row = (starts.where((F.col("cum_events") > target) | (F.lit(target) < 0))
               .agg(F.min(F.struct("start", "first_time")).alias("b")).first()["b"])
        return (0, None) if row is None else (row.start, row.first_time)

    test_start, test_time = boundary(total - n_test)
    val_start, _ = boundary(test_start - n_validation)
    # latest group start <= val_start from which validation holds both classes
    before_test = starts.where(F.col("start") < test_start)
    last_pos, last_neg = before_test.agg(
        F.max(F.when(F.col("hi") == 1, F.col("start"))),
        F.max(F.when(F.col("lo") == 0, F.col("start")))).first()
    if last_pos is None or last_neg is None:
        raise ValueError("the validation slice cannot be expanded to two classes")
    val_start = min(val_start, last_pos, last_neg)
    val_time = starts.where(F.col("start") == val_start).first()["first_time"]
    first = df.groupBy(event).agg(F.min(time).alias("_first"))
    split = F.when(F.col("_first") < F.lit(val_time), "train")
    if test_time is not None:
        split = split.when(F.col("_first") < F.lit(test_time), "validation").otherwise("test")
    else:
        split = split.otherwise("validation")
    return first.select(event, split.alias("split"))


def expanding_folds(groups: DataFrame, min_train: int = 4, n_val: int = 1) -> DataFrame:
    """(fold, group) membership of expanding-window folds: first k groups train, next ones validate,
    the one after tests. One row per fold is described by its bounds, not by its groups."""
    n = groups.agg(F.max("group_no").alias("n"))
    return n.select(F.explode(F.sequence(F.lit(min_train).cast("bigint"), F.col("n") - n_val - 1,
                                         F.lit(n_val).cast("bigint"))).alias("train_upto")).select(
        "train_upto", (F.col("train_upto") + n_val).alias("val_upto"),
        (F.col("train_upto") + n_val + 1).alias("test_group"))


def stratified_split(df: DataFrame, stratum: str, key: str, cuts: dict[str, float],
                     seed: int = 2026) -> DataFrame:
    """Exact stratified shares by hash order: row i of n goes to the first cut with (i-1)/n < bound."""
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    ranked = rank_rows(hashed, [stratum], ["_h", key], "_rank")
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    share = (F.col("_rank") - 1) / F.col("_n")
    label, bound = None, 0.0
    for name, width in cuts.items():
        bound += width
        cond = share < F.lit(round(bound, 12))
        label = F.when(cond, name) if label is None else label.when(cond, name)
    return (ranked.join(sizes, stratum).withColumn("split", label.otherwise(list(cuts)[-1]))
            .drop("_h", "_rank", "_n"))


def two_class(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Per split: rows, positives and whether both classes are present."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).cast("bigint").alias("n_pos"),
        (F.min(label) < F.max(label)).alias("two_class"))
