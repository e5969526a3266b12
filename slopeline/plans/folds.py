"""Cross-validation in which all folds are fitted together.

A row carries the number of its group, and a fold is a rule over those numbers: every group but one, or all
groups up to one. A Newton step of all logistic fits is one pass: tasks add up the gradient and the Hessian of
every fold their rows train in, and one row per fold comes back. So the passes do not depend on the number of
folds, and no fold is a job of its own. The driver holds some numbers per fold, as many as features squared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeline.operators.ordered import rank_rows, running_sums
from slopeline.plans.model import guarded, numeric_inputs
from slopeline.session import durable


@dataclass(frozen=True)
class Folds:
    """``n`` folds over groups 0, 1, ...: without ``upto`` fold k leaves out group k, with it fold k trains on
    groups up to upto[k] and tests on tests[k]."""

    n: int
    upto: tuple[int, ...] | None = None
    tests: tuple[int, ...] | None = None

    def trains(self, tags: np.ndarray) -> np.ndarray:
        """Rows x folds."""
        return tags[:, None] != np.arange(self.n) if self.upto is None else tags[:, None] <= np.array(self.upto)

    def tested(self, tags: np.ndarray) -> np.ndarray:
        """The fold that scores each row, -1 for none."""
        if self.tests is None:
            return np.where(tags < self.n, tags, -1)
        at = np.searchsorted(self.tests, tags)
        found = (at < self.n) & (np.array(self.tests)[np.minimum(at, self.n - 1)] == tags)
        return np.where(found, at, -1)


def expanding(groups: int, min_train: int = 4, n_val: int = 1) -> Folds:
    """Folds over groups 1 to ``groups`` in time: the first k train, the next ``n_val`` are for validation, the
    one after tests; k grows by ``n_val``."""
    upto = tuple(range(min_train, groups - n_val, n_val))
    return Folds(len(upto), upto, tuple(k + n_val + 1 for k in upto))


def _probability(linear: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(linear, -500, 500)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def fit_folds(rows: DataFrame, width: int, folds: Folds, ridge: float = 1.0, steps: int = 25, tolerance: float = 1e-9
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, intercepts, fitted): the balanced ridge-penalised logistic fit of every fold on features that are
    standardised over its training rows, turned back to the given features. ``fitted`` is false where the
    training rows hold one class.

    ``rows``: x (array of ``width`` doubles), y (0 or 1), tag.
    """
    n, p = folds.n, width
    # the steps read equal rows as one, with their number
    rows = durable(rows.groupBy("x", "y", "tag").agg(F.count(F.lit(1)).cast("double").alias("times")))
    sums = rows.groupBy("tag").agg(F.sum("times").alias("n"), F.sum(F.col("y") * F.col("times")).alias("pos"),
                                   *[F.sum(F.get("x", i) * F.col("times")).alias(f"s{i}") for i in range(p)],
                                   *[F.sum(F.pow(F.get("x", i), 2) * F.col("times")).alias(f"q{i}") for i in range(p)]).collect()
    tags, parts = np.array([r.tag for r in sums], np.int64), np.array([tuple(r)[1:] for r in sums], np.float64).reshape(-1, 2 * p + 2)
    per = folds.trains(tags).T.astype(np.float64) @ parts
    count, pos = per[:, 0], per[:, 1]
    fitted = (pos > 0) & (pos < count)
    safe = np.maximum(count, 1)[:, None]
    mean = per[:, 2:2 + p] / safe
    deviation = np.sqrt(np.maximum(per[:, 2 + p:] / safe - mean ** 2, 0))
    deviation = np.where(deviation > 1e-12 * np.maximum(np.abs(mean), 1), deviation, 1.0)
    weigh = np.stack([count / np.maximum(2 * (count - pos), 1), count / np.maximum(2 * pos, 1)])
    # (1, x) -> (1, standardised x)
    turn = np.zeros((n, p + 1, p + 1))
    turn[:, 0, 0] = 1
    turn[:, 1:, 0] = -mean / deviation
    turn[:, np.arange(1, p + 1), np.arange(1, p + 1)] = 1 / deviation
    penalty = np.diag([0.0, *[ridge] * p])
    theta = np.zeros((n, p + 1))
    live = np.flatnonzero(fitted)
    for _ in range(steps):
        if not len(live):
            break
        given, some, t = np.einsum("kij,ki->kj", turn[live], theta[live]), live, turn[live]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, h = np.zeros((len(some), p + 1)), np.zeros((len(some), p + 1, p + 1))
            for batch in batches:
                x = np.hstack([np.ones((batch.num_rows, 1)), _matrix(batch.column(0), p)])
                y, tag, times = (np.asarray(batch.column(c)) for c in (1, 2, 3))
                member = folds.trains(tag)[:, some] * times[:, None] * np.where(y[:, None] > 0, weigh[1, some], weigh[0, some])
                q = _probability(x @ given.T)
                g += (member * (q - y[:, None])).T @ x
                second = member * q * (1 - q)
                for k in range(len(some)):
                    h[k] += (x * second[:, k:k + 1]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(some), dtype=np.int32)), pa.array([np.concatenate([a, b.ravel()]).tobytes() for a, b in zip(g, h, strict=True)])],
                                             ["fold", "sums"])

        def add(key: tuple, table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b) for b in table.column("sums").to_pylist())
            return pa.table({"fold": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        back = rows.select("x", "y", "tag", "times").mapInArrow(work, "fold int, sums binary").groupBy("fold").applyInArrow(add, "fold int, sums binary").collect()
        found = np.array([np.frombuffer(r.sums) for r in sorted(back, key=lambda r: r.fold)])
        g = np.einsum("kij,kj->ki", t, found[:, :p + 1]) + theta[live] @ penalty
        h = t @ found[:, p + 1:].reshape(-1, p + 1, p + 1) @ t.transpose(0, 2, 1) + penalty
        # constant features leave zero rows without a ridge
        step = np.linalg.solve(h + 1e-12 * np.eye(p + 1), g[:, :, None])[:, :, 0]
        theta[live] -= step
        live = live[np.abs(step).max(1) > tolerance]
    plain = np.einsum("kij,ki->kj", turn, theta)
    return plain[:, 1:], plain[:, 0], fitted


def fold_scores(rows: DataFrame, width: int, folds: Folds, keep: Sequence[str], ridge: float = 1.0) -> DataFrame:
    """``keep``, fold (its number) and raw_probability of every row that a fold tests; 0.5 where its fold could
    not be fitted."""
    weights, intercepts, fitted = fit_folds(rows, width, folds, ridge)
    at = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = folds.tested(np.asarray(batch.column(at + 1)))
            x = _matrix(batch.column(at), width)
            p = np.where(fitted[fold], _probability((x * weights[fold]).sum(1) + intercepts[fold]), 0.5) if folds.n else np.zeros(len(fold))
            out = pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(fold.astype(np.int32)), pa.array(p)], [*keep, "fold", "raw_probability"])
            yield out.filter(pa.array(fold >= 0))

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "x", "tag").mapInArrow(work, f"{types}, fold int, raw_probability double")


def _inputs(df: DataFrame, features: Sequence[str], label: str) -> tuple[list[Column], DataFrame]:
    """Features with unknown values at their mean, and a flag for each; with an intercept and the flag, what
    stands for an unknown value hardly matters."""
    guarded(df, features, label)
    known = numeric_inputs(df, features)
    means = known.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in features]).first()
    return [*[F.coalesce(F.col(c), F.lit(means[c])) for c in features], *[F.col(f"is_missing_{c}") for c in features]], known


def percentiles_without(rows: DataFrame, value: str, group: str, name: str) -> DataFrame:
    """``group``, ``value`` and ``name``: for every known value of a group the share of the other groups' known
    values that are not above it. Two running sums over distinct values; no group is met by another."""
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    every = running_sums(known.groupBy(value).agg(F.sum("n").alias("n")), [], [value], {"le": "n"}).select(F.col(value).alias("_v"), "le")
    own = running_sums(known, [group], [value], {"own": "n"})
    sizes = known.groupBy(F.col(group).alias("_g")).agg(F.sum("n").alias("size"))
    total = known.agg(F.sum("n").alias("total"))
    met = own.join(every, F.col(value) == F.col("_v")).join(sizes, F.col(group) == F.col("_g"))
    # the total is a single row
    return met.join(total).select(group, value, ((F.col("le") - F.col("own")) / F.greatest(F.col("total") - F.col("size"), F.lit(1))).alias(name))


def leave_one_out_scores(df: DataFrame, features: Sequence[str], group: str, label: str = "label",
                         baselines: Sequence[str] = (), key: Sequence[str] = (), ridge: float = 1.0) -> DataFrame:
    """Scores of every row by a logistic fit on the other groups: ``key``, ``group``, label, raw_probability and, per
    baseline feature, <feature>_percentile among the other groups' rows (0 for an unknown value).

    Where the others hold a single class nothing can be learned and the score is 0.5. Rows without a group or
    label take no part.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(label).isNotNull())
    inputs, known = _inputs(rows, features, label)
    numbers = rank_rows(rows.select(F.col(group).alias("_g")).distinct(), [], ["_g"], "_n")
    keep = list(dict.fromkeys([*key, group, *baselines]))
    placed = durable(known.join(numbers, F.col(group) == F.col("_g")).select(
        *keep, F.col(label).cast("double").alias("y"), F.array(*inputs).alias("x"), (F.col("_n") - 1).alias("tag")))
    out = fold_scores(placed, len(inputs), Folds(numbers.count()), [*keep, "y"], ridge).withColumnRenamed("y", label).drop("fold")
    for c in baselines:
        share = percentiles_without(placed, c, group, f"{c}_percentile").select(F.col(group).alias("_bg"), F.col(c).alias("_bv"), f"{c}_percentile")
        out = out.join(share, (F.col(group) == F.col("_bg")) & (F.col(c) == F.col("_bv")), "left").drop("_bg", "_bv").withColumn(
            f"{c}_percentile", F.coalesce(f"{c}_percentile", F.lit(0.0)))
    return out


def expanding_scores(df: DataFrame, features: Sequence[str], *, event: str = "event_id", time: str = "prediction_time",
                     label: str = "label", min_train: int = 4, n_val: int = 1, key: Sequence[str] = (), ridge: float = 1.0) -> DataFrame:
    """Out-of-fold scores of expanding-window folds over event groups: ``key``, fold (the last training group),
    label and raw_probability. Folds whose training rows hold one class score nothing."""
    from slopeline.operators.splits import event_groups
    # the rows are read for their groups, times and means: their rules are worked out once
    df = durable(df.select(*dict.fromkeys([*key, *features, event, time, label])))
    groups = event_groups(df, event, time, label).select("first_time", "group_no")
    first = df.groupBy(F.col(event).alias("_e")).agg(F.min(time).alias("first_time"))
    inputs, known = _inputs(df, features, label)
    tagged = known.join(first.join(groups, "first_time"), F.col(event) == F.col("_e"))
    placed = durable(tagged.select(*key, F.col(label).cast("double").alias("y"), F.array(*inputs).alias("x"), F.col("group_no").alias("tag")))
    folds = expanding(placed.agg(F.max("tag")).first()[0] or 0, min_train, n_val)
    if not folds.n:
        return placed.limit(0).select(*key, F.lit(0).alias("fold"), F.col("y").alias(label), F.lit(0.0).alias("raw_probability"))
    scored = fold_scores(placed, len(inputs), folds, [*key, "y"], ridge).withColumn("fold", F.get(F.array(*map(F.lit, folds.upto)), "fold"))
    single = placed.groupBy("tag").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).agg(
        F.min(F.when(F.col("lo") == 0, F.col("tag"))).alias("neg"), F.min(F.when(F.col("hi") == 1, F.col("tag"))).alias("pos"))
    # both classes are there from some group on; one row
    return scored.join(F.broadcast(single), F.col("fold") >= F.greatest(F.coalesce("neg", F.lit(1 << 60)), F.coalesce("pos", F.lit(1 << 60)))).select(
        *key, "fold", F.col("y").alias(label), "raw_probability")
