"""Exact ranking and classification metrics per group.

Rows collapse to distinct scores in a partial aggregate before anything is ordered, and running
counts are sliced, so neither ties nor one large group load a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeline.operators.ordered import exact_quantiles, rank_rows, running_sums
from slopeline.operators.quality import count_if


def _same(by: Sequence[str], prefix: str):
    return [F.col(b).eqNullSafe(F.col(f"{prefix}{b}")) for b in by] or F.lit(True)


def score_levels(df: DataFrame, by: Sequence[str], y: str = "y", s: str = "s") -> DataFrame:
    """Per group and distinct score: rows, positives, running counts, group totals.

    ``at_least`` and ``pos_at_least`` count rows with this score or a higher one.
    """
    by = list(by)
    levels = df.groupBy(*by, F.col(s).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos"))
    ran = running_sums(levels, by, ["score"], {"cum_n": "n", "cum_pos": "pos"})
    totals = levels.groupBy(*by).agg(F.sum("n").alias("total"), F.sum("pos").alias("total_pos"))
    keyed = totals.select(*[F.col(b).alias(f"_g_{b}") for b in by], "total", "total_pos")
    out = ran.join(keyed, _same(by, "_g_"), "inner")
    return out.select(*by, "score", "n", "pos", "cum_n", "cum_pos", "total", "total_pos",
                      (F.col("total") - F.col("cum_n") + F.col("n")).alias("at_least"),
                      (F.col("total_pos") - F.col("cum_pos") + F.col("pos")).alias("pos_at_least"))


def ranking_metrics(df: DataFrame, by: Sequence[str], y: str = "y", s: str = "s") -> DataFrame:
    """roc_auc (mean rank of ties; NULL for one class) and average precision (steps at distinct scores)."""
    lv = score_levels(df, by, y, s)
    pos, neg = F.max("total_pos"), F.max("total") - F.max("total_pos")
    mean_rank = F.col("cum_n") - (F.col("n") - 1) / 2.0
    ranks = F.sum(F.col("pos") * mean_rank)
    ap = F.sum(F.col("pos") * F.col("pos_at_least") / F.col("at_least"))
    return lv.groupBy(*by).agg(
        F.max("total").alias("n"), pos.alias("n_pos"),
        F.when((pos > 0) & (neg > 0), (ranks - pos * (pos + 1) / 2.0) / (pos * neg)).alias("roc_auc"),
        F.when(pos > 0, ap / pos).otherwise(0.0).alias("avg_precision"))


def confusion_columns(threshold: Column | float = 0.5, y: str = "y", s: str = "s") -> dict[str, Column]:
    """tp, fp, fn, tn and the derived rates as aggregate columns."""
    hit = F.col(s) >= threshold
    tp, fp = count_if(hit & (F.col(y) == 1)), count_if(hit & (F.col(y) == 0))
    fn, tn = count_if(~hit & (F.col(y) == 1)), count_if(~hit & (F.col(y) == 0))
    share = lambda a, b, other=None: F.when(b > 0, a / b).otherwise(other)
    precision, recall = share(tp, tp + fp, 0.0), share(tp, tp + fn, 0.0)
    return {
        "tp": tp, "fp": fp, "fn": fn, "tn": tn, "precision": precision, "recall": recall,
        "f1": share(2 * tp, 2 * tp + fp + fn, 0.0), "false_negative_rate": share(fn, fn + tp),
        "negative_rate": share(tn + fp, tp + fp + fn + tn),
        "balanced_accuracy": (recall + share(tn, tn + fp, 0.0)) / 2.0,
    }


def classification_metrics(df: DataFrame, by: Sequence[str], threshold: Column | float = 0.5,
                           y: str = "y", s: str = "s") -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in confusion_columns(threshold, y, s).items()])


def probability_losses(df: DataFrame, by: Sequence[str], y: str = "y", s: str = "s",
                       eps: float = 1e-15) -> DataFrame:
    """Brier score on clipped probabilities and log-loss."""
    p = F.least(F.greatest(F.col(s), F.lit(0.0)), F.lit(1.0))
    q = F.least(F.greatest(F.col(s), F.lit(eps)), F.lit(1 - eps))
    loss = -F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q))
    return df.groupBy(*by).agg(F.avg(F.pow(p - F.col(y), 2)).alias("brier"), F.avg(loss).alias("log_loss"))


def evaluate(df: DataFrame, by: Sequence[str], threshold: Column | float = 0.5, y: str = "y",
             s: str = "s") -> DataFrame:
    """The full report per group."""
    by = list(by)
    parts = [ranking_metrics(df, by, y, s), classification_metrics(df, by, threshold, y, s),
             probability_losses(df, by, y, s)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, by) if by else out.join(part)
    return out


def recall_at_fraction(df: DataFrame, by: Sequence[str], fractions: Sequence[float] = (0.10, 0.25),
                       y: str = "y", s: str = "s", key: str = "id") -> DataFrame:
    """Positives among the top ceil(n*f) rows; ties by key."""
    by = list(by)
    ranked = rank_rows(df.select(*by, y, s, key), by, [(s, False), key], "_rank")
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y)).alias("_p"))
    keyed = n.select(*[F.col(b).alias(f"_g_{b}") for b in by], "_n", "_p")
    j = ranked.join(keyed, _same(by, "_g_"))
    frac = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    k = F.greatest(F.ceil(F.col("_n") * F.col("fraction")), F.lit(1))
    return (j.withColumn("fraction", frac).groupBy(*by, "fraction").agg(
        F.max(k).alias("n_selected"),
        F.count(F.when((F.col("_rank") <= k) & (F.col(y) == 1), 1)).alias("positives_found"),
        F.max("_p").alias("_p"))
        .withColumn("recall", F.when(F.col("_p") > 0, F.col("positives_found") / F.col("_p"))).drop("_p"))


def confusion_table(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def multiclass_metrics(df: DataFrame, actual: str, predicted: str) -> tuple[DataFrame, DataFrame]:
    """(per class precision/recall/f1/support, one row of accuracy, macro and weighted f1)."""
    cells = confusion_table(df, actual, predicted)
    side = F.explode(F.array(F.struct(F.col(actual).alias("class"), F.lit("a").alias("r")),
                             F.struct(F.col(predicted).alias("class"), F.lit("p").alias("r"))))
    c = cells.select((F.col(actual) == F.col(predicted)).alias("hit"), "n", side.alias("e"))
    per = c.groupBy(F.col("e.class").alias("class")).agg(
        F.coalesce(F.sum(F.when(F.col("hit") & (F.col("e.r") == "a"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("e.r") == "a", F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(F.col("e.r") == "p", F.col("n"))), F.lit(0)).alias("predicted"))
    z = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.select("class", "support", z(F.col("tp"), F.col("predicted")).alias("precision"),
                     z(F.col("tp"), F.col("support")).alias("recall"),
                     z(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "tp")
    total = F.sum("support")
    overall = per.agg((F.sum("tp") / total).alias("accuracy"), F.avg("f1").alias("macro_f1"),
                      (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"))
    return per.drop("tp"), overall


def overfit_gap(df: DataFrame, split: str = "split", y: str = "y", s: str = "s",
                limit: float = 0.20) -> DataFrame:
    """Train minus validation AUC and whether it exceeds the limit."""
    auc = ranking_metrics(df.where(F.col(split).isin("train", "validation")), [split], y, s)
    one = auc.agg(F.max(F.when(F.col(split) == "train", F.col("roc_auc"))).alias("train_roc_auc"),
                  F.max(F.when(F.col(split) == "validation", F.col("roc_auc"))).alias("validation_roc_auc"))
    gap = F.col("train_roc_auc") - F.col("validation_roc_auc")
    return one.withColumn("generalization_gap", gap).withColumn(
        "overfit_warning", F.coalesce(gap > limit, F.lit(False)))


def pooled_folds(df: DataFrame, fold: str = "fold", y: str = "y", s: str = "s") -> DataFrame:
    """Pooled metrics over out-of-fold scores with the spread (population std) of the fold metrics."""
    folds = ranking_metrics(df, [fold], y, s)
    spread = folds.agg(
        F.count(F.lit(1)).alias("n_folds"), F.count("roc_auc").alias("n_two_class_folds"),
        F.avg("roc_auc").alias("two_class_fold_mean_roc_auc"), F.min("roc_auc").alias("roc_auc_min"),
        F.max("roc_auc").alias("roc_auc_max"),
        F.when(F.count("roc_auc") > 1, F.stddev_pop("roc_auc")).alias("roc_auc_std"))
    pooled = ranking_metrics(df, [], y, s).select(
        F.col("n").alias("pooled_n_samples"), F.col("n_pos").alias("pooled_n_positives"),
        F.col("roc_auc").alias("pooled_roc_auc"), F.col("avg_precision").alias("pooled_avg_precision"))
    # two single-row tables
    return pooled.join(spread)


def median_lead(df: DataFrame, lead: str, y: str = "y", s: str = "s", at: float = 0.5) -> DataFrame:
    """Median warning lead time of the true positives."""
    hits = df.where((F.col(s) >= at) & (F.col(y) == 1)).select(F.col(lead).cast("double").alias("_lead"))
    return exact_quantiles(hits, [], "_lead", {"median_lead": 0.5})
