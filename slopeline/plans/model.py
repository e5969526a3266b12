"""Training, calibration, scoring and attribution with Spark ML.

Feature tables carry NULL for unknown. The learners of Spark reject NaN, so every pipeline fills the
training median and adds a 0/1 flag per feature.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeline.functions.scoring import calibrate, contribution_records, top_factors
from slopeline.operators.isotonic import isotonic_steps
from slopeline.operators.quality import count_if
from slopeline.schema import forbid_columns
from slopeline.session import durable, spread

# Size and pace of the boosted ensemble, and the early-stopping floor.
BOOSTING = {"maxIter": 200, "maxDepth": 2, "stepSize": 0.03, "subsamplingRate": 0.8, "minInstancesPerNode": 5, "seed": 2026}
MIN_VALIDATION_POSITIVES = 5


# Columns that hold the target or what the proxy target was made of.
LEAKAGE = ["risk_label", "risk_score", "road_risk_prior"]


def guarded(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """The features and the label; fails before any job when a feature would leak the target."""
    forbid_columns(df.select(*features), [*LEAKAGE, label], "features")
    return df.select(*features, label)


def numeric_inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles with a missing flag each; malformed, NaN and infinite values are missing."""
    def num(c):
        v = F.col(c).try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    out = df.withColumns({c: num(c) for c in features})
    return out.withColumns({f"is_missing_{c}": F.col(c).isNull().cast("double") for c in features})


def class_weight(df: DataFrame, label: str = "label", mode: str | float = "auto") -> tuple[DataFrame, float]:
    """Adds ``weight``: positives weigh n_neg/n_pos, a given number, or 1."""
    if mode == "none":
        w = 1.0
    elif mode == "auto":
        pos, neg = df.agg(count_if(F.col(label) == 1), count_if(F.col(label) == 0)).first()
        w = neg / pos if pos and neg else 1.0
    elif isinstance(mode, (int, float)) and not isinstance(mode, bool) and 0 < mode < float("inf"):
        w = float(mode)
    else:
        raise ValueError(f"class balance must be 'auto', 'none' or a positive number, not {mode!r}")
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(w)).otherwise(1.0)), w


def _known(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with at least one value: a median needs one."""
    row = df.agg(*[F.count(c).alias(c) for c in features]).first()
    return [c for c in features if row[c]]


def _stages(train: DataFrame, features: Sequence[str], output: str) -> list:
    known = _known(train, features)
    filled = [f"{c}_filled" for c in known]
    return [Imputer(strategy="median", inputCols=known, outputCols=filled),
            VectorAssembler(inputCols=filled + [f"is_missing_{c}" for c in features], outputCol=output)]


def fit_boosted(train: DataFrame, validation: DataFrame | None, features: Sequence[str], label: str = "label",
                balance: str | float = "auto", **params) -> PipelineModel:
    """Boosted trees. Validation rows steer early stopping only when they hold both classes and enough
    positives; otherwise the whole bounded ensemble is kept."""
    # the learner passes over its rows many times: they are written once
    base = durable(numeric_inputs(guarded(train, features, label), features))
    rows, _ = class_weight(base, label, balance)
    rows = rows.withColumn("is_validation", F.lit(False))
    gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", **{**BOOSTING, **params})
    if validation is not None:
        pos, neg = validation.agg(count_if(F.col(label) == 1), count_if(F.col(label) == 0)).first()
        if pos >= MIN_VALIDATION_POSITIVES and neg > 0:
            extra = numeric_inputs(validation.select(*features, label), features).withColumn("weight", F.lit(1.0)).withColumn(
                "is_validation", F.lit(True))
            rows = rows.unionByName(extra, allowMissingColumns=True)
            gbt = gbt.setValidationIndicatorCol("is_validation")
    prep = Pipeline(stages=_stages(rows.where("NOT is_validation"), features, "features")).fit(rows.where("NOT is_validation"))
    ready = prep.transform(rows).select("features", label, "weight", "is_validation").withColumn(
        label, F.col(label).cast("double"))
    return PipelineModel(stages=[*prep.stages, gbt.fit(ready)])


def fit_logistic(train: DataFrame, features: Sequence[str], label: str = "label", max_iter: int = 100) -> PipelineModel:
    """Logistic baseline: median fill, missing flags, standardised, balanced."""
    rows, _ = class_weight(durable(numeric_inputs(guarded(train, features, label), features)), label)
    stages = _stages(rows, features, "raw_features") + [
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", maxIter=max_iter, standardization=False)]
    return Pipeline(stages=stages).fit(rows.withColumn(label, F.col(label).cast("double")))


def preprocess(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    """Median fill and most-frequent fill with one-hot codes; a category unseen in training is its own code."""
    modes = {}
    for c in categorical:
        row = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(
            F.max(F.struct("n", c)).alias("m")).first()
        modes[c] = row["m"][c] if row["m"] else ""
    from pyspark.ml.feature import SQLTransformer
    fills = ", ".join(f"coalesce({c}, {_quote(modes[c])}) AS {c}_known" for c in categorical)
    sql = SQLTransformer(statement=f"SELECT *{', ' + fills if fills else ''} FROM __THIS__")
    filled = [f"{c}_filled" for c in numeric]
    return Pipeline(stages=[
        sql, Imputer(strategy="median", inputCols=list(numeric), outputCols=filled),
        StringIndexer(inputCols=[f"{c}_known" for c in categorical], outputCols=[f"{c}_index" for c in categorical],
                      handleInvalid="keep", stringOrderType="frequencyDesc"),
        OneHotEncoder(inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_code" for c in categorical],
                      handleInvalid="keep", dropLast=False),
        VectorAssembler(inputCols=filled + [f"{c}_code" for c in categorical], outputCol="features")])


def _quote(v: str) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_multiclass(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str = "risk_class",
                   trees: int = 60, depth: int = 8) -> PipelineModel:
    """Forest on the four proxy classes (Spark's boosted trees are binary). The forest keeps each task's rows in
    memory, so they are dealt to tasks by their number."""
    guarded(df, [*numeric, *categorical], label)
    df = spread(df.select(*numeric, *categorical, label))
    prep = preprocess(df, numeric, categorical)
    forest = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=2026)
    return Pipeline(stages=[*prep.getStages(), forest]).fit(df.withColumn(label, F.col(label).cast("double")))


def fit_calibration(scored: DataFrame, label: str = "label", score: str = "raw_probability") -> tuple[list[float], list[float]]:
    """Isotonic thresholds (x, y) of the validation scores; the model's step table is small."""
    return isotonic_steps(scored, label, score)


@dataclass(frozen=True)
class FrozenLogistic:
    """A released logistic model as its numbers: the weight of each feature, what stands for an unknown one,
    and the intercept. Scoring it is one column expression."""

    weights: dict[str, float]
    fills: dict[str, float]
    intercept: float = 0.0

    def probability(self) -> Column:
        terms = [F.coalesce(F.col(c), F.lit(self.fills[c])) * F.lit(w) for c, w in self.weights.items()]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-sum(terms, F.lit(self.intercept))))


def score(model: PipelineModel | FrozenLogistic, df: DataFrame, features: Sequence[str],
          calibration: tuple[Sequence[float], Sequence[float]] | None = None) -> DataFrame:
    """raw and calibrated probability of the positive class for every row."""
    keep = [c for c in df.columns]
    inputs = numeric_inputs(df, features)
    if isinstance(model, FrozenLogistic):
        out = inputs.select(*keep, model.probability().alias("raw_probability"))
    else:
        out = model.transform(inputs).select(*keep, vector_to_array("probability")[1].alias("raw_probability"))
    p = F.col("raw_probability") if calibration is None else calibrate(F.col("raw_probability"), *calibration)
    return out.withColumn("calibrated_probability", p)


def linear_factors(model: PipelineModel, df: DataFrame, features: Sequence[str], n: int = 5) -> DataFrame:
    """Top contributions coef * (x - mean) / std of the logistic model, as an array per row."""
    imputer, _, scaler, logistic = model.stages[-4:]
    medians = imputer.surrogateDF.first().asDict()
    known = imputer.getInputCols()
    mean, std, coef = scaler.mean.toArray(), scaler.std.toArray(), logistic.coefficients.toArray()
    rows = numeric_inputs(df, features)
    values, parts = [], []
    for i, c in enumerate(known):
        x = F.coalesce(F.col(c), F.lit(float(medians[c])))
        values.append(F.col(c))
        parts.append((x - float(mean[i])) / float(std[i]) * float(coef[i]) if std[i] else F.lit(0.0))
    factors = top_factors(contribution_records(known, values, parts), n)
    return rows.select(*df.columns, factors.alias("top_contributing_factors"))


Fit = Callable[[DataFrame, DataFrame | None], PipelineModel]


def grouped_cv(df: DataFrame, features: Sequence[str], fit: Fit, *, event: str = "event_id", time: str = "prediction_time",
               label: str = "label", n_val: int = 1, min_train: int = 4) -> DataFrame | None:
    """Out-of-fold scores of expanding-window folds over event groups: fold, label, raw_probability.

    The driver loops over folds, one fit each; single-class training folds are skipped.
    """
    from slopeline.operators.splits import event_groups, expanding_folds
    groups = event_groups(df, event, time, label).select("first_time", "group_no")
    first = df.groupBy(event).agg(F.min(time).alias("first_time"))
    # the fold loop reads this table many times
    placed = durable(df.select(*features, label, event).join(first.join(groups, "first_time").select(event, "group_no"), event))
    folds = expanding_folds(groups, min_train, n_val).orderBy("train_upto").collect()
    out = None
    for f in folds:
        train = placed.where(F.col("group_no") <= f.train_upto)
        val = placed.where((F.col("group_no") > f.train_upto) & (F.col("group_no") <= f.val_upto))
        test = placed.where(F.col("group_no") == f.test_group)
        if train.select(label).distinct().count() < 2:
            continue
        s = durable(score(fit(train, val), test, features).select(
            F.lit(f.train_upto).alias("fold"), F.col(label).alias("label"), "raw_probability"))
        out = s if out is None else out.unionByName(s)
    return out


def leave_one_out_cv(df: DataFrame, features: Sequence[str], fit: Fit, fold: str, label: str = "label") -> DataFrame | None:
    """Out-of-fold scores with one corridor held out at a time; one fit each.

    The held-out rows take no part in the fit. Where the others hold a single class nothing can be
    learned: every row of the fold scores 0.5.
    """
    placed = durable(df.select(*features, label, fold))
    out = None
    for (value,) in placed.select(fold).where(F.col(fold).isNotNull()).distinct().orderBy(fold).collect():
        train, test = placed.where(F.col(fold) != value), placed.where(F.col(fold) == value)
        single = train.select(label).distinct().count() < 2
        scores = test.withColumn("raw_probability", F.lit(0.5)) if single else score(fit(train, None), test, features)
        s = durable(scores.select(
            F.lit(value).alias("fold"), F.col(label).alias("label"), "raw_probability"))
        out = s if out is None else out.unionByName(s)
    return out
