"""Relating features to labels: correlation, split, scaling, regression, metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtide.functions.numbers import known, ratio
from revtide.plans.runs import ROWS_PER_SLICE, running
from revtide.session import settle

# The regression's inverse penalty and iteration limit.
INVERSE_PENALTY = 10_000.0
MAX_ITERATIONS = 10_000

# Newton steps after the fit, and the distance to the optimum (Newton decrement) at which they end.
MAX_STEPS, CLOSE_ENOUGH = 40, 1e-9


def feature_correlations(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Pearson correlation of each feature with the label over rows where both are known.

    One aggregation covers all features; only its single row is turned into one row per feature.
    A constant feature has no correlation (NULL).
    """
    y = known(F.col(label))
    measures = []
    for i, name in enumerate(features):
        x = known(F.col(name))
        both = x.isNotNull() & y.isNotNull()
        spread = F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y))
        measures.append(F.try_divide(F.covar_samp(x, y), spread).alias(f"_{i}"))
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_{i}").alias("score")) for i, n in enumerate(features)])
    return df.agg(*measures).select(F.inline(rows)).withColumn("abs", F.abs("score"))


def top_correlations(correlations: DataFrame, count: int = 10) -> DataFrame:
    """The strongest features; unknown scores last, ties by name."""
    return correlations.orderBy(F.desc_nulls_last("abs"), "feature").limit(count)


def impute_zero(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({name: F.coalesce(known(F.col(name)), F.lit(0.0)) for name in features})


def split_bucket(key: Sequence[str], buckets: int) -> Column:
    """A bucket number that depends on the key alone, so every run and engine splits alike."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    return (F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long") % buckets).cast("int")


def train_test_split(df: DataFrame, key: Sequence[str], buckets: int = 4) -> DataFrame:
    """Add `is_test`: one bucket in `buckets` (4: 75/25, 5: 80/20)."""
    return df.withColumn("is_test", split_bucket(key, buckets) == 0)


def standard_scale(df: DataFrame, features: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Centre and scale by mean and population deviation of the rows in `fit_on`.

    The fit is one aggregation whose single row (two numbers per feature) comes to the driver and
    goes back as literals. A constant feature is centred only.
    """
    fitted = df if fit_on is None else df.filter(fit_on)
    measures = []
    for name in features:
        measures += [F.avg(name).alias(f"m_{name}"), F.stddev_pop(name).alias(f"s_{name}")]
    stats = fitted.agg(*measures).first()

    def scaled(name: str) -> Column:
        mean, deviation = stats[f"m_{name}"] or 0.0, stats[f"s_{name}"] or 1.0
        return (F.col(name) - F.lit(mean)) / F.lit(deviation)

    return df.withColumns({name: scaled(name) for name in features})


class Logistic(NamedTuple):
    """Weights (intercept first) and the Newton decrement there: how far from the optimum they can be."""

    weights: list[float]
    decrement: float


def _row(features: Sequence[str]) -> Column:
    return F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])


def _margin(row: Column, weights: Sequence[float]) -> Column:
    products = F.zip_with(row, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def _probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def loss_terms(df: DataFrame, features: Sequence[str], weights: Sequence[float], label: str = "label") -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the penalised loss at `weights`, intercept first and not penalised.

    One aggregation of vector sums, combined before the shuffle; its single row holds (1 + features) squared
    numbers, however many rows there are.
    """
    rows = df.select(_row(features).alias("x"), F.col(label).cast("double").alias("y"))
    rows = rows.withColumn("p", _probability(_margin(F.col("x"), weights)))
    slope = F.transform("x", lambda v: v * (F.col("p") - F.col("y")))
    bend = F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: a * b * F.col("p") * (1 - F.col("p")))))
    sums = rows.select(Summarizer.sum(array_to_vector(slope)).alias("slope"), Summarizer.sum(array_to_vector(bend)).alias("bend")).first()
    penalty = np.array([0.0, *[1.0 / INVERSE_PENALTY] * len(features)])
    gradient = sums["slope"].toArray() + penalty * np.array(weights)
    return gradient, sums["bend"].toArray().reshape(len(penalty), -1) + np.diag(penalty)


def fit_logistic(train: DataFrame, features: Sequence[str], label: str = "label") -> Logistic:
    """L2 logistic regression, brought to its optimum; the penalty is per row here, hence the division by the row count.

    Where the library's iterations stop depends on its tolerance. Damped Newton steps from there, one pass over
    the rows each, end within CLOSE_ENOUGH of the one optimum, so equal rows give equal scores in any engine.
    Rows of one class have no optimum: the intercept is infinite then, and no steps are taken.
    """
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(train)
    rows = train.count()
    fitted = LogisticRegression(
        featuresCol="features",
        labelCol=label,
        regParam=1.0 / (INVERSE_PENALTY * max(rows, 1)),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=MAX_ITERATIONS,
    ).fit(vectors)
    weights = np.array([fitted.intercept, *fitted.coefficients.toArray()])
    decrement = math.inf
    if np.isfinite(weights).all():
        for _ in range(MAX_STEPS):
            gradient, curvature = loss_terms(train, features, weights, label)
            step = np.linalg.solve(curvature, gradient)
            before, decrement = decrement, math.sqrt(max(float(gradient @ step), 0.0))
            if not decrement < before:
                break
            weights = weights - step / (1 + decrement)
            if decrement < CLOSE_ENOUGH:
                break
    return Logistic([float(w) for w in weights], decrement)


def score_logistic(fitted: Logistic, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add `score`, the probability of class 1, and `prediction`; a tie goes to class 0."""
    scored = df.withColumn("_margin", _margin(_row(features), fitted.weights))
    return scored.select(
        *df.columns, _probability(F.col("_margin")).alias("score"), (F.col("_margin") > 0).cast("int").alias("prediction")
    )


def roc_auc(
    df: DataFrame,
    by: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
    *,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Area under the ROC curve per group, ties counted half.

    Rows are first reduced to one per score, written once. Negatives below each score are a running sum per group:
    the scores of a large group are cut into slices of equal numbers of distinct scores, as many as it takes.
    """
    y = F.col(label)
    counted = df.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )
    keys = list(by) or ["_all"]
    lined = running(
        settle(counted if by else counted.withColumn("_all", F.lit(0))),
        keys,
        ["_s"],
        total={"_upto": F.col("neg")},
        rows_per_slice=rows_per_slice,
    )
    area = F.col("pos") * (F.col("_upto") - F.col("neg") / 2)
    total = lined.groupBy(*by).agg(F.sum(area).alias("_area"), F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    return total.select(*by, ratio(F.col("_area"), F.col("_pos").cast("double") * F.col("_neg")).alias("roc_auc"))


def confusion_matrix(df: DataFrame, by: Sequence[str] = (), prediction: str = "prediction", label: str = "label") -> DataFrame:
    """One row per true class with the number of rows predicted as 0 and as 1."""
    return df.groupBy(*by, F.col(label).alias("y_true")).agg(
        F.count_if(F.col(prediction) == 0).alias("predicted_0"),
        F.count_if(F.col(prediction) == 1).alias("predicted_1"),
    )


def f1_accuracy(df: DataFrame, by: Sequence[str] = (), prediction: str = "prediction", label: str = "label") -> DataFrame:
    hit, said, true = F.col(prediction) == F.col(label), F.col(prediction) == 1, F.col(label) == 1
    tp = F.count_if(said & true)
    return df.groupBy(*by).agg(
        F.coalesce(ratio(2 * tp, F.count_if(said) + F.count_if(true)), F.lit(0.0)).alias("f1"),
        ratio(F.count_if(hit), F.count(F.lit(1))).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def run_experiment(
    df: DataFrame, features: Sequence[str], key: Sequence[str], label: str = "label", buckets: int = 4
) -> DataFrame:
    """Impute, split, scale on the training rows, fit, and score the held-out rows.

    The narrow feature rows are written once; fitting and scoring read those, not their sources.
    """
    rows = impute_zero(df.select(*key, label, *features), features)
    scaled = standard_scale(settle(train_test_split(rows, key, buckets)), features, ~F.col("is_test"))
    train = scaled.filter(~F.col("is_test"))
    return score_logistic(fit_logistic(train, features, label), scaled.filter("is_test"), features)


def experiment_report(scored: DataFrame, by: Sequence[str] = ("feature_set",), label: str = "label") -> DataFrame:
    """AUC, F1, accuracy and confusion counts per experiment."""
    y, p = F.col(label), F.col("prediction")
    counts = scored.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )
    metrics = f1_accuracy(scored, by, label=label).join(roc_auc(scored, by, label=label), list(by))
    return metrics.join(counts, list(by))
