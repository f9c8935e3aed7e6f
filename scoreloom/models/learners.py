"""Base learners: fit on labelled rows, score every row, one (id, score) table each."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
)
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..operators.evaluate import stratified_folds
from ..operators.scaling import Prepared
from ..session import cut_lineage

FEATURES = "_features"
SEED = 1


def with_vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES).transform(df)


def positive_probability(column: str = "probability"):
    return vector_to_array(F.col(column))[1]


def scores_of(model, rows: DataFrame, id: str, name: str = "score") -> DataFrame:
    return model.transform(rows).select(id, positive_probability().alias(name))


def fit_and_score(data: Prepared, estimator, name: str) -> DataFrame:
    """Fit on the labelled rows and score labelled and unlabelled rows alike."""
    rows = with_vector(data.frame, data.features)
    model = estimator.fit(rows.filter(F.col(data.label).isNotNull()))
    return scores_of(model, rows, data.id, name)


def learner(estimator, features: Sequence[str]) -> Callable:
    """The ``learn`` argument of ``stack.cross_fit`` for an estimator."""

    def learn(labelled: DataFrame):
        model = estimator.fit(with_vector(labelled, features))
        return lambda rows, name: model.transform(with_vector(rows, features)).select(*rows.columns, positive_probability().alias(name))

    return learn


def _common(label: str) -> dict:
    return {"featuresCol": FEATURES, "labelCol": label}


# ----------------------------------------------------------------- linear

# Class weights, inverse regularisation and L2 strength.
CLASS_WEIGHTS = (0.1, 0.9)
INVERSE_L2 = 0.2
SGD_ALPHA = 0.01
SVM_C = 1.0


def logistic_regression(data: Prepared, name: str = "logistic_regression", tol: float = 1e-4) -> DataFrame:
    """Class-weighted logistic regression; the penalty is scaled to the weighted mean loss."""
    weight = F.when(F.col(data.label) == 1, CLASS_WEIGHTS[1]).otherwise(CLASS_WEIGHTS[0])
    weighted = Prepared(data.frame.withColumn("_weight", weight), data.features, data.id, data.label)
    total = weighted.labelled.agg(F.sum("_weight")).first()[0]
    model = LogisticRegression(
        weightCol="_weight", regParam=1.0 / (INVERSE_L2 * total), standardization=False, maxIter=800, tol=tol,
        **_common(data.label),
    )
    return fit_and_score(weighted, model, name)


def sgd_logistic(data: Prepared, name: str = "sgd_log_loss", tol: float = 1e-6) -> DataFrame:
    """L2 logistic loss at the same strength, solved to its optimum."""
    model = LogisticRegression(regParam=SGD_ALPHA, standardization=False, tol=tol, **_common(data.label))
    return fit_and_score(data, model, name)


def linear_svm(data: Prepared, name: str = "pca20_svm_linear_kernel", folds: int = 5) -> DataFrame:
    """Linear support vectors at C = 1; the probability is a sigmoid fitted to the margins of held-out folds."""
    rows = cut_lineage(with_vector(data.frame, data.features).select(data.id, data.label, FEATURES))
    folded = cut_lineage(stratified_folds(rows, data.id, data.label, folds))
    counts = {r["fold"]: r["n"] for r in folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())

    def margins(train: DataFrame, n: int, scored: DataFrame) -> DataFrame:
        svm = LinearSVC(regParam=1.0 / (SVM_C * max(n, 1)), standardization=False, rawPredictionCol="_raw", **_common(data.label))
        return svm.fit(train).transform(scored).select(data.id, data.label, vector_to_array("_raw")[1].alias("_margin"))

    def held_out(k: int) -> DataFrame:
        return margins(folded.filter(F.col("fold") != k), total - counts[k], folded.filter(F.col("fold") == k))

    with ThreadPool(folds + 1) as pool:  # the fits wait for Spark, not for each other
        last = pool.apply_async(margins, (folded, total, rows))
        apart = pool.map(held_out, sorted(counts))
        scored = last.get()
    slope, level = sigmoid(cut_lineage(reduce(DataFrame.unionByName, apart)), "_margin", data.label)
    return scored.select(data.id, (1 / (1 + F.exp(F.col("_margin") * slope + level))).alias(name))


def sigmoid(scored: DataFrame, margin: str, label: str, steps: int = 100) -> tuple[float, float]:
    """(A, B) of 1 / (1 + exp(A margin + B)) with the least log loss against smoothed labels, by Newton steps of one aggregate each.

    With p rows of class 1 and n of class 0 the targets are (p + 1) / (p + 2) and 1 / (n + 2).
    """
    p, n = scored.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    target = F.when(F.col(label) == 1, (p + 1.0) / (p + 2.0)).otherwise(1.0 / (n + 2.0))
    rows = scored.select(F.col(margin).alias("f"), target.alias("t"))

    def sums(a: float, b: float):
        z = F.col("f") * a + F.lit(b)
        q = 1 / (1 + F.exp(z))  # the probability of class 1
        loss = F.col("t") * z + F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        off, w = F.col("t") - q, q * (1 - q)
        cells = [loss, off * F.col("f"), off, w * F.col("f") * F.col("f"), w * F.col("f"), w]
        return rows.agg(*[F.sum(c).alias(f"c{i}") for i, c in enumerate(cells)]).first()

    a, b = 0.0, math.log((n + 1.0) / (p + 1.0))
    loss, ga, gb, haa, hab, hbb = sums(a, b)
    for _ in range(steps):
        if max(abs(ga), abs(gb)) < 1e-8:
            break
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = haa * hbb - hab * hab
        da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        if -(ga * da + gb * db) < 1e-12 * max(1.0, loss):  # all that is left to gain is lost in the loss's own rounding
            a, b = a + da, b + db
            break
        size = 1.0
        while size > 1e-10:
            found = sums(a + size * da, b + size * db)
            if found[0] < loss + 1e-4 * size * (ga * da + gb * db) or found[0] == loss:
                break
            size /= 2
        else:
            break
        a, b = a + size * da, b + size * db
        loss, ga, gb, haa, hab, hbb = found
    return a, b


# ----------------------------------------------------------------- others


def gaussian_mixture(data: Prepared, name: str = "gaussian_mixture") -> DataFrame:
    """Posterior of the second of two unsupervised components, fitted on labelled rows."""
    rows = with_vector(data.frame, data.features)
    model = GaussianMixture(k=2, seed=SEED, featuresCol=FEATURES).fit(rows.filter(F.col(data.label).isNotNull()))
    return scores_of(model, rows, data.id, name)
