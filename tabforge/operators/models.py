"""Estimator registry: the reference's estimator names and parameters
mapped onto Spark ML learners (distributed training via treeAggregate).

Parameter translation (scikit-learn convention -> Spark ML):
* ``C`` (inverse penalty on the summed loss) -> ``regParam = 1 / (C * n_train)``
  since Spark averages the loss;
* ``max_depth`` -> ``maxDepth`` (above Spark's limit of 30 an error);
* ``n_estimators`` -> ``numTrees`` / ``maxIter``;
* ``tol`` -> ``tol`` with the reference estimators' own defaults (1e-3 for
  SVC, 1e-4 for LogisticRegression) instead of Spark's 1e-6;
* every learner is seeded with the run's ``random_state``.
"""

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.errors import InvalidParameter, UnknownStep
from tabforge.functions.columns import ROW_ID
from tabforge.operators.boosting import fit_softmax_boosting
from tabforge.operators.features import FeatureModel
from tabforge.operators.forest import fit_grid_forest

MAX_TREE_DEPTH = 30


@dataclass
class FittedEstimator:
    """A fitted learner plus how to read its outputs."""
    model: object
    is_classifier: bool
    n_classes: int
    has_probability: bool
    pre: object = None  # optional feature-map model applied before the learner

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.pre.transform(df) if self.pre is not None else df)


def _int(params, key, default):
    v = params.get(key, default)
    try:
        return int(float(v))
    except (TypeError, ValueError):
        raise InvalidParameter(f"{key} must be a number, got {v!r}")


def _float(params, key, default):
    v = params.get(key, default)
    try:
        return float(v)
    except (TypeError, ValueError):
        raise InvalidParameter(f"{key} must be a number, got {v!r}")


def _flag(params, key, default):
    v = params.get(key, default)
    return v if isinstance(v, bool) else str(v).strip().lower() == "true"


def _depth(params, default):
    d = _int(params, "max_depth", default)
    if d < 1:
        raise InvalidParameter("max_depth must be >= 1")
    if d > MAX_TREE_DEPTH:
        raise InvalidParameter(f"max_depth must be <= {MAX_TREE_DEPTH}, the learner's limit; got {d}")
    return d


class NystroemFeatures(FeatureModel):
    """Kernel feature map z(x) = K(x, L) U |D|^(-1/2) over landmark rows L,
    with K(L, L) = U D U' (Williams & Seeger, 2001): a linear learner on z is a
    kernel machine whose solution lies in the span of the landmarks. Applied
    per Arrow batch with numpy. ``rbf``: exp(-gamma |x - y|^2); ``sigmoid``:
    tanh(gamma x.y + coef0), an indefinite kernel, hence |D|."""

    @staticmethod
    def of(input_col: str, output_col: str, kernel: str, landmarks: np.ndarray, gamma: float, coef0: float):
        m = NystroemFeatures()
        m._set(featureCols=[input_col], outputCols=[output_col],
               state=json.dumps({"kernel": kernel, "gamma": gamma, "coef0": coef0, "landmarks": landmarks.tolist()}))
        return m

    @staticmethod
    def kernel(st: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if st["kernel"] == "sigmoid":
            return np.tanh(st["gamma"] * (x @ y.T) + st["coef0"])
        d2 = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
        return np.exp(-st["gamma"] * np.maximum(d2, 0.0))

    def _transform(self, df: DataFrame) -> DataFrame:
        import pandas as pd

        st, kernel = self.feature_state(), self.kernel
        land = np.array(st.pop("landmarks"), dtype=float)
        values, vectors = np.linalg.eigh(kernel(st, land, land))
        used = np.abs(values) > 1e-10 * np.abs(values).max()
        back = vectors[:, used] / np.sqrt(np.abs(values[used]))

        @F.pandas_udf("array<double>")
        def features(col: pd.Series) -> pd.Series:
            x = np.stack(col.to_numpy()) if len(col) else np.zeros((0, land.shape[1]))
            return pd.Series(list(kernel(st, x, land) @ back))

        (source,), (out,) = self.getOrDefault(self.featureCols), self.getOrDefault(self.outputCols)
        return df.withColumn(out, array_to_vector(features(vector_to_array(F.col(source)))))


def landmark_rows(train: DataFrame, features: str, wanted: int, n: int, seed: int) -> np.ndarray:
    """The ``wanted`` feature rows of least seeded hash of the row id, so the
    choice follows the data and never the layout. Only about four times as
    many candidates are ordered."""
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(ROW_ID)), F.lit(1 << 40))
    least = min(1 << 40, int((1 << 40) * (4 * wanted + 40) / max(n, 1)))
    rows = (train.select(h.alias("h"), F.col(ROW_ID).alias("i"), vector_to_array(F.col(features)).alias("x"))
            .where(F.col("h") < least).orderBy("h", "i").limit(wanted).collect())
    return np.array([r["x"] for r in rows], dtype=float)


def _scale_gamma(train: DataFrame, features: str, n_features: int) -> float:
    """1 / (features x variance of all values), the default width of a kernel."""
    from pyspark.ml.stat import Summarizer

    row = train.select(Summarizer.variance(F.col(features)).alias("v"), Summarizer.mean(F.col(features)).alias("m"),
                       Summarizer.count(F.col(features)).alias("n")).first()
    if not n_features or not row["n"]:
        return 1.0
    mean, within = row["m"].toArray(), row["v"].toArray() * (row["n"] - 1) / row["n"]
    var = float(np.mean(within + mean ** 2) - np.mean(mean) ** 2)
    return 1.0 / (n_features * var) if var > 0 else 1.0


def fit_estimator(name: str, params: dict, train: DataFrame, features: str, label: str,
                  n_classes: int, seed: int, n_features: int, n_rows: int | None = None,
                  plain: DataFrame | None = None) -> FittedEstimator:
    """Fit the named estimator on ``train`` (vector column ``features``);
    ``plain`` has the same rows with a column a feature, then ``y``."""
    params = dict(params or {})
    n = n_rows

    def n_train():
        nonlocal n
        if n is None:
            n = train.count()
        return max(n, 1)

    if name == "RandomForestClassifier":
        m = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=_int(params, "n_estimators", 100),
                                   maxDepth=_depth(params, 10), featureSubsetStrategy="sqrt", bootstrap=_flag(params, "bootstrap", True), seed=seed).fit(train)
        return FittedEstimator(m, True, n_classes, True)
    if name == "RandomForestRegressor":
        trees, depth, bootstrap = _int(params, "n_estimators", 100), _depth(params, 10), _flag(params, "bootstrap", True)
        m = fit_grid_forest(train, features, label, n_train(), n_features, trees, depth, bootstrap, seed, plain)
        if m is None:
            m = RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth,
                                      featureSubsetStrategy="all", bootstrap=bootstrap, seed=seed).fit(train)
        return FittedEstimator(m, False, 0, False)
    if name == "GradientBoostingClassifier":
        rounds, rate, depth = _int(params, "n_estimators", 100), _float(params, "learning_rate", 0.1), _depth(params, 3)
        if n_classes <= 2:
            gbt = GBTClassifier(featuresCol=features, labelCol=label, maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed)
            return FittedEstimator(gbt.fit(train), True, n_classes, True)
        return FittedEstimator(fit_softmax_boosting(train, features, label, n_classes, n_features, rounds, rate, depth, seed),
                               True, n_classes, True)
    if name == "LogisticRegression":
        C = _float(params, "C", 1.0)
        if C <= 0:
            raise InvalidParameter("C must be > 0")
        m = LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / (C * n_train()),
                               elasticNetParam=0.0, standardization=False, tol=_float(params, "tol", 1e-4),
                               maxIter=_int(params, "max_iter", 100)).fit(train)
        return FittedEstimator(m, True, n_classes, True)
    if name == "LinearRegression":
        m = LinearRegression(featuresCol=features, labelCol=label, regParam=0.0, solver="auto").fit(train)
        return FittedEstimator(m, False, 0, False)
    if name == "SVC":
        C = _float(params, "C", 1.0)
        if C <= 0:
            raise InvalidParameter("C must be > 0")
        kernel = params.get("kernel", "rbf")
        pre = None
        col = features
        if kernel in ("rbf", "sigmoid"):
            gamma = params.get("gamma", "scale")
            gamma = (_scale_gamma(train, features, n_features) if gamma == "scale" else 1.0 / max(n_features, 1) if gamma == "auto"
                     else _float(params, "gamma", 1.0))
            land = landmark_rows(train, features, _int(params, "n_components", 200), n_train(), seed)
            pre = NystroemFeatures.of(features, "__kernel", kernel, land, gamma, _float(params, "coef0", 0.0))
            col = "__kernel"
        elif kernel == "poly":
            pre = PolynomialExpansion(inputCol=features, outputCol="__poly", degree=_int(params, "degree", 3))
            col = "__poly"
        elif kernel != "linear":
            raise InvalidParameter(f"SVC kernel {kernel!r} is not supported (linear, rbf, poly, sigmoid)")
        # the mapped features are computed once and reused by every solver pass
        data = pre.transform(train).select(col, label).persist() if pre is not None else train
        svc = LinearSVC(featuresCol=col, labelCol=label, regParam=1.0 / (C * n_train()),
                        tol=_float(params, "tol", 1e-3), maxIter=_int(params, "max_iter", 100),
                        standardization=False)
        if n_classes > 2:
            svc = OneVsRest(classifier=svc, featuresCol=col, labelCol=label, parallelism=4)
        try:
            fitted = svc.fit(data)
        finally:
            if pre is not None:
                data.unpersist()
        return FittedEstimator(fitted, True, n_classes, False, pre=pre)
    if name == "KNeighborsClassifier":
        from tabforge.operators.knn import KNNClassifier

        m = KNNClassifier(k=_int(params, "n_neighbors", 5), weights=params.get("weights", "uniform"),
                          features_col=features, label_col=label).fit(train)
        return FittedEstimator(m, True, n_classes, True)
    raise UnknownStep(name)


ESTIMATORS = {
    "RandomForestClassifier": True,
    "RandomForestRegressor": False,
    "GradientBoostingClassifier": True,
    "LogisticRegression": True,
    "LinearRegression": False,
    "SVC": True,
    "KNeighborsClassifier": True,
}


def needs_columns(name: str, params: dict) -> bool:
    """Whether a constant added to a feature changes what the learner learns
    (polynomials and inner products without an intercept): one-hot slots must
    then carry their shifts."""
    return name == "SVC" and (params or {}).get("kernel", "rbf") in ("poly", "sigmoid")


def feature_importance(fitted: FittedEstimator, names: list[str]) -> list[dict]:
    """Importances (trees) or |coefficients| (linear), paired with the
    final feature names, largest first. Multiclass linear models average
    |coef| over classes; one-vs-rest averages over its sub-models."""
    m = fitted.model
    vals = None
    if hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray()
    elif hasattr(m, "coefficientMatrix") and m.numClasses > 2:
        vals = np.abs(m.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(m, "coefficients"):
        vals = np.abs(m.coefficients.toArray())
    elif hasattr(m, "models"):
        subs = []
        for sm in m.models:
            if hasattr(sm, "featureImportances"):
                subs.append(sm.featureImportances.toArray())
            elif hasattr(sm, "coefficients"):
                subs.append(np.abs(sm.coefficients.toArray()))
        if subs:
            vals = np.mean(subs, axis=0)
    if vals is None or fitted.pre is not None:
        return []
    pairs = [{"feature": n, "importance": float(v)} for n, v in zip(names, vals)]
    return sorted(pairs, key=lambda d: d["importance"], reverse=True)
