"""Training runs: closed-form checks, determinism, quality and refusals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.errors import InvalidParameter, UnknownStep
from tabforge.functions.columns import ROW_ID
from tabforge.plans.cleaning import apply_ops
from tabforge.operators.models import NystroemFeatures, landmark_rows
from tabforge.plans.training import TrainSpec, train
from tabforge.queries.model_queries import embeddings_wide
from tabforge.sources.store import Store

SF = "/root/testdata/sf0.01"
EST = "estimators"


def lineitem(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias(ROW_ID), "l_quantity",
                     "l_extendedprice", "l_returnflag", "l_discount")


def test_linear_regression_matches_normal_equations(spark):
    df = lineitem(spark)
    run = train(df, TrainSpec("l_extendedprice", [{"name": "LinearRegression", "category": EST}],
                              feature_columns=["l_quantity", "l_discount"]))
    preds = run.predictions
    n = preds.count()
    assert n == math.ceil(0.2 * df.count())
    # refit by numpy on the same training rows
    test_ids = {r[0] for r in preds.select(ROW_ID).collect()}
    rows = [r for r in df.collect() if r[ROW_ID] not in test_ids]
    X = np.array([[1.0, r["l_quantity"], r["l_discount"]] for r in rows])
    y = np.array([r["l_extendedprice"] for r in rows])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    model = run.stages[-1].model
    assert model.intercept == pytest.approx(beta[0], rel=1e-6)
    assert list(model.coefficients) == pytest.approx(list(beta[1:]), rel=1e-6)
    assert set(run.metrics) == {"r2", "mse", "rmse"}
    assert run.metrics["rmse"] == pytest.approx(math.sqrt(run.metrics["mse"]))
    assert preds.where(F.abs(F.col("residual") - (F.col("actual") - F.col("predicted"))) > 1e-9).count() == 0


def test_classifier_beats_majority_and_is_deterministic(spark):
    # the generated columns are independent, so the target is derived from a
    # feature: a learner must find the threshold on l_discount
    df = lineitem(spark).withColumn("high_discount", (F.col("l_discount") > 0.05).cast("int"))
    steps = [{"name": "StandardScaler"}, {"name": "LogisticRegression", "category": EST}]
    spec = TrainSpec("high_discount", steps, feature_columns=["l_quantity", "l_discount"])
    a, b = train(df, spec), train(df, spec)
    assert a.metrics["accuracy"] == b.metrics["accuracy"]
    counts = [r["count"] for r in a.predictions.groupBy("actual").count().collect()]
    assert a.metrics["accuracy"] > max(counts) / sum(counts)
    cm = a.metrics["confusion_matrix"]
    assert sum(map(sum, cm)) == a.predictions.count() and len(cm) == len(cm[0])
    assert a.feature_importance and a.feature_importance[0]["importance"] >= a.feature_importance[-1]["importance"]


def test_text_target_is_decoded(spark):
    df = lineitem(spark)
    run = train(df, TrainSpec("l_returnflag", [{"name": "RandomForestClassifier", "category": EST,
                                                "params": {"n_estimators": 5, "max_depth": 3}}],
                              feature_columns=["l_quantity", "l_discount"]))
    got = {r[0] for r in run.predictions.select("predicted").distinct().collect()}
    assert got <= {"A", "N", "R"}
    assert run.predictions.where(F.col("probability").isNull()).count() == 0


def test_refusals(spark):
    df = lineitem(spark)
    with pytest.raises(InvalidParameter):
        train(df, TrainSpec("l_extendedprice", [{"name": "StandardScaler"}]))
    with pytest.raises(UnknownStep):
        train(df, TrainSpec("l_extendedprice", [{"name": "Magic", "category": EST}]))
    with pytest.raises(InvalidParameter):
        train(df, TrainSpec("l_returnflag", [{"name": "LinearRegression", "category": EST}]))
    with pytest.raises(InvalidParameter):
        train(df.withColumnRenamed("l_discount", "residual"),
              TrainSpec("l_extendedprice", [{"name": "LinearRegression", "category": EST}]))
    with pytest.raises(InvalidParameter):  # text features must be encoded first
        train(df, TrainSpec("l_extendedprice", [{"name": "LinearRegression", "category": EST}]))


def test_renamed_column_reaches_training(spark):
    df = apply_ops(lineitem(spark), [("rename_column", {"old_name": "l_quantity", "new_name": "qty"}),
                                     ("drop_columns", {"columns": ["l_returnflag"]})])
    run = train(df, TrainSpec("l_extendedprice", [{"name": "LinearRegression", "category": EST}]))
    assert "qty" in run.predictions.columns
    assert {d["feature"] for d in run.feature_importance} == {"qty", "l_discount"}


def test_predictions_vary(spark):
    df = lineitem(spark)
    run = train(df, TrainSpec("l_extendedprice", [{"name": "RandomForestRegressor", "category": EST,
                                                   "params": {"n_estimators": 5, "max_depth": 4}}],
                              feature_columns=["l_quantity", "l_discount"]))
    assert run.predictions.select("predicted").distinct().count() > 1


def _plane(spark, rule, n=1500):
    df = spark.range(0, n, 1, 3).select(F.col("id").alias("_row_id"), *[
        (F.pmod(F.xxhash64(F.lit(s), "id"), F.lit(100_000)) / 25_000 - 2).alias(c) for s, c in ((1, "a"), (2, "b"))])
    return df.withColumn("label", F.when(rule(F.col("a"), F.col("b")), "in").otherwise("out"))


CURVES = {"rbf": lambda a, b: a * a + b * b < 2.5, "sigmoid": lambda a, b: b > F.sin(2.5 * a)}


@pytest.mark.parametrize("kernel", list(CURVES))
def test_kernels_learn_curves(spark, kernel, store_root):
    df = _plane(spark, CURVES[kernel])
    params = {"rbf": {"kernel": "rbf", "C": 100}, "sigmoid": {"kernel": "sigmoid", "C": 1000, "gamma": 1.0, "max_iter": 300}}[kernel]

    def run(p):
        return train(df, TrainSpec("label", [{"name": "SVC", "category": EST, "params": p}], feature_columns=["a", "b"]))

    curved, straight = run(params), run({"kernel": "linear"})
    assert curved.metrics["accuracy"] > 0.93 > straight.metrics["accuracy"] + 0.02
    store = Store(spark, f"{store_root}/{kernel}")
    store.save_run(curved)
    scored = store.score(curved.job_id, df).join(curved.predictions.select("_row_id", F.col("predicted").alias("p")), "_row_id")
    assert scored.count() == 300 and scored.where("predicted <> p").count() == 0


def test_nystroem_features_give_the_kernel_back(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "_row_id long, x array<double>")
    df = df.select("_row_id", array_to_vector("x").alias("v"))
    land = landmark_rows(df, "v", 100, 40, seed=1)
    assert len(land) == 40 and sorted(map(tuple, land)) == sorted(map(tuple, x))
    assert np.array_equal(landmark_rows(df.repartition(7), "v", 12, 40, seed=1), landmark_rows(df, "v", 12, 40, seed=1))
    m = NystroemFeatures.of("v", "z", "rbf", land, 0.7, 0.0)
    rows = m.transform(df).orderBy("_row_id").select(vector_to_array("z").alias("z")).collect()
    z = np.array([r["z"] for r in rows])
    want = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(2))
    np.testing.assert_allclose(z @ z.T, want, atol=1e-6)


@pytest.mark.parametrize("kernel", ["linear", "rbf", "poly", "sigmoid"])
def test_svc_kernels(spark, kernel):
    df = embeddings_wide(spark, SF).where(F.col("label") < 2)
    run = train(df, TrainSpec("label", [{"name": "StandardScaler"},
                                        {"name": "SVC", "category": EST, "params": {"kernel": kernel}}],
                              feature_columns=[f"e{i}" for i in range(8)]))
    assert run.predictions.where(F.col("probability").isNotNull()).count() == 0
    assert 0.0 <= run.metrics["accuracy"] <= 1.0


def test_gbt_multiclass(spark):
    df = embeddings_wide(spark, SF).where(F.col("label") < 3)
    run = train(df, TrainSpec("label", [{"name": "GradientBoostingClassifier", "category": EST,
                                         "params": {"n_estimators": 3, "max_depth": 2}}],
                              feature_columns=[f"e{i}" for i in range(6)]))
    assert run.predictions.count() == math.ceil(0.2 * df.count())


def test_joint_boosting_beats_one_against_the_rest(spark, store_root):
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tabforge.operators.boosting import fit_softmax_boosting

    df = _plane(spark, lambda a, b: a > b).drop("label")
    odds = [F.exp(2 * (F.col("a") + F.col("b"))), F.exp(2 * (F.col("a") - F.col("b"))), F.exp(-3 * F.col("a"))]
    u = F.pmod(F.xxhash64(F.lit(3), "_row_id"), F.lit(100_000)) / 100_000 * (odds[0] + odds[1] + odds[2])
    df = df.withColumn("y", F.when(u < odds[0], 0).when(u < odds[0] + odds[1], 1).otherwise(2).cast("double"))
    data = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(df)
    fit, test = data.where("_row_id % 4 <> 0"), data.where("_row_id % 4 = 0")
    model = fit_softmax_boosting(fit, "f", "y", 3, 2, rounds=12, rate=0.3, depth=2, seed=1)
    p = model.transform(test).select("y", "prediction", vector_to_array("probability").alias("p")).collect()
    assert all(sum(r["p"]) == pytest.approx(1.0) for r in p)
    joint = -np.mean([np.log(r["p"][int(r["y"])]) for r in p])
    rest = OneVsRest(classifier=GBTClassifier(featuresCol="f", labelCol="y", maxIter=12, stepSize=0.3, maxDepth=2, seed=1),
                     featuresCol="f", labelCol="y").fit(fit).transform(test)
    odds = [(1 / (1 + np.exp(-2 * r["rawPrediction"].toArray())), int(r["y"])) for r in rest.select("rawPrediction", "y").collect()]
    assert joint < -np.mean([np.log(o[y] / o.sum()) for o, y in odds])
    assert np.mean([r["prediction"] == r["y"] for r in p]) > 0.8
    # more rounds than a checkpoint apart, the stored model, and importances of both features
    model.write().overwrite().save(f"{store_root}/boosting")
    again = type(model).load(f"{store_root}/boosting")
    x = np.array([[0.1, 0.2], [1.5, -1.0]])
    assert np.array_equal(again.raw_scores(x), model.raw_scores(x))
    assert model.featureImportances.toArray().sum() == pytest.approx(1.0) and (model.featureImportances.toArray() > 0.1).all()


def test_local_metrics_match_spark_metrics(spark):
    from tabforge.operators import evaluate as ev
    from tabforge.queries.evaluation_queries import predictions_multi

    p = predictions_multi(spark, SF)
    spark_row = ev.classification_metrics(p).first().asDict()
    local = ev.metrics_from_counts([tuple(r) for r in ev.confusion_counts(p).collect()])
    for k in ("accuracy", "precision", "recall", "f1"):
        assert local[k] == pytest.approx(spark_row[k], rel=1e-12)
    assert local["confusion_matrix"] == ev.confusion_matrix_array(p)


def test_a_table_of_a_few_hundred_thousand_values_is_learnt_in_several_tasks(spark):
    """One part held two million values, so a forest over half a million rows was one task."""
    from tabforge.plans.training import _spread

    df = spark.range(0, 300_000, 1, 3).select(F.col("id").alias(ROW_ID), (F.col("id") % 7).cast("double").alias("a"),
                                              F.concat(F.lit("k"), F.col("id") % 3).alias("b"))
    out = _spread(df, 300_000, ["a", "b"])
    assert out.rdd.getNumPartitions() == 6
    assert out.count() == 300_000 and out.select(ROW_ID).distinct().count() == 300_000
    again = _spread(df.repartition(5), 300_000, ["a", "b"])
    parts = [[[tuple(r) for r in p] for p in d.select(ROW_ID, "a", "b").rdd.glom().collect()] for d in (out, again)]
    assert parts[0] == parts[1]
    assert all(p == sorted(p, key=lambda r: (r[1], r[2], r[0])) for p in parts[0])
    assert _spread(df, 100_000, ["a", "b"]).rdd.getNumPartitions() == 1
