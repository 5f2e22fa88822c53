"""One-hot blocks: the same run as with one column a category, at any vocabulary."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import blocks as bl
from tabforge.operators import features as fs
from tabforge.plans.training import TrainSpec, train
from tabforge.session import scratch_path
from tabforge.sources.store import Store

PIPES = [
    ["StandardScaler"], ["MinMaxScaler"], ["RobustScaler"], ["VarianceThreshold"], [("SelectKBest", {"k": 4})],
    [("SimpleImputer", {"strategy": "most_frequent"}), "StandardScaler", ("VarianceThreshold", {"threshold": 0.1})],
    [("MinMaxScaler", {"min": -2, "max": 3}), "StandardScaler", "RobustScaler", ("SelectKBest", {"k": "all"})],
    [("SelectKBest", {"k": 6, "score_func": "f_regression"}), "MinMaxScaler"], ["Normalizer"],
    [("PolynomialFeatures", {"degree": 2}), ("SelectKBest", {"k": 8})], ["StandardScaler", ("PCA", {"n_components": 2})],
]


def frame(spark, n=400):
    kind = F.when(F.col("id") % 11 == 3, None).otherwise(F.concat(F.lit("k"), (F.col("id") * 7 % 23 % 6)))
    return spark.range(0, n, 1, 3).select(
        F.col("id").alias("_row_id"), (F.col("id") * 37 % 101).cast("double").alias("x"), kind.alias("kind"),
        (F.col("id") % 3 == 0).alias("flag"), ((F.col("id") * 13 % 17) + F.col("id") * 7 % 23 % 6 * 3.0).alias("y"),
        F.concat(F.lit("c"), (F.col("id") * 7 % 23 % 6 + F.col("id") % 2).cast("int") % 3).alias("cls"))


def steps(pipe, estimator, params=None):
    pre = [{"name": p, "params": {}} if isinstance(p, str) else {"name": p[0], "params": p[1]} for p in pipe]
    return pre + [{"name": estimator, "category": "estimators", "params": params or {}}]


def as_columns(df):
    """The table with the slots as columns of numbers from the start."""
    return df.select("_row_id", "x", *[F.coalesce((F.col("kind") == f"k{i}").cast("double"), F.lit(0.0)).alias(f"kind_k{i}") for i in range(6)],
                     *[(F.col("flag").cast("string") == v).cast("double").alias(f"flag_{v}") for v in ("false", "true")], "y", "cls")


@pytest.mark.parametrize("pipe", PIPES, ids=lambda p: "-".join(x if isinstance(x, str) else x[0] for x in p))
def test_blocks_train_like_columns(spark, pipe):
    df = frame(spark)
    feats = ["x", "kind", "flag"]
    got = train(df, TrainSpec(target_column="y", feature_columns=feats, steps=steps(["OneHotEncoder", *pipe], "LinearRegression")))
    wide = as_columns(df)
    want = train(wide, TrainSpec(target_column="y", feature_columns=[c for c in wide.columns[1:-2]], steps=steps(pipe, "LinearRegression")))
    assert got.final_features == want.final_features
    a, b = ([r["predicted"] for r in run.predictions.orderBy("_row_id").collect()] for run in (got, want))
    np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-6)
    assert got.column_names == feats


@pytest.mark.parametrize("estimator,params", [("LogisticRegression", {}), ("KNeighborsClassifier", {}), ("SVC", {"kernel": "poly", "degree": 2}),
                                              ("RandomForestClassifier", {"n_estimators": 5, "max_depth": 4})])
def test_blocks_with_every_kind_of_learner(spark, estimator, params):
    df, pipe = frame(spark), ["StandardScaler"]
    got = train(df, TrainSpec(target_column="cls", feature_columns=["x", "kind"], steps=steps(["OneHotEncoder", *pipe], estimator, params)))
    wide = as_columns(df).drop("flag_false", "flag_true")
    want = train(wide, TrainSpec(target_column="cls", feature_columns=wide.columns[1:-2], steps=steps(pipe, estimator, params)))
    a, b = ([r["predicted"] for r in run.predictions.orderBy("_row_id").collect()] for run in (got, want))
    assert np.mean([x == y for x, y in zip(a, b)]) >= (1.0 if estimator in ("KNeighborsClassifier", "LogisticRegression") else 0.95)


def test_slot_statistics(spark):
    df = frame(spark).where("_row_id < 57")
    b = {"kind": bl.Block.of("kind", [f"k{i}" for i in range(7)])}  # k6 does not occur
    total, counts = bl.category_counts(df, b)
    z = np.array([[r["kind"] == f"k{i}" for i in range(7)] for r in df.collect()], float)
    assert total == len(z) and counts["kind"].tolist() == z.sum(0).tolist()
    for p in (0.25, 0.5, 0.75, 0.9):
        np.testing.assert_allclose(bl.slot_quantile(total, counts["kind"], p), np.quantile(z, p, axis=0))
    wide = df.select("cls", "y", *[(F.coalesce(F.col("kind") == f"k{i}", F.lit(False))).cast("double").alias(f"c{i}") for i in range(7)])
    for by_slot, by_column, label in ((bl.anova_f, fs.anova_f, "cls"), (bl.f_regression, fs.f_regression, "y")):
        want = by_column(wide, [f"c{i}" for i in range(7)], label)
        got = by_slot(df, b, label)["kind"]
        assert [v is None for v in got] == [v is None for v in want.values()]
        np.testing.assert_allclose([v for v in got if v is not None], [v for v in want.values() if v is not None], rtol=1e-9)


@pytest.mark.parametrize("mode", ["ignore", "error"])
def test_unknown_categories_of_a_stored_run(spark, mode):
    store = Store(spark, scratch_path(spark, "blocks"))
    df = frame(spark)
    run = train(df, TrainSpec(target_column="y", feature_columns=["x", "kind"], steps=[
        {"name": "OneHotEncoder", "params": {"handle_unknown": mode, "sparse": "false"}}, {"name": "StandardScaler"},
        {"name": "LinearRegression", "category": "estimators"}]))
    store.save_run(run)
    new = spark.createDataFrame([(1, 5.0, "k1"), (2, 5.0, None)], "_row_id long, x double, kind string")
    assert store.score(run.job_id, new).count() == 2
    odd = spark.createDataFrame([(1, 5.0, "never seen")], "_row_id long, x double, kind string")
    if mode == "ignore":
        missing, unknown = (store.score(run.job_id, d).where(w).first()["prediction"] for d, w in ((new, "kind is null"), (odd, "true")))
        assert unknown == pytest.approx(missing)
    else:
        with pytest.raises(Exception, match="unknown category"):
            store.score(run.job_id, odd).collect()


def many(spark, n, rows):
    return spark.range(0, rows, 1, 4).select(
        F.col("id").alias("_row_id"), F.concat(F.lit("v"), F.col("id") % n).alias("kind"),
        ((F.col("id") % n) % 2).cast("double").alias("x"), ((F.col("id") % n == 7).cast("double") * 50 + (F.col("id") % n) % 2).alias("y"))


def test_plan_does_not_grow_with_the_vocabulary(spark):
    sizes = []
    for n in (20, 2000):
        run = train(many(spark, n, 4000), TrainSpec(target_column="y", steps=steps(["OneHotEncoder", "StandardScaler"], "LinearRegression")))
        fitted = many(spark, n, 4000)
        for m in run.stages:
            fitted = m.transform(fitted)
        sizes.append(len(fitted._jdf.queryExecution().optimizedPlan().numberedTreeString()))
        assert len(run.feature_importance) > 0.9 * n
    assert sizes[1] < sizes[0] * 1.5


def test_a_hundred_thousand_categories(spark):
    df = many(spark, 100_000, 300_000)
    run = train(df, TrainSpec(target_column="y", steps=steps(
        ["OneHotEncoder", "VarianceThreshold", ("SelectKBest", {"k": 2})], "LinearRegression")))
    assert set(run.final_features) == {"x", "kind_v7"}
    assert run.metrics["r2"] > 0.999
