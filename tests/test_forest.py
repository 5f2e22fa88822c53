"""Regression forests grown from the sums of a grid's cells."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tabforge.functions.columns import ROW_ID
from tabforge.operators import forest
from tabforge.operators.models import fit_estimator
from tabforge.plans.training import TrainSpec, train
from tabforge.sources.store import Store

FOREST = {"name": "RandomForestRegressor", "category": "estimators"}


def _rows(spark, n: int, parts: int = 3):
    """Three features: 100 values, 7 values, and numbers that hardly repeat."""
    i = F.col("id")
    h = F.pmod(F.xxhash64(i), F.lit(1_000_003)) / 1_000_003
    return spark.range(0, n, 1, parts).select(
        i.alias(ROW_ID), (F.pmod(F.xxhash64(i, F.lit(1)), F.lit(100)) / 10).alias("a"),
        F.pmod(F.xxhash64(i, F.lit(2)), F.lit(7)).cast("double").alias("b"), h.alias("c"),
        (F.pmod(F.xxhash64(i, F.lit(3)), F.lit(100)) / 50).alias("y")).withColumn(
            "y", F.sin("a") * 10 + F.col("b") * F.col("c") + F.col("y"))


def _vectors(df, columns="abc"):
    return VectorAssembler(inputCols=list(columns), outputCol="f").transform(df).select(ROW_ID, "f", "y")


def test_a_forest_reads_the_rows_equally_often_whatever_its_depth(spark):
    """Every level was another pass in which each row was looked up in every tree."""
    n, data = 140_000, _vectors(_rows(spark, 140_000)).persist()
    assert data.count() == n
    jobs = []
    for depth in ("2", "8"):
        spark.sparkContext.setJobGroup(group := f"forest-{depth}", "")
        fit_estimator("RandomForestRegressor", {"n_estimators": "5", "max_depth": depth}, data, "f", "y", 0, 42, 3, n)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("other", "")
    data.unpersist()
    assert jobs[0] == jobs[1]


@pytest.mark.parametrize("columns", ["a", "ab", "abc"])
def test_one_tree_of_all_rows_is_sparks(spark, monkeypatch, columns):
    monkeypatch.setattr(forest, "GRID_FROM", 100)
    monkeypatch.setattr(forest, "GRID_MOST", 1 << 40)
    # Spark's learner takes its split points from all of up to 10,000 rows
    n, data = 9_000, _vectors(_rows(spark, 9_000), columns).persist()
    bounds, mean = forest._grid(data.select(forest.vector_to_array("f").alias("x"), "y"), len(columns))
    assert mean == pytest.approx(data.agg(F.avg("y")).first()[0], rel=1e-12)
    theirs = RandomForestRegressor(featuresCol="f", labelCol="y", numTrees=2, maxDepth=6, featureSubsetStrategy="all",
                                   bootstrap=False, seed=1).fit(data)
    ours = forest.fit_grid_forest(data, "f", "y", n, len(columns), 2, 6, False, 1)
    a, b = (np.array([r[0] for r in m.transform(data).orderBy(ROW_ID).select("prediction").collect()]) for m in (theirs, ours))
    data.unpersist()
    assert np.allclose(a, b, rtol=1e-9, atol=1e-9)
    assert np.allclose(theirs.featureImportances.toArray(), ours.featureImportances.toArray(), atol=1e-9)


def test_a_grid_forest_is_as_good_as_sparks_and_the_same_in_any_layout(spark, store_root):
    rows = _rows(spark, 170_000)
    spec = TrainSpec(target_column="y", feature_columns=["a", "b", "c"],
                     steps=[{**FOREST, "params": {"n_estimators": "10", "max_depth": "6"}}], dataset_id="d")
    runs = [train(rows.repartition(p), spec) for p in (2, 9)]
    assert isinstance(runs[0].stages[-1].model, forest.GridForestModel)
    a, b = (r.predictions.orderBy(ROW_ID).select("predicted").collect() for r in runs)
    assert a == b and len(a) == 34_000
    fitted = RandomForestRegressor(featuresCol="f", labelCol="y", numTrees=10, maxDepth=6, featureSubsetStrategy="all", seed=42)
    test = runs[0].predictions.select(ROW_ID)
    data = _vectors(rows)
    scored = fitted.fit(data.join(test, ROW_ID, "left_anti")).transform(data.join(test, ROW_ID))
    theirs = scored.agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
    assert runs[0].metrics["rmse"] == pytest.approx(theirs, rel=0.03)
    assert [d["feature"] for d in runs[0].feature_importance][0] == "a"
    # the stored model gives the predictions back
    store = Store(spark, store_root)
    store.save_run(runs[0])
    again = store.score(runs[0].job_id, rows.join(test, ROW_ID)).orderBy(ROW_ID).select("prediction").collect()
    assert [r[0] for r in again] == [r[0] for r in a]


def test_a_grid_finer_than_the_rows_is_left_to_sparks_learner(spark, monkeypatch):
    data = _vectors(_rows(spark, 5_000)).persist()
    assert forest.fit_grid_forest(data, "f", "y", 5_000, 3, 5, 4, True, 1) is None
    monkeypatch.setattr(forest, "GRID_FROM", 100)
    assert forest.fit_grid_forest(data, "f", "y", 5_000, 3, 5, 4, True, 1) is None
    endless = _vectors(_rows(spark, 5_000).withColumn("a", F.when(F.col(ROW_ID) == 7, F.lit(math.inf)).otherwise(F.col("a"))))
    with pytest.raises(Exception, match="finite"):
        forest.fit_grid_forest(endless, "f", "y", 5_000, 3, 5, 4, True, 1)
    data.unpersist()


def test_draws_are_poisson():
    table, steps = forest.poisson_table()
    drawn = forest.poisson_draws(np.random.default_rng(5), (20_000, 101), table, steps)
    assert drawn.shape == (20_000, 101)
    n = drawn.size
    for k in range(8):
        p = math.exp(-1) / math.factorial(k)
        assert abs((drawn == k).sum() - n * p) < 5 * math.sqrt(n * p)


def test_values_beyond_those_kept_close_equal_shares():
    x = np.random.default_rng(1).normal(size=50_000)
    v, n = forest.value_counts(x, 100)
    assert n.sum() == 50_000 and len(v) <= 100 and v[-1] == x.max() and abs(n - 500).max() <= 1
    points = forest.split_points(v, n)
    assert len(points) == 31
    shares = np.diff(np.searchsorted(np.sort(x), [-np.inf, *points, np.inf])) / len(x)
    assert abs(shares - 1 / 32).max() < 0.02
    assert forest.split_points(np.array([1.0, 2.0, 4.0]), np.array([5, 1, 1])) == [1.5, 3.0]


def test_plain_columns_give_the_forest_of_the_vectors(spark, monkeypatch):
    monkeypatch.setattr(forest, "GRID_FROM", 100)
    rows = _rows(spark, 9_000)
    vectors, plain = _vectors(rows), rows.select(F.col("a").alias("x0"), F.col("b").alias("x1"), F.col("c").alias("x2"), "y")
    a, b = (forest.fit_grid_forest(vectors, "f", "y", 9_000, 3, 5, 4, True, 1, p).feature_state() for p in (None, plain))
    assert a == b


def test_the_split_compares_hashes_as_text(spark, monkeypatch):
    """A number made of the hash's digits cost more a row than the hash, in each of four passes."""
    from tabforge.operators import split

    train_rows, test_rows = split.train_test_split(_rows(spark, 3_000), 0.2, 42)
    assert "conv(" not in test_rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert (train_rows.count(), test_rows.count()) == (2_400, 600)
    # rows of one key cannot be told apart: the cut ends all the same
    monkeypatch.setattr(split, "_FINAL_ROWS", 5)
    same = spark.range(100).select(F.lit(7).alias(ROW_ID))
    assert split.train_test_split(same, 0.2, 42)[1].count() == 100
