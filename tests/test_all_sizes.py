"""One behaviour at every size, any column name, any stored model."""

import math

import pytest
from pyspark.sql import functions as F

from tabforge.errors import InvalidParameter
from tabforge.operators import features as fs
from tabforge.operators import profile
from tabforge.operators.clean import filter_predicate
from tabforge.plans.cleaning import apply_ops
from tabforge.plans.training import TrainSpec, train
from tabforge.session import scratch_path
from tabforge.sources.scan import scan_csv
from tabforge.sources.store import Store


def frame(spark, n=240, parts=3):
    return spark.range(0, n, 1, parts).select(
        F.col("id").alias("_row_id"), (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"),
        F.concat(F.lit("c"), F.col("id") % 3).alias("y"), ((F.col("id") % 17) * 2 + 1).cast("double").alias("line"))


@pytest.mark.parametrize("n", [255, 257])
def test_one_hot_training_at_any_vocabulary(spark, n):
    df = spark.range(0, 4 * n, 1, 2).select(
        F.col("id").alias("_row_id"), F.concat(F.lit("k"), F.col("id") % n).alias("kind"), (F.col("id") % n).cast("double").alias("y"))
    df = df.withColumn("kind", F.when(F.col("_row_id") != 3, F.col("kind")))
    model = fs.OneHotEncoder(handle_unknown="error")
    model._set(featureCols=["kind"])
    fitted = model.fit(df)
    assert len(fitted.output_columns()) == n
    row = fitted.transform(df).where("_row_id = 3").drop("_row_id", "y").first()
    assert sum(row) == 0.0


def test_sparse_one_hot_trains_with_category_names(spark):
    df = frame(spark)
    run = train(df, TrainSpec(target_column="line", feature_columns=["y", "x"], steps=[
        {"name": "OneHotEncoder", "params": {"sparse": True}}, {"name": "LinearRegression", "category": "estimators"}]))
    assert {f["feature"] for f in run.feature_importance} == {"y_c0", "y_c1", "y_c2", "x"}
    assert run.metrics["r2"] > 0.999


@pytest.mark.parametrize("n", [15, 16])
def test_profile_of_empty_tables(spark, n):
    empty = spark.createDataFrame([], ", ".join(f"c{i} double" for i in range(n)))
    rows = profile.describe_columns(empty).collect()
    assert len(rows) == n and all(r["null_count"] == 0 and r["mean"] is None for r in rows)
    assert profile.describe_dataset(empty)["columns"] == n


@pytest.mark.parametrize("estimator,target", [("LogisticRegression", "y"), ("LinearRegression", "line")])
def test_missing_targets_are_refused(spark, estimator, target):
    df = frame(spark).withColumn(target, F.when(F.col("_row_id") != 9, F.col(target)))
    with pytest.raises(InvalidParameter, match="missing"):
        train(df, TrainSpec(target_column=target, feature_columns=["x"], steps=[{"name": estimator, "category": "estimators"}]))


def test_depth_beyond_the_learner_is_refused(spark):
    with pytest.raises(InvalidParameter, match="max_depth"):
        train(frame(spark), TrainSpec(target_column="y", feature_columns=["x"], steps=[
            {"name": "RandomForestClassifier", "category": "estimators", "params": {"max_depth": "50"}}]))


def test_forest_does_not_depend_on_partitions(spark):
    spec = TrainSpec(target_column="y", feature_columns=["x", "z"], steps=[
        {"name": "RandomForestClassifier", "category": "estimators", "params": {"n_estimators": "5", "max_depth": "4"}}])
    runs = [train(frame(spark).repartition(p), spec) for p in (1, 7)]
    a, b = (sorted(map(tuple, r.predictions.select("_row_id", "predicted", "probability").collect())) for r in runs)
    assert a == b


def test_boosting_gives_class_probabilities(spark):
    run = train(frame(spark), TrainSpec(target_column="y", feature_columns=["x", "z"], steps=[
        {"name": "GradientBoostingClassifier", "category": "estimators", "params": {"n_estimators": "3"}}]))
    p = [r.probability for r in run.predictions.collect()]
    assert all(1 / 3 <= v <= 1 for v in p)


@pytest.mark.parametrize("op", ["==", "!=", ">", "<", ">=", "<="])
@pytest.mark.parametrize("column,value", [("a", "7"), ("b", "7"), ("c", "7.5"), ("t", "2020-01-02"), ("s", "k3")])
def test_filters_reach_the_scan(spark, filtered_table, op, column, value):
    if (column, op) == ("c", "!="):
        return  # keeps NaN as well, which no scan filter can say
    df = spark.read.parquet(filtered_table)
    plan = df.where(filter_predicate(df, column, op, value))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters: ["):].split("]", 1)[0]
    name = {"==": "EqualTo", "!=": "EqualNullSafe", ">": "GreaterThan(", "<": "LessThan(", ">=": "GreaterThanOrEqual",
            "<=": "LessThanOrEqual"}[op]
    assert f"{name.rstrip('(')}({column}," in pushed, pushed


@pytest.fixture(scope="module")
def filtered_table(spark):
    path = scratch_path(spark, "filters")
    (spark.range(50).select(F.col("id").cast("int").alias("a"), F.col("id").alias("b"), F.col("id").cast("double").alias("c"),
                            F.timestamp_seconds(F.col("id") + 1_577_836_800).cast("timestamp_ntz").alias("t"),
                            F.concat(F.lit("k"), "id").alias("s")).write.parquet(path))
    return path


def test_narrow_integer_casts_check_the_range(spark):
    df = spark.createDataFrame([(3_000_000_000, 5, 2.0**31), (1, 6, 1.0)], "a long, b long, c double")
    ops = [{"op": "cast_dtype", "params": {"column": c, "dtype": "int32"}} for c in "abc"]
    assert apply_ops(df, ops).dtypes == [("a", "bigint"), ("b", "int"), ("c", "double")]


def test_perfect_and_partial_correlations(spark):
    df = frame(spark).withColumn("part", F.when(F.col("_row_id") % 2 == 0, F.col("line")))
    scores = fs.f_regression(df, ["x", "part", "z"], "line")
    assert scores["x"] == math.inf and scores["part"] == math.inf and scores["z"] < 100


def test_rfe_refuses_gaps(spark):
    df = frame(spark).withColumn("x", F.when(F.col("_row_id") != 9, F.col("x")))
    step = fs.RFE(n_features_to_select=1)
    step._set(featureCols=["x", "z"], labelCol="line")
    with pytest.raises(InvalidParameter, match="missing"):
        step.fit(df)


def test_rows_longer_than_the_header_are_refused(spark, tmp_path):
    (tmp_path / "long.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    with pytest.raises(Exception, match="more than the 2 fields"):
        scan_csv(spark, str(tmp_path / "long.csv")).collect()
    (tmp_path / "short.csv").write_text("a,b\n1,2\n3\n")
    assert sorted(tuple(r)[:2] for r in scan_csv(spark, str(tmp_path / "short.csv")).select("a", "b").collect()) == [(1, 2.0), (3, None)] or \
        sorted(tuple(r) for r in scan_csv(spark, str(tmp_path / "short.csv")).select("a", "b").collect()) == [(1, 2), (3, None)]


def test_repeated_headers_train(spark, tmp_path):
    lines = ["a,a,it's"] + [f"{i % 7},{i % 3},{2 * (i % 7) + 1}" for i in range(60)]
    (tmp_path / "twice.csv").write_text("\n".join(lines) + "\n")
    st = Store(spark, str(tmp_path / "store"))
    ds = st.ingest(str(tmp_path / "twice.csv"), multiline=False)["id"]
    run = st.train(TrainSpec(target_column="it's", dataset_id=ds, steps=[
        {"name": "SimpleImputer", "params": {"strategy": "most_frequent"}}, {"name": "LinearRegression", "category": "estimators"}]))
    assert run.column_names == ["a", "a.1"] and run.metrics["r2"] > 0.999


@pytest.mark.parametrize("name,params", [("SVC", {"max_iter": "5"}), ("KNeighborsClassifier", {"n_neighbors": "3"}),
                                         ("GradientBoostingClassifier", {"n_estimators": "2"})])
def test_every_run_keeps_a_model(spark, tmp_path, name, params):
    frame(spark).drop("_row_id").coalesce(1).write.parquet(str(tmp_path / "in.parquet"))
    st = Store(spark, str(tmp_path / "store"))
    ds = st.ingest(str(tmp_path / "in.parquet"))["id"]
    run = st.train(TrainSpec(target_column="y", feature_columns=["x", "z"], dataset_id=ds, steps=[
        {"name": "StandardScaler"}, {"name": name, "category": "estimators", "params": params}]))
    want = {r["_row_id"]: r.predicted for r in run.predictions.collect()}
    got = {r["_row_id"]: r.predicted for r in st.score(run.job_id, st.load(ds)).select("_row_id", "predicted").collect()}
    assert {k: got[k] for k in want} == want


def test_registered_steps_can_be_used(spark):
    @fs.register_step("Doubler")
    class Doubler(fs.StandardScaler):
        def _fit_state(self, df, cols):
            return {c: (0.0, 0.5) for c in cols}, cols

    try:
        run = train(frame(spark), TrainSpec(target_column="line", feature_columns=["x"], steps=[
            {"name": "Doubler"}, {"name": "LinearRegression", "category": "estimators"}]))
        assert run.feature_importance[0]["importance"] == pytest.approx(1.0)
    finally:
        fs.STEP_CLASSES.pop("Doubler")


def test_prefix_of_a_statistic_is_computed_once(spark):
    df = frame(spark).withColumn("x", F.when(F.col("_row_id") % 4 != 0, F.col("x")))
    ops = [{"op": "drop_duplicates", "params": {"subset": ["line", "y"]}},
           {"op": "fill_missing", "params": {"column": "x", "strategy": "median"}}]
    out = apply_ops(df, ops)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # the de-duplicated prefix is read, not computed again
    values = sorted(r.x for r in out.collect())
    kept = {}
    for r in df.orderBy("_row_id").collect():
        kept.setdefault((r.line, r.y), r.x)
    known = sorted(v for v in kept.values() if v is not None)
    half = len(known) // 2
    median = known[half] if len(known) % 2 else (known[half - 1] + known[half]) / 2
    assert values == sorted(median if v is None else v for v in kept.values())
