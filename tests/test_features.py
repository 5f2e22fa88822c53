"""Feature-step fixtures (scikit-learn conventions) and persistence."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabforge.errors import InvalidParameter
from tabforge.functions.columns import ROW_ID
from tabforge.operators import features as fs


def fit(step, df, cols, label=None):
    step._set(featureCols=cols)
    if label:
        step._set(labelCol=label)
    m = step.fit(df)
    return m, m.transform(df)


def values(df, cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(ROW_ID).collect()]


def two(spark, rows, schema="x double, y double"):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW_ID} bigint, {schema}")


def test_standard_scaler_population_std(spark):
    _, out = fit(fs.StandardScaler(), two(spark, [(1.0, 5.0), (3.0, 5.0)]), ["x", "y"])
    assert values(out, ["x", "y"]) == [(-1.0, 0.0), (1.0, 0.0)]


def test_minmax_constant_maps_to_min(spark):
    _, out = fit(fs.MinMaxScaler(min=-1, max=1), two(spark, [(1.0, 5.0), (3.0, 5.0)]), ["x", "y"])
    assert values(out, ["x", "y"]) == [(-1.0, -1.0), (1.0, -1.0)]


def test_robust_constant(spark):
    _, out = fit(fs.RobustScaler(), two(spark, [(1.0, 5.0), (3.0, 5.0), (5.0, 5.0)]), ["x", "y"])
    assert values(out, ["x", "y"]) == [(-1.0, 0.0), (0.0, 0.0), (1.0, 0.0)]


def test_normalizer_max_and_zero_row(spark):
    _, out = fit(fs.Normalizer(norm="max"), two(spark, [(1.0, 5.0), (0.0, 0.0)]), ["x", "y"])
    assert values(out, ["x", "y"]) == [(0.2, 1.0), (0.0, 0.0)]


def test_one_hot_unknown_is_zeros(spark):
    train = two(spark, [("b",), ("a",), ("b",)], "c string")
    m, _ = fit(fs.OneHotEncoder(), train, ["c"])
    assert m.output_columns() == ["c_a", "c_b"]
    out = m.transform(two(spark, [("zz",), ("a",), ("b",)], "c string"))
    assert values(out, ["c_a", "c_b"]) == [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]


def test_one_hot_error_mode(spark):
    m, _ = fit(fs.OneHotEncoder(handle_unknown="error"), two(spark, [("a",)], "c string"), ["c"])
    with pytest.raises(Exception):
        m.transform(two(spark, [("zz",)], "c string")).collect()


def test_polynomial_order(spark):
    m, out = fit(fs.PolynomialFeatures(degree=2), two(spark, [(1.0, 5.0)]), ["x", "y"])
    assert m.output_columns() == ["x", "y", "x^2", "x y", "y^2"]
    assert values(out, m.output_columns()) == [(1.0, 5.0, 1.0, 5.0, 25.0)]


def test_polynomial_bias(spark):
    m, _ = fit(fs.PolynomialFeatures(degree=2, include_bias=True), two(spark, [(1.0, 5.0)]), ["x", "y"])
    assert m.output_columns()[0] == "1"


def test_variance_threshold(spark):
    m, _ = fit(fs.VarianceThreshold(), two(spark, [(1.0, 5.0), (3.0, 5.0)]), ["x", "y"])
    assert m.output_columns() == ["x"]


def test_pca_centred(spark):
    m, out = fit(fs.PCA(n_components=1), two(spark, [(1.0, 5.0), (3.0, 5.0)]), ["x", "y"])
    got = [round(v[0], 9) for v in values(out, ["pca0"])]
    assert sorted(got) == [-1.0, 1.0]


def test_pca_too_many_components(spark):
    with pytest.raises(InvalidParameter):
        fit(fs.PCA(n_components=3), two(spark, [(1.0, 5.0), (3.0, 5.0)]), ["x", "y"])


def test_imputer_most_frequent_and_all_null_dropped(spark):
    df = two(spark, [(1.0, None), (None, None), (1.0, None), (2.0, None)])
    m, out = fit(fs.SimpleImputer(strategy="most_frequent"), df, ["x", "y"])
    assert m.output_columns() == ["x"]
    assert [v[0] for v in values(out, ["x"])] == [1.0, 1.0, 1.0, 2.0]


def test_select_k_best_anova(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        y = i % 3
        rows.append((i, float(y + rng.normal(0, 0.1)), float(rng.normal()), y))
    df = spark.createDataFrame(rows, f"{ROW_ID} bigint, signal double, noise double, y int")
    m, _ = fit(fs.SelectKBest(k=1), df, ["signal", "noise"], label="y")
    assert m.output_columns() == ["signal"]
    # closed form check of the F statistic
    data = np.array([(r[1], r[3]) for r in rows])
    groups = [data[data[:, 1] == g, 0] for g in range(3)]
    grand = data[:, 0].mean()
    ssb = sum(len(g) * (g.mean() - grand) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    f = (ssb / 2) / (ssw / (len(data) - 3))
    assert m.feature_state()["scores"]["signal"] == pytest.approx(f, rel=1e-9)


def test_models_persist_in_pipeline(spark, store_root):
    df = two(spark, [(1.0, 5.0), (3.0, 7.0), (4.0, 1.0)])
    m1, d1 = fit(fs.StandardScaler(), df, ["x", "y"])
    m2, d2 = fit(fs.PolynomialFeatures(degree=2), d1, ["x", "y"])
    path = store_root + "-pipe"
    PipelineModel(stages=[m1, m2]).write().overwrite().save(path)
    back = PipelineModel.load(path)
    assert values(back.transform(df), m2.output_columns()) == values(d2, m2.output_columns())


def test_anova_long_matches_wide(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 4, *[float(v) for v in rng.normal(size=18) + (i % 4) * np.arange(18) / 10]) for i in range(400)]
    cols = [f"f{j}" for j in range(18)]
    df = spark.createDataFrame(rows, f"{ROW_ID} bigint, y int, " + ", ".join(f"{c} double" for c in cols))
    long = fs.anova_f(df, cols, "y")
    wide = fs.anova_f(df, cols[:5], "y")
    for c in cols[:5]:
        assert long[c] == pytest.approx(wide[c], rel=1e-9)


def test_one_hot_vectors_of_a_wide_vocabulary_stay_sparse(spark):
    """Spelt out, 30,000 slots in 30,000 rows are 7 GB, and their names in the column's metadata grow with them."""
    from tabforge.operators import blocks

    n = 30_000
    df = spark.range(0, n, 1, 4).select("id", F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("kind"))
    df = df.withColumn("kind", F.when(F.col("id") != 5, F.col("kind")))
    model = fs.OneHotEncoder(sparse=True)
    model._set(featureCols=["kind"])
    fitted = model.fit(df)
    for limit in (blocks.BROADCAST_CATEGORIES, 10):
        blocks.BROADCAST_CATEGORIES, kept = limit, blocks.BROADCAST_CATEGORIES
        try:
            out = fitted.transform(df.unionByName(spark.createDataFrame([(n, "new")], "id long, kind string")))
        finally:
            blocks.BROADCAST_CATEGORIES = kept
        assert len(out.schema.json()) < 5_000
        v = F.unwrap_udt("kind_onehot")
        rows = out.select("id", v["size"].alias("size"), v["indices"].alias("at"), v["values"].alias("x")).collect()
        assert len(rows) == n + 1 and {r["size"] for r in rows} == {n - 1}
        assert all(r["at"] == ([] if r["id"] in (5, n) else [r["id"] - (r["id"] > 5)]) and len(r["x"]) == len(r["at"]) for r in rows)
