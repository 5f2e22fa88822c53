"""Exact operators built for scale, checked against brute force on small data.

Limits are lowered so that every narrowing / refinement / widening path
runs, not just the small-data shortcut.
"""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.columns import ROW_ID
from tabforge.operators import knn
from tabforge.operators import split as split_mod
from tabforge.operators import stats
from tabforge.operators.knn import KNNClassifier


@pytest.mark.parametrize("limit,accuracy", [(100_000, 200), (40, 200), (150, 1000)])
def test_exact_quantiles_match_numpy(spark, limit, accuracy):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.integers(0, 5, 500).astype(float)])
    y = rng.exponential(size=5000)
    rows = [(i, float(a), float(b) if i % 9 else None) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, f"{ROW_ID} bigint, x double, y double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = stats.exact_quantiles(df, ["x", "y"], probs, accuracy=accuracy, bracket_limit=limit)
    yy = np.array([r[2] for r in rows if r[2] is not None])
    for p, gx, gy in zip(probs, got["x"], got["y"]):
        assert gx == pytest.approx(float(np.percentile(x, p * 100)), abs=1e-12)
        assert gy == pytest.approx(float(np.percentile(yy, p * 100)), abs=1e-12)


def test_quantiles_of_empty_column(spark):
    df = spark.createDataFrame([(0, None)], f"{ROW_ID} bigint, x double")
    assert stats.exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_mode_with_hot_value(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
    assert stats.column_mode(df, "v") == 7


@pytest.mark.parametrize("final_rows", [200_000, 5])
def test_split_exact_size_and_matches_sort(spark, monkeypatch, final_rows):
    monkeypatch.setattr(split_mod, "_FINAL_ROWS", final_rows)
    monkeypatch.setattr(split_mod, "_BUCKETS", 16)
    df = spark.range(5003).withColumnRenamed("id", ROW_ID)
    train, test = split_mod.train_test_split(df, 0.3, seed=7)
    n_test = math.ceil(0.3 * 5003)
    got = {r[0] for r in test.collect()}
    assert len(got) == n_test and train.count() == 5003 - n_test
    import hashlib

    order = sorted(range(5003), key=lambda i: hashlib.md5(f"{i}-7".encode()).hexdigest())
    assert got == set(order[:n_test])


def brute_knn(train, test, k, weights):
    out = {}
    for qid, qx in test:
        d = sorted(((float(np.sum((np.array(qx) - np.array(tx)) ** 2)), tid, y) for tid, tx, y in train))[:k]
        votes = {}
        zero = any(dd == 0 for dd, _, _ in d)
        for dd, _, y in d:
            w = 1.0 if weights == "uniform" else ((1.0 if dd == 0 else 0.0) if zero else 1.0 / math.sqrt(dd))
            votes[y] = votes.get(y, 0.0) + w
        best = sorted(votes.items(), key=lambda kv: (-kv[1], kv[0]))[0]
        out[qid] = (best[0], best[1] / sum(votes.values()))
    return out


@pytest.mark.parametrize("weights,k,bucket", [("uniform", 3, None), ("distance", 4, 2), ("uniform", 50, 2)])
def test_knn_matches_brute_force(spark, weights, k, bucket):
    rng = np.random.default_rng(3)
    pts = rng.integers(0, 6, size=(240, 3)).astype(float)     # many exact duplicates and ties
    pts[:60] = [1.0, 1.0, 1.0]                                 # a hot vector: a quarter of the rows
    labels = rng.integers(0, 3, size=240)
    rows = [(i, *map(float, p), int(l)) for i, (p, l) in enumerate(zip(pts, labels))]
    df = spark.createDataFrame(rows, f"{ROW_ID} bigint, a double, b double, c double, label int")
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df)
    train = vec.where(F.col(ROW_ID) % 5 != 0)
    test = vec.where(F.col(ROW_ID) % 5 == 0)
    model = KNNClassifier(k=k, weights=weights, features_col="f", label_col="label", bucket_rows=bucket).fit(train)
    got = {r[ROW_ID]: (int(r["prediction"]), float(max(r["probability"].toArray())))
           for r in model.transform(test).collect()}
    tr = [(r[0], r[1:4], r[4]) for r in rows if r[0] % 5 != 0]
    te = [(r[0], r[1:4]) for r in rows if r[0] % 5 == 0]
    want = brute_knn(tr, te, k, weights)
    assert set(got) == set(want)
    for q in want:
        assert got[q][0] == want[q][0], q
        assert got[q][1] == pytest.approx(want[q][1])


@pytest.mark.parametrize("n_cols", [3, 64])
def test_sketch_quantiles_keep_their_rank_error(spark, n_cols):
    rng = np.random.default_rng(5)
    x = rng.lognormal(size=40_000)
    x[:10_000] = 1.5  # a quarter of the rows share a value
    df = spark.createDataFrame(zip(x.tolist()), "x double")
    df = df.select(*[(F.when(F.col("x") > 0.01 * i, F.col("x") + i)).alias(f"c{i}") for i in range(n_cols - 1)], F.lit(None).cast("double").alias("no"))
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = stats.sketch_quantiles(df, df.columns, probs)
    for i in range(n_cols - 1):
        v = np.sort(x[x > 0.01 * i] + i)
        for p, q in zip(probs, got[f"c{i}"]):
            low, high = np.searchsorted(v, q, "left") / len(v), np.searchsorted(v, q, "right") / len(v)
            assert q in v and low - 0.003 <= p <= high + 0.003
    assert got["no"] == [None] * 5


def test_approximate_steps(spark):
    from tabforge.operators import features as fs
    from tabforge.plans.cleaning import apply_ops

    df = spark.range(0, 10_001).select(F.col("id").alias(ROW_ID), F.when(F.col("id") % 10 != 3, F.col("id").cast("double")).alias("x"))
    filled = apply_ops(df, [("fill_missing", {"column": "x", "strategy": "median", "approximate": "true"})])
    assert abs(filled.where(f"{ROW_ID} = 3").first()["x"] - 5000) < 40
    for step in (fs.RobustScaler(approximate=True), fs.SimpleImputer(strategy="median", approximate=True)):
        step._set(featureCols=["x"])
        state = step.fit(df).feature_state()
        middle = state["x"][0] if "x" in state else state["fill"]["x"]
        assert abs(middle - 5000) < 40


def _vectors(spark, points):
    rows = [(i, p.tolist(), i % 3) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, f"{ROW_ID} bigint, x array<double>, label int")
    return df.select(ROW_ID, array_to_vector("x").alias("f"), "label")


@pytest.mark.parametrize("bucket", [None, 16])
def test_knn_of_clustered_vectors_prunes(spark, bucket):
    """40 dimensions, 60 clusters, a third of the rows in one of them: exact,
    and far from all pairs."""
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 10, (60, 40))
    of = np.where(rng.random(6000) < 0.33, 0, rng.integers(0, 60, 6000))
    points = centres[of] + rng.normal(0, 0.3, (6000, 40))
    df = _vectors(spark, points)
    model = KNNClassifier(k=5, features_col="f", label_col="label", bucket_rows=bucket).fit(df.where(F.col(ROW_ID) % 6 != 0))
    got = {}
    for r in model.neighbours(df.where(F.col(ROW_ID) % 6 == 0)).collect():
        got.setdefault(r["qid"], []).append((r["d2"], r["tid"]))
    tid = np.array([i for i in range(6000) if i % 6])
    for q in range(0, 6000, 6):
        d2 = ((points[tid] - points[q]) ** 2).sum(1)
        want = tid[np.lexsort((tid, d2))[:5]].tolist()
        assert [t for _, t in sorted(got[q])] == want
    assert model.all_pairs == 1000 * 5000
    assert model.examined < 0.2 * model.all_pairs


def test_knn_blocks_of_test_rows_and_stored_index(spark, monkeypatch, store_root):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 16)  # every unit is visited in many blocks
    monkeypatch.setattr(knn, "SAMPLE_ROWS", 100)
    rng = np.random.default_rng(12)
    points = rng.normal(size=(900, 8)) * 1e6 + 1e8  # far from the origin: rounding of the screen matters
    points[::10] = points[0]
    df = _vectors(spark, points)
    model = KNNClassifier(k=7, features_col="f", label_col="label", bucket_rows=20).fit(df.where(F.col(ROW_ID) % 3 != 0))
    test = df.where(F.col(ROW_ID) % 3 == 0)
    got = sorted(tuple(r) for r in model.neighbours(test).collect())
    tid = np.array([i for i in range(900) if i % 3])
    seen = {}
    for q, t, _, d2 in got:
        seen.setdefault(q, []).append((d2, t))
    for q in range(0, 900, 3):
        d2 = ((points[tid] - points[q]) ** 2).sum(1)
        assert [t for _, t in sorted(seen[q])] == tid[np.lexsort((tid, d2))[:7]].tolist()
    model.save(f"{store_root}/knn-index")
    again = knn.KNNModel.load(spark, f"{store_root}/knn-index")
    assert sorted(tuple(r) for r in again.neighbours(test).collect()) == got
    assert again.neighbours(test.limit(0)).count() == 0


def test_knn_with_fewer_rows_than_k(spark):
    df = _vectors(spark, np.array([[0.0], [1.0], [5.0]]))
    model = KNNClassifier(k=9, features_col="f", label_col="label").fit(df)
    assert model.neighbours(df).count() == 9


def test_kth_smallest_and_deep_page(spark):
    from tabforge.operators import profile
    from tabforge.operators.stats import kth_smallest

    ids = spark.range(0, 60000).select((F.col("id") * 3 + (F.col("id") % 3)).alias(ROW_ID), F.col("id").alias("v"))
    assert kth_smallest(ids, ROW_ID, 12345, buckets=16, final_rows=50) == 12345 * 3 + 12345 % 3
    page = profile.preview_page(ids, page=500, page_size=20)
    assert [r["v"] for r in page.collect()] == list(range(10000, 10020))
    assert profile.preview_page(ids, page=4000, page_size=20).count() == 0


def test_many_class_target_uses_lookup_join(spark):
    from tabforge.plans.training import _encode_target

    df = spark.range(300).select(F.col("id").alias(ROW_ID), (F.col("id") % 100).cast("string").alias("t"))
    out, labels = _encode_target(df, "t", True)
    got = {r["t"]: r["__label"] for r in out.collect()}
    assert len(labels) == 100 and all(labels[int(code)] == t for t, code in got.items())


def test_numeric_stats_long_and_wide_agree(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, 20))
    data[::7, 3] = np.nan
    rows = [tuple(float(v) if not np.isnan(v) else None for v in r) for r in data]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(20)))
    metrics = ["count", "mean", "min", "max", "var_pop", "std_pop"]
    long = stats.numeric_column_stats(df, [f"c{i}" for i in range(20)], metrics)
    wide = stats.numeric_column_stats(df, [f"c{i}" for i in range(4)], metrics)
    for i in range(4):
        for m in metrics:
            assert long[f"c{i}"][m] == pytest.approx(wide[f"c{i}"][m])
    col3 = data[:, 3][~np.isnan(data[:, 3])]
    assert long["c3"]["count"] == len(col3) and long["c3"]["var_pop"] == pytest.approx(col3.var())


def test_describe_long_matches_wide(spark):
    from tabforge.operators import profile
    from tabforge.operators.stats import LONG_FORMAT_COLUMNS

    rng = np.random.default_rng(9)
    n_num = LONG_FORMAT_COLUMNS
    rows = []
    for i in range(200):
        vals = [float(v) if rng.random() > 0.1 else None for v in rng.normal(size=n_num)]
        rows.append((i, *vals, None if i % 5 == 0 else f"t{i % 3}"))
    schema = f"{ROW_ID} bigint, " + ", ".join(f"x{j} double" for j in range(n_num)) + ", s string"
    df = spark.createDataFrame(rows, schema)
    long = {r["column_name"]: r.asDict() for r in profile.describe_columns(df).collect()}
    narrow = df.select(ROW_ID, "x0", "x1", "s")
    wide = {r["column_name"]: r.asDict() for r in profile.describe_columns(narrow).collect()}
    assert len(long) == n_num + 1
    for c in ("x0", "x1", "s"):
        for k, v in wide[c].items():
            assert long[c][k] == (pytest.approx(v) if isinstance(v, float) else v)


def test_describe_dataset_wide_table(spark):
    from tabforge.operators import profile

    df = spark.range(50).select(F.col("id").alias(ROW_ID), *[(F.col("id") * j).cast("double").alias(f"c{j}")
                                                              for j in range(20)])
    info = profile.describe_dataset(df)
    assert info["rows"] == 50 and info["columns"] == 20 and info["stats"]["c3"]["max"] == 147.0
    assert info["null_counts"]["c0"] == 0 and len(info["preview"]) == 50


def test_drop_duplicates_sorts_no_whole_rows(spark):
    from tabforge.errors import InvalidParameter
    from tabforge.plans.cleaning import apply_ops

    # one key holds a third of the rows; nulls and NaN are keys like any other
    rows = [(i, [None, float("nan"), 0.0, -0.0, 7.0, float(i)][i % 6] if i % 3 else 7.0, f"v{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "_row_id long, `k.1` double, v string").repartition(6)
    ops = [{"op": "drop_duplicates", "params": {"subset": ["k.1"]}}]
    out = apply_ops(df, ops)
    assert "SortAggregate" not in out._jdf.queryExecution().toString()
    first = {}
    for i, k, v in rows:
        first.setdefault("null" if k is None else "nan" if k != k else k, (i, v))
    assert sorted((r["_row_id"], r["v"]) for r in out.collect()) == sorted(first.values())
    assert out.columns == df.columns
    with pytest.raises(InvalidParameter):
        apply_ops(df.drop("_row_id"), ops)


def test_wide_rows_are_searched_in_few_units(spark, monkeypatch):
    """Every visit ships a wide test row, and every cell was a unit of its own: sqrt(n) shipments a row and more."""
    from tabforge.operators.knn import _block_rows, _cell_count, _unit_rows

    monkeypatch.setattr(knn, "WIDE_CELLS", 5)
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2400, 20)), rng.integers(0, 3, 2400)
    rows = [(i, Vectors.dense(v), float(c)) for i, (v, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, T.StructType([
        T.StructField(ROW_ID, T.LongType()), T.StructField("f", VectorUDT()), T.StructField("label", T.DoubleType())]))
    model = KNNClassifier(k=5, features_col="f", label_col="label").fit(df.where(F.col(ROW_ID) % 6 != 0))
    assert len(model.units) <= 5 + 2000 // 256
    monkeypatch.undo()
    assert _cell_count(400_000, 64) == _cell_count(4_000_000, 64) == 128 and _cell_count(10**6, 2) == 1000
    out = model.transform(df.where(F.col(ROW_ID) % 6 == 0))
    train = np.array([i for i in range(2400) if i % 6])
    for r in out.collect():
        near = train[np.lexsort((train, ((x[train] - x[r[ROW_ID]]) ** 2).sum(1)))[:5]]
        assert r["prediction"] == np.bincount(y[near], minlength=3).argmax()
    # the shipped rows grow with the test rows, the units do not; narrow rows are cut as before
    assert 400_000 // _unit_rows(400_000, 64, 5) == 4_000_000 // _unit_rows(4_000_000, 64, 5) == 64
    assert _unit_rows(10**9, 64, 5) * 64 * 8 <= 1 << 26 and _unit_rows(10**6, 2, 5) == 256 and _block_rows(64) > _block_rows(2)


def test_answers_as_many_as_the_test_rows_are_not_broadcast(spark):
    df = spark.createDataFrame([(i, Vectors.dense([float(i), float(i % 7)]), float(i % 2)) for i in range(200)], T.StructType([
        T.StructField(ROW_ID, T.LongType()), T.StructField("f", VectorUDT()), T.StructField("label", T.DoubleType())]))
    out = KNNClassifier(k=3, features_col="f", label_col="label").fit(df).transform(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
