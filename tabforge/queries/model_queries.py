"""Queries for estimators and training runs (§2.5, §2.6).

Each learner has an oracle where its fit has a closed form, always through
``train``: linear regression, the exact KNN vote, and trees, boosting and
logistic regression on one two-valued feature, whose best fit is the rate of
each value. The runs with default settings on many features are checked by
row count here and by quality and determinism tests in ``tests/``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.functions.columns import ROW_ID
from tabforge.plans.training import TrainSpec, train
from tabforge.queries.registry import R, query, rounded
from tabforge.sources.scan import load_table, scan_parquet

N_EMB = 64


def embeddings_wide(spark, sf):
    """embeddings with the 64 floats as scalar features e0..e63."""
    e = load_table(spark, sf, "embeddings", order_by="vec_id")
    return e.select(ROW_ID, "vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(N_EMB)],
                    "label")


def labelled_documents(spark, sf):
    """labels joined to simple numeric document features (quality target)."""
    d = load_table(spark, sf, "documents").select(
        "doc_id", "lang", "n_chars",
        F.size(F.split(F.col("text"), r"\s+")).cast("double").alias("n_words"),
        F.length(F.regexp_replace(F.col("text"), r"[^0-9]", "")).cast("double").alias("n_digits"))
    lab = load_table(spark, sf, "labels")
    return lab.join(d, "doc_id").select(F.col("doc_id").alias(ROW_ID), "doc_id", "lang", "n_chars", "n_words",
                                        "n_digits", "quality", "toxic")


def _emb_run(spark, sf, steps):
    df = embeddings_wide(spark, sf)
    spec = TrainSpec(target_column="label", feature_columns=[f"e{i}" for i in range(N_EMB)], steps=steps)
    return train(df, spec)


def _preds(run):
    return run.predictions.drop(ROW_ID)


@query("rf_classifier")
def q_rf_classifier(spark, sf):
    return _preds(_emb_run(spark, sf, [{"name": "RandomForestClassifier", "category": "estimators"}]))


@query("gbt_classifier")
def q_gbt_classifier(spark, sf):
    df = labelled_documents(spark, sf)
    spec = TrainSpec(target_column="quality", feature_columns=["n_chars", "n_words", "n_digits", "lang"],
                     steps=[{"name": "OneHotEncoder", "category": "preprocessing"},
                            {"name": "GradientBoostingClassifier", "category": "estimators"}])
    return _preds(train(df, spec))


@query("logistic_regression")
def q_logistic_regression(spark, sf):
    run = _emb_run(spark, sf, [{"name": "StandardScaler"},
                               {"name": "LogisticRegression", "category": "estimators", "params": {"C": "1.0"}}])
    return _preds(run)


@query("svm_classifier")
def q_svm_classifier(spark, sf):
    df = labelled_documents(spark, sf)
    spec = TrainSpec(target_column="toxic", feature_columns=["n_chars", "n_words", "n_digits"],
                     steps=[{"name": "StandardScaler"},
                            {"name": "SVC", "category": "estimators", "params": {"C": "1.0", "kernel": "rbf"}}])
    return _preds(train(df, spec))


@query("rf_regressor")
def q_rf_regressor(spark, sf):
    df = scan_parquet(spark, f"{sf}/lineitem.parquet").select(ROW_ID, "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    spec = TrainSpec(target_column="l_extendedprice", feature_columns=["l_quantity", "l_discount", "l_tax"],
                     steps=[{"name": "RandomForestRegressor", "category": "estimators"}])
    return _preds(train(df, spec))


@query("train_run")
def q_train_run(spark, sf):
    """A full run: impute -> scale -> polynomial -> select -> PCA -> logistic regression."""
    df = labelled_documents(spark, sf)
    spec = TrainSpec(target_column="quality", feature_columns=["n_chars", "n_words", "n_digits"],
                     steps=[{"name": "SimpleImputer", "params": {"strategy": "median"}},
                            {"name": "RobustScaler"},
                            {"name": "PolynomialFeatures", "params": {"degree": "2"}},
                            {"name": "SelectKBest", "category": "feature_selection", "params": {"k": "5"}},
                            {"name": "PCA", "category": "feature_selection", "params": {"n_components": "3"}},
                            {"name": "LogisticRegression", "category": "estimators"}])
    return _preds(train(df, spec))


# ------------------------------------------------------------------ oracle-checked models

KNN_SQL = f"""WITH s AS (
  SELECT *, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR) || '-42'))
            <= (SELECT ceil(count(*) * 0.2) FROM customer) AS is_test FROM customer),
te AS (SELECT c_custkey AS qid, c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS b FROM s WHERE is_test),
tr AS (SELECT c_custkey AS tid, c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS b, c_mktsegment AS y
       FROM s WHERE NOT is_test),
d AS (SELECT qid, tid, y, (te.a - tr.a) * (te.a - tr.a) + (te.b - tr.b) * (te.b - tr.b) AS d2
      FROM te CROSS JOIN tr),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, tid) AS rn FROM d) t
       WHERE rn <= 5),
v AS (SELECT qid, y, count(*) AS v FROM nn GROUP BY qid, y),
b AS (SELECT qid, y, v, row_number() OVER (PARTITION BY qid ORDER BY v DESC, y) AS r FROM v)
SELECT qid AS c_custkey, y AS predicted, {R("v / 5.0", 6)} AS probability FROM b WHERE r = 1"""


@query("knn_classifier", KNN_SQL)
def q_knn_classifier(spark, sf):
    c = load_table(spark, sf, "customer", order_by="c_custkey").select(
        ROW_ID, "c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    spec = TrainSpec(target_column="c_mktsegment", feature_columns=["c_acctbal", "c_nationkey"],
                     steps=[{"name": "KNeighborsClassifier", "category": "estimators",
                             "params": {"n_neighbors": "5"}}])
    # the split is keyed by the row id, which is c_custkey here
    run = train(c, spec)
    out = run.predictions.select(F.col(ROW_ID).alias("c_custkey"), "predicted", "probability")
    return rounded(out, 6)


SPLIT_ORDERS = """WITH s AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'))
    <= (SELECT ceil(count(*) * 0.2) FROM orders) AS is_test,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1.0 ELSE 0.0 END AS x,
  CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END AS price,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'first' ELSE 'second' END AS class,
  CASE WHEN (o_orderpriority IN ('1-URGENT', '2-HIGH')) = (o_orderkey % 4 <> 0) THEN 'low' ELSE 'high' END AS mixed FROM orders),
g AS (SELECT x, avg(o_totalprice) AS mean, avg(CASE WHEN price = 'low' THEN 1.0 ELSE 0.0 END) AS rate,
             avg(CASE WHEN mixed = 'low' THEN 1.0 ELSE 0.0 END) AS mixed_rate
      FROM s WHERE NOT is_test GROUP BY x)
"""


def _two_valued(spark, sf):
    """orders with one two-valued feature, keyed and ordered by o_orderkey."""
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return load_table(spark, sf, "orders", order_by="o_orderkey").select(
        ROW_ID, "o_orderkey", "o_totalprice", F.when(urgent, 1.0).otherwise(0.0).alias("x"),
        F.when(F.col("o_totalprice") > 150000, "high").otherwise("low").alias("price"),
        F.when(urgent, "first").otherwise("second").alias("class"),
        F.when(urgent == (F.col("o_orderkey") % 4 != 0), "low").otherwise("high").alias("mixed"))


def _two_valued_run(spark, sf, target: str, name: str, steps=(), **params):
    spec = TrainSpec(target_column=target, feature_columns=["x"],
                     steps=[*steps, {"name": name, "category": "estimators", "params": params}])
    return train(_two_valued(spark, sf), spec).predictions.withColumnRenamed(ROW_ID, "o_orderkey")


@query("linear_regression", SPLIT_ORDERS + f"""SELECT o_orderkey, {R("mean", 3)} AS predicted,
  {R("o_totalprice - mean", 3)} AS residual FROM s JOIN g USING (x) WHERE is_test""")
def q_linear_regression(spark, sf):
    out = _two_valued_run(spark, sf, "o_totalprice", "LinearRegression")
    return rounded(out.select("o_orderkey", "predicted", "residual"), 3)


@query("train_run_linear", SPLIT_ORDERS + f"""SELECT o_orderkey, {R("mean", 3)} AS predicted FROM s JOIN g USING (x) WHERE is_test""")
def q_train_run_linear(spark, sf):
    """A run through every kind of step; none changes the best fit of one feature."""
    steps = [{"name": "SimpleImputer", "params": {"strategy": "median"}}, {"name": "StandardScaler"},
             {"name": "MinMaxScaler"}, {"name": "PolynomialFeatures", "params": {"degree": "1"}},
             {"name": "VarianceThreshold"}, {"name": "SelectKBest", "params": {"k": "1"}},
             {"name": "PCA", "params": {"n_components": "1"}}]
    return rounded(_two_valued_run(spark, sf, "o_totalprice", "LinearRegression", steps).select("o_orderkey", "predicted"), 3)


@query("rf_regressor_stump", SPLIT_ORDERS + f"SELECT o_orderkey, {R('mean', 4)} AS predicted FROM s JOIN g USING (x) WHERE is_test")
def q_rf_regressor_stump(spark, sf):
    out = _two_valued_run(spark, sf, "o_totalprice", "RandomForestRegressor", n_estimators="1", max_depth="1", bootstrap="false")
    return rounded(out.select("o_orderkey", "predicted"), 4)


_RATE_SQL = "SELECT o_orderkey, CASE WHEN {p} > 0.5 THEN 'low' ELSE 'high' END AS predicted, {r} AS probability FROM s JOIN g USING (x) WHERE is_test"


@query("rf_classifier_stump", SPLIT_ORDERS + _RATE_SQL.format(p="mixed_rate", r=R("mixed_rate", 6)))
def q_rf_classifier_stump(spark, sf):
    out = _two_valued_run(spark, sf, "mixed", "RandomForestClassifier", n_estimators="1", max_depth="1", bootstrap="false")
    return rounded(out.select("o_orderkey", "predicted", "probability"), 6)


@query("gbt_classifier_stump", SPLIT_ORDERS + _RATE_SQL.format(p="rate", r=R("1 / (1 + exp(-2 * (2 * rate - 1)))", 6)))
def q_gbt_classifier_stump(spark, sf):
    """One round of boosting fits the mean of the signed label; the probability is its logistic at twice the margin."""
    out = _two_valued_run(spark, sf, "price", "GradientBoostingClassifier", n_estimators="1", max_depth="1")
    return rounded(out.select("o_orderkey", "predicted", "probability"), 6)


@query("logistic_regression_rates", SPLIT_ORDERS + _RATE_SQL.format(p="rate", r=R("rate", 3)))
def q_logistic_regression_rates(spark, sf):
    """Practically without penalty the maximum likelihood is the rate of each value."""
    out = _two_valued_run(spark, sf, "price", "LogisticRegression", C="1e12", tol="1e-12", max_iter="500")
    return rounded(out.select("o_orderkey", "predicted", "probability"), 3)


@query("gbt_multiclass_stump", f"""WITH s AS (SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS x,
    CASE WHEN o_orderkey % 7 < 3 AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'a' WHEN o_orderkey % 5 < 3 THEN 'b' ELSE 'c' END AS y,
    row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42')) <= (SELECT ceil(count(*) * 0.2) FROM orders) AS is_test FROM orders),
p AS (SELECT y AS k, count(*) / (SELECT count(*) FROM s WHERE NOT is_test) AS p FROM s WHERE NOT is_test GROUP BY y),
g AS (SELECT x, k, ln(any_value(p)) + 0.1 * 2 / 3 * sum((y = k)::INT - p) / sum(abs((y = k)::INT - p) * (1 - abs((y = k)::INT - p))) AS raw
      FROM s, p WHERE NOT is_test GROUP BY x, k),
r AS (SELECT x, arg_max(k, raw) AS predicted, exp(max(raw)) / sum(exp(raw)) AS probability FROM g GROUP BY x)
SELECT o_orderkey, predicted, {R("probability", 6)} AS probability FROM s JOIN r USING (x) WHERE is_test""")
def q_gbt_multiclass_stump(spark, sf):
    """One round of joint boosting over three classes: a stump and a Newton step a class."""
    urgent, key = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderkey")
    o = load_table(spark, sf, "orders", order_by="o_orderkey").select(
        ROW_ID, urgent.cast("double").alias("x"),
        F.when((key % 7 < 3) & urgent, "a").when(key % 5 < 3, "b").otherwise("c").alias("y"))
    run = train(o, TrainSpec(target_column="y", steps=[{"name": "GradientBoostingClassifier", "category": "estimators",
                                                        "params": {"n_estimators": "1", "max_depth": "1"}}]))
    return rounded(run.predictions.select(F.col(ROW_ID).alias("o_orderkey"), "predicted", "probability"), 6)


@query("svm_separable", SPLIT_ORDERS + "SELECT o_orderkey, class AS actual, class AS predicted FROM s WHERE is_test")
def q_svm_separable(spark, sf):
    out = _two_valued_run(spark, sf, "class", "SVC", C="10.0", max_iter="20")
    return out.select("o_orderkey", "actual", "predicted")


@query("svm_sigmoid_separable", SPLIT_ORDERS + "SELECT o_orderkey, class AS actual, class AS predicted FROM s WHERE is_test")
def q_svm_sigmoid_separable(spark, sf):
    out = _two_valued_run(spark, sf, "class", "SVC", kernel="sigmoid", C="10.0", max_iter="20")
    return out.select("o_orderkey", "actual", "predicted")


@query("one_hot_train_wide", """WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'))
    <= (SELECT ceil(count(*) * 0.2) FROM orders) AS is_test FROM orders)
SELECT o_orderkey, CAST(o_orderkey % 300 AS DOUBLE) AS predicted FROM s t WHERE is_test
  AND EXISTS (SELECT 1 FROM s u WHERE NOT u.is_test AND u.o_orderkey % 300 = t.o_orderkey % 300)""")
def q_one_hot_train_wide(spark, sf):
    """A text feature of 300 categories through train(); test rows whose category was trained on."""
    o = load_table(spark, sf, "orders", order_by="o_orderkey").select(
        ROW_ID, F.concat(F.lit("it's a `kind`. "), F.col("o_orderkey") % 300).alias("a 'kind'"),
        (F.col("o_orderkey") % 300).cast("double").alias("y"))
    spec = TrainSpec(target_column="y", feature_columns=["a 'kind'"],
                     steps=[{"name": "OneHotEncoder"}, {"name": "LinearRegression", "category": "estimators"}])
    run = train(o, spec)
    known = {f["feature"] for f in run.feature_importance}
    seen = run.predictions.where(F.concat(F.lit("a 'kind'_"), F.col("`a 'kind'`")).isin(*known))
    return seen.select(F.col(ROW_ID).alias("o_orderkey"), (F.round("predicted", 1) + F.lit(0.0)).alias("predicted"))


@query("one_hot_select_train", f"""WITH s AS (SELECT o_orderkey, o_totalprice AS y, 'c' || (o_custkey % 700) AS kind,
    row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42')) <= (SELECT ceil(count(*) * 0.2) FROM orders) AS is_test FROM orders),
t AS (SELECT count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM s WHERE NOT is_test),
c AS (SELECT kind, count(*) / any_value(n) AS p, sum(y - m) / any_value(n) AS d, any_value(v) AS v
      FROM s, t WHERE NOT is_test GROUP BY kind),
b AS (SELECT kind FROM c ORDER BY d * d / (p * (1 - p) * v) DESC LIMIT 1),
r AS (SELECT s.kind = b.kind AS hit, avg(y) AS predicted FROM s, b WHERE NOT is_test GROUP BY ALL)
SELECT o_orderkey, {R("predicted", 3)} AS predicted FROM s, b, r WHERE is_test AND r.hit = (s.kind = b.kind)""")
def q_one_hot_select_train(spark, sf):
    """700 categories through scaling, a variance threshold and univariate
    selection: the regression on the best slot predicts two means."""
    o = load_table(spark, sf, "orders", order_by="o_orderkey").select(
        ROW_ID, F.concat(F.lit("c"), F.col("o_custkey") % 700).alias("kind"), F.col("o_totalprice").alias("y"))
    run = train(o, TrainSpec(target_column="y", steps=[
        {"name": "OneHotEncoder"}, {"name": "VarianceThreshold"}, {"name": "MinMaxScaler"},
        {"name": "SelectKBest", "params": {"k": "1", "score_func": "f_regression"}},
        {"name": "LinearRegression", "category": "estimators"}]))
    return rounded(run.predictions.select(F.col(ROW_ID).alias("o_orderkey"), "predicted"), 3)


KNN_DIST_SQL = f"""WITH s AS (
  SELECT *, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR) || '-42'))
            <= (SELECT ceil(count(*) * 0.2) FROM customer) AS is_test FROM customer),
te AS (SELECT c_custkey AS qid, c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS b FROM s WHERE is_test),
tr AS (SELECT c_custkey AS tid, c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS b, c_mktsegment AS y
       FROM s WHERE NOT is_test),
d AS (SELECT qid, tid, y, (te.a - tr.a) * (te.a - tr.a) + (te.b - tr.b) * (te.b - tr.b) AS d2
      FROM te CROSS JOIN tr),
nn AS (SELECT *, min(d2) OVER (PARTITION BY qid) = 0 AS has_zero FROM (
         SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, tid) AS rn FROM d) t WHERE rn <= 7),
v AS (SELECT qid, y, sum(CASE WHEN has_zero THEN CASE WHEN d2 = 0 THEN 1.0 ELSE 0.0 END
                         ELSE 1.0 / sqrt(d2) END) AS v FROM nn GROUP BY qid, y),
b AS (SELECT qid, y, v, sum(v) OVER (PARTITION BY qid) AS tot,
             row_number() OVER (PARTITION BY qid ORDER BY v DESC, y) AS r FROM v)
SELECT qid AS c_custkey, y AS predicted, {R("v / tot", 6)} AS probability FROM b WHERE r = 1"""


@query("knn_classifier_distance", KNN_DIST_SQL)
def q_knn_classifier_distance(spark, sf):
    c = load_table(spark, sf, "customer", order_by="c_custkey").select(
        ROW_ID, "c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    spec = TrainSpec(target_column="c_mktsegment", feature_columns=["c_acctbal", "c_nationkey"],
                     steps=[{"name": "KNeighborsClassifier", "category": "estimators",
                             "params": {"n_neighbors": "7", "weights": "distance"}}])
    out = train(c, spec).predictions.select(F.col(ROW_ID).alias("c_custkey"), "predicted", "probability")
    return rounded(out, 6)


def _knn_embeddings_sql(k: int, weight: str) -> str:
    return f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || '-42'))
    <= (SELECT ceil(count(*) * 0.2) FROM embeddings) AS is_test FROM embeddings),
d AS (SELECT te.vec_id AS qid, tr.vec_id AS tid, tr.label AS y,
             list_sum(list_transform(list_zip(te.embedding, tr.embedding), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2]))) AS d2
      FROM s te, s tr WHERE te.is_test AND NOT tr.is_test),
nn AS (SELECT *, min(d2) OVER (PARTITION BY qid) = 0 AS zero FROM (
         SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, tid) AS rn FROM d) WHERE rn <= {k}),
v AS (SELECT qid, y, sum({weight}) AS v FROM nn GROUP BY qid, y),
b AS (SELECT qid, y, v, sum(v) OVER (PARTITION BY qid) AS total, row_number() OVER (PARTITION BY qid ORDER BY v DESC, y) AS r FROM v)
SELECT qid AS vec_id, y AS predicted, {R("CASE WHEN (SELECT count(DISTINCT label) FROM s) = 2 THEN NULL ELSE v / total END", 6)} AS probability
FROM b WHERE r = 1"""


def _knn_embeddings(spark, sf, k: int, weights: str):
    run = _emb_run(spark, sf, [{"name": "KNeighborsClassifier", "category": "estimators",
                                "params": {"n_neighbors": str(k), "weights": weights}}])
    return rounded(run.predictions.select(F.col(ROW_ID).alias("vec_id"), "predicted", "probability"), 6)


@query("knn_embeddings", _knn_embeddings_sql(5, "1.0"))
def q_knn_embeddings(spark, sf):
    """64 features: cells and rings prune where a projection cannot."""
    return _knn_embeddings(spark, sf, 5, "uniform")


@query("knn_embeddings_distance", _knn_embeddings_sql(9, "CASE WHEN zero THEN CASE WHEN d2 = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / sqrt(d2) END"))
def q_knn_embeddings_distance(spark, sf):
    return _knn_embeddings(spark, sf, 9, "distance")
