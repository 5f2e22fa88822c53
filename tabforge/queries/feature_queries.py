"""Queries for feature steps (§2.4) and the split (§2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import features as fs
from tabforge.operators.split import split_flag
from tabforge.queries.fixtures import ORDERS_N_SQL, lineitem, orders_n, part
from tabforge.queries.registry import R, query, rounded

LI_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_KEYS = ["l_orderkey", "l_linenumber"]


def _fit_transform(step, df, cols, label=None):
    step._set(featureCols=cols)
    if label:
        step._set(labelCol=label)
    model = step.fit(df)
    return model, model.transform(df)


def _li_sql(expr_of, stats_sql: str, digits: int = 6) -> str:
    sel = ", ".join(f"{R(expr_of(c), digits)} AS {c}" for c in LI_FEATS)
    return f"WITH s AS ({stats_sql}) SELECT l_orderkey, l_linenumber, {sel} FROM lineitem, s"


def _li_stats(*templates: str) -> str:
    return "SELECT " + ", ".join(t.format(c=c) for c in LI_FEATS for t in templates) + " FROM lineitem"


@query("standard_scaler", _li_sql(
    lambda c: f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END",
    _li_stats("avg({c}) AS m_{c}", "stddev_pop({c}) AS s_{c}")))
def q_standard_scaler(spark, sf):
    _, out = _fit_transform(fs.StandardScaler(), lineitem(spark, sf), LI_FEATS)
    return rounded(out.select(*LI_KEYS, *LI_FEATS), 6)


@query("minmax_scaler", _li_sql(
    lambda c: f"({c} - a_{c}) / CASE WHEN b_{c} = a_{c} THEN 1 ELSE b_{c} - a_{c} END * 2.0 - 1.0",
    _li_stats("min({c}) AS a_{c}", "max({c}) AS b_{c}")))
def q_minmax_scaler(spark, sf):
    _, out = _fit_transform(fs.MinMaxScaler(min=-1.0, max=1.0), lineitem(spark, sf), LI_FEATS)
    return rounded(out.select(*LI_KEYS, *LI_FEATS), 6)


@query("robust_scaler", _li_sql(
    lambda c: f"({c} - md_{c}) / CASE WHEN q3_{c} = q1_{c} THEN 1 ELSE q3_{c} - q1_{c} END",
    _li_stats("quantile_cont({c}, 0.5) AS md_{c}", "quantile_cont({c}, 0.25) AS q1_{c}",
              "quantile_cont({c}, 0.75) AS q3_{c}")))
def q_robust_scaler(spark, sf):
    _, out = _fit_transform(fs.RobustScaler(), lineitem(spark, sf), LI_FEATS)
    return rounded(out.select(*LI_KEYS, *LI_FEATS), 6)


def _norm_sql(norm_expr: str) -> str:
    sel = ", ".join(f"{R(f'{c} / n', 9)} AS {c}" for c in LI_FEATS)
    return (f"WITH t AS (SELECT *, CASE WHEN {norm_expr} = 0 THEN 1 ELSE {norm_expr} END AS n FROM lineitem) "
            f"SELECT l_orderkey, l_linenumber, {sel} FROM t")


def _normalizer(spark, sf, norm):
    _, out = _fit_transform(fs.Normalizer(norm=norm), lineitem(spark, sf), LI_FEATS)
    return rounded(out.select(*LI_KEYS, *LI_FEATS), 9)


@query("normalizer", _norm_sql("sqrt(" + " + ".join(f"{c} * {c}" for c in LI_FEATS) + ")"))
def q_normalizer(spark, sf):
    return _normalizer(spark, sf, "l2")


@query("normalizer_l1", _norm_sql(" + ".join(f"abs({c})" for c in LI_FEATS)))
def q_normalizer_l1(spark, sf):
    return _normalizer(spark, sf, "l1")


@query("normalizer_max", _norm_sql("greatest(" + ", ".join(f"abs({c})" for c in LI_FEATS) + ")"))
def q_normalizer_max(spark, sf):
    return _normalizer(spark, sf, "max")


W = f"WITH {ORDERS_N_SQL}\n"


def _mode_sql(c: str) -> str:
    return (f"(SELECT {c} FROM orders_n WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


@query("simple_imputer", W + f"""SELECT o_orderkey,
  {R("COALESCE(o_custkey, (SELECT avg(o_custkey) FROM orders_n))", 4)} AS o_custkey,
  {R("COALESCE(price, (SELECT avg(price) FROM orders_n))", 4)} AS price FROM orders_n""")
def q_simple_imputer(spark, sf):
    df = orders_n(spark, sf)
    _, out = _fit_transform(fs.SimpleImputer(strategy="mean"), df, ["o_custkey", "price"])
    return rounded(out.select("o_orderkey", "o_custkey", "price"), 4)


@query("simple_imputer_median", W + f"""SELECT o_orderkey,
  {R("COALESCE(o_custkey, (SELECT quantile_cont(o_custkey, 0.5) FROM orders_n))", 4)} AS o_custkey,
  {R("COALESCE(price, (SELECT quantile_cont(price, 0.5) FROM orders_n))", 4)} AS price FROM orders_n""")
def q_simple_imputer_median(spark, sf):
    df = orders_n(spark, sf)
    _, out = _fit_transform(fs.SimpleImputer(strategy="median"), df, ["o_custkey", "price"])
    return rounded(out.select("o_orderkey", "o_custkey", "price"), 4)


@query("simple_imputer_most_frequent", W + f"""SELECT o_orderkey,
  CAST(COALESCE(o_custkey, {_mode_sql("o_custkey")}) AS DOUBLE) AS o_custkey,
  {R(f"COALESCE(price, {_mode_sql('price')})", 4)} AS price,
  COALESCE(priority, {_mode_sql("priority")}) AS priority FROM orders_n""")
def q_simple_imputer_most_frequent(spark, sf):
    df = orders_n(spark, sf)
    _, out = _fit_transform(fs.SimpleImputer(strategy="most_frequent"), df, ["o_custkey", "price", "priority"])
    return rounded(out.select("o_orderkey", "o_custkey", "price", "priority"), 4)


@query("simple_imputer_constant", W + """SELECT o_orderkey, CAST(COALESCE(o_custkey, 0) AS DOUBLE) AS o_custkey,
  COALESCE(priority, 'missing_value') AS priority FROM orders_n""")
def q_simple_imputer_constant(spark, sf):
    df = orders_n(spark, sf)
    _, out = _fit_transform(fs.SimpleImputer(strategy="constant"), df, ["o_custkey", "priority"])
    return out.select("o_orderkey", "o_custkey", "priority")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


@query("one_hot_encoder", "SELECT o_orderkey, " + ", ".join(
    [f"CAST(CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS \"o_orderpriority_{v}\""
     for v in PRIORITIES] +
    [f"CAST(CASE WHEN o_orderstatus = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS \"o_orderstatus_{v}\""
     for v in STATUSES]) + " FROM orders")
def q_one_hot_encoder(spark, sf):
    from tabforge.queries.fixtures import load_table

    df = load_table(spark, sf, "orders", order_by="o_orderkey")
    model, out = _fit_transform(fs.OneHotEncoder(), df, ["o_orderpriority", "o_orderstatus"])
    return out.select("o_orderkey", *model.output_columns())


@query("polynomial_features", """SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice,
  CAST(p_size * p_size AS DOUBLE) AS "p_size^2", """ + R("p_size * p_retailprice", 6) + """ AS "p_size p_retailprice",
  """ + R("p_retailprice * p_retailprice", 6) + """ AS "p_retailprice^2" FROM part""")
def q_polynomial_features(spark, sf):
    model, out = _fit_transform(fs.PolynomialFeatures(degree=2), part(spark, sf), ["p_size", "p_retailprice"])
    return rounded(out.select("p_partkey", *model.output_columns()), 6)


def _f_sql() -> str:
    g = ", ".join(f"sum({c}) AS s_{c}, sum({c} * {c}) AS q_{c}" for c in LI_FEATS)
    t = ", ".join(f"sum(s_{c}) AS S_{c}, sum(q_{c}) AS Q_{c}, sum(s_{c} * s_{c} / n) AS B_{c}" for c in LI_FEATS)
    f = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, ((B_{c} - S_{c} * S_{c} / N) / (G - 1)) / "
        f"((Q_{c} - S_{c} * S_{c} / N - (B_{c} - S_{c} * S_{c} / N)) / (N - G)) AS score FROM t"
        for c in LI_FEATS)
    return (f"WITH g AS (SELECT l_returnflag, count(*) AS n, {g} FROM lineitem GROUP BY l_returnflag), "
            f"t AS (SELECT sum(n) AS N, count(*) AS G, {t} FROM g), f AS ({f}) "
            f"SELECT feature, {R('score', 6)} AS score, "
            f"row_number() OVER (ORDER BY score DESC) <= 2 AS selected FROM f")


@query("select_k_best", _f_sql())
def q_select_k_best(spark, sf):
    model, _ = _fit_transform(fs.SelectKBest(k=2), lineitem(spark, sf), LI_FEATS, label="l_returnflag")
    scores = model.feature_state()["scores"]
    kept = set(model.output_columns())
    rows = [(c, scores[c], c in kept) for c in LI_FEATS]
    return rounded(spark.createDataFrame(rows, "feature string, score double, selected boolean"), 6)


@query("variance_threshold", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, var_pop({c}) > 0.0007 AS kept FROM lineitem" for c in LI_FEATS))
def q_variance_threshold(spark, sf):
    model, _ = _fit_transform(fs.VarianceThreshold(threshold=0.0007), lineitem(spark, sf), LI_FEATS)
    kept = set(model.output_columns())
    return spark.createDataFrame([(c, c in kept) for c in LI_FEATS], "feature string, kept boolean")


@query("pca", """WITH s AS (
  SELECT avg(p_size) AS mx, avg(p_retailprice) AS my, var_samp(p_size) AS a, var_samp(p_retailprice) AS c,
         covar_samp(p_size, p_retailprice) AS b FROM part),
e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l1 FROM s),
v AS (SELECT *, CASE WHEN a >= c THEN l1 - c ELSE b END AS v1, CASE WHEN a >= c THEN b ELSE l1 - a END AS v2 FROM e),
u AS (SELECT *, v1 / sqrt(v1 * v1 + v2 * v2) AS u1, v2 / sqrt(v1 * v1 + v2 * v2) AS u2 FROM v),
p AS (SELECT p_partkey, (p_size - mx) * u1 + (p_retailprice - my) * u2 AS z FROM part, u),
sg AS (SELECT CASE WHEN arg_max(z, abs(z)) < 0 THEN -1 ELSE 1 END AS sgn FROM p)
SELECT p_partkey, """ + R("z * sgn", 6) + """ AS pca0 FROM p, sg""")
def q_pca(spark, sf):
    model, out = _fit_transform(fs.PCA(n_components=1), part(spark, sf), ["p_size", "p_retailprice"])
    return rounded(out.select("p_partkey", "pca0"), 6)


@query("label_encode", """SELECT l_orderkey, l_linenumber,
  CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS code FROM lineitem""")
def q_label_encode(spark, sf):
    out, _ = fs.label_encode(lineitem(spark, sf), "l_returnflag", "code")
    return out.select("l_orderkey", "l_linenumber", "code")


@query("train_test_split", """SELECT o_orderkey,
  row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'))
    <= (SELECT ceil(count(*) * 0.2) FROM orders) AS is_test FROM orders""")
def q_train_test_split(spark, sf):
    df = orders_n(spark, sf).select(*[c for c in ["_row_id", "o_orderkey"]])
    return split_flag(df, 0.2, 42, key_cols=["o_orderkey"]).select("o_orderkey", "is_test")


@query("rfe")
def q_rfe(spark, sf):
    """Recursive elimination down to two lineitem features (one fit per round)."""
    df = lineitem(spark, sf).withColumn("l_linenumber", F.col("l_linenumber").cast("double"))
    feats = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    model, _ = _fit_transform(fs.RFE(estimator="LinearRegression", n_features_to_select=2), df, feats,
                              label="l_extendedprice")
    ranking = model.feature_state()["ranking"]
    kept = set(model.output_columns())
    return spark.createDataFrame([(c, int(ranking[c]), c in kept) for c in feats],
                                 "feature string, ranking int, selected boolean")


@query("rfe_pair", f"""WITH c AS (SELECT covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_discount, l_discount) AS bb,
  covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay,
  covar_pop(l_discount, l_extendedprice) AS by_ FROM lineitem),
w AS (SELECT abs((ay * bb - by_ * ab) / (aa * bb - ab * ab)) AS a, abs((by_ * aa - ay * ab) / (aa * bb - ab * ab)) AS b FROM c)
SELECT 'l_quantity' AS feature, CASE WHEN a >= b THEN 1 ELSE 2 END AS ranking, a >= b AS selected FROM w UNION ALL
SELECT 'l_discount', CASE WHEN a >= b THEN 2 ELSE 1 END, a < b FROM w""")
def q_rfe_pair(spark, sf):
    """Of two features the one with the smaller least-squares coefficient goes."""
    feats = ["l_quantity", "l_discount"]
    model, _ = _fit_transform(fs.RFE(estimator="LinearRegression", n_features_to_select=1), lineitem(spark, sf), feats,
                              label="l_extendedprice")
    ranking, kept = model.feature_state()["ranking"], set(model.output_columns())
    return spark.createDataFrame([(c, int(ranking[c]), c in kept) for c in feats], "feature string, ranking int, selected boolean")


def _anova_sql(cols: dict[str, str]) -> str:
    one = []
    for name, e in cols.items():
        one.append(f"""SELECT '{name}' AS feature, {R("(b - s * s / n) / (g - 1) / ((q - b) / (n - g))", 4)} AS score FROM (
  SELECT sum(n) AS n, count(*) AS g, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM (
    SELECT l_returnflag, count(v) AS n, sum(v) AS s, sum(v * v) AS q FROM (SELECT l_returnflag, {e} AS v FROM lineitem)
    WHERE v IS NOT NULL GROUP BY l_returnflag))""")
    return "\nUNION ALL\n".join(one)


@query("select_k_best_nulls", _anova_sql({"half": "CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END", "whole": "l_quantity"}))
def q_select_k_best_nulls(spark, sf):
    """The F statistic of a feature counts the rows where it has a value."""
    df = lineitem(spark, sf).withColumns({"half": F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")),
                                          "whole": F.col("l_quantity")})
    model, _ = _fit_transform(fs.SelectKBest(k=1), df, ["half", "whole"], label="l_returnflag")
    return rounded(spark.createDataFrame([(c, float(v)) for c, v in model.feature_state()["scores"].items()],
                                         "feature string, score double"), 4)


@query("select_k_best_regression", "WITH f AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r, count(*) AS n FROM lineitem" for c in LI_FEATS[:1]
    + ["l_discount", "l_tax"]) + ") SELECT feature, " + R("r * r / (1 - r * r) * (n - 2)", 6) + " AS score, "
    "row_number() OVER (ORDER BY r * r / (1 - r * r) * (n - 2) DESC) <= 2 AS selected FROM f")
def q_select_k_best_regression(spark, sf):
    feats = ["l_quantity", "l_discount", "l_tax"]
    model, _ = _fit_transform(fs.SelectKBest(k=2, score_func="f_regression"), lineitem(spark, sf), feats,
                              label="l_extendedprice")
    scores = model.feature_state()["scores"]
    kept = set(model.output_columns())
    rows = [(c, scores[c], c in kept) for c in feats]
    return rounded(spark.createDataFrame(rows, "feature string, score double, selected boolean"), 6)


@query("one_hot_encoder_vector", """SELECT c_custkey,
  CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS hot_index,
  CAST(count(*) OVER () AS INTEGER) AS width FROM customer""")
def q_one_hot_encoder_vector(spark, sf):
    """A vocabulary as one sparse vector column, on request."""
    from tabforge.queries.fixtures import customer

    model, out = _fit_transform(fs.OneHotEncoder(sparse=True), customer(spark, sf), ["c_name"])
    # of the sparse form: spelt out, the vectors would grow with the square of the table
    hot = F.unwrap_udt("c_name_onehot")
    return out.select("c_custkey", F.coalesce(F.get(hot["indices"], 0), F.lit(-1)).cast("int").alias("hot_index"),
                      hot["size"].cast("int").alias("width"))


SKETCH_PROBS = [0.33, 0.61, 0.95]


@query("sketch_quantiles", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS prob, CAST(quantile_disc({c}, {p}) AS DOUBLE) AS value FROM lineitem"
    for c in ("l_quantity", "l_discount") for p in SKETCH_PROBS))
def q_sketch_quantiles(spark, sf):
    """Quantiles from one sketch a column; the values lie far enough apart for the rank error not to matter."""
    from tabforge.operators.stats import sketch_quantiles

    cols = ["l_quantity", "l_discount"]
    found = sketch_quantiles(lineitem(spark, sf), cols, SKETCH_PROBS)
    return spark.createDataFrame([(c, p, v) for c in cols for p, v in zip(SKETCH_PROBS, found[c])],
                                 "column_name string, prob double, value double")
