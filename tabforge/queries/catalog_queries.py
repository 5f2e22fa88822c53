"""Queries for sources, sinks and the dataset/run catalog (§2.1).

Each query builds a fresh store under the session's shared checkpoint
folder, ingests the given tables into it (so the work grows with them),
and reads the catalog back. Ids are passed explicitly so that the oracle
can name them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabforge.functions.columns import ROW_ID
from tabforge.plans.training import TrainSpec
from tabforge.queries.registry import R, query, rnd, rounded
from tabforge.session import discard, materialize, scratch_path
from tabforge.sources.scan import infer_schema, read_csv_text, scan_csv, scan_parquet
from tabforge.sources.store import Store

CLEAN_OPS = [{"op": "filter_rows", "params": {"column": "o_orderstatus", "operator": "==", "value": "F"}},
             {"op": "drop_columns", "params": {"columns": ["o_orderdate"]}}]


def _store(spark, sf) -> Store:
    st = Store(spark, scratch_path(spark, "store"))
    st.ingest(f"{sf}/orders.parquet", dataset_id="raw00001")
    st.ingest(f"{sf}/customer.parquet", dataset_id="raw00002")
    st.save_clean("raw00001", CLEAN_OPS, clean_id="cln00001")
    return st


@query("list_datasets", """SELECT 'raw00001' AS id, 'orders.parquet' AS name, count(*) AS n_rows,
  CAST(6 AS BIGINT) AS n_columns, 'raw' AS type FROM orders
UNION ALL SELECT 'raw00002', 'customer.parquet', count(*), 5, 'raw' FROM customer
UNION ALL SELECT 'cln00001', 'cln00001', count(*), 5, 'clean' FROM orders WHERE o_orderstatus = 'F'""")
def q_list_datasets(spark, sf):
    return _store(spark, sf).list_datasets()


@query("dataset_display_name", """SELECT 'raw00001' AS id, 'orders.parquet' AS display_name
UNION ALL SELECT 'raw00002', 'customer.parquet' UNION ALL SELECT 'cln00001', 'orders.parquet'""")
def q_dataset_display_name(spark, sf):
    return _store(spark, sf).display_names()


@query("clean_history", """SELECT CAST(0 AS INTEGER) AS position, 'filter_rows' AS op,
  '{"column":"o_orderstatus","operator":"==","value":"F"}' AS params
UNION ALL SELECT 1, 'drop_columns', '{"columns":["o_orderdate"]}'""")
def q_clean_history(spark, sf):
    return _store(spark, sf).clean_history("cln00001")


@query("save_clean", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority "
       "FROM orders WHERE o_orderstatus = 'F'")
def q_save_clean(spark, sf):
    return _store(spark, sf).load("cln00001").drop(ROW_ID)


@query("scan_parquet", "SELECT *, o_orderkey - (SELECT min(o_orderkey) FROM orders) AS row_id FROM orders")
def q_scan_parquet(spark, sf):
    """Every row with its place in the file (the table is stored in key order)."""
    return scan_parquet(spark, f"{sf}/orders.parquet").withColumnRenamed(ROW_ID, "row_id")


# Rows of a written CSV file: its sort is one task's.
FILE_ROWS = 250_000


def _orders_csv(spark, sf, parts: int = 4) -> str:
    path = scratch_path(spark, "orders-csv")
    o = spark.read.parquet(f"{sf}/orders.parquet")
    (o.repartitionByRange(max(parts, -(-o.count() // FILE_ROWS)), "o_orderkey").sortWithinPartitions("o_orderkey")
     .write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
    return path


@query("scan_csv", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders""")
def q_scan_csv(spark, sf):
    """A multi-file CSV read back with inferred types (dates stay text)."""
    return scan_csv(spark, _orders_csv(spark, sf)).drop(ROW_ID)


@query("row_ids_csv", "SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def q_row_ids_csv(spark, sf):
    """Row ids follow file then line order across CSV part files."""
    df = scan_csv(spark, _orders_csv(spark, sf), multiline=False)
    return df.select("o_orderkey", "o_orderstatus", F.col(ROW_ID).alias("row_id"))


def _text_csv(spark, sf, name: str, line: Column, header: str, parts: int = 4, key: str = "o_custkey") -> list[str]:
    """CSV files of lines as they are, each file below its header: by part, in
    ranges of the key of about FILE_ROWS rows. The folders are in file order."""
    path = scratch_path(spark, name)
    o = spark.read.parquet(f"{sf}/orders.parquet")
    rows = o.select((F.col("o_orderkey") % parts).cast("int").alias("part"), F.lit(1).alias("below"), F.col(key).alias("key"), line.alias("line"))
    # written once: a range partitioning that runs again may cut elsewhere
    dealt = materialize(rows.repartitionByRange(max(1, -(-o.count() // FILE_ROWS)), "part", "key")
                        .withColumn("piece", F.format_string("%06d", F.spark_partition_id())), f"{name}-lines")
    found = {tuple(r) for r in dealt.select("part", "piece").distinct().collect()}
    files = sorted(found | {(i, "000000") for i in range(parts) if i not in {p for p, _ in found}}, key=lambda f: (f[0] is not None, f))
    heads = spark.createDataFrame([(p, 0, None, header, q) for p, q in files], dealt.schema)
    (dealt.union(heads).repartition(len(files), "part", "piece").sortWithinPartitions("part", "piece", "below", "key")
     .select("part", "piece", "line").write.partitionBy("part", "piece").text(path))
    discard(dealt)
    return [f"{path}/part={p}/piece={q}" for p, q in files if p is not None]


@query("scan_csv_ragged", """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS o_custkey
  FROM orders""")
def q_scan_csv_ragged(spark, sf):
    """Rows that end early have missing values in the columns they lack."""
    line = F.concat_ws(",", "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")))
    path = _text_csv(spark, sf, "ragged-csv", line, "o_orderkey,o_orderstatus,o_custkey")
    return scan_csv(spark, path, multiline=False).drop(ROW_ID)


@query("scan_csv_breaks", """SELECT o_orderkey, 'status ""' || o_orderstatus || '"",' || chr(10) || chr(10) || 'customer ' || o_custkey AS note,
  o_totalprice, row_number() OVER (ORDER BY o_orderkey % 4, o_orderkey) - 1 AS row_id FROM orders""".replace('""', '"'))
def q_scan_csv_breaks(spark, sf):
    """Quoted fields with line breaks, commas and quotes, read in splits; row ids in file order."""
    line = F.concat("o_orderkey", F.lit(',"status ""'), "o_orderstatus", F.lit('"",\n\ncustomer '), "o_custkey", F.lit('",'), "o_totalprice")
    path = _text_csv(spark, sf, "breaks-csv", line, '"o_orderkey",note,o_totalprice', key="o_orderkey")
    return scan_csv(spark, path).select("o_orderkey", "note", "o_totalprice", F.col(ROW_ID).alias("row_id"))


@query("infer_schema_bigint", """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || '00000000000000000000' AS large FROM orders""")
def q_infer_schema_bigint(spark, sf):
    """Integers beyond 64 bits stay text."""
    line = F.concat("o_orderkey", F.lit(","), "o_custkey", F.lit("0" * 20))
    path = _text_csv(spark, sf, "large-csv", line, "o_orderkey,large")
    return scan_csv(spark, path, multiline=False).drop(ROW_ID)


def _infer_sql() -> str:
    def rule(c):
        t = f"CAST({c} AS VARCHAR)"
        return (f"SELECT '{c}' AS column_name, CASE "
                f"WHEN count_if(NOT regexp_full_match({t}, '\\s*[+-]?\\d+\\s*')) = 0 THEN 'bigint' "
                f"WHEN count_if(NOT regexp_full_match({t}, '\\s*[+-]?((\\d+\\.?\\d*)|(\\.\\d+))([eE][+-]?\\d+)?\\s*')) = 0 "
                f"THEN 'double' ELSE 'string' END AS dtype FROM orders")
    return "\nUNION ALL\n".join(rule(c) for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                   "o_orderdate", "o_orderpriority"])


@query("infer_schema", _infer_sql())
def q_infer_schema(spark, sf):
    types = infer_schema(read_csv_text(spark, _orders_csv(spark, sf)))
    return spark.createDataFrame(sorted(types.items()), "column_name string, dtype string")


# A one-feature linear run has a closed form over the split's training rows
# (scaling the feature does not change the predictions).
RUN_SQL = """WITH s AS (SELECT *, row_number() OVER (
    ORDER BY md5(CAST(p_partkey - (SELECT min(p_partkey) FROM part) AS VARCHAR) || '-42'))
    <= (SELECT ceil(count(*) * 0.2) FROM part) AS is_test FROM part),
m AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a,
             stddev_pop(p_size) AS sd FROM s WHERE NOT is_test),
p AS (SELECT p_partkey, p_size, p_retailprice AS actual, a + b * p_size AS predicted FROM s, m WHERE is_test),
e AS (SELECT avg((actual - predicted) ** 2) AS mse, var_pop(actual) AS v FROM p)
"""


def run_store(spark, sf):
    st = Store(spark, scratch_path(spark, "store"))
    st.ingest(f"{sf}/part.parquet", dataset_id="part0001")
    spec = TrainSpec(target_column="p_retailprice", feature_columns=["p_size"],
                     steps=[{"name": "StandardScaler"},
                            {"name": "LinearRegression", "category": "estimators"}], dataset_id="part0001")
    st.train(spec, job_id="run00001")
    return st


_RUN_COLS = f"""'run00001' AS job_id, 'part0001' AS dataset_id, 'p_retailprice' AS target_column, false AS is_classifier,
  {R("1 - mse / v", 6)} AS r2, {R("mse", 3)} AS mse, {R("sqrt(mse)", 4)} AS rmse"""
_METRICS_SCHEMA = "r2 double, mse double, rmse double"


def _metric_columns(parsed):
    return [rnd(parsed["r2"], 6).alias("r2"), rnd(parsed["mse"], 3).alias("mse"), rnd(parsed["rmse"], 4).alias("rmse")]


@query("list_runs", RUN_SQL + f"SELECT {_RUN_COLS} FROM e")
def q_list_runs(spark, sf):
    return run_store(spark, sf).list_runs().select(
        "job_id", "dataset_id", "target_column", "is_classifier",
        *_metric_columns(F.from_json("metrics", _METRICS_SCHEMA)))


@query("get_run", RUN_SQL + f"""SELECT {_RUN_COLS}, 'p_size' AS feature, {R("abs(b) * sd", 4)} AS importance,
  (SELECT least(count(*), 200) FROM p) AS previewed FROM e, m""")
def q_get_run(spark, sf):
    r = run_store(spark, sf).get_run("run00001")
    m, top = r["metrics"], r["feature_importance"][0]
    row = (r["job_id"], r["dataset_id"], r["target_column"], r["is_classifier"], m["r2"], m["mse"], m["rmse"],
           top["feature"], top["importance"], len(r["predictions"]))
    df = spark.createDataFrame([row], "job_id string, dataset_id string, target_column string, is_classifier boolean, "
                                      f"{_METRICS_SCHEMA}, feature string, importance double, previewed long")
    return df.select("job_id", "dataset_id", "target_column", "is_classifier", *_metric_columns(df), "feature",
                     rnd(F.col("importance"), 4).alias("importance"), "previewed")


_PRED_COLS = f"""p_size, {R("actual", 4)} AS actual, {R("predicted", 4)} AS predicted, CAST(NULL AS DOUBLE) AS probability,
  {R("actual - predicted", 4)} AS residual"""


@query("save_predictions", RUN_SQL + f"SELECT {_PRED_COLS} FROM p")
def q_save_predictions(spark, sf):
    return rounded(run_store(spark, sf).predictions("run00001").drop(ROW_ID), 4)


@query("export_predictions_csv", RUN_SQL + f"SELECT {_PRED_COLS} FROM p")
def q_export_predictions_csv(spark, sf):
    st = run_store(spark, sf)
    out = st.export_predictions_csv("run00001", scratch_path(spark, "export"))
    df = spark.read.option("header", True).csv(out)
    return rounded(df.select(F.col("p_size").cast("int"), *[F.col(c).cast("double") for c in
                                                            ("actual", "predicted", "probability", "residual")]), 4)


@query("predictions_preview", RUN_SQL + f"SELECT {_PRED_COLS} FROM (SELECT * FROM p ORDER BY p_partkey LIMIT 200)")
def q_predictions_preview(spark, sf):
    """The first 200 rows of a run's predictions, in row order."""
    from tabforge.plans.training import train

    st = run_store(spark, sf)
    run = train(st.load("part0001"), TrainSpec(target_column="p_retailprice", feature_columns=["p_size"],
                                               steps=[{"name": "LinearRegression", "category": "estimators"}]))
    return rounded(spark.createDataFrame(run.predictions_preview(), run.predictions.drop(ROW_ID).schema), 4)


@query("feature_importance", RUN_SQL + f"SELECT 'p_size' AS feature, {R('abs(b) * sd', 4)} AS importance FROM m")
def q_feature_importance(spark, sf):
    return rounded(spark.createDataFrame(run_store(spark, sf).get_run("run00001")["feature_importance"],
                                         "feature string, importance double"), 4)


@query("save_model", RUN_SQL + f"SELECT p_partkey, {R('a + b * p_size', 4)} AS prediction FROM part, m")
def q_save_model(spark, sf):
    """The stored stages, loaded again, score the whole table."""
    st = run_store(spark, sf)
    return rounded(st.score("run00001", st.load("part0001")).select("p_partkey", "prediction"), 4)


@query("numeric_columns", """SELECT column_name FROM (DESCRIBE part)
  WHERE column_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT', 'DOUBLE', 'FLOAT')""")
def q_numeric_columns(spark, sf):
    from tabforge.operators.explore import numeric_columns_of

    return spark.createDataFrame([(c,) for c in numeric_columns_of(scan_parquet(spark, f"{sf}/part.parquet"))], "column_name string")


@query("prediction_columns", RUN_SQL + f"""SELECT t.position, t.name FROM (SELECT count(*) AS n FROM p),
  (VALUES (0, 'p_size'), (1, 'actual'), (2, 'predicted'), (3, 'residual')) AS t(position, name) WHERE n > 0""")
def q_prediction_columns(spark, sf):
    from tabforge.operators.explore import prediction_columns

    st = run_store(spark, sf)
    r = st.get_run("run00001")
    offered = prediction_columns(r["feature_columns"], r["is_classifier"])
    have = st.predictions("run00001").columns
    return spark.createDataFrame([(i, c) for i, c in enumerate(offered) if c in have], "position int, name string")
