"""CSV inference, row identity across files, and the catalog store."""

import os

import pytest
from pyspark.sql import functions as F

from tabforge.errors import DatasetNotFound, InvalidParameter
from tabforge.functions.columns import ROW_ID
from tabforge.sources.scan import infer_schema, read_csv_text, scan_csv
from tabforge.sources.store import Store


def write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_inference(spark, tmp_path):
    p = write(tmp_path / "t.csv",
              "a,b,b2,c,d,e,g,h,suffix\n"
              "1,True,True,x,1, 1,2020-01-01,yes,1.5d\n"
              "2,FALSE,NA,NA,,2,2020-01-02,no,1f\n")
    types = infer_schema(read_csv_text(spark, str(p)))
    assert types == {"a": "bigint", "b": "boolean", "b2": "string", "c": "string", "d": "bigint",
                     "e": "bigint", "g": "string", "h": "string", "suffix": "string"}
    df = scan_csv(spark, str(p))
    rows = df.orderBy(ROW_ID).collect()
    assert rows[1]["d"] is None and rows[0]["e"] == 1 and rows[1]["c"] is None and rows[1]["b"] is False


def test_duplicate_header(spark, tmp_path):
    p2 = write(tmp_path / "d2.csv", "a,a\n1,2\n")
    assert read_csv_text(spark, str(p2)).columns == ["a", "a.1"]


def test_all_missing_column_is_double(spark, tmp_path):
    p = write(tmp_path / "n.csv", "a,b\n1,\n2,NA\n")
    assert infer_schema(read_csv_text(spark, str(p)))["b"] == "double"


def test_row_ids_follow_file_order(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    start = 0
    for name, n in [("part-0.csv", 3000), ("part-1.csv", 9000), ("part-2.csv", 500)]:
        write(d / name, "v\n" + "\n".join(str(start + i) for i in range(n)) + "\n")
        start += n
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = scan_csv(spark, str(d), multiline=False)
        assert df.rdd.getNumPartitions() > 3
        bad = df.where(F.col(ROW_ID) != F.col("v")).count()
        assert bad == 0 and df.count() == 12500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_store_round_trip(spark, store_root):
    st = Store(spark, store_root + "-rt")
    info = st.ingest("/root/testdata/sf0.001/orders.parquet")
    assert info["rows"] == 1500 and info["columns"] == 6 and len(info["preview"]) == 50
    raw = info["id"]
    page = st.preview(raw, page=1, page_size=10)
    assert page["total"] == 1500 and len(page["rows"]) == 10
    res = st.save_clean(raw, [{"op": "filter_rows", "params": {"column": "o_orderstatus", "operator": "==",
                                                                "value": "O"}}], name="open")
    assert res["rows"] == st.load(res["clean_id"]).count()
    assert st.describe(res["clean_id"])["name"] == "orders.parquet"
    hist = st.clean_history(res["clean_id"]).collect()
    assert [r["op"] for r in hist] == ["filter_rows"]
    assert st.clean_history(raw).count() == 0
    listed = st.list_datasets().collect()
    assert [r["type"] for r in listed] == ["raw", "clean"]
    with pytest.raises(DatasetNotFound):
        st.load("nope")
    with pytest.raises(InvalidParameter):
        st.ingest("/root/testdata/sf0.001/orders.xlsx")


def test_run_round_trip(spark, store_root):
    from tabforge.plans.training import TrainSpec

    st = Store(spark, store_root + "-runs")
    ds = st.ingest("/root/testdata/sf0.001/lineitem.parquet")["id"]
    spec = TrainSpec(target_column="l_extendedprice", feature_columns=["l_quantity", "l_tax"],
                     steps=[{"name": "MinMaxScaler"}, {"name": "LinearRegression", "category": "estimators"}],
                     dataset_id=ds)
    run = st.train(spec)
    got = st.get_run(run.job_id)
    assert got["metrics"]["r2"] == pytest.approx(run.metrics["r2"])
    assert len(got["predictions"]) == 200
    out = st.export_predictions_csv(run.job_id, store_root + "-export")
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 1200 and "residual" in back.columns
    from pyspark.ml import PipelineModel

    model = PipelineModel.load(st.runs().where(F.col("job_id") == run.job_id).first()["model_path"])
    assert len(model.stages) == 3


def test_written_csv_files_are_bounded_whatever_the_table(spark, tmp_path, monkeypatch):
    """A part was one file, sorted whole by one task."""
    from tabforge.queries import catalog_queries as cq

    n = 3000
    o = spark.range(1, n + 1).select(
        F.col("id").alias("o_orderkey"), (F.col("id") * 7 % 100).alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
        (F.col("id") + 0.5).alias("o_totalprice"), F.lit("1-URGENT").alias("o_orderpriority"))
    o.write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(cq, "FILE_ROWS", 250)
    rows = cq.q_scan_csv_breaks(spark, str(tmp_path)).orderBy("row_id").collect()
    want = sorted(range(1, n + 1), key=lambda k: (k % 4, k))
    assert [(r.o_orderkey, r.row_id) for r in rows] == [(k, i) for i, k in enumerate(want)]
    assert rows[0].note == f'status "O",\n\ncustomer {want[0] * 7 % 100}'
    assert sorted(tuple(r) for r in cq.q_infer_schema_bigint(spark, str(tmp_path)).collect()) == [
        (k, f"{k * 7 % 100}" + "0" * 20) for k in range(1, n + 1)]
    files = cq._text_csv(spark, str(tmp_path), "bounded", F.col("o_orderkey").cast("string"), "h", key="o_orderkey")
    sizes = [spark.read.text(f).count() for f in files]
    assert len(files) >= 12 and sum(sizes) == n + len(files) and max(sizes) < 600
