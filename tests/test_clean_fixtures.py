"""Hand-written cleaning fixtures (reference behaviour and our decisions)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabforge.errors import ColumnNotFound, InvalidParameter, UnknownOperation
from tabforge.functions.columns import ROW_ID
from tabforge.operators import profile
from tabforge.operators.explore import histogram
from tabforge.plans.cleaning import apply_ops, preview_clean


def frame(spark, schema, values):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"{ROW_ID} bigint, {schema}")


def col(df, name):
    return [r[0] for r in df.orderBy(ROW_ID).select(name).collect()]


def test_mode_tie_takes_smallest(spark):
    df = frame(spark, "x double", [3.0, 1.0, 3.0, 1.0, 2.0, None])
    out = apply_ops(df, [("fill_missing", {"column": "x", "strategy": "mode"})])
    assert col(out, "x")[-1] == 1.0


def test_mode_text(spark):
    df = frame(spark, "s string", ["b", "a", None, None, None])
    out = apply_ops(df, [("fill_missing", {"column": "s", "strategy": "mode"})])
    assert col(out, "s") == ["b", "a", "a", "a", "a"]


def test_not_equal_keeps_null(spark):
    df = frame(spark, "x double", [1.0, None])
    out = apply_ops(df, [("filter_rows", {"column": "x", "operator": "!=", "value": "1"})])
    assert col(out, "x") == [None]


def test_greater_on_text_drops_null(spark):
    df = frame(spark, "s string", ["a", None, "c"])
    out = apply_ops(df, [("filter_rows", {"column": "s", "operator": ">", "value": "b"})])
    assert col(out, "s") == ["c"]


def test_int32_filter_coerces(spark):
    df = frame(spark, "i int", [1, 2])
    out = apply_ops(df, [("filter_rows", {"column": "i", "operator": "==", "value": "1"})])
    assert col(out, "i") == [1]


def test_timestamp_filter(spark):
    df = frame(spark, "t timestamp_ntz", [dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)])
    out = apply_ops(df, [("filter_rows", {"column": "t", "operator": ">=", "value": "2020-06-01"})])
    assert col(out, "t") == [dt.datetime(2021, 1, 1)]


def test_filter_bad_value_is_noop_with_report(spark):
    df = frame(spark, "x double", [1.0, 2.0])
    reports = []
    out = apply_ops(df, [("filter_rows", {"column": "x", "operator": ">", "value": "abc"})], reports=reports)
    assert col(out, "x") == [1.0, 2.0]
    assert reports[0].applied is False


@pytest.mark.parametrize("schema,values,dtype,expected", [
    ("x double", [1.9, -1.9], "int64", [1, -1]),
    ("x double", [1.5, None], "int64", [1.5, None]),
    ("s string", ["1", "1.5"], "int64", ["1", "1.5"]),
    ("s string", [" 1 ", "1e3"], "float64", [1.0, 1000.0]),
    ("s string", ["1", "x"], "float64", ["1", "x"]),
    ("x double", [0.0, 2.0, None], "bool", [False, True, None]),
    ("s string", ["", "False", None], "bool", [False, True, None]),
    ("s string", ["1.5d", "2"], "float64", ["1.5d", "2"]),
])
def test_casts(spark, schema, values, dtype, expected):
    name = schema.split()[0]
    df = frame(spark, schema, values)
    out = apply_ops(df, [("cast_dtype", {"column": name, "dtype": dtype})])
    assert col(out, name) == expected


def test_duplicates_treat_nulls_equal(spark):
    df = frame(spark, "a double", [None, None, 1.0])
    out = apply_ops(df, [("drop_duplicates", {})])
    assert sorted(col(out, ROW_ID)) == [0, 2]


def test_duplicates_keep_first_by_row_order(spark):
    rows = [(5, "k", 1), (2, "k", 2), (9, "j", 3)]
    df = spark.createDataFrame(rows, f"{ROW_ID} bigint, key string, v int")
    out = apply_ops(df, [("drop_duplicates", {"subset": ["key"]})])
    assert sorted((r["key"], r["v"]) for r in out.collect()) == [("j", 3), ("k", 2)]


def test_mean_on_text_is_typed_error(spark):
    df = frame(spark, "s string", ["a", "b", None])
    with pytest.raises(InvalidParameter):
        apply_ops(df, [("fill_missing", {"column": "s", "strategy": "mean"})])


def test_rename_clash_raises(spark):
    df = spark.createDataFrame([(0, 1, 2)], f"{ROW_ID} bigint, a int, b int")
    with pytest.raises(InvalidParameter):
        apply_ops(df, [("rename_column", {"old_name": "a", "new_name": "b"})])


def test_past_end_page_is_empty(spark):
    df = frame(spark, "a int", [1])
    assert profile.preview_page(df, page=1, page_size=50).count() == 0


def test_missing_subset_is_typed_error(spark):
    df = frame(spark, "a int", [1])
    with pytest.raises(ColumnNotFound):
        apply_ops(df, [("drop_nulls", {"subset": ["z"]})])


def test_unknown_op_raises(spark):
    df = frame(spark, "a int", [1])
    with pytest.raises(UnknownOperation):
        apply_ops(df, [("explode_everything", {})])


@pytest.mark.parametrize("closed,total", [(False, 14), (True, 15)])
def test_histogram_max(spark, closed, total):
    df = frame(spark, "x double", [float(v) for v in range(15)])
    h = histogram(df, "x", closed_last=closed)
    assert h.count() == 14
    assert sum(r["count"] for r in h.collect()) == total


def test_histogram_constant_column(spark):
    df = frame(spark, "x double", [2.0, 2.0])
    h = {r["bin"]: r["count"] for r in histogram(df, "x").collect()}
    assert h[0] == 2 and sum(h.values()) == 2


def test_fill_all_keeps_untouched_int_type(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (1, 2, None)], f"{ROW_ID} bigint, k bigint, x double")
    out = apply_ops(df, [("fill_missing", {"strategy": "median"})])
    assert dict(out.dtypes)["k"] == "bigint"
    assert col(out, "x") == [1.0, 1.0]


def test_adjacent_fills_share_one_plan(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, None, 4.0), (2, 3.0, 2.0)],
                               f"{ROW_ID} bigint, a double, b double")
    out = apply_ops(df, [("fill_missing", {"column": "a", "strategy": "mean"}),
                         ("fill_missing", {"column": "b", "strategy": "mean"})])
    assert col(out, "a") == [1.0, 2.0, 3.0] and col(out, "b") == [3.0, 4.0, 2.0]


def test_preview_clean_shapes(spark):
    df = frame(spark, "x double", [1.0, None, 3.0])
    res = preview_clean(df, [("drop_nulls", {})])
    assert (res["original_rows"], res["result_rows"], res["result_cols"]) == (3, 2, 1)
    assert res["null_counts"] == {"x": 0}


def test_cast_naive_timestamp_to_int_is_epoch_nanos(spark):
    df = frame(spark, "t timestamp_ntz", [dt.datetime(1970, 1, 2)])
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        out = apply_ops(df, [("cast_dtype", {"column": "t", "dtype": "int64"})])
        assert col(out, "t") == [86_400 * 10**9]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_adjacent_casts_share_one_check(spark):
    df = spark.createDataFrame([(0, "1", "x", 2.5), (1, "2", "3", None)],
                               f"{ROW_ID} bigint, a string, b string, c double")
    reports = []
    out = apply_ops(df, [("cast_dtype", {"column": "a", "dtype": "int64"}),
                         ("cast_dtype", {"column": "b", "dtype": "float64"}),
                         ("cast_dtype", {"column": "c", "dtype": "str"})], reports=reports)
    assert dict(out.dtypes)["a"] == "bigint" and dict(out.dtypes)["b"] == "string"
    assert col(out, "a") == [1, 2] and col(out, "c") == ["2.5", None]
    assert [r.applied for r in reports] == [True, False, True]
