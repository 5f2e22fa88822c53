"""Tier 2: random small frames through our ops and through the pandas calls
the reference makes; results must agree except where a deliberate
deviation (SURVEY §2.9) says otherwise."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabforge.functions.columns import ROW_ID
from tabforge.plans.cleaning import apply_ops

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

values = st.one_of(st.none(), st.sampled_from([0.0, 1.0, 1.5, 2.0, -3.0, 7.25]))
labels = st.one_of(st.none(), st.sampled_from(["a", "b", "c"]))
rows = st.lists(st.tuples(values, values, labels), min_size=1, max_size=12)


def to_spark(spark, data):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"{ROW_ID} bigint, x double, y double, s string")


def to_pandas(data):
    return pd.DataFrame(data, columns=["x", "y", "s"]).astype({"x": "float64", "y": "float64", "s": "object"})


def ours(df):
    out = df.orderBy(ROW_ID).drop(ROW_ID).toPandas()
    return [tuple(None if (isinstance(v, float) and math.isnan(v)) or v is None else v for v in r)
            for r in out.itertuples(index=False)]


def theirs(pdf):
    return [tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in r)
            for r in pdf.itertuples(index=False)]


def close(a, b):
    assert len(a) == len(b)
    for ra, rb in zip(a, b):
        for va, vb in zip(ra, rb):
            if isinstance(va, float) and isinstance(vb, float):
                assert va == pytest.approx(vb)
            else:
                assert va == vb


@SETTINGS
@given(rows, st.sampled_from(["mean", "median", "mode"]))
def test_fill_matches_pandas(spark, data, strategy):
    pdf = to_pandas(data)
    col = pdf["x"]
    fill = {"mean": col.mean(), "median": col.median(),
            "mode": col.mode()[0] if not col.mode().empty else np.nan}[strategy]
    pdf["x"] = col.fillna(fill)
    out = apply_ops(to_spark(spark, data), [("fill_missing", {"column": "x", "strategy": strategy})])
    close(ours(out), theirs(pdf))


@SETTINGS
@given(rows)
def test_fill_all_median_matches_pandas(spark, data):
    pdf = to_pandas(data)
    num = pdf.select_dtypes(include="number").columns
    pdf[num] = pdf[num].fillna(pdf[num].median())
    out = apply_ops(to_spark(spark, data), [("fill_missing", {"strategy": "median"})])
    close(ours(out), theirs(pdf))


@SETTINGS
@given(rows, st.sampled_from([None, ["x"], ["s", "y"]]))
def test_drop_nulls_matches_pandas(spark, data, subset):
    pdf = to_pandas(data).dropna(subset=subset)
    out = apply_ops(to_spark(spark, data), [("drop_nulls", {"subset": subset})])
    close(ours(out), theirs(pdf))


@SETTINGS
@given(rows, st.sampled_from([None, ["x"], ["s", "x"]]))
def test_drop_duplicates_keeps_first_like_pandas(spark, data, subset):
    pdf = to_pandas(data).drop_duplicates(subset=subset)
    out = apply_ops(to_spark(spark, data), [("drop_duplicates", {"subset": subset})])
    close(ours(out), theirs(pdf))


OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b,
       "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


@SETTINGS
@given(rows, st.sampled_from(sorted(OPS)), st.sampled_from(["1", "1.5", "-3"]))
def test_numeric_filters_match_pandas(spark, data, op, value):
    pdf = to_pandas(data)
    pdf = pdf[OPS[op](pdf["x"], float(value))]
    out = apply_ops(to_spark(spark, data), [("filter_rows", {"column": "x", "operator": op, "value": value})])
    close(ours(out), theirs(pdf))


@SETTINGS
@given(rows, st.sampled_from(["==", "!=", ">", "<="]), st.sampled_from(["a", "b"]))
def test_text_filters_match_pandas(spark, data, op, value):
    pdf = to_pandas(data)
    keep = [(OPS[op](v, value) if v is not None else op == "!=") for v in pdf["s"]]
    pdf = pdf[keep]
    out = apply_ops(to_spark(spark, data), [("filter_rows", {"column": "s", "operator": op, "value": value})])
    close(ours(out), theirs(pdf))


def test_parquet_row_ids_across_files(spark, tmp_path):
    from tabforge.sources.scan import scan_parquet

    src = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    src.repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(str(tmp_path / "o"))
    df = scan_parquet(spark, str(tmp_path / "o"))
    assert df.where(df[ROW_ID] != df["o_orderkey"]).count() == 0
