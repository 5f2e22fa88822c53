"""CSV records across splits: the same rows as the one-task reader."""

import csv
import os
import random

import pytest

from tabforge.functions.columns import ROW_ID
from tabforge.sources import records
from tabforge.sources.scan import scan_csv
from tabforge.session import scratch_path

FIELDS = ["", "a", "plain text", "with \"quotes\"", "one\nbreak", "two\n\nbreaks", "comma, and\nbreak", "\"", "\n", "x" * 300,
          "crlf\r\nbreak", "long\n" * 40, "é日本\n", "5\" pipe", "trailing space ", "'"]


def write(path, rows, ending="\n", header=("k", "a", "b")):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=ending)
        w.writerow(header)
        w.writerows(rows)


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in zip(keys, ("500", "0", "1")):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_of(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice(FIELDS), rng.choice(FIELDS)) for i in range(n)]


@pytest.mark.parametrize("seed,ending", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_records_equal_the_written_rows(spark, small_splits, tmp_path, seed, ending):
    files = {}
    for name in ("b.csv", "a.csv", "c.csv"):
        files[name] = rows_of(f"{seed}{name}", 150 if name != "c.csv" else 0)
        write(tmp_path / name, files[name], ending)
    assert records.has_open_lines(spark, str(tmp_path))
    df = scan_csv(spark, str(tmp_path))
    got = [(r[ROW_ID], r["k"], r["a"], r["b"]) for r in df.orderBy(ROW_ID).collect()]
    want = [(i, *r) for i, r in enumerate(files["a.csv"] + files["b.csv"])]
    assert [(i, k) for i, k, *_ in got] == [(i, k) for i, k, *_ in want]
    for g, w in zip(got, want):
        assert [v or "" for v in g[2:]] == list(w[2:]), w


def test_records_equal_the_one_task_reader(spark, small_splits, tmp_path):
    path = str(tmp_path / "t.csv")
    write(path, rows_of(9, 400))
    with open(path, "a", newline="") as f:  # blank lines, short rows, stray quotes, an open end
        f.write("\n\n700,short\n701,5\" pipe,x\n702,\"closed\" tail,y\n703,\"never\nclosed")
    opts = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}
    want = spark.read.schema("k string, a string, b string").options(**opts).csv(path).collect()
    got = scan_csv(spark, path).orderBy(ROW_ID).collect()
    assert [tuple(v or "" for v in r) for r in want] == [tuple(str(v) if v is not None else "" for v in (r["k"], r["a"], r["b"])) for r in got]
    assert scan_csv(spark, path, row_ids=False).count() == len(want)


def test_lines_of_white_space_are_skipped_like_in_pandas(spark, small_splits, tmp_path):
    import pandas as pd

    path = str(tmp_path / "w.csv")
    with open(path, "w") as f:
        f.write("k,a\n1,\"x\n   \ny\"\n   \n\n2,z\n \t \n")
    want = pd.read_csv(path)
    assert [(r["k"], r["a"], r[ROW_ID]) for r in scan_csv(spark, path).orderBy(ROW_ID).collect()] == [
        (k, a, i) for i, (k, a) in enumerate(want.itertuples(index=False))]


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "large.csv")
    body = "".join(f'{i},"line one\nline {i % 10}","{"text " * 40}"\n' for i in range(100_000))
    with open(path, "w") as f:
        f.write("k,a,b\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
    try:
        lines = records._lines(spark, path)
        assert lines.rdd.getNumPartitions() >= os.path.getsize(path) // (2 << 20) >= 10
        df = scan_csv(spark, path)
        assert df.dtypes == [("k", "bigint"), ("a", "string"), ("b", "string"), (ROW_ID, "bigint")]
        assert df.count() == 100_000 and df.where(f"k <> {ROW_ID} or a <> concat('line one\n', 'line ', k % 10)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_record_over_many_splits_and_only_a_header(spark, small_splits, tmp_path):
    path = scratch_path(spark, "csv")
    os.makedirs(path.removeprefix("file:"))
    write(f"{path.removeprefix('file:')}/x.csv", [(1, "many lines\n" * 2000, "z"), (2, "a", "b")])
    got = scan_csv(spark, path).orderBy(ROW_ID).collect()
    assert [(r["k"], r["a"], r["b"]) for r in got] == [(1, "many lines\n" * 2000, "z"), (2, "a", "b")]
    write(tmp_path / "h.csv", [], header=("k\nname", "a", "b"))
    assert scan_csv(spark, str(tmp_path / "h.csv")).count() == 0


@pytest.mark.parametrize("line,is_open", [
    ("a,b", False), ('a,"b', True), ('a,"b"', False), ('"a""', True), ('"a"",b', True), ('"a""",b', False), ('a"b,c', False),
    ('"a" x,"b', True), ('"a" x,b', False), ('"', True), ('""', False), ('"""', True), ('a,"x,""y"', False), (',,"', True), ("", False)])
def test_open_lines(line, is_open):
    assert bool(records._OPEN.match(line)) is is_open
