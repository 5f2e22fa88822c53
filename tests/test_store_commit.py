"""Writing to a store: all or nothing, also with two writers."""

import datetime as dt
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tabforge.errors import InvalidParameter
from tabforge.plans.training import TrainSpec, train
from tabforge.session import scratch_path
from tabforge.sources.store import Store


@pytest.fixture
def store(spark):
    return Store(spark, scratch_path(spark, "commit-store"))


def files(store, *parts):
    path = os.path.join(store.root.removeprefix("file:"), *parts)
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def write_csv(tmp_path, text="a,b\n1,x\n2,y\n"):
    path = tmp_path / "t.csv"
    path.write_text(text)
    return str(path)


def test_a_failed_ingest_leaves_nothing_and_can_be_repeated(store, tmp_path):
    path = write_csv(tmp_path, "a,b\n1,x\n2,y,too,long\n")
    with pytest.raises(Exception, match="more than the 2 fields"):
        store.ingest(path, dataset_id="one")
    assert files(store, "raw") == [] and files(store, "_staging") == [] and store.datasets().count() == 0
    write_csv(tmp_path)
    assert store.ingest(path, dataset_id="one")["rows"] == 2
    assert [r["n_rows"] for r in store.datasets().collect()] == [2]
    assert files(store, "_staging") == [] and files(store, "_catalog", "datasets")[-1:] == ["one.parquet"]


def test_an_id_is_taken_once(store, tmp_path):
    path = write_csv(tmp_path)
    store.ingest(path, dataset_id="one")
    with pytest.raises(InvalidParameter, match="exists already"):
        store.ingest(path, dataset_id="one")
    assert store.load("one").count() == 2 and store.datasets().count() == 1
    # a row that cannot be added takes its data back
    store._append("datasets", "id string", ("two",))
    with pytest.raises(InvalidParameter, match="exists already"):
        store.ingest(path, dataset_id="two")
    assert files(store, "raw") == ["one"]


def test_a_failed_clean_leaves_no_lineage(store, tmp_path, monkeypatch):
    store.ingest(write_csv(tmp_path), dataset_id="one")
    real = Store._append

    def broken(self, name, schema, row):
        if name == "datasets":
            raise OSError("full")
        return real(self, name, schema, row)

    monkeypatch.setattr(Store, "_append", broken)
    with pytest.raises(OSError):
        store.save_clean("one", [], clean_id="c")
    monkeypatch.setattr(Store, "_append", real)
    assert files(store, "clean") == [] and store.history().count() == 0
    assert store.save_clean("one", [], clean_id="c")["rows"] == 2
    assert store.clean_history("c").count() == 0 and store.history().count() == 1


def test_two_writers_at_a_time(store, tmp_path):
    path = write_csv(tmp_path)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: Store(store.spark, store.root).ingest(path, dataset_id=f"d{i}"), range(8)))
    assert sorted(r["id"] for r in store.datasets().collect()) == [f"d{i}" for i in range(8)]
    assert all(store.load(f"d{i}").count() == 2 for i in range(8)) and files(store, "_staging") == []

    def same(i):
        try:
            return store.ingest(path, dataset_id="same")["rows"]
        except InvalidParameter:
            return None

    with ThreadPoolExecutor(3) as pool:
        done = [r for r in pool.map(same, range(3)) if r]
    assert done == [2] and store.load("same").count() == 2


@pytest.mark.parametrize("label", ["date", "boolean", "double", "string"])
def test_stored_classes_keep_their_type(spark, store, label):
    day = F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 2).cast("int"))
    value = {"date": day, "boolean": F.col("id") % 2 == 0, "double": (F.col("id") % 2) / 2, "string": F.concat(F.lit("c"), F.col("id") % 2)}[label]
    df = spark.range(60).select(F.col("id").alias("_row_id"), (F.col("id") % 2).cast("double").alias("x"), value.alias("y"))
    run = train(df, TrainSpec("y", [{"name": "LogisticRegression", "category": "estimators"}]))
    store.save_run(run)
    scored = store.score(run.job_id, df)
    assert dict(scored.dtypes)["predicted"] == label
    assert scored.where("predicted <> y").count() == 0
