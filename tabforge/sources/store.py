"""Datasets, cleaning lineage and training runs kept as Parquet tables.

Layout under one root folder (shared storage on a cluster)::

    raw/<id>/            ingested data (Parquet directory, with _row_id)
    clean/<id>/          cleaned data
    runs/<id>/predictions   full predictions table
    runs/<id>/model         fitted stages (Spark ML persistence)
    _catalog/datasets    one row per dataset (append-only)
    _catalog/history     one row per cleaned dataset: source id + ops JSON
    _catalog/runs        one row per training run

    _staging/<uuid>      what is being written

Data are written below ``_staging`` and renamed into place when complete. A
catalog row is a file of its own, named by its id and renamed into the table
only if no such file is there: two writers never share an output folder, one
id is taken once, and readers see whole rows. A failed write leaves neither
data nor a row. Row counts come from the Parquet footers of the written files,
so neither saving nor listing reads the data again.
"""

from __future__ import annotations

import datetime as _dt
import json
import os
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.errors import DatasetNotFound, InvalidParameter, RunNotFound
from tabforge.functions.columns import ROW_ID, field_type, user_columns
from tabforge.operators import profile
from tabforge.plans.cleaning import CleanOp, apply_ops, preview_clean
from tabforge.sources.scan import scan_csv, scan_parquet

DATASETS_SCHEMA = ("id string, name string, type string, path string, n_rows bigint, n_columns bigint, "
                   "column_names array<string>, dense_ids boolean, created_at timestamp")
HISTORY_SCHEMA = "clean_id string, source_id string, ops string, created_at timestamp"
RUNS_SCHEMA = ("job_id string, dataset_id string, target_column string, is_classifier boolean, "
               "metrics string, feature_importance string, feature_columns array<string>, steps string, "
               "column_names array<string>, predictions_path string, model_path string, labels string, "
               "created_at timestamp")

SUPPORTED = (".csv", ".parquet")


def new_id() -> str:
    return uuid.uuid4().hex[:8]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ------------------------------------------------------------ tables
    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/_catalog/{name}"
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _exists(self, path: str) -> bool:
        """Whether the path is there; any other failure to look is an error."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _move(self, source: str, target: str) -> None:
        """Rename a complete file or folder; an existing target is an error."""
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        # Rename.NONE, unlike FileSystem.rename, neither replaces nor nests into what is there
        context = hadoop.FileContext.getFileContext(hadoop.Path(target).toUri(), self.spark._jsc.hadoopConfiguration())
        kind = getattr(hadoop, "Options$Rename")
        how = gateway.new_array(kind, 1)
        how[0] = kind.NONE
        context.mkdir(hadoop.Path(target).getParent(), hadoop.permission.FsPermission.getDirDefault(), True)
        try:
            context.rename(hadoop.Path(source), hadoop.Path(target), how)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise InvalidParameter(f"{target} exists already")
            raise

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    @contextmanager
    def _staged(self, target: str):
        """A folder to write to that becomes ``target`` if the block succeeds."""
        if self._exists(target):
            raise InvalidParameter(f"{target} exists already")
        folder = f"{self.root}/_staging/{uuid.uuid4().hex}"
        try:
            yield folder
            self._move(folder, target)
        finally:
            self._delete(folder)

    @contextmanager
    def _undone_unless_listed(self, *paths: str):
        """Take back what was put in place if its catalog row cannot be added."""
        try:
            yield
        except Exception:
            for path in paths:
                self._delete(path)
            raise

    def _append(self, name: str, schema: str, row: tuple) -> str:
        """Add one row under the id it begins with; returns its file."""
        folder = f"{self.root}/_staging/{uuid.uuid4().hex}"
        target = f"{self.root}/_catalog/{name}/{row[0]}.parquet"
        try:
            self.spark.createDataFrame([row], schema).coalesce(1).write.parquet(folder)
            (part,) = self.spark.read.schema(schema).parquet(folder).inputFiles()
            self._move(part, target)
        finally:
            self._delete(folder)
        return target

    def datasets(self) -> DataFrame:
        return self._table("datasets", DATASETS_SCHEMA)

    def history(self) -> DataFrame:
        return self._table("history", HISTORY_SCHEMA)

    def runs(self) -> DataFrame:
        return self._table("runs", RUNS_SCHEMA)

    def _entry(self, dataset_id: str):
        rows = self.datasets().where(F.col("id") == dataset_id).limit(1).collect()
        if not rows:
            raise DatasetNotFound(dataset_id)
        return rows[0]

    # ------------------------------------------------------------ ingest
    def _write(self, df: DataFrame, path: str) -> tuple[int, list[str]]:
        with self._staged(path) as folder:
            df.write.parquet(folder)
            # from the footers of the written files; an Observation would make every later
            # checkpoint of the session fail (its manager cannot be serialized)
            n = self.spark.read.parquet(folder).count()
        return n, user_columns(df)

    def ingest(self, path: str, name: str | None = None, dataset_id: str | None = None, multiline: bool = True) -> dict:
        """Read a CSV (with type inference) or Parquet file/folder, snapshot
        it as Parquet with a dense row id, record it, return its profile.
        ``multiline=False`` spares the look for quoted line breaks."""
        ext = os.path.splitext(path.rstrip("/"))[1].lower()
        if ext not in SUPPORTED:
            raise InvalidParameter(f"unsupported file type {ext!r}: use CSV or Parquet")
        ds_id = dataset_id or new_id()
        df = scan_csv(self.spark, path, multiline=multiline) if ext == ".csv" else scan_parquet(self.spark, path)
        out = f"{self.root}/raw/{ds_id}"
        n, cols = self._write(df, out)
        name = name or os.path.basename(path.rstrip("/"))
        with self._undone_unless_listed(out):
            self._append("datasets", DATASETS_SCHEMA, (ds_id, name, "raw", out, n, len(cols), cols, True, _dt.datetime.now()))
        info = profile.describe_dataset(self.load(ds_id), dense_row_ids=True)
        return {"id": ds_id, "name": name, **info}

    def load(self, dataset_id: str) -> DataFrame:
        return self.spark.read.parquet(self._entry(dataset_id)["path"])

    # ------------------------------------------------------------ listing
    def list_datasets(self) -> DataFrame:
        """id, name, rows, columns, type — raw first, then by id."""
        return (self.datasets().select("id", "name", "n_rows", "n_columns", "type")
                .orderBy(F.when(F.col("type") == "raw", 0).otherwise(1), "id"))

    def display_names(self) -> DataFrame:
        """(id, display_name): a cleaned dataset shows its raw source's name."""
        c, h, s = self.datasets().alias("c"), self.history().alias("h"), self.datasets().alias("s")
        return (c.join(h, F.col("c.id") == F.col("h.clean_id"), "left")
                .join(s, (F.col("s.id") == F.col("h.source_id")) & (F.col("s.type") == "raw"), "left")
                .select(F.col("c.id").alias("id"),
                        F.when(F.col("c.type") == "raw", F.col("c.name"))
                        .otherwise(F.coalesce(F.col("s.name"), F.col("c.name"))).alias("display_name")))

    def describe(self, dataset_id: str) -> dict:
        e = self._entry(dataset_id)
        name = self.display_names().where(F.col("id") == dataset_id).first()["display_name"]
        info = profile.describe_dataset(self.load(dataset_id))
        return {"id": dataset_id, "name": name, **info}

    def preview(self, dataset_id: str, page: int = 0, page_size: int = profile.PREVIEW_ROWS) -> dict:
        e = self._entry(dataset_id)
        df = self.spark.read.parquet(e["path"])
        rows = profile.preview_page(df, page, page_size, dense_row_ids=bool(e["dense_ids"])).collect()
        return {"rows": [r.asDict() for r in rows], "total": int(e["n_rows"]), "page": page,
                "page_size": page_size}

    # ------------------------------------------------------------ cleaning
    def preview_clean(self, dataset_id: str, ops) -> dict:
        return preview_clean(self.load(dataset_id), ops)

    def save_clean(self, dataset_id: str, ops, name: str | None = None, clean_id: str | None = None) -> dict:
        ops = [CleanOp.of(o) for o in ops]
        out_df = apply_ops(self.load(dataset_id), ops)
        cid = clean_id or new_id()
        out = f"{self.root}/clean/{cid}"
        n, cols = self._write(out_df, out)
        now = _dt.datetime.now()
        done = json.dumps([{"op": o.op, "params": o.params} for o in ops], default=str)
        with self._undone_unless_listed(out):
            lineage = self._append("history", HISTORY_SCHEMA, (cid, dataset_id, done, now))
            with self._undone_unless_listed(lineage):
                self._append("datasets", DATASETS_SCHEMA, (cid, name or cid, "clean", out, n, len(cols), cols, False, now))
        return {"clean_id": cid, "rows": n, "columns": len(cols), "column_names": cols,
                "message": f"cleaned dataset {cid}"}

    def clean_history(self, dataset_id: str) -> DataFrame:
        """(position, op, params) of the operations that produced a cleaned
        dataset; empty when it has none."""
        ops = F.from_json(F.col("ops"), "array<struct<op:string, params:string>>")
        return (self.history().where(F.col("clean_id") == dataset_id)
                .select(F.posexplode(ops).alias("position", "o"))
                .select("position", F.col("o.op").alias("op"), F.col("o.params").alias("params")))

    # ------------------------------------------------------------ runs
    def train(self, spec, job_id: str | None = None):
        from tabforge.plans.training import train

        if not spec.dataset_id:
            raise InvalidParameter("TrainSpec.dataset_id is required")
        result = train(self.load(spec.dataset_id), spec, job_id=job_id)
        self.save_run(result)
        return result

    def save_run(self, result) -> None:
        base = f"{self.root}/runs/{result.job_id}"
        with self._staged(base) as folder:
            result.predictions.write.parquet(f"{folder}/predictions")
            self.save_model(result, f"{folder}/model")
        labels = None
        if result.labels is not None:
            kind = field_type(result.predictions, "actual").simpleString()
            labels = {"type": kind, "values": [str(v).lower() if isinstance(v, bool) else str(v) for v in result.labels]}
        with self._undone_unless_listed(base):
            self._append("runs", RUNS_SCHEMA, (
                result.job_id, result.dataset_id, result.target_column, result.is_classifier,
                json.dumps(result.metrics, default=float), json.dumps(result.feature_importance),
                result.feature_columns, json.dumps(result.steps, default=str), result.column_names,
                f"{base}/predictions", f"{base}/model", json.dumps(labels), _dt.datetime.now()))

    def save_model(self, result, path: str) -> str:
        """Persist the fitted stages: Spark ML stages as a PipelineModel,
        nearest neighbours as their prepared training rows beside it."""
        from pyspark.ml import PipelineModel

        from tabforge.operators.knn import KNNModel

        fitted = result.stages[-1]
        stages = [*result.stages[:-1], *([fitted.pre] if fitted.pre is not None else [])]
        if isinstance(fitted.model, KNNModel):
            fitted.model.save(f"{path}-neighbours")
        else:
            stages.append(fitted.model)
        PipelineModel(stages=stages).write().overwrite().save(path)
        return path

    def score(self, job_id: str, df: DataFrame) -> DataFrame:
        """``df`` with the stored model's ``prediction`` and, for a
        classifier, the class it names in ``predicted``."""
        from pyspark.ml import PipelineModel

        from tabforge.operators.knn import KNNModel

        rows = self.runs().where(F.col("job_id") == job_id).limit(1).collect()
        if not rows:
            raise RunNotFound(job_id)
        out = PipelineModel.load(rows[0]["model_path"]).transform(df)
        if self._exists(f"{rows[0]['model_path']}-neighbours"):
            out = KNNModel.load(self.spark, f"{rows[0]['model_path']}-neighbours").transform(out)
        labels = json.loads(rows[0]["labels"] or "null")
        if rows[0]["is_classifier"] and labels:
            # the classes have the type of the target
            names = F.lit(labels["values"]).cast(f"array<{labels['type']}>")
            out = out.withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1))
        return out

    def list_runs(self) -> DataFrame:
        return self.runs().select("job_id", "dataset_id", "target_column", "is_classifier", "metrics")

    def get_run(self, job_id: str) -> dict:
        rows = self.runs().where(F.col("job_id") == job_id).limit(1).collect()
        if not rows:
            raise RunNotFound(job_id)
        r = rows[0].asDict()
        r["metrics"] = json.loads(r["metrics"])
        r["feature_importance"] = json.loads(r["feature_importance"])
        r["steps"] = json.loads(r["steps"])
        preds = self.spark.read.parquet(r["predictions_path"])
        r["predictions"] = [x.asDict() for x in preds.orderBy(ROW_ID).limit(200).drop(ROW_ID).collect()]
        return r

    def predictions(self, job_id: str) -> DataFrame:
        rows = self.runs().where(F.col("job_id") == job_id).select("predictions_path").limit(1).collect()
        if not rows:
            raise RunNotFound(job_id)
        return self.spark.read.parquet(rows[0]["predictions_path"])

    def export_predictions_csv(self, job_id: str, out_path: str, single_file: bool = False) -> str:
        """Predictions as CSV with a header and no index. Many part files at
        scale; ``single_file=True`` funnels through one task on request."""
        df = self.predictions(job_id)
        df = df.orderBy(ROW_ID).drop(ROW_ID) if ROW_ID in df.columns else df
        if single_file:
            df = df.coalesce(1)
        df.write.option("header", True).mode("errorifexists").csv(out_path)
        return out_path
