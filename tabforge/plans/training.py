"""Train -> evaluate -> predictions, as one synchronous call.

``train(df, spec)`` runs the reference's training flow on Spark:
features and target are selected, a text target is encoded for
classifiers, the rows are split with an exact seeded split, the
preprocessing / selection steps are fitted in order on the training rows
only (each fit is a few aggregates, each transform one projection), the
last estimator is fitted with Spark ML, and the test rows are scored.
The predictions table keeps the original test features next to
``actual`` / ``predicted`` and ``probability`` or ``residual``; metrics and
importances come from distributed aggregates.
"""

from __future__ import annotations

import logging
import math
import time
import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.errors import InvalidParameter, UnknownStep
from tabforge.functions.columns import ROW_ID, field_type, is_floating, is_numeric, user_columns, quoted
from tabforge.operators import evaluate as ev
from tabforge.operators.features import STEP_CLASSES, BlockExpander, FeatureAssembler, OneHotEncoder
from tabforge.operators.models import ESTIMATORS, feature_importance, fit_estimator, needs_columns
from tabforge.operators.split import split_counted
from tabforge.session import checkpoint_dir

log = logging.getLogger(__name__)

RESERVED = ("actual", "predicted", "probability", "residual")
PREVIEW_PREDICTIONS = 200
CELLS_PER_PARTITION = 2_000_000
# A table of more than SPREAD_CELLS values is dealt into parts of CELLS_AT_LEAST, up to WIDE_PARTS of them.
SPREAD_CELLS, CELLS_AT_LEAST, WIDE_PARTS, NEAR_COLUMNS = 400_000, 100_000, 48, 8
# Up to this many classes a label's code is an array lookup in the row.
SMALL_LABEL_SET = 64
_ORIG = "__orig__"
_LABEL = "__label"
_FEATURES = "__features"


@dataclass
class Step:
    name: str
    category: str = "preprocessing"
    params: dict = field(default_factory=dict)

    @staticmethod
    def of(s) -> "Step":
        if isinstance(s, Step):
            return s
        return Step(s["name"], s.get("category", "preprocessing"), dict(s.get("params") or {}))


@dataclass
class TrainSpec:
    target_column: str
    steps: list
    feature_columns: list[str] | None = None
    test_size: float = 0.2
    random_state: int = 42
    dataset_id: str | None = None


@dataclass
class RunResult:
    job_id: str
    dataset_id: str | None
    target_column: str
    feature_columns: list[str]
    steps: list[dict]
    is_classifier: bool
    metrics: dict
    feature_importance: list[dict]
    predictions: DataFrame
    column_names: list[str]
    final_features: list[str]
    labels: list | None
    stages: list

    def predictions_preview(self, n: int = PREVIEW_PREDICTIONS) -> list[dict]:
        head = self.predictions.orderBy(ROW_ID).limit(n).drop(ROW_ID)
        return [r.asDict() for r in head.collect()]

    def metadata(self) -> dict:
        return {
            "job_id": self.job_id, "dataset_id": self.dataset_id, "target_column": self.target_column,
            "feature_columns": self.feature_columns, "steps": self.steps, "is_classifier": self.is_classifier,
            "metrics": self.metrics, "feature_importance": self.feature_importance,
            "column_names": self.column_names,
        }


def coerce_param(key: str, v):
    """Text parameters as the reference reads them: digits -> int,
    float text -> float, include_bias -> bool."""
    if key == "include_bias":
        return str(v).lower() == "true"
    if isinstance(v, str):
        if v.isdigit():
            return int(v)
        try:
            return float(v)
        except ValueError:
            return v
    return v


def build_step(step: Step):
    cls = STEP_CLASSES.get(step.name)
    if cls is None:
        raise UnknownStep(step.name)
    params = {k: coerce_param(k, v) for k, v in step.params.items()}
    if step.name == "SelectKBest" and "k" in params:
        params["k"] = str(params["k"])
    try:
        return cls(**params)
    except TypeError as e:
        raise InvalidParameter(f"could not build {step.name}: {e}")


def _validate(df: DataFrame, spec: TrainSpec) -> tuple[list[str], Step, list[Step]]:
    cols = user_columns(df)
    if spec.target_column not in cols:
        raise InvalidParameter(f"unknown target column {spec.target_column!r}")
    feats = list(spec.feature_columns) if spec.feature_columns else [c for c in cols if c != spec.target_column]
    missing = [c for c in feats if c not in cols]
    if missing:
        raise InvalidParameter(f"unknown feature columns {missing}")
    clash = [c for c in feats if c in RESERVED]
    if clash:
        raise InvalidParameter(f"feature names {clash} are reserved for the predictions table")
    steps = [Step.of(s) for s in spec.steps]
    estimator = None
    pre = []
    for s in steps:
        if s.category == "estimators":
            if s.name not in ESTIMATORS:
                raise UnknownStep(s.name)
            estimator = s
        else:
            if s.name not in STEP_CLASSES:
                raise UnknownStep(s.name)
            pre.append(s)
    if estimator is None:
        raise InvalidParameter("No estimator in pipeline")
    return feats, estimator, pre


def _encode_target(df: DataFrame, target: str, is_classifier: bool):
    dt = field_type(df, target)
    y = quoted(target)
    if not is_classifier:
        if not is_numeric(dt):
            raise InvalidParameter("regression needs a numeric target")
        return df.withColumn(_LABEL, y.cast("double")), None
    # the sorted labels are part of the result (and the model is at least as large)
    vals = df.select(y.alias("v")).where(F.col("v").isNotNull()).distinct().orderBy("v").collect()
    labels = [r["v"] for r in vals]
    if len(labels) <= SMALL_LABEL_SET:
        arr = F.array(*[F.lit(v) for v in labels])
        return df.withColumn(_LABEL, (F.array_position(arr, y) - 1).cast("double")), labels
    codes = _codes(df, labels, field_type(df, target))
    return df.join(codes, y == F.col("__lv")).drop("__lv").withColumnRenamed("__code", _LABEL), labels


def _codes(df: DataFrame, labels: list, label_type: T.DataType) -> DataFrame:
    """(__lv, __code): the label table, joined where there are many labels."""
    schema = T.StructType([T.StructField("__lv", label_type), T.StructField("__code", T.DoubleType())])
    return df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(labels)], schema)


def _require_target(df: DataFrame, target: str) -> None:
    """Rows without a target cannot be learnt from or judged: refuse them, for both kinds of run."""
    y = quoted(target)
    missing = (y.isNull() | F.isnan(y)) if is_floating(field_type(df, target)) else y.isNull()
    n = df.where(missing).limit(1).count()
    if n:
        raise InvalidParameter(f"target column {target!r} has missing values: drop or fill them first")


def train(df: DataFrame, spec: TrainSpec, job_id: str | None = None) -> RunResult:
    """Fit the pipeline on the training rows and score the test rows."""
    if ROW_ID not in df.columns:
        raise InvalidParameter(f"training needs the {ROW_ID} row order column (ingest the data first)")
    t0 = time.perf_counter()

    def mark(what: str) -> None:
        log.info("train: %s done at %.2fs", what, time.perf_counter() - t0)

    feats, est_step, pre_steps = _validate(df, spec)
    is_clf = ESTIMATORS[est_step.name]
    target = spec.target_column
    # the selected columns are read by the encoding, the split, the fits and
    # the scoring: materialise them once instead of recomputing the input
    source = df.select(ROW_ID, *[quoted(c) for c in dict.fromkeys(feats + [target])])
    source = source.persist(StorageLevel.MEMORY_AND_DISK)
    _require_target(source, target)
    data, labels = _encode_target(source, target, is_clf)
    mark("target encoding")
    train_df, test_df, n_rows = split_counted(data, spec.test_size, spec.random_state)
    n_test = int(math.ceil(float(spec.test_size) * n_rows))
    train_df, test_df = _spread(train_df, n_rows - n_test, feats), _spread(test_df, n_test, feats)
    train_df = train_df.persist(StorageLevel.MEMORY_AND_DISK)
    mark("split")
    try:
        current = list(feats)
        stages = []
        cur_train, blocks = train_df, {}

        def apply(model, now: DataFrame) -> DataFrame:
            stages.append(model)
            return model.transform(now)

        for s in pre_steps:
            step = build_step(s)
            if step.needs_columns and blocks:
                cur_train = apply(expander := BlockExpander.of(current, blocks), cur_train)
                current, blocks = expander.output_columns(), {}
            if isinstance(step, OneHotEncoder):
                step.as_blocks = True
            step._set(featureCols=current, labelCol=_LABEL)
            step.blocks = blocks
            model = step.fit(cur_train)
            cur_train = apply(model, cur_train)
            current, blocks = model.output_columns(), model.blocks
            mark(f"step {s.name}")
        if blocks and needs_columns(est_step.name, est_step.params):
            cur_train = apply(expander := BlockExpander.of(current, blocks), cur_train)
            current, blocks = expander.output_columns(), {}
        current = [c for c in current if c not in blocks or blocks[c].categories]
        types = {f.name: f.dataType for f in cur_train.schema.fields}
        bad = [c for c in current if not (c in blocks or is_numeric(types[c]) or isinstance(types[c], T.BooleanType)
                                          or isinstance(types[c], VectorUDT))]
        if bad:
            raise InvalidParameter(f"features {bad} are not numeric: encode or drop them before the estimator")
        if not current:
            raise InvalidParameter("no features left for the estimator")
        assembler = FeatureAssembler.of(current, _FEATURES, blocks)
        stages.append(assembler)
        final = [n for c in current for n in (blocks[c].names if c in blocks else [c])]
        fit_data = assembler.transform(cur_train).select(ROW_ID, _FEATURES, _LABEL)
        plain = None
        if not any(c in blocks or isinstance(types[c], VectorUDT) for c in current):
            plain = cur_train.select(*[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(current)], F.col(_LABEL).alias("y"))
        fitted = fit_estimator(est_step.name, est_step.params, fit_data, _FEATURES, _LABEL,
                               len(labels or []), spec.random_state, len(final), n_rows - n_test, plain)
        mark(f"estimator {est_step.name}")
        # the test rows keep their untouched features for the predictions table
        scored = test_df.select("*", *[quoted(c).alias(_ORIG + c) for c in feats])
        for m in stages[:-1]:
            scored = m.transform(scored)
        scored = fitted.transform(assembler.transform(scored))
        predictions = _predictions_table(scored, feats, target, is_clf, labels, fitted)
        # a reliable checkpoint: the table outlives the cached inputs and an
        # executor loss, and every later metric/chart reads it directly
        checkpoint_dir(df.sparkSession)
        predictions = predictions.checkpoint()
        metrics = _metrics(predictions, is_clf)
        mark("scoring and metrics")
        importance = feature_importance(fitted, final)
    finally:
        train_df.unpersist()
        source.unpersist()
    return RunResult(
        job_id=job_id or uuid.uuid4().hex[:8], dataset_id=spec.dataset_id, target_column=target,
        feature_columns=feats, steps=[s.__dict__ for s in pre_steps + [est_step]], is_classifier=is_clf,
        metrics=metrics, feature_importance=importance, predictions=predictions, column_names=feats,
        final_features=final, labels=labels, stages=stages + [fitted])


def _spread(df: DataFrame, n_rows: int, columns: list[str]) -> DataFrame:
    """Learners parallelise over partitions, and sampling learners draw by
    partition and row order. Rows are dealt by a hash of the row id into
    parts of about CELLS_PER_PARTITION values, several parts in the order of their
    first features and one part in row order: number and content
    of the parts depend on the data alone, never on cores or files. Beyond
    SPREAD_CELLS values, up to WIDE_PARTS parts are smaller (CELLS_AT_LEAST), so
    a table of a few million values keeps a cluster busy; beyond, every part more is another copy
    of a forest's statistics in each of its passes."""
    cells = n_rows * max(len(columns), 1)
    wide = min(WIDE_PARTS, math.ceil(cells / CELLS_AT_LEAST)) if cells > SPREAD_CELLS else 1
    parts = max(1, math.ceil(cells / CELLS_PER_PARTITION), wide)
    # neighbours in a part then fall into the same tree nodes, whose statistics are still in the processor's cache
    plain = [c for c in columns if is_numeric(t := field_type(df, c)) or isinstance(t, (T.StringType, T.BooleanType))]
    near = [quoted(c) for c in plain[:NEAR_COLUMNS]] if parts > 1 else []
    return df.repartition(parts, ROW_ID).sortWithinPartitions(*near, ROW_ID)


def _predictions_table(scored: DataFrame, feats, target, is_clf, labels, fitted) -> DataFrame:
    orig = [quoted(_ORIG + c).alias(c) for c in feats]
    pred = F.col("prediction")
    if is_clf:
        if len(labels) <= SMALL_LABEL_SET:
            predicted = F.element_at(F.array(*[F.lit(v) for v in labels]), pred.cast("int") + 1)
        else:
            codes = _codes(scored, labels, field_type(scored, target))
            scored = scored.join(codes, pred == F.col("__code"), "left")
            predicted = F.col("__lv")
        if fitted.has_probability:
            parr = vector_to_array(F.col("probability"))
            prob = parr[1] if len(labels) == 2 else F.array_max(parr)
        else:
            prob = F.lit(None).cast("double")
        return scored.select(ROW_ID, *orig, quoted(target).alias("actual"),
                             predicted.alias("predicted"), prob.alias("probability"))
    actual = quoted(target).cast("double")
    return scored.select(ROW_ID, *orig, actual.alias("actual"), pred.alias("predicted"),
                         F.lit(None).cast("double").alias("probability"),
                         ev.residual(target, "prediction"))


def _metrics(predictions: DataFrame, is_clf: bool) -> dict:
    if is_clf:
        # one partial-aggregating job; its result is the k x k matrix itself
        pairs = [tuple(r) for r in ev.confusion_counts(predictions).collect()]
        return ev.metrics_from_counts(pairs)
    return ev.regression_metrics(predictions).first().asDict()
