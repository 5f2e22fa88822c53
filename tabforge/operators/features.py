"""Feature steps as Spark ML Estimators / Models over scalar columns.

Each step's ``fit`` is one (or, for exact quantiles, a few) distributed
aggregates whose O(columns) result is kept as a JSON parameter; its
``transform`` is one ``select`` of column expressions, so it stays inside
whole-stage codegen, keeps column names, and is null-aware. Models
persist with ``DefaultParamsWritable`` and load inside a ``PipelineModel``.

Feature lists flow from step to step: a fitted model records the
``outputCols`` that the next step receives as its ``featureCols``.
"""

from __future__ import annotations

import json
import math
from itertools import combinations_with_replacement

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import PCA as _SparkPCA
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.errors import InvalidParameter
from tabforge.functions.columns import field_type, is_numeric, quoted
from tabforge.operators import blocks as bl
from tabforge.operators.stats import LONG_FORMAT_COLUMNS, column_mode, numeric_column_stats, quantiles

def _q(name: str) -> Column:
    return quoted(name)


def _num(name: str) -> Column:
    v = _q(name).cast("double")
    return F.when(~F.isnan(v), v)


class _StepParams(Params):
    featureCols = Param(Params._dummy(), "featureCols", "input feature columns",
                        typeConverter=TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "target column", typeConverter=TypeConverters.toString)


class _ModelParams(_StepParams):
    outputCols = Param(Params._dummy(), "outputCols", "output feature columns",
                       typeConverter=TypeConverters.toListString)
    state = Param(Params._dummy(), "state", "fitted statistics (JSON)", typeConverter=TypeConverters.toString)


class FeatureModel(Model, _ModelParams, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted step: ``outputCols`` computed from ``featureCols`` and ``state``."""

    def __init__(self):
        super().__init__()
        self.blocks: dict[str, bl.Block] = {}

    def feature_state(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    def output_columns(self) -> list[str]:
        return self.getOrDefault(self.outputCols)

    def _exprs(self, df: DataFrame, cols: list[str], st: dict) -> list[Column]:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getOrDefault(self.featureCols)
        st = self.feature_state()
        keep = [_q(c) for c in df.columns if c not in cols]
        return df.select(*keep, *self._exprs(df, cols, st))


class FeatureStep(Estimator, _StepParams, DefaultParamsReadable, DefaultParamsWritable):
    """Base estimator; subclasses implement ``_fit_state`` -> (state, outputCols)."""

    model_class: type = FeatureModel
    #: feature types the step transforms; others pass through untouched
    applies_to = "numeric"
    #: the step multiplies features with each other: one-hot slots must be columns
    needs_columns = False

    def __init__(self):
        super().__init__()
        #: one-hot features that come as blocks (a training run passes them on)
        self.blocks: dict[str, bl.Block] = {}

    def _fit_state(self, df: DataFrame, cols: list[str]) -> tuple[dict, list[str]]:
        raise NotImplementedError

    def _fit(self, df: DataFrame) -> FeatureModel:
        cols = self.getOrDefault(self.featureCols)
        blocks = {c: self.blocks[c] for c in cols if c in self.blocks}
        state, out = self._fit_state(df, [c for c in cols if c not in blocks])
        blocks = self._fit_blocks(df, blocks, state)
        if blocks:
            out = [c for c in cols if c in blocks or c in out]
        m = self.model_class()
        m.blocks = blocks
        m._set(featureCols=cols, outputCols=out, state=json.dumps(state))
        if self.isDefined(self.labelCol):
            m._set(labelCol=self.getOrDefault(self.labelCol))
        return m

    def _fit_blocks(self, df: DataFrame, blocks: dict[str, bl.Block], state: dict) -> dict[str, bl.Block]:
        """What the step makes of one-hot features; by default nothing changes."""
        return blocks


def _split_numeric(df: DataFrame, cols: list[str]) -> tuple[list[str], list[str]]:
    num = [c for c in cols if is_numeric(field_type(df, c))]
    return num, [c for c in cols if c not in num]


def _passthrough(cols, changed: dict[str, Column]) -> list[Column]:
    return [changed[c].alias(c) if c in changed else _q(c) for c in cols]


class FeatureAssembler(FeatureModel):
    """The feature columns as one vector. Columns are given safe names on
    the way, so any column name will do; booleans count as 0 and 1, and
    blocks of one-hot slots become sparse vectors."""

    @staticmethod
    def of(cols: list[str], output: str, blocks: dict[str, bl.Block] | None = None) -> "FeatureAssembler":
        m = FeatureAssembler()
        m._set(featureCols=cols, outputCols=[output], state=json.dumps({"blocks": bl.pack(blocks or {})}))
        return m

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, (output,) = self.getOrDefault(self.featureCols), self.getOrDefault(self.outputCols)
        blocks = bl.unpack(self.feature_state().get("blocks", {}))
        safe = [f"__slot{i}" for i in range(len(cols))]
        named = df.select(*[_q(c) for c in df.columns], *[
            (_q(c).cast("string") if c in blocks else _q(c).cast("double") if isinstance(field_type(df, c), T.BooleanType)
             else _q(c)).alias(n) for c, n in zip(cols, safe)])
        parts = []
        for c, n in zip(cols, safe):
            if c not in blocks:
                parts.append(n)
            elif blocks[c].categories:
                named = bl.sparse_vector(named, blocks[c], n, f"{n}_v")
                parts.append(f"{n}_v")
        out = VectorAssembler(inputCols=parts, outputCol=output, handleInvalid="error").transform(named)
        return out.drop(*safe, *parts)


class BlockExpander(FeatureModel):
    """One column a slot, for steps that need the slots as columns."""

    @staticmethod
    def of(cols: list[str], blocks: dict[str, bl.Block]) -> "BlockExpander":
        m = BlockExpander()
        m._set(featureCols=cols, outputCols=[n for c in cols for n in (blocks[c].names if c in blocks else [c])],
               state=json.dumps({"blocks": bl.pack(blocks)}))
        return m

    def _exprs(self, df, cols, st):
        blocks = bl.unpack(st["blocks"])
        return [e for c in cols for e in (bl.columns_of(blocks[c]) if c in blocks else [_q(c)])]


# ---------------------------------------------------------------- scalers

class StandardScalerModel(FeatureModel):
    def _exprs(self, df, cols, st):
        return _passthrough(cols, {c: (_num(c) - F.lit(m)) / F.lit(s) for c, (m, s) in st.items()})


class StandardScaler(FeatureStep):
    """(x - mean) / population std; a zero std divides by 1."""
    model_class = StandardScalerModel

    def _fit_state(self, df, cols):
        num, _ = _split_numeric(df, cols)
        if not num:
            return {}, cols
        stats = numeric_column_stats(df, num, ["mean", "std_pop"])
        st = {}
        for c in num:
            m, s = stats[c]["mean"], stats[c]["std_pop"]
            st[c] = (m if m is not None else 0.0, s if s not in (None, 0.0) and not math.isnan(s) else 1.0)
        return st, cols

    def _fit_blocks(self, df, blocks, state):
        if not blocks:
            return blocks
        total, counts = bl.category_counts(df, blocks)
        out = {}
        for c, b in blocks.items():
            p, scale = counts[c] / max(total, 1), np.array(b.scale)
            spread = np.abs(scale) * np.sqrt(p * (1 - p))
            out[c] = b.moved(np.array(b.shift) + scale * p, np.where(spread > 0, spread, 1.0))
        return out


class MinMaxScalerModel(FeatureModel):
    def _exprs(self, df, cols, st):
        lo, hi = st["range"]
        changed = {c: (_num(c) - F.lit(dmin)) / F.lit(rng) * F.lit(hi - lo) + F.lit(lo)
                   for c, (dmin, rng) in st["cols"].items()}
        return _passthrough(cols, changed)


class MinMaxScaler(FeatureStep):
    """Scale to [min, max]; a constant column maps to ``min``."""
    model_class = MinMaxScalerModel
    min = Param(Params._dummy(), "min", "lower bound", typeConverter=TypeConverters.toFloat)
    max = Param(Params._dummy(), "max", "upper bound", typeConverter=TypeConverters.toFloat)

    def __init__(self, min: float = 0.0, max: float = 1.0):
        super().__init__()
        self._setDefault(min=0.0, max=1.0)
        self._set(min=float(min), max=float(max))

    def _fit_state(self, df, cols):
        lo, hi = self.getOrDefault(self.min), self.getOrDefault(self.max)
        if lo >= hi:
            raise InvalidParameter("MinMaxScaler: min must be < max")
        num, _ = _split_numeric(df, cols)
        st = {"range": [lo, hi], "cols": {}}
        if num:
            stats = numeric_column_stats(df, num, ["min", "max"])
            for c in num:
                a, b = stats[c]["min"], stats[c]["max"]
                a = a if a is not None else 0.0
                rng = (b - a) if b is not None and b != a else 1.0
                st["cols"][c] = (a, rng)
        return st, cols

    def _fit_blocks(self, df, blocks, state):
        if not blocks:
            return blocks
        (lo, hi), (total, counts) = state["range"], bl.category_counts(df, blocks)
        out = {}
        for c, b in blocks.items():
            least, most = (np.array(b.shift) + np.array(b.scale) * z for z in bl.slot_range(total, counts[c]))
            spread = np.where(most > least, most - least, 1.0) / (hi - lo)
            out[c] = b.moved(least - lo * spread, spread)
        return out


class RobustScalerModel(FeatureModel):
    def _exprs(self, df, cols, st):
        return _passthrough(cols, {c: (_num(c) - F.lit(m)) / F.lit(s) for c, (m, s) in st.items()})


class RobustScaler(FeatureStep):
    """(x - median) / (q75 - q25) with exact quantiles (or a sketch's, if
    ``approximate``); zero IQR divides by 1."""
    model_class = RobustScalerModel
    approximate = Param(Params._dummy(), "approximate", "quantiles from a sketch", typeConverter=TypeConverters.toBoolean)

    def __init__(self, approximate: bool | str = False):
        super().__init__()
        self._setDefault(approximate=False)
        self._set(approximate=str(approximate).strip().lower() == "true")

    def _fit_state(self, df, cols):
        num, _ = _split_numeric(df, cols)
        qs = quantiles(df, num, [0.25, 0.5, 0.75], self.getOrDefault(self.approximate))
        st = {}
        for c in num:
            q1, med, q3 = qs[c]
            iqr = (q3 - q1) if q1 is not None and q3 is not None else 0.0
            st[c] = (med if med is not None else 0.0, iqr if iqr != 0.0 else 1.0)
        return st, cols

    def _fit_blocks(self, df, blocks, state):
        if not blocks:
            return blocks
        total, counts = bl.category_counts(df, blocks)
        out = {}
        for c, b in blocks.items():
            q1, med, q3 = (np.array(b.shift) + np.array(b.scale) * bl.slot_quantile(total, counts[c], p) for p in (0.25, 0.5, 0.75))
            out[c] = b.moved(med, np.where(q3 != q1, q3 - q1, 1.0))
        return out


class NormalizerModel(FeatureModel):
    def _exprs(self, df, cols, st):
        num = st["cols"]
        if not num:
            return [_q(c) for c in cols]
        xs = [_num(c) for c in num]
        norm = st["norm"]
        if norm == "l1":
            n = sum((F.abs(x) for x in xs[1:]), F.abs(xs[0]))
        elif norm == "l2":
            n = F.sqrt(sum((x * x for x in xs[1:]), xs[0] * xs[0]))
        else:
            n = F.greatest(*[F.abs(x) for x in xs]) if len(xs) > 1 else F.abs(xs[0])
        n = F.when(n == 0, F.lit(1.0)).otherwise(n)
        return _passthrough(cols, {c: _num(c) / n for c in num})


class Normalizer(FeatureStep):
    """Each row divided by its l1 / l2 / max norm; a zero row is unchanged."""
    model_class = NormalizerModel
    needs_columns = True
    norm = Param(Params._dummy(), "norm", "l1, l2 or max", typeConverter=TypeConverters.toString)

    def __init__(self, norm: str = "l2"):
        super().__init__()
        self._setDefault(norm="l2")
        self._set(norm=norm)

    def _fit_state(self, df, cols):
        norm = self.getOrDefault(self.norm)
        if norm not in ("l1", "l2", "max"):
            raise InvalidParameter(f"Normalizer: unknown norm {norm!r}")
        num, _ = _split_numeric(df, cols)
        return {"norm": norm, "cols": num}, cols


# ---------------------------------------------------------------- imputer

class SimpleImputerModel(FeatureModel):
    def _exprs(self, df, cols, st):
        out = []
        for c in self.getOrDefault(self.outputCols):
            if c in st["fill"]:
                v = st["fill"][c]
                dt = field_type(df, c)
                if is_numeric(dt):
                    out.append(F.coalesce(_num(c), F.lit(float(v))).alias(c))
                else:
                    out.append(F.coalesce(_q(c), F.lit(v).cast(dt)).alias(c))
            else:
                out.append(_q(c))
        return out


class SimpleImputer(FeatureStep):
    """Fill missing values with a statistic fitted on the training rows.

    mean / median (exact) need numbers; most_frequent takes the smallest
    of tied values; constant uses ``fill_value`` (0 for numbers,
    'missing_value' for text). Columns with no value at all are dropped
    (except for constant).
    """
    model_class = SimpleImputerModel
    applies_to = "all"
    strategy = Param(Params._dummy(), "strategy", "mean, median, most_frequent or constant",
                     typeConverter=TypeConverters.toString)
    fill_value = Param(Params._dummy(), "fill_value", "constant fill value", typeConverter=TypeConverters.toString)

    approximate = Param(Params._dummy(), "approximate", "medians from a sketch", typeConverter=TypeConverters.toBoolean)

    def __init__(self, strategy: str = "mean", fill_value: str | None = None, approximate: bool | str = False):
        super().__init__()
        self._setDefault(strategy="mean", approximate=False)
        self._set(strategy=strategy, approximate=str(approximate).strip().lower() == "true")
        if fill_value is not None:
            self._set(fill_value=str(fill_value))

    def _fit_state(self, df, cols):
        strategy = self.getOrDefault(self.strategy)
        num, other = _split_numeric(df, cols)
        fill, dropped = {}, []
        if strategy in ("mean", "median"):
            # statistics of numbers only; text columns pass through untouched
            if strategy == "mean":
                vals = {c: v["mean"] for c, v in numeric_column_stats(df, num, ["mean"]).items()}
            else:
                vals = {c: v[0] for c, v in quantiles(df, num, [0.5], self.getOrDefault(self.approximate)).items()}
            for c in num:
                if vals[c] is None:
                    dropped.append(c)
                else:
                    fill[c] = vals[c]
        elif strategy == "most_frequent":
            for c in cols:
                m = column_mode(df, c)
                if m is None:
                    dropped.append(c)
                else:
                    fill[c] = m
        elif strategy == "constant":
            given = self.getOrDefault(self.fill_value) if self.isDefined(self.fill_value) else None
            for c in cols:
                if c in num:
                    fill[c] = float(given) if given is not None else 0.0
                else:
                    fill[c] = given if given is not None else "missing_value"
        else:
            raise InvalidParameter(f"SimpleImputer: unknown strategy {strategy!r}")
        out = [c for c in cols if c not in dropped]
        return {"fill": {c: (v.isoformat() if hasattr(v, "isoformat") else v) for c, v in fill.items()}}, out


# ---------------------------------------------------------------- one-hot

class OneHotEncoderModel(FeatureModel):
    def _exprs(self, df, cols, st):
        out = []
        for c in cols:
            if c not in st["categories"]:
                out.append(_q(c))
            elif st["form"] == "block":
                out.append(_q(c).cast("string").alias(c))
            elif st["form"] == "vector":
                out.append(_q(f"{c}_onehot"))
            else:
                out += bl.columns_of(bl.Block.of(c, st["categories"][c]))
        return out

    def _transform(self, df):
        st = self.feature_state()
        for i, (c, categories) in enumerate(st["categories"].items()):
            block, safe = bl.Block.of(c, categories), f"__cat{i}"
            if st["handle_unknown"] == "error":
                df = bl.index_model(block, safe, f"{safe}_i").transform(df.withColumn(safe, _q(c).cast("string")))
                unknown = _q(safe).isNotNull() & (_q(f"{safe}_i") == len(categories))
                df = df.withColumn(c, F.when(unknown, F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), _q(safe))))
                                   .otherwise(_q(safe))).drop(safe, f"{safe}_i")
            if st["form"] == "vector":
                # safe internal names; unknown and missing are all zeros
                df = bl.indicator_vector(df.withColumn(safe, _q(c).cast("string")), categories, safe, f"{safe}_v")
                df = df.drop(safe).withColumnRenamed(f"{safe}_v", f"{c}_onehot")
        return super()._transform(df)


class OneHotEncoder(FeatureStep):
    """One output column per category (sorted), whatever their number;
    unknown and missing -> all zeros (``handle_unknown='ignore'``), or an
    error for an unknown one. Applies to text and boolean columns; numbers pass through.

    ``sparse=True`` gives one sparse vector column per feature instead. A
    training run uses the third form, ``as_blocks``: the column stays and its
    slots travel as a ``Block``, so every later step works on them and no plan
    grows with the vocabulary.
    """
    model_class = OneHotEncoderModel
    applies_to = "categorical"
    handle_unknown = Param(Params._dummy(), "handle_unknown", "ignore or error",
                           typeConverter=TypeConverters.toString)
    sparse = Param(Params._dummy(), "sparse", "one sparse vector per feature", typeConverter=TypeConverters.toBoolean)

    def __init__(self, handle_unknown: str = "ignore", sparse: bool | str = False):
        super().__init__()
        self._setDefault(handle_unknown="ignore", sparse=False)
        self._set(handle_unknown=handle_unknown, sparse=str(sparse).strip().lower() == "true")
        self.as_blocks = False

    def _fit_state(self, df, cols):
        hu = self.getOrDefault(self.handle_unknown)
        if hu not in ("ignore", "error"):
            raise InvalidParameter(f"OneHotEncoder: handle_unknown must be ignore or error, got {hu!r}")
        _, cat = _split_numeric(df, cols)
        form = "block" if self.as_blocks else "vector" if self.getOrDefault(self.sparse) else "columns"
        st = {"handle_unknown": hu, "form": form, "categories": {c: [] for c in cat}}
        if cat:
            # the vocabularies of all columns in one job; they name the features of the run
            cells = F.array(*[F.struct(F.lit(i).alias("i"), _q(c).cast("string").alias("v")) for i, c in enumerate(cat)])
            found = df.select(F.inline(cells)).where(F.col("v").isNotNull()).distinct().orderBy("i", "v").toArrow()
            for i, v in zip(found["i"].to_pylist(), found["v"].to_pylist()):
                st["categories"][cat[i]].append(v)
        names = {"block": lambda c: [c], "vector": lambda c: [f"{c}_onehot"],
                 "columns": lambda c: [f"{c}_{v}" for v in st["categories"][c]]}[form]
        return st, [n for c in cols for n in (names(c) if c in cat else [c])]

    def _fit_blocks(self, df, blocks, state):
        made = {c: bl.Block.of(c, v) for c, v in state["categories"].items()} if self.as_blocks else {}
        if self.as_blocks and state["handle_unknown"] == "ignore":
            state["categories"] = {c: [] for c in made}  # the assembler alone needs them
        return {**blocks, **made}


# ---------------------------------------------------------------- polynomial

def polynomial_terms(names: list[str], degree: int, include_bias: bool,
                     interaction_only: bool = False) -> list[tuple[str, tuple[int, ...]]]:
    """Monomials in graded order (x, y, x^2, x y, y^2 for degree 2)."""
    terms = [("1", ())] if include_bias else []
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(range(len(names)), d):
            if interaction_only and len(set(combo)) < len(combo):
                continue
            parts = []
            for i in sorted(set(combo)):
                k = combo.count(i)
                parts.append(names[i] if k == 1 else f"{names[i]}^{k}")
            terms.append((" ".join(parts), combo))
    return terms


class PolynomialFeaturesModel(FeatureModel):
    def _exprs(self, df, cols, st):
        num = st["cols"]
        out = [_q(c) for c in cols if c not in num]
        xs = [_num(c) for c in num]
        for name, combo in st["terms"]:
            if not combo:
                out.append(F.lit(1.0).alias(name))
                continue
            e = xs[combo[0]]
            for i in combo[1:]:
                e = e * xs[i]
            out.append(e.alias(name))
        return out


class PolynomialFeatures(FeatureStep):
    model_class = PolynomialFeaturesModel
    needs_columns = True
    degree = Param(Params._dummy(), "degree", "maximal degree", typeConverter=TypeConverters.toInt)
    include_bias = Param(Params._dummy(), "include_bias", "add a constant 1 column",
                         typeConverter=TypeConverters.toBoolean)
    interaction_only = Param(Params._dummy(), "interaction_only", "products of distinct features only",
                             typeConverter=TypeConverters.toBoolean)

    def __init__(self, degree: int = 2, include_bias: bool = False, interaction_only: bool = False):
        super().__init__()
        self._setDefault(degree=2, include_bias=False, interaction_only=False)
        self._set(degree=int(degree), include_bias=bool(include_bias), interaction_only=bool(interaction_only))

    def _fit_state(self, df, cols):
        deg = self.getOrDefault(self.degree)
        if deg < 0:
            raise InvalidParameter("PolynomialFeatures: degree must be >= 0")
        num, other = _split_numeric(df, cols)
        terms = polynomial_terms(num, deg, self.getOrDefault(self.include_bias),
                                 self.getOrDefault(self.interaction_only))
        return {"cols": num, "terms": terms}, other + [t[0] for t in terms]


# ---------------------------------------------------------------- selection

def anova_f(df: DataFrame, cols: list[str], label: str) -> dict[str, float | None]:
    """One-way ANOVA F of every feature against the label classes.

    Per-class sums are one partial-aggregating group-by; the F statistic is
    a second aggregate over those per-class rows, JVM-side, so the number
    of classes never matters to the driver.
    """
    if not cols:
        return {}
    y = _q(label)
    base = df.where(y.isNotNull())
    if len(cols) >= LONG_FORMAT_COLUMNS:
        return _anova_f_long(base, y, cols)
    # each feature is judged on the rows where it has a value
    per = base.groupBy(y.alias("__y")).agg(
        *[F.count(_num(c)).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.sum(_num(c)).alias(f"s{i}") for i, c in enumerate(cols)],
        *[F.sum(_num(c) * _num(c)).alias(f"q{i}") for i, c in enumerate(cols)])
    aggs = []
    for i in range(len(cols)):
        aggs += [F.sum(f"n{i}").alias(f"N{i}"), F.count_if(F.col(f"n{i}") > 0).alias(f"G{i}"),
                 F.sum(f"s{i}").alias(f"S{i}"), F.sum(f"q{i}").alias(f"Q{i}"),
                 F.sum(F.when(F.col(f"n{i}") > 0, F.col(f"s{i}") * F.col(f"s{i}") / F.col(f"n{i}"))).alias(f"B{i}")]
    row = per.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        n, g = row[f"N{i}"] or 0, row[f"G{i}"] or 0
        S, Q, B = row[f"S{i}"], row[f"Q{i}"], row[f"B{i}"]
        if n - g <= 0 or g < 2 or S is None:
            out[c] = None
            continue
        sst = Q - S * S / n
        ssb = B - S * S / n
        ssw = sst - ssb
        msb, msw = ssb / (g - 1), ssw / (n - g)
        out[c] = msb / msw if msw != 0 else (math.inf if msb != 0 else None)
    return out


def _anova_f_long(base: DataFrame, y: Column, cols: list[str]) -> dict[str, float | None]:
    """The same F statistics for many features: (feature, class) sums in
    long format, then one aggregate per feature — d rows reach the driver."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), _num(c).alias("v")) for i, c in enumerate(cols)])
    per = (base.select(y.alias("__y"), F.inline(pairs)).where(F.col("v").isNotNull()).groupBy("i", "__y")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")))
    rows = per.groupBy("i").agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("G"), F.sum("s").alias("S"),
                                F.sum("q").alias("Q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B")).collect()
    out = {c: None for c in cols}
    for r in rows:
        n, g, S, Q, B = r["N"], r["G"], r["S"], r["Q"], r["B"]
        if n - g <= 0 or g < 2 or S is None:
            continue
        ssb = B - S * S / n
        ssw = (Q - S * S / n) - ssb
        msb, msw = ssb / (g - 1), ssw / (n - g)
        out[cols[r["i"]]] = msb / msw if msw != 0 else (math.inf if msb != 0 else None)
    return out


def _corr(x: Column, y: Column) -> Column:
    """Pearson's r; null where one side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def f_regression(df: DataFrame, cols: list[str], label: str) -> dict[str, float | None]:
    """F statistic of a univariate linear regression of the label on each feature."""
    if not cols:
        return {}
    y = _q(label).cast("double")
    # a pair counts where both are present; a perfect correlation scores infinity
    both = [F.when(y.isNotNull(), _num(c)) for c in cols]
    row = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(both)],
                 *[_corr(v, F.when(v.isNotNull(), y)).alias(f"r{i}") for i, v in enumerate(both)]).first()
    out = {}
    for i, c in enumerate(cols):
        r, n = row[f"r{i}"], row[f"n{i}"]
        if r is None or math.isnan(r) or n < 3:
            out[c] = None
        else:
            rest = 1 - r * r
            out[c] = math.inf if rest <= 1e-15 else r * r / rest * (n - 2)
    return out


class _SelectModel(FeatureModel):
    def _exprs(self, df, cols, st):
        keep = set(self.getOrDefault(self.outputCols))
        return [_q(c) for c in cols if c in keep]

    def _transform(self, df):
        cols = self.getOrDefault(self.featureCols)
        keep = set(self.getOrDefault(self.outputCols))
        return df.select([_q(c) for c in df.columns if c not in cols or c in keep])


class SelectKBestModel(_SelectModel):
    pass


class SelectKBest(FeatureStep):
    """Keep the k features with the highest univariate score (ANOVA F by
    default, also for regression targets). A feature with no score ranks
    last; ties at the cut keep the later feature."""
    model_class = SelectKBestModel
    k = Param(Params._dummy(), "k", "number of features to keep ('all' keeps every one)",
              typeConverter=TypeConverters.toString)
    score_func = Param(Params._dummy(), "score_func", "f_classif or f_regression",
                       typeConverter=TypeConverters.toString)

    def __init__(self, k="10", score_func: str = "f_classif"):
        super().__init__()
        self._setDefault(k="10", score_func="f_classif")
        self._set(k=str(k), score_func=score_func)

    def _fit_state(self, df, cols):
        label = self.getOrDefault(self.labelCol)
        num, other = _split_numeric(df, cols)
        fn = f_regression if self.getOrDefault(self.score_func) == "f_regression" else anova_f
        scores = fn(df, num, label)
        k = self.getOrDefault(self.k)
        if k != "all" and int(k) < 0:
            raise InvalidParameter("SelectKBest: k must be >= 0")
        slots = {}
        if self.blocks:
            by_slot = bl.f_regression if fn is f_regression else bl.anova_f
            slots = by_slot(df, self.blocks, label)
        # every feature in order: (column, slot or None, score)
        every = [(c, j, v) for c in self.getOrDefault(self.featureCols) for j, v in
                 (enumerate(slots[c]) if c in slots else [(None, scores[c])] if c in scores else [])]
        kk = len(every) if k == "all" else min(int(k), len(every))
        order = sorted(range(len(every)), key=lambda i: (_score_key(every[i][2]), i))
        chosen = {every[i][:2] for i in order[len(every) - kk:]}
        self._kept = {c: [j for j in range(len(slots[c])) if (c, j) in chosen] for c in slots}
        keep = [c for c in cols if (c, None) in chosen or c in other]
        found = {**scores, **{self.blocks[c].names[j]: v for c in slots for j, v in enumerate(slots[c])}}
        return {"scores": {c: _json_float(v) for c, v in found.items()}}, keep

    def _fit_blocks(self, df, blocks, state):
        return {c: b.keep(self._kept[c]) for c, b in blocks.items() if self._kept[c]}


def _score_key(v):
    return -math.inf if v is None or (isinstance(v, float) and math.isnan(v)) else v


def _json_float(v):
    if v is None or (isinstance(v, float) and (math.isnan(v) or math.isinf(v))):
        return None if v is None or math.isnan(v) else ("inf" if v > 0 else "-inf")
    return v


class VarianceThresholdModel(_SelectModel):
    pass


class VarianceThreshold(FeatureStep):
    """Keep features whose population variance exceeds the threshold (with
    threshold 0 the peak-to-peak range guards against rounding noise)."""
    model_class = VarianceThresholdModel
    threshold = Param(Params._dummy(), "threshold", "variance threshold", typeConverter=TypeConverters.toFloat)

    def __init__(self, threshold: float = 0.0):
        super().__init__()
        self._setDefault(threshold=0.0)
        self._set(threshold=float(threshold))

    def _fit_state(self, df, cols):
        num, other = _split_numeric(df, cols)
        thr = self.getOrDefault(self.threshold)
        stats = numeric_column_stats(df, num, ["var_pop", "min", "max"])
        var = {}
        for c in num:
            v = stats[c]["var_pop"]
            lo, hi = stats[c]["min"], stats[c]["max"]
            p = hi - lo if lo is not None and hi is not None else None
            if thr == 0 and v is not None and p is not None:
                v = min(v, p)
            var[c] = v
        keep = [c for c in num if var[c] is not None and var[c] > thr]
        self._kept = {}
        if self.blocks:
            total, counts = bl.category_counts(df, self.blocks)
            for c, b in self.blocks.items():
                p, scale = counts[c] / max(total, 1), np.abs(np.array(b.scale))
                least, most = bl.slot_range(total, counts[c])
                spread = scale ** 2 * p * (1 - p)
                spread = np.minimum(spread, scale * (most - least)) if thr == 0 else spread
                self._kept[c] = np.flatnonzero(spread > thr).tolist()
                var.update(zip(b.names, spread.tolist()))
        if not keep and not any(self._kept.values()):
            raise InvalidParameter(f"VarianceThreshold: no feature has variance above {thr}")
        return {"variances": var}, [c for c in cols if c in keep or c in other]

    def _fit_blocks(self, df, blocks, state):
        return {c: b.keep(self._kept[c]) for c, b in blocks.items() if self._kept[c]}


# ---------------------------------------------------------------- PCA

class PCAModel(FeatureModel):
    def _exprs(self, df, cols, st):
        num = st["cols"]
        out = [_q(c) for c in cols if c not in num]
        xs = [F.coalesce(_num(c), F.lit(m)) - F.lit(m) for c, m in zip(num, st["mean"])]
        for j, comp in enumerate(st["components"]):
            e = None
            for x, w in zip(xs, comp):
                t = x * F.lit(float(w))
                e = t if e is None else e + t
            out.append(e.alias(f"pca{j}"))
        return out


class PCA(FeatureStep):
    """Centred principal components (Spark ML's PCA on centred vectors).

    Component signs follow the pinned reference library: within each
    component, the training row with the largest absolute score gets a
    positive score.
    """
    model_class = PCAModel
    needs_columns = True
    n_components = Param(Params._dummy(), "n_components", "number of components",
                         typeConverter=TypeConverters.toInt)

    def __init__(self, n_components: int = 5):
        super().__init__()
        self._setDefault(n_components=5)
        self._set(n_components=int(n_components))

    def _fit_state(self, df, cols):
        num, other = _split_numeric(df, cols)
        k = self.getOrDefault(self.n_components)
        n = df.count()
        if k < 1 or k > min(n, len(num)):
            raise InvalidParameter(f"PCA: n_components={k} must be between 1 and min(n_samples, n_features)")
        stats = numeric_column_stats(df, num, ["mean"])
        means = [stats[c]["mean"] or 0.0 for c in num]
        centred = df.select([(F.coalesce(_num(c), F.lit(m)) - F.lit(m)).alias(f"x{i}")
                             for i, (c, m) in enumerate(zip(num, means))])
        vec = VectorAssembler(inputCols=[f"x{i}" for i in range(len(num))], outputCol="__v").transform(centred)
        model = _SparkPCA(k=k, inputCol="__v", outputCol="__p").fit(vec)
        comps = model.pc.toArray().T.tolist()  # k rows of d loadings
        # sign: largest-|score| training row positive
        scores = [sum((F.col(f"x{i}") * F.lit(float(w)) for i, w in enumerate(comp[1:], 1)),
                      F.col("x0") * F.lit(float(comp[0]))) for comp in comps]
        srow = centred.agg(*[F.max_by(s, F.abs(s)).alias(f"s{j}") for j, s in enumerate(scores)]).first()
        for j in range(k):
            if srow[f"s{j}"] is not None and srow[f"s{j}"] < 0:
                comps[j] = [-w for w in comps[j]]
        return ({"cols": num, "mean": means, "components": comps,
                 "explained_variance": list(model.explainedVariance.toArray())},
                other + [f"pca{j}" for j in range(k)])


# ---------------------------------------------------------------- label encoding

def label_encode(df: DataFrame, col: str, output_col: str | None = None) -> tuple[DataFrame, list]:
    """Text target -> codes 0..k-1 in sorted order; returns (df, labels)."""
    out = output_col or col
    model = StringIndexer(inputCol=col, outputCol="__code", stringOrderType="alphabetAsc",
                          handleInvalid="keep").fit(df)
    coded = model.transform(df).withColumn("__code", F.col("__code").cast("int"))
    if out == col:
        coded = coded.drop(col)
    coded = coded.withColumnRenamed("__code", out)
    return coded, list(model.labels)


def register_step(name: str):
    """Decorator adding a preprocessing step (a ``FeatureStep``) under ``name``."""
    def deco(cls):
        STEP_CLASSES[name] = cls
        return cls
    return deco


STEP_CLASSES = {
    "StandardScaler": StandardScaler,
    "MinMaxScaler": MinMaxScaler,
    "RobustScaler": RobustScaler,
    "Normalizer": Normalizer,
    "SimpleImputer": SimpleImputer,
    "OneHotEncoder": OneHotEncoder,
    "PolynomialFeatures": PolynomialFeatures,
    "SelectKBest": SelectKBest,
    "VarianceThreshold": VarianceThreshold,
    "PCA": PCA,
}


# ---------------------------------------------------------------- RFE

class RFEModel(_SelectModel):
    pass


class RFE(FeatureStep):
    """Recursive feature elimination: fit a Spark ML learner on the current
    features, drop the ``step`` weakest (|coefficient| or tree importance),
    refit, until ``n_features_to_select`` remain (default: half). Each round
    is one distributed fit; the driver only orders the d importances."""
    model_class = RFEModel
    needs_columns = True
    estimator = Param(Params._dummy(), "estimator", "learner used for ranking",
                      typeConverter=TypeConverters.toString)
    n_features_to_select = Param(Params._dummy(), "n_features_to_select", "features to keep",
                                 typeConverter=TypeConverters.toInt)
    step = Param(Params._dummy(), "step", "features removed per round", typeConverter=TypeConverters.toInt)

    n_estimators = Param(Params._dummy(), "n_estimators", "trees of a forest learner", typeConverter=TypeConverters.toInt)
    max_depth = Param(Params._dummy(), "max_depth", "depth of a forest learner's trees", typeConverter=TypeConverters.toInt)

    def __init__(self, estimator: str = "LinearRegression", n_features_to_select: int | None = None,
                 step: int = 1, n_estimators: int = 100, max_depth: int = 10):
        super().__init__()
        self._setDefault(estimator="LinearRegression", step=1, n_estimators=100, max_depth=10)
        self._set(estimator=estimator, step=int(step), n_estimators=int(n_estimators), max_depth=int(max_depth))
        if n_features_to_select is not None:
            self._set(n_features_to_select=int(n_features_to_select))

    def _ranker(self, cols: list[str], label: str):
        from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
        from pyspark.ml.regression import LinearRegression, RandomForestRegressor

        name = self.getOrDefault(self.estimator)
        trees = {"numTrees": self.getOrDefault(self.n_estimators), "maxDepth": self.getOrDefault(self.max_depth), "seed": 42}
        kinds = {"LinearRegression": lambda: LinearRegression(regParam=0.0),
                 "LogisticRegression": lambda: LogisticRegression(standardization=False),
                 "RandomForestClassifier": lambda: RandomForestClassifier(**trees),
                 "RandomForestRegressor": lambda: RandomForestRegressor(**trees)}
        if name not in kinds:
            raise InvalidParameter(f"RFE: unsupported estimator {name!r}")
        return kinds[name]().setFeaturesCol("__rfe").setLabelCol(label)

    def _fit_state(self, df, cols):
        label = self.getOrDefault(self.labelCol)
        num, other = _split_numeric(df, cols)
        target = (self.getOrDefault(self.n_features_to_select) if self.isDefined(self.n_features_to_select)
                  else max(len(num) // 2, 1))
        step = max(self.getOrDefault(self.step), 1)
        # safe internal names, whatever the columns are called
        safe = {c: f"__f{i}" for i, c in enumerate(num)}
        data = df.select(*[_num(c).alias(safe[c]) for c in num], quoted(label).cast("double").alias("__y")).persist()
        gaps = data.where(" OR ".join(f"{c} IS NULL" for c in data.columns)).limit(1).count()
        if gaps:
            data.unpersist()
            raise InvalidParameter("RFE: missing values in the features or the target; impute or drop them first")
        remaining = list(num)
        rounds: list[list[str]] = []
        try:
            while len(remaining) > target:
                vec = VectorAssembler(inputCols=[safe[c] for c in remaining], outputCol="__rfe").transform(data)
                m = self._ranker(remaining, "__y").fit(vec)
                if hasattr(m, "featureImportances"):
                    imp = m.featureImportances.toArray()
                elif hasattr(m, "coefficientMatrix"):
                    imp = abs(m.coefficientMatrix.toArray()).sum(axis=0)
                else:
                    imp = abs(m.coefficients.toArray())
                order = sorted(range(len(remaining)), key=lambda i: (imp[i], i))
                drop = [remaining[i] for i in order[:min(step, len(remaining) - target)]]
                rounds.append(drop)
                remaining = [c for c in remaining if c not in drop]
        finally:
            data.unpersist()
        # kept features rank 1; the last round's eliminations rank 2, and so on
        ranking = {c: 1 for c in remaining}
        for r, dropped in enumerate(rounds):
            for c in dropped:
                ranking[c] = len(rounds) - r + 1
        keep = [c for c in cols if c in remaining or c in other]
        return {"ranking": ranking}, keep


STEP_CLASSES["RFE"] = RFE
