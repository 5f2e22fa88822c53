"""Declarative cleaning operations.

Each operation is ``(op, params)`` — the same names and parameters the
reference's API takes — and maps a DataFrame to a DataFrame lazily. Ops
that need a statistic (mean / median / mode) or a validity check (casts,
whose result *type* depends on the data) run one small aggregate first and
inline the result as a literal, the way a fitted Spark ML model does; only
a handful of numbers reach the driver.

Row order is the hidden ``_row_id`` column; keep-first de-duplication
follows it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.errors import ColumnNotFound, InvalidParameter, UnknownOperation
from tabforge.functions.coerce import (
    INTEGER_TEXT,
    NUMERIC_TEXT,
    NotComparable,
    filter_literal,
    truthiness,
    typed_lit,
)
from tabforge.functions.columns import (
    quoted,
    ROW_ID,
    field_type,
    is_floating,
    is_fractional,
    is_integral,
    is_numeric,
    numeric_columns,
    user_columns,
)
from tabforge.operators.stats import column_mode, quantiles


@dataclass
class OpReport:
    op: str
    params: dict
    applied: bool = True
    reason: str | None = None


@dataclass
class OpContext:
    """Carries options and collects one report per operation."""
    strict: bool = False
    reports: list[OpReport] = field(default_factory=list)

    def skipped(self, op: str, params: dict, reason: str) -> None:
        if self.strict:
            raise InvalidParameter(f"{op}: {reason}")
        self.reports.append(OpReport(op, params, applied=False, reason=reason))


OpFn = Callable[[DataFrame, dict, OpContext], DataFrame]
OPERATIONS: dict[str, OpFn] = {}


def register_op(name: str):
    """Decorator adding a cleaning operation to the registry."""
    def deco(fn: OpFn) -> OpFn:
        OPERATIONS[name] = fn
        return fn
    return deco


def apply_operation(df: DataFrame, op: str, params: dict | None = None,
                    ctx: OpContext | None = None) -> DataFrame:
    """Apply one operation; unknown names raise ``UnknownOperation``."""
    fn = OPERATIONS.get(op)
    if fn is None:
        raise UnknownOperation(op)
    ctx = ctx if ctx is not None else OpContext()
    params = dict(params or {})
    n_before = len(ctx.reports)
    out = fn(df, params, ctx)
    if len(ctx.reports) == n_before:
        ctx.reports.append(OpReport(op, params))
    return out


def _keep_order(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select([quoted(c) for c in cols])


def _missing(df: DataFrame, c: str) -> Column:
    col = quoted(c)
    return (col.isNull() | F.isnan(col)) if is_floating(field_type(df, c)) else col.isNull()


def _replace(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Replace one column in place (same position)."""
    return df.select([expr.alias(c) if c == name else quoted(c) for c in df.columns])


# ---------------------------------------------------------------- columns

def _as_list(v) -> list[str]:
    if v is None:
        return []
    if isinstance(v, str):
        return [s.strip() for s in v.split(",") if s.strip()]
    return [str(s) for s in v]


@register_op("drop_columns")
def drop_columns(df: DataFrame, params: dict, ctx: OpContext) -> DataFrame:
    """Drop the listed columns; unknown names are ignored."""
    cols = set(_as_list(params.get("columns"))) - {ROW_ID}
    return _keep_order(df, [c for c in df.columns if c not in cols])


@register_op("rename_column")
def rename_column(df: DataFrame, params: dict, ctx: OpContext) -> DataFrame:
    old, new = params.get("old_name"), params.get("new_name")
    if not old or not new or old not in user_columns(df):
        ctx.skipped("rename_column", params, "old_name missing or unknown, or new_name empty")
        return df
    if old == new:
        return df
    if new in df.columns:
        raise InvalidParameter(f"rename_column: {new!r} already exists")
    return df.withColumnRenamed(old, new)


# ---------------------------------------------------------------- fills

def _fill_value_expr(df: DataFrame, c: str, value: Column) -> Column:
    return F.when(_missing(df, c), value).otherwise(quoted(c))


def fill_with_stats(df: DataFrame, strategy: str, cols: list[str], approximate: bool = False) -> DataFrame:
    """Fill nulls of ``cols`` with their mean or median (exact unless ``approximate``).

    One aggregate computes every statistic and every null count; columns
    without nulls keep their type untouched, filled ones become DOUBLE.
    """
    if not cols:
        return df
    for c in cols:
        if not is_numeric(field_type(df, c)):
            raise InvalidParameter(f"fill {strategy}: column {c!r} is not numeric")
    aggs = [F.count_if(_missing(df, c)).alias(f"n{i}") for i, c in enumerate(cols)]
    if strategy == "mean":
        for i, c in enumerate(cols):
            v = quoted(c).cast("double")
            aggs.append(F.avg(F.when(~F.isnan(v), v)).alias(f"s{i}"))
    row = df.agg(*aggs).first()
    need = [c for i, c in enumerate(cols) if row[f"n{i}"] > 0]
    if strategy == "mean":
        stats = {c: row[f"s{i}"] for i, c in enumerate(cols)}
    elif strategy == "median":
        stats = {c: v[0] for c, v in quantiles(df, need, [0.5], approximate).items()}
    else:
        raise InvalidParameter(f"unknown statistic {strategy!r}")
    if not need:
        return df
    out = []
    for c in df.columns:
        if c in need:
            v = quoted(c).cast("double")
            s = stats[c]
            fill = F.lit(s).cast("double") if s is not None else F.lit(None).cast("double")
            out.append(F.when(v.isNull() | F.isnan(v), fill).otherwise(v).alias(c))
        else:
            out.append(quoted(c))
    return df.select(out)


def fill_mode(df: DataFrame, c: str) -> DataFrame:
    m = column_mode(df, c)
    if m is None:
        return df
    return _replace(df, c, _fill_value_expr(df, c, F.lit(m).cast(field_type(df, c))))


def fill_constant(df: DataFrame, c: str, value) -> DataFrame:
    """Fill with a constant cast to the column's type; an integral column
    filled with a fractional number becomes DOUBLE. A value that does not
    fit the type raises (the reference would silently mix types)."""
    dt = field_type(df, c)
    if isinstance(dt, T.StringType):
        return _replace(df, c, _fill_value_expr(df, c, F.lit(value if isinstance(value, str) else str(value))))
    if is_numeric(dt):
        try:
            num = float(value)
        except (TypeError, ValueError):
            raise InvalidParameter(f"fill constant: {value!r} is not a number for {c!r}")
        if is_integral(dt) and num.is_integer():
            return _replace(df, c, _fill_value_expr(df, c, F.lit(int(num)).cast(dt)))
        filled = _fill_value_expr(df, c, F.lit(num).cast("double"))
        return _replace(df, c, filled.cast("double"))
    try:
        lit = typed_lit(filter_literal(dt, value), dt)
    except NotComparable as e:
        raise InvalidParameter(f"fill constant: {e}")
    return _replace(df, c, _fill_value_expr(df, c, lit))


@register_op("fill_missing")
def fill_missing(df: DataFrame, params: dict, ctx: OpContext) -> DataFrame:
    """Fill one column (mean/median/mode/constant) or, without a known
    column, every numeric column (mean/median; mode/constant do nothing).
    ``approximate`` takes medians from a sketch, in one scan."""
    col = params.get("column")
    strategy = params.get("strategy", "mean")
    approximate = str(params.get("approximate", False)).lower() == "true"
    if strategy not in ("mean", "median", "mode", "constant"):
        raise InvalidParameter(f"fill_missing: unknown strategy {strategy!r}")
    if col and col in user_columns(df):
        if strategy in ("mean", "median"):
            return fill_with_stats(df, strategy, [col], approximate)
        if strategy == "mode":
            return fill_mode(df, col)
        return fill_constant(df, col, params.get("value", 0))
    if strategy in ("mean", "median"):
        return fill_with_stats(df, strategy, numeric_columns(df), approximate)
    ctx.skipped("fill_missing", params, f"strategy {strategy} needs a known column")
    return df


# ---------------------------------------------------------------- rows

@register_op("drop_nulls")
def drop_nulls(df: DataFrame, params: dict, ctx: OpContext) -> DataFrame:
    subset = _as_list(params.get("subset")) or user_columns(df)
    missing = [c for c in subset if c not in df.columns]
    if missing:
        raise ColumnNotFound(", ".join(missing))
    cond = None
    for c in subset:
        m = _missing(df, c)
        cond = m if cond is None else (cond | m)
    return df.where(~cond) if cond is not None else df


@register_op("drop_duplicates")
def drop_duplicates(df: DataFrame, params: dict, ctx: OpContext) -> DataFrame:
    """Keep the first row (by row order) of every group of equal rows.

    Nulls compare equal. Only keys and row ids are aggregated (by hash, combined
    before the shuffle, so a key that holds a third of the rows costs one row
    per task). The keys that occur more than once are then joined back, and
    their later rows go: rows are never sorted whole, and do not move at all
    while the repeated keys are few enough to be broadcast by the engine. A hot
    key of a larger join is split by its skew handling.
    """
    subset = _as_list(params.get("subset"))
    missing = [c for c in subset if c not in df.columns]
    if missing:
        raise ColumnNotFound(", ".join(missing))
    keys = subset or user_columns(df)
    for c in keys:
        if isinstance(field_type(df, c), T.MapType):
            raise InvalidParameter(f"drop_duplicates: map column {c!r} cannot be compared")
    rest = [c for c in df.columns if c not in keys and c != ROW_ID]
    if ROW_ID not in df.columns:
        if rest:
            raise InvalidParameter(f"drop_duplicates: without the {ROW_ID} row order column no row is the first of its key")
        return df.dropDuplicates(keys)
    groups = df.groupBy(*[quoted(c) for c in keys]).agg(F.min(ROW_ID).alias(ROW_ID), F.count(F.lit(1)).alias("__rows"))
    if not rest:
        return _keep_order(groups, df.columns)
    repeated = groups.where(F.col("__rows") > 1).select(
        *[quoted(c).alias(f"__key_{i}") for i, c in enumerate(keys)], F.col(ROW_ID).alias("__first"))
    same = reduce(and_, [quoted(c).eqNullSafe(F.col(f"__key_{i}")) for i, c in enumerate(keys)])
    out = df.join(repeated, same, "left").where(F.col("__first").isNull() | (F.col(ROW_ID) == F.col("__first")))
    return _keep_order(out, df.columns)


_FILTER_OPS = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: ~c.eqNullSafe(v),
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
}


def filter_predicate(df: DataFrame, col: str, operator: str, value) -> Column:
    """``col OP value`` with the value coerced to the column type.

    ``!=`` keeps missing values (pandas semantics); the other operators
    drop them. Raises NotComparable when the value does not fit the type.
    """
    if operator not in _FILTER_OPS:
        raise InvalidParameter(f"filter_rows: unknown operator {operator!r}")
    dt = field_type(df, col)
    v = filter_literal(dt, value)
    c = quoted(col)
    if isinstance(v, float) and math.isnan(v):
        return F.lit(operator == "!=")
    pred = _FILTER_OPS[operator](c, typed_lit(v, dt))
    if is_floating(dt):
        pred = (pred | F.isnan(c)) if operator == "!=" else (pred & ~F.isnan(c))
    return pred


@register_op("filter_rows")
def filter_rows(df: DataFrame, params: dict, ctx: OpContext) -> DataFrame:
    col, operator, value = params.get("column"), params.get("operator", "=="), params.get("value")
    if not col or col not in user_columns(df) or value is None:
        ctx.skipped("filter_rows", params, "column unknown or value missing")
        return df
    try:
        pred = filter_predicate(df, col, operator, value)
    except NotComparable as e:
        ctx.skipped("filter_rows", params, str(e))
        return df
    return df.where(pred)


# ---------------------------------------------------------------- casts

# Dtype spellings accepted by cast_dtype.
_CAST_TARGETS = {
    "float": "double", "float64": "double", "double": "double", "float32": "float",
    "int": "bigint", "int64": "bigint", "int32": "int", "long": "bigint",
    "str": "string", "string": "string", "object": "string",
    "bool": "boolean", "boolean": "boolean",
}
# The ranges of the integer targets, upper bounds exclusive.
_INT_RANGE = {"bigint": (-2.0**63, 2.0**63), "int": (-2.0**31, 2.0**31)}


def _in_range(null_fail: Column, value: Column, target: str) -> tuple[Column, Column]:
    if target == "bigint":
        return null_fail, value.cast(target)
    lo, hi = _INT_RANGE[target]
    bad = (value < F.lit(int(lo))) | (value >= F.lit(int(hi)))
    return null_fail | F.coalesce(bad, F.lit(False)), F.when(~bad, value).cast(target)


def _cast_plan(df: DataFrame, c: str, target: str, strict: bool) -> tuple[Column, Column]:
    """(failure condition per row, converted value) for an all-or-nothing cast."""
    dt = field_type(df, c)
    col = quoted(c)
    never = F.lit(False)
    if target in ("double", "float"):
        if is_numeric(dt) or isinstance(dt, T.BooleanType):
            return never, col.cast(target)
        if isinstance(dt, T.StringType):
            parsed = F.trim(col).try_cast("double")
            return col.isNotNull() & ~col.rlike(NUMERIC_TEXT), parsed.cast(target)
        return F.lit(True), col
    if target in ("bigint", "int"):
        null_fail = col.isNull() if strict else never
        lo, hi = _INT_RANGE[target]
        if isinstance(dt, T.BooleanType):
            return null_fail, col.cast(target)
        if is_integral(dt):
            if target == "bigint" or not isinstance(dt, T.LongType):
                return null_fail, col.cast(target)
            bad = (col < F.lit(int(lo))) | (col >= F.lit(int(hi)))
            return null_fail | (col.isNotNull() & bad), F.when(~bad, col).cast(target)
        if is_fractional(dt):
            d = col.cast("double")
            whole = F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("double") if target == "int" else d
            bad = F.isnan(d) | (whole < F.lit(lo)) | (whole >= F.lit(hi))
            return null_fail | (col.isNotNull() & bad), F.when(bad, None).otherwise(d).cast(target)
        if isinstance(dt, T.StringType):
            parsed = F.trim(col).try_cast(target)
            bad = ~col.rlike(INTEGER_TEXT) | parsed.isNull()
            return null_fail | (col.isNotNull() & bad), parsed
        if isinstance(dt, T.TimestampNTZType):
            # naive timestamps count from the naive epoch, whatever the session time zone
            micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col)
            return _in_range(null_fail, micros * 1000, target)
        if isinstance(dt, T.TimestampType):
            return _in_range(null_fail, F.unix_micros(col) * 1000, target)
        return F.lit(True), col
    if target == "string":
        return never, col.cast("string")
    if target == "boolean":
        return never, truthiness(col, dt)
    raise InvalidParameter(f"cast to {target!r} is not supported")


def cast_column(df: DataFrame, c: str, dtype: str, strict: bool = True) -> tuple[DataFrame, bool]:
    """All-or-nothing cast: if any value cannot convert, the column is left
    unchanged and False is returned. One aggregate decides."""
    target = _CAST_TARGETS.get(str(dtype).lower())
    if target is None:
        raise InvalidParameter(f"cast_dtype: unknown dtype {dtype!r}")
    fail, value = _cast_plan(df, c, target, strict)
    if isinstance(fail, Column):
        n_bad = df.agg(F.count_if(fail).alias("bad")).first()["bad"]
        if n_bad:
            return df, False
    if target in ("double", "float"):
        value = F.when(F.isnan(value), F.lit(None)).otherwise(value).cast(target)
    return _replace(df, c, value), True


def cast_columns(df: DataFrame, casts: list[tuple[str, str]], strict: bool = True) -> tuple[DataFrame, list[str]]:
    """Several all-or-nothing casts on different columns with ONE validity
    aggregate. Returns the frame and the columns left unchanged."""
    plans = {}
    for c, dtype in casts:
        target = _CAST_TARGETS.get(str(dtype).lower())
        if target is None:
            raise InvalidParameter(f"cast_dtype: unknown dtype {dtype!r}")
        fail, value = _cast_plan(df, c, target, strict)
        if target in ("double", "float"):
            value = F.when(F.isnan(value), F.lit(None)).otherwise(value).cast(target)
        plans[c] = (fail, value)
    row = df.agg(*[F.count_if(fail).alias(f"bad{i}") for i, (fail, _) in enumerate(plans.values())]).first()
    failed = [c for i, c in enumerate(plans) if row[f"bad{i}"]]
    ok = {c: v for c, (_, v) in plans.items() if c not in failed}
    out = df.select([ok[c].alias(c) if c in ok else quoted(c) for c in df.columns])
    return out, failed


@register_op("cast_dtype")
def cast_dtype(df: DataFrame, params: dict, ctx: OpContext) -> DataFrame:
    col, dtype = params.get("column"), params.get("dtype", "float")
    if not col or col not in user_columns(df):
        ctx.skipped("cast_dtype", params, "column unknown")
        return df
    strict = params.get("strict", True)
    if isinstance(strict, str):
        strict = strict.lower() != "false"
    out, ok = cast_column(df, col, dtype, strict=bool(strict))
    if not ok:
        ctx.skipped("cast_dtype", params, f"some values of {col!r} do not convert to {dtype}")
    return out
