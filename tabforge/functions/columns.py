"""Column-level helpers: row identity, type classes, NaN normalisation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.errors import ColumnNotFound

# Hidden column carrying the dataset's row order (head, paging, keep-first
# de-duplication and the split all follow it). Never shown to users.
ROW_ID = "_row_id"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def user_columns(df: DataFrame) -> list[str]:
    """Visible column names, in order, without the hidden row id."""
    return [c for c in df.columns if c != ROW_ID]


def field_type(df: DataFrame, name: str) -> T.DataType:
    for f in df.schema.fields:
        if f.name == name:
            return f.dataType
    raise ColumnNotFound(name)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, _INTEGRAL)


def is_fractional(dt: T.DataType) -> bool:
    return isinstance(dt, _FRACTIONAL)


def is_numeric(dt: T.DataType) -> bool:
    """Numbers as the profiler and the fill-all ops see them (no bool, no intervals)."""
    return is_integral(dt) or is_fractional(dt)


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def numeric_columns(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    names = list(cols) if cols is not None else user_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in names if c in types and is_numeric(types[c])]


def require_columns(df: DataFrame, cols: Iterable[str]) -> None:
    present = set(df.columns)
    missing = [c for c in cols if c not in present]
    if missing:
        raise ColumnNotFound(", ".join(missing))


def nan_to_null(c: Column) -> Column:
    """Missing is NULL: turn a floating NaN into NULL."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def normalize_nans(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column (one projection, codegen'd)."""
    floating = {f.name for f in df.schema.fields if is_floating(f.dataType)}
    if not floating:
        return df
    return df.select([
        nan_to_null(quoted(c)).cast(field_type(df, c)).alias(c) if c in floating else quoted(c)
        for c in df.columns
    ])


# The dtype names the reference reports for each column type.
_DTYPE_NAMES = {
    "bigint": "int64",
    "int": "int32",
    "smallint": "int16",
    "tinyint": "int8",
    "double": "float64",
    "float": "float32",
    "string": "object",
    "boolean": "bool",
    "timestamp": "datetime64[ns]",
    "timestamp_ntz": "datetime64[ns]",
    "date": "object",
    "binary": "object",
}


def dtype_name(dt: T.DataType) -> str:
    simple = dt.simpleString()
    if simple in _DTYPE_NAMES:
        return _DTYPE_NAMES[simple]
    if simple.startswith("decimal") or simple.startswith("array") or simple.startswith("struct") \
            or simple.startswith("map"):
        return "object"
    if simple.startswith("interval"):
        return "timedelta64[ns]"
    return simple


def dtypes(df: DataFrame) -> dict[str, str]:
    """Column -> dtype string, for the visible columns."""
    return {f.name: dtype_name(f.dataType) for f in df.schema.fields if f.name != ROW_ID}
