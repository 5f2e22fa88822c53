"""Text/number coercion rules shared by casts, filters and CSV inference.

All checks are regular expressions evaluated JVM-side, because Spark's own
casts accept more than the target semantics do (``'1.5d'`` and ``'1f'`` cast
to double, ``'yes'`` casts to boolean).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.columns import is_integral, is_numeric

# Text that parses as a float (decimal or exponent notation,
# inf / infinity / nan in any case, surrounding blanks allowed).
NUMERIC_TEXT = r"^\s*[+-]?(((\d+\.?\d*)|(\.\d+))([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"
# Text that parses as an integer.
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
# The spellings read as booleans.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

# Tokens read as missing when text is parsed.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def truthiness(c: Column, dt: T.DataType) -> Column:
    """Python truthiness of a value; NULL stays NULL.

    0 / 0.0 / '' are False, every other number or text (even 'False') is True.
    """
    if isinstance(dt, T.BooleanType):
        return c
    if is_numeric(dt):
        return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(c != F.lit(0))
    if isinstance(dt, T.StringType):
        return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.length(c) > 0)
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(True))


class NotComparable(ValueError):
    """The filter value cannot be compared with the column."""


def filter_literal(dt: T.DataType, value) -> object:
    """Coerce a filter value to the column's type, in the driver.

    Numbers (every width, not only 64-bit) compare as floats; booleans accept
    true/false/1/0; timestamps accept ISO text; text compares as text.
    Raises NotComparable when the value cannot be coerced.
    """
    if value is None:
        raise NotComparable("no value")
    if is_numeric(dt):
        try:
            return float(value)
        except (TypeError, ValueError) as e:
            raise NotComparable(str(e)) from e
    if isinstance(dt, T.BooleanType):
        s = str(value).strip().lower()
        if s in ("true", "1", "1.0"):
            return True
        if s in ("false", "0", "0.0"):
            return False
        raise NotComparable(f"not a boolean: {value!r}")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        if isinstance(value, (_dt.datetime, _dt.date)):
            return value
        try:
            parsed = _dt.datetime.fromisoformat(str(value).strip())
        except ValueError as e:
            raise NotComparable(str(e)) from e
        if isinstance(dt, T.DateType):
            return parsed.date()
        return parsed.replace(tzinfo=None)
    if isinstance(dt, T.StringType):
        return value if isinstance(value, str) else str(value)
    raise NotComparable(f"column type {dt.simpleString()} is not comparable")


def typed_lit(value, dt: T.DataType) -> Column:
    if isinstance(value, float) and is_numeric(dt):
        # a whole number against an integer column stays an integer, so the filter reaches the scan
        if is_integral(dt) and value.is_integer() and abs(value) < 2.0**53:
            return F.lit(int(value)).cast("bigint")
        return F.lit(value).cast("double")
    if isinstance(value, _dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast(dt)
    return F.lit(value)
