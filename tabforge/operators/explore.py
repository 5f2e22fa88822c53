"""Exploration of a full predictions table (or any dataset).

The reference recomputes these in the browser over at most 200 preview
rows; here they run over every row and return small aggregated frames:
rule filters with mixed numeric/text comparison, a fixed-bin histogram, a
continuous colour scale, and ordered samples for scatter/line charts.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.errors import InvalidParameter
from tabforge.functions.columns import ROW_ID, field_type, is_numeric, user_columns, quoted

FILTER_OPS = ("==", "!=", ">", "<", ">=", "<=", "contains")
HIST_BINS = 14
SCATTER_ROWS = 400
LINE_ROWS = 80
# The two colours of the continuous scale (RGB).
START_COLOR = (0, 144, 255)
END_COLOR = (0, 229, 160)

# The numeric prefix a browser's parseFloat reads.
_JS_FLOAT_PREFIX = r"^\s*([+-]?(Infinity|((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)))"


def parse_number(text: str, js_compat: bool = False) -> float:
    """Driver-side parse of a filter value; NaN when it is not a number."""
    if text is None:
        return math.nan
    s = str(text)
    if js_compat:
        m = re.match(_JS_FLOAT_PREFIX, s)
        if not m:
            return math.nan
        v = m.group(1)
        return float(v.replace("Infinity", "inf"))
    try:
        v = float(s.strip())
    except ValueError:
        return math.nan
    return v


def _row_number_expr(c: Column, dt, js_compat: bool) -> Column:
    """The row value as a number, NULL when it does not parse."""
    if is_numeric(dt):
        v = c.cast("double")
        return F.when(~F.isnan(v), v)
    s = c.cast("string")
    if js_compat:
        pre = F.regexp_extract(s, _JS_FLOAT_PREFIX, 1)
        return F.when(pre != "", pre.try_cast("double"))
    return F.when(s.rlike(r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|Infinity|inf)\s*$"),
                  F.trim(s).try_cast("double"))


def _as_text(c: Column, dt) -> Column:
    """Text form of a value; missing reads as 'null'."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def rule_predicate(df: DataFrame, col: str, op: str, val: str, js_compat: bool = False) -> Column:
    """One filter rule.

    contains: case-insensitive substring of the text form. Otherwise, when
    both the value and the row parse as numbers, a numeric comparison;
    else ``==`` / ``!=`` compare text and every other operator keeps the row.
    """
    if op not in FILTER_OPS:
        raise InvalidParameter(f"unknown filter operator {op!r}")
    dt = field_type(df, col)
    c = quoted(col)
    text = _as_text(c, dt)
    if op == "contains":
        return F.lower(text).contains(str(val).lower())
    num_f = parse_number(val, js_compat)
    if op == "==":
        fallback = text == F.lit(str(val))
    elif op == "!=":
        fallback = text != F.lit(str(val))
    else:
        fallback = F.lit(True)
    if math.isnan(num_f):
        return fallback
    num_row = _row_number_expr(c, dt, js_compat)
    lit = F.lit(num_f)
    cmp = {"==": num_row == lit, "!=": num_row != lit, ">": num_row > lit,
           "<": num_row < lit, ">=": num_row >= lit, "<=": num_row <= lit}[op]
    return F.when(num_row.isNotNull(), cmp).otherwise(fallback)


def filter_predictions(df: DataFrame, rules, js_compat: bool = False) -> DataFrame:
    """Keep rows satisfying every rule ``(col, op, val)`` (AND)."""
    pred = None
    for r in rules:
        col, op, val = (r["col"], r["op"], r["val"]) if isinstance(r, dict) else r
        p = rule_predicate(df, col, op, val, js_compat)
        pred = p if pred is None else (pred & p)
    return df if pred is None else df.where(pred)


def histogram(df: DataFrame, col: str, bins: int = HIST_BINS, closed_last: bool = True) -> DataFrame:
    """(bin, bin_start, count) over ``bins`` equal bins spanning min..max.

    Bins are [lo, hi); the width is 1 when all values are equal. With
    ``closed_last=False`` the maximum falls outside the last bin (the
    reference's chart); the default counts it. Empty when the column has
    no numbers. The per-row bin is one codegen'd expression and the count
    a partial-aggregating group-by; empty bins come from a 14-row frame.
    """
    if bins < 1:
        raise InvalidParameter("bins must be >= 1")
    v = quoted(col).cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) != F.lit(math.inf)), v)  # finite values only
    vals = df.select(v.alias("__v")).where(F.col("__v").isNotNull())
    stats = vals.agg(F.min("__v").alias("mn"), F.max("__v").alias("mx"),
                     F.count(F.lit(1)).alias("n")).first()
    if not stats["n"]:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, count bigint")
    mn, mx = stats["mn"], stats["mx"]
    size = (mx - mn) / bins or 1.0
    x = F.col("__v")
    guess = F.floor((x - F.lit(mn)) / F.lit(size)).cast("int")
    # exact boundary semantics: v >= mn + i*size and v < mn + (i+1)*size
    lo = F.lit(mn) + guess.cast("double") * F.lit(size)
    hi = F.lit(mn) + (guess + 1).cast("double") * F.lit(size)
    b = F.when(x < lo, guess - 1).when(x >= hi, guess + 1).otherwise(guess)
    if closed_last and mx > mn:
        b = F.when(x == F.lit(mx), F.lit(bins - 1)).otherwise(b)
    counts = (vals.select(b.alias("bin")).where((F.col("bin") >= 0) & (F.col("bin") < bins))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    frame = frame.withColumn("bin_start", F.lit(mn) + F.col("bin").cast("double") * F.lit(size))
    # counts has at most `bins` rows, so broadcasting it is bounded
    return (frame.join(F.broadcast(counts), "bin", "left")
            .select("bin", "bin_start", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def _ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(ROW_ID) if ROW_ID in df.columns else df


def scatter_sample(df: DataFrame, x: str, y: str, c: str | None = None, n: int = SCATTER_ROWS,
                   seed: int | None = None) -> DataFrame:
    """n rows as (i, x, y, c), in row order; a missing x axis is the row's
    place ``i``, a missing y is ``probability``, a missing colour is 0.

    Without a seed these are the first rows. With one they are a sample of
    all rows: those of least md5 of ``row id-seed``. A task keeps its n least,
    so the sample follows the data and never the layout."""
    cols = set(df.columns)
    if seed is None:
        head = _ordered(df).limit(n)
    else:
        if ROW_ID not in cols:
            raise InvalidParameter(f"a seeded sample needs the {ROW_ID} row order column")
        used = [ROW_ID, *dict.fromkeys(k for k in (x, y if y in cols else "probability", c) if k in cols and k != ROW_ID)]
        drawn = F.md5(F.concat(F.col(ROW_ID).cast("string"), F.lit(f"-{seed}")))
        head = df.select(*[quoted(k) for k in used]).orderBy(drawn, ROW_ID).limit(n)
    w_i = F.row_number().over(_order_window(df)) - 1
    xe = quoted(x) if x in cols else w_i.cast("double")
    ye = quoted(y) if y in cols else F.col("probability")
    ce = quoted(c) if c and c in cols else F.lit(0)
    return head.select(w_i.cast("bigint").alias("i"), xe.alias("x"), ye.alias("y"), ce.alias("c"))


def _order_window(df: DataFrame):
    from pyspark.sql import Window

    return Window.orderBy(ROW_ID) if ROW_ID in df.columns else Window.orderBy(F.monotonically_increasing_id())


def line_series(df: DataFrame, y: str, n: int = LINE_ROWS) -> DataFrame:
    """First n rows as (i, val); ``val`` is NULL when the column is absent."""
    head = _ordered(df).limit(n)
    val = quoted(y) if y in df.columns else F.lit(None).cast("double")
    return head.select((F.row_number().over(_order_window(df)) - 1).cast("bigint").alias("i"), val.alias("val"))


def color_scale(df: DataFrame, col: str, start=START_COLOR, end=END_COLOR) -> Column:
    """``rgb(r, g, b)`` per row.

    Numeric column: linear blend by (v - min) / (max - min) over finite
    values, rounded half up; min >= max gives the start colour. Other
    columns: the end colour where the value reads as 1, else the start.
    Returns a column expression; min/max come from one aggregate.
    """
    dt = field_type(df, col)
    c = quoted(col)
    s_css = F.lit(f"rgb({start[0]}, {start[1]}, {start[2]})")
    e_css = F.lit(f"rgb({end[0]}, {end[1]}, {end[2]})")
    if not is_numeric(dt):
        one = F.trim(c.cast("string")).try_cast("double") == F.lit(1.0)
        return F.when(c.isNull(), s_css).when(one, e_css).otherwise(s_css)
    v = c.cast("double")
    finite = ~F.isnan(v) & (F.abs(v) != F.lit(math.inf))
    row = df.agg(F.min(F.when(finite, v)).alias("mn"), F.max(F.when(finite, v)).alias("mx")).first()
    mn, mx = row["mn"], row["mx"]
    if mn is None or mn >= mx:
        return F.when(v.isNull() | ~finite, s_css).otherwise(s_css)
    ratio = (v - F.lit(mn)) / F.lit(mx - mn)
    parts = [F.floor(F.lit(float(a)) + ratio * F.lit(float(b - a)) + F.lit(0.5)).cast("bigint")
             for a, b in zip(start, end)]
    rgb = F.concat(F.lit("rgb("), parts[0].cast("string"), F.lit(", "), parts[1].cast("string"),
                   F.lit(", "), parts[2].cast("string"), F.lit(")"))
    return F.when(v.isNull() | ~finite, s_css).otherwise(rgb)


def numeric_columns_of(df: DataFrame) -> list[str]:
    """Columns offered as numeric axes: decided by the schema."""
    return [c for c in user_columns(df) if is_numeric(field_type(df, c))]


def prediction_columns(feature_cols: list[str], is_classifier: bool) -> list[str]:
    return [*feature_cols, "actual", "predicted", "probability" if is_classifier else "residual"]
