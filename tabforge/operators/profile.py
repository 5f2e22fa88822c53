"""Profiling and projections: shape, dtypes, nulls, statistics, previews.

Every per-column figure comes from ONE fused aggregate over the data, so a
profile costs one scan however wide the table is. Long-format results are
produced with ``inline`` JVM-side; nothing is melted in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.errors import InvalidParameter
from tabforge.functions.columns import (
    quoted,
    ROW_ID,
    dtypes,
    field_type,
    is_floating,
    numeric_columns,
    user_columns,
)

PREVIEW_ROWS = 50
# Pages starting this deep locate their first row by counting, not sorting.
DEEP_PAGE = 10_000


def _missing(df: DataFrame, c: str):
    col = quoted(c)
    if is_floating(field_type(df, c)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def _rows(rows: list[dict]):
    """Turn one wide row into a row per dict of columns (any column name)."""
    return F.inline(F.array(*[F.struct(*[v.alias(k) for k, v in r.items()]) for r in rows]))


def shape(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns."""
    cols = user_columns(df)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(cols)).cast("bigint").alias("n_columns"))


def null_count_exprs(df: DataFrame) -> list:
    return [F.count_if(_missing(df, c)).alias(f"__nulls_{i}") for i, c in enumerate(user_columns(df))]


def null_counts(df: DataFrame) -> DataFrame:
    """Long format (column_name, null_count), one aggregate for all columns."""
    cols = user_columns(df)
    wide = df.agg(*null_count_exprs(df))
    return wide.select(_rows([{"column_name": F.lit(c), "null_count": F.col(f"__nulls_{i}")} for i, c in enumerate(cols)]))


def null_summary(df: DataFrame) -> DataFrame:
    """(column_name, null_count, null_pct) with the percentage to 1 decimal.

    An empty table gives 0 %.
    """
    cols = user_columns(df)
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *null_count_exprs(df))
    long = wide.select("__rows", _rows([{"column_name": F.lit(c), "null_count": F.col(f"__nulls_{i}")}
                                        for i, c in enumerate(cols)]))
    pct = F.when(F.col("__rows") == 0, F.lit(0.0)).otherwise(
        F.round(F.col("null_count") * 100.0 / F.col("__rows"), 1))
    return long.select("column_name", "null_count", pct.alias("null_pct"))


def null_bars(df: DataFrame) -> DataFrame:
    """Columns that have missing values, with their counts."""
    return null_counts(df).where(F.col("null_count") > 0)


def numeric_stats(df: DataFrame) -> DataFrame:
    """(column_name, min, max, mean, std) for every numeric column.

    std is the sample standard deviation; a column with no values gives
    NULLs. NaN counts as missing.
    """
    cols = numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        v = quoted(c).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}"),
                 F.avg(v).alias(f"av{i}"), F.stddev_samp(v).alias(f"sd{i}")]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column_name string, min double, max double, mean double, std double")
    wide = df.agg(*aggs)
    return wide.select(_rows([{"column_name": F.lit(c), "min": F.col(f"mn{i}"), "max": F.col(f"mx{i}"),
                               "mean": F.col(f"av{i}"), "std": F.col(f"sd{i}")} for i, c in enumerate(cols)]))


def preview_head(df: DataFrame, n: int = PREVIEW_ROWS, dense_row_ids: bool = False) -> DataFrame:
    """First n rows in row order (a take-ordered, not a full sort)."""
    if n < 0:
        raise InvalidParameter("n must be >= 0")
    if ROW_ID in df.columns:
        if dense_row_ids:  # ids 0..n-1: a range filter, pruned by row-group statistics
            df = df.where(F.col(ROW_ID) < n)
        return df.orderBy(ROW_ID).limit(n).select([quoted(c) for c in user_columns(df)])
    return df.limit(n)


def preview_page(df: DataFrame, page: int = 0, page_size: int = PREVIEW_ROWS,
                 dense_row_ids: bool = False) -> DataFrame:
    """Rows [page*size, (page+1)*size) in row order; past the end is empty.

    ``dense_row_ids=True`` (ingested, unfiltered data whose ids are
    0..n-1) turns the page into a range filter that prunes row groups.
    """
    if page < 0 or page_size <= 0:
        raise InvalidParameter("page must be >= 0 and page_size > 0")
    start = page * page_size
    if dense_row_ids and ROW_ID in df.columns:
        return (df.where((F.col(ROW_ID) >= start) & (F.col(ROW_ID) < start + page_size))
                .orderBy(ROW_ID).select([quoted(c) for c in user_columns(df)]))
    if ROW_ID not in df.columns:
        return df.offset(start).limit(page_size)
    if start >= DEEP_PAGE:
        # a deep page would be a take-ordered of start+size rows; find the
        # row id at rank `start` by bucketed counting and read from there
        from tabforge.operators.stats import kth_smallest

        first = kth_smallest(df, ROW_ID, start)
        if first is None:
            return df.limit(0).select([quoted(c) for c in user_columns(df)])
        return df.where(F.col(ROW_ID) >= first).orderBy(ROW_ID).limit(page_size).select([quoted(c) for c in user_columns(df)])
    return df.orderBy(ROW_ID).offset(start).limit(page_size).select([quoted(c) for c in user_columns(df)])


def describe_dataset(df: DataFrame, preview_rows: int = PREVIEW_ROWS, dense_row_ids: bool = False) -> dict:
    """The profile of a dataset as a plain dict (rows, columns, dtypes,
    null counts, numeric statistics, preview). One fused aggregate plus one
    take-ordered for the preview.
    """
    from tabforge.operators.stats import LONG_FORMAT_COLUMNS

    cols = user_columns(df)
    num = numeric_columns(df)
    if len(cols) >= LONG_FORMAT_COLUMNS:
        per = {r["column_name"]: r for r in _describe_long(df).collect()}
        return {
            "rows": df.count(),
            "columns": len(cols),
            "column_names": cols,
            "dtypes": dtypes(df),
            "null_counts": {c: int(per[c]["null_count"]) for c in cols},
            "stats": {c: {k: per[c][k] for k in ("min", "max", "mean", "std")} for c in num},
            "preview": [r.asDict() for r in preview_head(df, preview_rows, dense_row_ids).collect()],
        }
    aggs = [F.count(F.lit(1)).alias("__rows"), *null_count_exprs(df)]
    for i, c in enumerate(num):
        v = quoted(c).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}"),
                 F.avg(v).alias(f"av{i}"), F.stddev_samp(v).alias(f"sd{i}")]
    row = df.agg(*aggs).first()
    stats = {}
    for i, c in enumerate(num):
        stats[c] = {"min": row[f"mn{i}"], "max": row[f"mx{i}"], "mean": row[f"av{i}"], "std": row[f"sd{i}"]}
    preview = [r.asDict() for r in preview_head(df, preview_rows, dense_row_ids).collect()]
    return {
        "rows": int(row["__rows"]),
        "columns": len(cols),
        "column_names": cols,
        "dtypes": dtypes(df),
        "null_counts": {c: int(row[f"__nulls_{i}"]) for i, c in enumerate(cols)},
        "stats": stats,
        "preview": preview,
    }


def _describe_long(df: DataFrame) -> DataFrame:
    """describe_columns for wide tables: every cell becomes (column index,
    numeric value or NULL, missing flag) and one group-by on the index
    computes all figures — a handful of codegen'd aggregate functions
    instead of hundreds of buffer fields."""
    cols = user_columns(df)
    num = set(numeric_columns(df))
    names = dtypes(df)
    cells = []
    for i, c in enumerate(cols):
        col = quoted(c)
        v = F.nanvl(col.cast("double"), F.lit(None).cast("double")) if c in num else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(i).alias("i"), v.alias("v"), _missing(df, c).alias("m")))
    per = (df.select(F.inline(F.array(*cells))).groupBy("i")
           .agg(F.count_if("m").alias("null_count"), F.min("v").alias("min"), F.max("v").alias("max"),
                F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")))
    # one row per column, also where the table is empty
    every = df.sparkSession.createDataFrame([(i, c, names[c]) for i, c in enumerate(cols)], "i int, column_name string, dtype string")
    return (every.join(per, "i", "left")
            .select("column_name", "dtype", F.coalesce("null_count", F.lit(0)).alias("null_count"), "min", "max", "mean", "std"))


def describe_columns(df: DataFrame) -> DataFrame:
    """Per column: dtype, null count and (numbers only) min/max/mean/std —
    the whole profile from ONE aggregate, melted JVM-side (long format from
    LONG_FORMAT_COLUMNS columns on)."""
    from tabforge.operators.stats import LONG_FORMAT_COLUMNS

    cols = user_columns(df)
    if len(cols) >= LONG_FORMAT_COLUMNS:
        return _describe_long(df)
    num = set(numeric_columns(df))
    names = dtypes(df)
    aggs = [*null_count_exprs(df)]
    for i, c in enumerate(cols):
        if c in num:
            v = quoted(c).cast("double")
            v = F.when(~F.isnan(v), v)
            aggs += [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}"),
                     F.avg(v).alias(f"av{i}"), F.stddev_samp(v).alias(f"sd{i}")]
    wide = df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        stats = {k: F.col(f"{short}{i}") if c in num else F.lit(None).cast("double")
                 for k, short in (("min", "mn"), ("max", "mx"), ("mean", "av"), ("std", "sd"))}
        rows.append({"column_name": F.lit(c), "dtype": F.lit(names[c]), "null_count": F.col(f"__nulls_{i}"), **stats})
    return wide.select(_rows(rows))
