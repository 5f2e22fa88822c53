"""Scans with row identity and pandas-compatible CSV type inference.

Row order is made explicit as ``_row_id`` without shuffling the data:

* Parquet: ``offset(file) + _metadata.row_index``;
* CSV: ``offset(file, block) + (monotonic id - first monotonic id of the
  block)`` — a block is read by one task, so ids inside it are consecutive;
  records with line breaks are numbered by ``sources.records``.

Offsets are cumulative row counts of a tiny per-file (per-block) aggregate;
that table has one row per file/block, its size is known from the file
listing, and it is broadcast only below a fixed bound.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.errors import InvalidParameter
from tabforge.functions.coerce import (
    FALSE_TOKENS,
    INTEGER_TEXT,
    NULL_TOKENS,
    NUMERIC_TEXT,
    TRUE_TOKENS,
)
from tabforge.functions.columns import ROW_ID, normalize_nans, quoted
from tabforge.sources import records

# Above this many files/blocks the offsets table is joined, not broadcast.
MAX_BROADCAST_OFFSETS = 20_000


def _attach_offsets(df: DataFrame, keys: list[str], local_pos, n_parts: int) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    if n_parts <= MAX_BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    joined = df.join(offsets, on=keys, how="inner")
    return joined.withColumn(ROW_ID, F.col("__off") + local_pos).drop("__off", *keys)


def with_row_ids_parquet(df: DataFrame) -> DataFrame:
    """Add ``_row_id`` following file order then row order inside each file."""
    tagged = df.select("*", F.col("_metadata.file_path").alias("__file"),
                       F.col("_metadata.row_index").alias("__ri"))
    n_files = max(len(df.inputFiles()), 1)
    out = _attach_offsets(tagged, ["__file"], F.col("__ri"), n_files)
    return out.drop("__ri")


def with_row_ids_text(df: DataFrame) -> DataFrame:
    """Add ``_row_id`` to a CSV/text scan (file order, then line order).

    One grouped pass gives, per (file, block), its row count and its first
    monotonic id; the running sum of counts is the block's offset.
    """
    tagged = df.select("*", F.col("_metadata.file_path").alias("__file"),
                       F.col("_metadata.file_block_start").alias("__blk"),
                       F.monotonically_increasing_id().alias("__mono"))
    keys = ["__file", "__blk"]
    per_block = tagged.groupBy(*keys).agg(F.min("__mono").alias("__first"), F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(*keys, "__first", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    n_blocks = max(df.rdd.getNumPartitions(), len(df.inputFiles()), 1) * 4
    if n_blocks <= MAX_BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    out = tagged.join(offsets, keys).withColumn(ROW_ID, F.col("__off") + F.col("__mono") - F.col("__first"))
    return out.drop("__mono", "__first", "__off", *keys)


def scan_parquet(spark: SparkSession, path: str, row_ids: bool = True) -> DataFrame:
    df = normalize_nans(spark.read.parquet(path))
    return with_row_ids_parquet(df) if row_ids else df


def load_table(spark: SparkSession, sf_dir: str, name: str, order_by: str | None = None) -> DataFrame:
    """A driver test table; ``order_by`` names a unique key used as row order."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if order_by:
        return df.withColumn(ROW_ID, F.col(order_by).cast("bigint"))
    return df


# ----------------------------------------------------------------- CSV

def _dedupe_header(names: list[str]) -> list[str]:
    """Duplicate headers become name, name.1, name.2 ..."""
    seen: dict[str, int] = {}
    out = []
    taken = set(names)
    for n in names:
        n = n if n is not None and n != "" else "Unnamed"
        if n in seen:
            k = seen[n]
            cand = f"{n}.{k}"
            while cand in taken:
                k += 1
                cand = f"{n}.{k}"
            seen[n] = k + 1
            taken.add(cand)
            out.append(cand)
        else:
            seen[n] = 1
            out.append(n)
    return out


def read_csv_text(spark: SparkSession, path: str, multiline: bool = True, row_ids: bool = False) -> DataFrame:
    """All-string CSV scan with the header de-duplicated. Short rows are
    filled with missing values; a row longer than the header is an error.

    With ``multiline``, quoted fields may hold line breaks; files that do are
    read in splits all the same (``sources.records``)."""
    opts = {"header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "\u0000__never__"}
    header = spark.read.options(**{**opts, "header": "false", "multiLine": str(multiline).lower()}).csv(path).first()
    if header is None:
        raise InvalidParameter(f"empty CSV: {path}")
    names = _dedupe_header([str(v) if v is not None else "" for v in header])
    # one column more than the header has: rows that fill it are too long
    schema = ", ".join([*(f"c{i} string" for i in range(len(names))), "more string"])
    if multiline and records.has_open_lines(spark, path):
        whole = records.records(spark, path)
        # as multiLine reads them: line breaks within quotes stay as they are
        fields = F.from_csv("text", schema, {**opts, "multiLine": "true", "lineSep": "\n"})
        raw = whole.select(ROW_ID, fields.alias("f")).select(ROW_ID, "f.*")
        raw = raw if row_ids else raw.drop(ROW_ID)
    else:
        raw = spark.read.schema(schema).options(**opts).csv(path)
        raw = with_row_ids_text(raw) if row_ids else raw
    too_long = F.raise_error(F.lit(f"a row has more than the {len(names)} fields of the header"))
    first = F.when(F.col("more").isNotNull(), too_long.cast("string")).otherwise(F.col("c0"))
    return raw.select(*[(first if i == 0 else F.col(f"c{i}")).alias(n) for i, n in enumerate(names)],
                      *([ROW_ID] if row_ids else []))


def infer_schema(df: DataFrame) -> dict[str, str]:
    """Infer a type per text column in ONE aggregate over all columns.

    After dropping null tokens: all integer text within 64 bits -> bigint; all numeric text
    -> double; all true/false spellings with no missing value -> boolean;
    otherwise string. An all-missing column -> double. Dates stay text.
    """
    cols = [c for c in df.columns if c != ROW_ID]
    aggs = []
    for i, c in enumerate(cols):
        v = quoted(c)
        present = v.isNotNull() & ~v.isin(*NULL_TOKENS)
        aggs += [
            F.count_if(present).alias(f"p{i}"),
            F.count_if(~present).alias(f"m{i}"),
            F.count_if(present & ~v.rlike(INTEGER_TEXT)).alias(f"i{i}"),
            F.count_if(present & F.trim(v).try_cast("bigint").isNull()).alias(f"w{i}"),
            F.count_if(present & ~v.rlike(NUMERIC_TEXT)).alias(f"f{i}"),
            F.count_if(present & ~v.isin(*TRUE_TOKENS, *FALSE_TOKENS)).alias(f"b{i}"),
        ]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        if row[f"p{i}"] == 0:
            out[c] = "double"
        elif row[f"i{i}"] == 0:
            # integers that 64 bits cannot hold stay text
            out[c] = "bigint" if row[f"w{i}"] == 0 else "string"
        elif row[f"f{i}"] == 0:
            out[c] = "double"
        elif row[f"b{i}"] == 0 and row[f"m{i}"] == 0:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def apply_schema(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns to the inferred types; null tokens become NULL."""
    out = []
    for c in df.columns:
        if c == ROW_ID or c not in types:
            out.append(quoted(c))
            continue
        v = quoted(c)
        v = F.when(v.isNull() | v.isin(*NULL_TOKENS), F.lit(None)).otherwise(v)
        t = types[c]
        if t == "boolean":
            v = v.isin(*TRUE_TOKENS)
        elif t in ("bigint", "double"):
            v = F.trim(v).try_cast(t)
            if t == "double":
                v = F.when(F.isnan(v), F.lit(None)).otherwise(v)
        out.append(v.cast(t).alias(c))
    return df.select(out)


def scan_csv(spark: SparkSession, path: str, multiline: bool = True, row_ids: bool = True) -> DataFrame:
    text = read_csv_text(spark, path, multiline=multiline, row_ids=row_ids)
    types = infer_schema(text.drop(ROW_ID))  # inference needs no row order
    return apply_schema(text, types)
