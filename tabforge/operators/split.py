"""Seeded train/test split with an exact test size and no global sort.

A row's place in the shuffled order is ``md5(key || '-' || seed)``; the
test set is the ``ceil(n * test_size)`` rows with the smallest hashes.
Instead of sorting all rows (a single-partition global limit at scale),
the exact cut is found by bucketing: a histogram of the first hash digits
over B buckets (one partial-aggregating pass) locates the bucket
holding the cut; buckets are refined until one holds few rows, and only
those rows are ordered. Hashes are uniform, so every level divides the
candidates by ~B whatever the key skew. Digits are compared as text: a
number made of them (``conv``) costs more a row than the hash. The result is two lazy filters
over the same deterministic hash — recomputable after an executor loss.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.errors import InvalidParameter
from tabforge.functions.columns import ROW_ID, quoted

_BUCKETS = 4096
_FINAL_ROWS = 200_000
_DIGITS = 32


def split_hash(key_cols: list[str], seed: int) -> Column:
    """The md5 of the row key and seed: 32 hex digits, whose order as text is
    that of the numbers they spell."""
    parts = [quoted(c).cast("string") for c in key_cols] + [F.lit(str(seed))]
    return F.md5(F.concat_ws("-", *parts))


def _cut(scored: DataFrame, test_size: float) -> tuple[str, int] | None:
    """md5 of the last test row, i.e. the k-th smallest (0-based) with
    k = ceil(n * test_size) - 1, and n. A bucket is the rows that share their
    first digits; the first histogram also gives n, so no separate count pass
    is needed."""
    prefix, below = "", 0
    digits = max(1, round(math.log(_BUCKETS, 16)))
    k = None
    while True:
        inside = scored.where(F.col("__m").startswith(prefix)) if prefix else scored
        hist = (inside.groupBy(F.substring("__m", len(prefix) + 1, digits).alias("b"))
                .count().collect())
        counts = sorted((r["b"], r["count"]) for r in hist)
        if k is None:
            n = sum(c for _, c in counts)
            total = n
            n_test = int(math.ceil(float(test_size) * n))
            if n == 0 or n_test >= n:
                raise InvalidParameter(f"cannot split {n} rows with test_size={test_size}")
            k = n_test - 1
        seen = below
        target = None
        for b, n in counts:
            if seen + n > k:
                target = (b, n)
                break
            seen += n
        if target is None:
            return None
        b, n = target
        prefix, below = prefix + b, seen
        if len(prefix) >= _DIGITS:  # rows of one key
            return prefix, total
        if n <= _FINAL_ROWS:
            rows = (scored.where(F.col("__m").startswith(prefix))
                    .select("__m").orderBy("__m").offset(k - below).limit(1).collect())
            return (rows[0]["__m"], total) if rows else None


def test_condition(df: DataFrame, test_size: float = 0.2, seed: int = 42,
                   key_cols: list[str] | None = None) -> Column:
    """Boolean column: the row belongs to the test set (exact size)."""
    return _condition(df, test_size, seed, key_cols)[0]


def _condition(df: DataFrame, test_size: float, seed: int, key_cols: list[str] | None) -> tuple[Column, int]:
    if not (0.0 < float(test_size) < 1.0):
        raise InvalidParameter("test_size must be in (0, 1)")
    m = split_hash(key_cols or [ROW_ID], seed)
    cut = _cut(df.select(m.alias("__m")), test_size)
    if cut is None:
        raise RuntimeError("split: cut not found")
    last, n = cut
    return m <= F.lit(last), n


def train_test_split(df: DataFrame, test_size: float = 0.2, seed: int = 42,
                     key_cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact-size seeded split -> (train, test).

    ``key_cols`` default to the hidden row id. Keys should be unique; equal
    keys get equal hashes, and the cut is exact only between distinct keys.
    """
    train, test, _ = split_counted(df, test_size, seed, key_cols)
    return train, test


def split_counted(df: DataFrame, test_size: float = 0.2, seed: int = 42,
                  key_cols: list[str] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(train, test, total rows); the count comes free with the cut."""
    is_test, n = _condition(df, test_size, seed, key_cols)
    return df.where(~is_test), df.where(is_test), n


def split_flag(df: DataFrame, test_size: float = 0.2, seed: int = 42,
               key_cols: list[str] | None = None, name: str = "is_test") -> DataFrame:
    """The same split as one boolean column."""
    return df.withColumn(name, test_condition(df, test_size, seed, key_cols))
