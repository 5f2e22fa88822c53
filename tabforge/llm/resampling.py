"""Importance resampling of raw text towards a target.

Words and word pairs of every text are hashed into ``BUCKETS`` cells. Two
generative models (bags of hashed n-grams) are counted: one over the target
texts, one over all raw texts. A document's log importance weight is the sum
over its n-grams of log(target rate / raw rate). Adding seeded Gumbel
noise and taking the k largest samples without replacement in proportion to the
weights.

The counts cover all texts (BUCKETS sums come to the driver, whatever the size
of the corpus). The k-th largest key is found exactly without sorting: each
round counts keys in ``BINS`` equal ranges and goes on in the one that holds
the k-th, until all keys in it are equal; ties at the border are settled by
id in that one group. Nothing larger than BINS counts leaves the tasks.

Defined cases: null text counts as empty; a text without words has weight 0. The
noise is a function of seed, id and text, so reruns agree and repeated rows
share a key; rows that tie at the border in key and id are kept together, which
may exceed k. Null ids draw noise like any other. Without target texts both
models are equal and all weights are 0. k above the number of rows keeps all.
An empty table gives an empty result. Other columns play no part and may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import materialize

BUCKETS = 10_000
BINS = 4096
KEEP = 0.5
SEED = 17
WORD_MULTIPLIER = 0x9E3779B97F4A7C15


def hashed_ngrams(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The cells of all words and word pairs of a text, repeats included."""
    import zlib

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.int64)
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    pairs = h[:-1] * np.uint64(WORD_MULTIPLIER) + h[1:]
    pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate([h, pairs >> np.uint64(32)]).astype(np.int64) % buckets


def _counts(texts: DataFrame, buckets: int) -> np.ndarray:
    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(hashed_ngrams(text, buckets), minlength=buckets)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cells), "n": pa.array(total[cells])})

    out = np.zeros(buckets)
    for r in texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r["n"]
    return out


def _gumbel(seed: int):
    """Standard Gumbel noise from 52 hashed bits."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 12).cast("double")
    return -F.log(-F.log((bits + 0.5) / float(1 << 52)))


def kth_largest(keys: DataFrame, k: int, bins: int = BINS) -> float:
    """The exact k-th largest value of column ``key`` (1 <= k <= rows)."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while lo < hi:
        width = (hi - lo) / bins
        if width <= 0 or lo + width <= lo or hi - width >= hi:
            edge = F.col("key")  # neighbouring doubles: count the values themselves
            groups = keys.filter(F.col("key").between(lo, hi)).groupBy(edge.alias("key")).count().orderBy(F.desc("key"))
            for r in groups.limit(bins).collect():
                above += r["count"]
                if above >= k:
                    return r.key
            return lo
        cell = F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1))
        got = (keys.filter(F.col("key").between(lo, hi)).groupBy(cell.alias("cell"))
               .agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect())
        for r in sorted(got, key=lambda r: -r.cell):
            if above + r.n >= k:
                lo, hi = r.lo, r.hi
                break
            above += r.n
    return lo


def importance_sample(raw: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      k: int | None = None, keep: float = KEEP, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, key, selected per row of ``raw``; ``target`` has a
    column ``text``. ``k`` rows are selected, by default the share ``keep``."""
    raw = raw.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seen, wanted = _counts(raw.select("text"), buckets), _counts(target.select("text"), buckets)
    if wanted.sum() == 0:
        wanted = seen
    ratio = np.log((wanted + 1) / (wanted.sum() + buckets)) - np.log((seen + 1) / (seen.sum() + buckets))
    shared = raw.sparkSession.sparkContext.broadcast(ratio)  # fixed size: one number a cell

    @F.pandas_udf("double")
    def weight(texts):
        import pandas as pd

        return pd.Series([float(shared.value[hashed_ngrams(t, buckets)].sum()) for t in texts], dtype="float64")

    scored = materialize(raw.select("doc_id", weight("text").alias("log_weight"), _gumbel(seed).alias("noise"))
                         .withColumn("key", F.col("log_weight") + F.col("noise")).drop("noise"), "resampling-keys")
    n = scored.count()
    k = round(keep * n) if k is None else k
    if k >= n or k <= 0:
        return scored.withColumn("selected", F.lit(k > 0))
    border = kth_largest(scored, k)
    higher = scored.filter(F.col("key") > border).count()
    ties = scored.filter(F.col("key") == border)
    if higher + ties.count() == k:
        return scored.withColumn("selected", F.col("key") >= border)
    # among equal keys the smaller ids, null last: the same search on the id
    last = -kth_largest(ties.select((-F.coalesce(F.col("doc_id").cast("double"), F.lit(float(1 << 63)))).alias("key")), k - higher)
    return scored.withColumn("selected", (F.col("key") > border) | (
        (F.col("key") == border) & (F.coalesce(F.col("doc_id").cast("double"), F.lit(float(1 << 63))) <= last)))
