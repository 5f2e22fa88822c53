"""One-hot slots as blocks: a text column and the slots it stands for.

Inside a training run a one-hot feature stays what it is, a column of
categories. Its slots exist as a ``Block`` beside the plan: names,
categories, and for each slot a shift and a scale, since every elementwise
step maps 0 and 1 to two other numbers. Statistics of slots follow from
grouped counts of the categories, so a step costs one aggregation whatever
the vocabulary, and no plan grows with it. The assembler makes the sparse
vector at the end.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StringIndexerModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.columns import quoted

BROADCAST_CATEGORIES = 100_000


@dataclass
class Block:
    """Slot j of ``column`` is ``shift[j] + scale[j] * (category == categories[j])``."""
    column: str
    names: list[str]
    categories: list[str]
    shift: list[float]
    scale: list[float]

    @staticmethod
    def of(column: str, categories: list[str]) -> "Block":
        return Block(column, [f"{column}_{v}" for v in categories], list(categories), [0.0] * len(categories), [1.0] * len(categories))

    def keep(self, slots) -> "Block":
        return Block(self.column, *([x[j] for j in slots] for x in (self.names, self.categories, self.shift, self.scale)))

    def moved(self, centre: np.ndarray, spread: np.ndarray) -> "Block":
        """Every slot x as (x - centre) / spread."""
        return Block(self.column, self.names, self.categories, ((np.array(self.shift) - centre) / spread).tolist(),
                     (np.array(self.scale) / spread).tolist())


def pack(blocks: dict[str, Block]) -> dict:
    return {c: asdict(b) for c, b in blocks.items()}


def unpack(state: dict) -> dict[str, Block]:
    return {c: Block(**b) for c, b in state.items()}


def _cells(blocks: dict[str, Block]) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(i).alias("i"), quoted(c).cast("string").alias("v")) for i, c in enumerate(blocks)]))


def _by_slot(blocks: dict[str, Block], rows, fields: list[str]) -> dict[str, dict[str, np.ndarray]]:
    """Rows (i, v, fields...) as one array a field and block; a category without a row has zeros."""
    place = [{v: j for j, v in enumerate(b.categories)} for b in blocks.values()]
    out = [{f: np.zeros(len(p)) for f in fields} for p in place]
    for r in rows:
        j = place[r["i"]].get(r["v"])
        if j is not None:
            for f in fields:
                out[r["i"]][f][j] = r[f]
    return dict(zip(blocks, out))


def category_counts(df: DataFrame, blocks: dict[str, Block]) -> tuple[int, dict[str, np.ndarray]]:
    """Rows of ``df``, and rows of each slot's category."""
    rows = df.select(_cells(blocks)).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in rows if r["i"] == 0)
    return total, {c: x["n"] for c, x in _by_slot(blocks, rows, ["n"]).items()}


def slot_range(total: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest indicator of each slot."""
    return (counts >= total).astype(float), (counts > 0).astype(float)


def slot_quantile(total: int, counts: np.ndarray, p: float) -> np.ndarray:
    """The interpolated quantile of each slot's indicators, from their counts alone."""
    at = (max(total, 1) - 1) * p
    low = np.floor(at)
    zeros = total - counts
    a, b = (low >= zeros).astype(float), (np.ceil(at) >= zeros).astype(float)
    return a + (b - a) * (at - low)


def anova_f(df: DataFrame, blocks: dict[str, Block], label: str) -> dict[str, list[float | None]]:
    """One-way ANOVA F of every slot. An indicator's sums in a class are the
    rows of its category there; F does not depend on shift and scale."""
    y = quoted(label)
    base = df.where(y.isNotNull())
    totals = base.groupBy(y.alias("__y")).agg(F.count(F.lit(1)).alias("ny"))
    n, g = totals.agg(F.sum("ny"), F.count(F.lit(1))).first()
    per = base.select(y.alias("__y"), _cells(blocks)).where("v is not null").groupBy("i", "v", "__y").agg(F.count(F.lit(1)).alias("s"))
    rows = (per.join(totals, "__y").groupBy("i", "v")
            .agg(F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("ny")).alias("b")).collect())
    out = {}
    for c, x in _by_slot(blocks, rows, ["s", "b"]).items():
        s, b = x["s"], x["b"]
        if not n or n - g <= 0 or g < 2:
            out[c] = [None] * len(s)
            continue
        between, within = (b - s * s / n) / (g - 1), (s - b) / (n - g)
        # as for columns: no score for a constant, infinite for a perfect split
        out[c] = [None if w <= 1e-12 and v <= 1e-12 else float("inf") if w <= 1e-12 else float(v / w)
                  for v, w in zip(between, within)]
    return out


def f_regression(df: DataFrame, blocks: dict[str, Block], label: str) -> dict[str, list[float | None]]:
    """F of a univariate regression of the label on every slot."""
    y = quoted(label).cast("double")
    n, mean, var = df.agg(F.count(y), F.avg(y), F.var_pop(y)).first()
    rows = (df.where(y.isNotNull()).select((y - F.lit(mean or 0.0)).alias("__d"), _cells(blocks)).where("v is not null")
            .groupBy("i", "v").agg(F.count(F.lit(1)).alias("s"), F.sum("__d").alias("d")).collect())
    out = {}
    for c, x in _by_slot(blocks, rows, ["s", "d"]).items():
        p = x["s"] / max(n, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            r2 = (x["d"] / max(n, 1)) ** 2 / (p * (1 - p) * (var or 0.0))
        out[c] = [None if n < 3 or not np.isfinite(v) else float("inf") if 1 - v <= 1e-15 else float(v / (1 - v) * (n - 2)) for v in r2]
    return out


def index_model(block: Block, source: str, out: str) -> StringIndexerModel:
    """Category -> slot; unknown and missing get one more index. The
    vocabulary travels with the task, not in the plan."""
    return StringIndexerModel.from_labels(block.categories, inputCol=source, outputCol=out, handleInvalid="keep")


def sparse_vector(df: DataFrame, block: Block, source: str, out: str) -> DataFrame:
    """Add the block's slots as a sparse vector, without their shifts: a
    constant added to a feature changes no learner with an intercept, no tree
    and no distance. Learners that it would change get columns instead."""
    df = index_model(block, source, f"{out}_i").transform(df)
    hot = out if all(s == 1.0 for s in block.scale) else f"{out}_h"
    encoder = OneHotEncoder(inputCols=[f"{out}_i"], outputCols=[hot], dropLast=True)
    df = encoder.fit(df).transform(df).drop(f"{out}_i")
    if hot != out:
        df = ElementwiseProduct(scalingVec=Vectors.dense(block.scale), inputCol=hot, outputCol=out).transform(df).drop(hot)
    return df


def indicator_vector(df: DataFrame, categories: list[str], source: str, out: str) -> DataFrame:
    """Add the slots of ``categories`` as a sparse vector; unknown and missing
    have no slot. The vocabulary is joined: neither the plan, the column's
    metadata nor a task holds all of it (Spark's encoder names every slot in
    the metadata), and a small one is broadcast, so rows stay where they are."""
    import pyarrow as pa
    from pyspark.ml.linalg import VectorUDT

    width = len(categories)
    slots = df.sparkSession.createDataFrame(pa.table({f"{out}_c": pa.array(categories, pa.string()),
                                                      f"{out}_i": pa.array(np.arange(width, dtype=np.int32))}))
    slots = F.broadcast(slots) if width <= BROADCAST_CATEGORIES else slots
    hot = F.udf(lambda i: Vectors.sparse(width, [] if i is None else [(i, 1.0)]), VectorUDT())
    joined = df.join(slots, F.col(source) == F.col(f"{out}_c"), "left")
    return joined.withColumn(out, hot(f"{out}_i")).drop(f"{out}_c", f"{out}_i")


def columns_of(block: Block) -> list[Column]:
    """One column a slot, shift and scale applied."""
    v = quoted(block.column).cast("string")
    return [F.when(v == F.lit(k), F.lit(a + b)).otherwise(F.lit(a)).alias(n)
            for n, k, a, b in zip(block.names, block.categories, block.shift, block.scale)]


