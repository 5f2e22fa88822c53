"""Exact k-nearest-neighbour classification over ball cells.

Every test row must see its true k nearest training rows (ties broken by
the smaller training id) without comparing all pairs:

1. Training rows with identical vectors are cut to the k smallest ids
   (``row_number() <= k`` per vector; Spark applies the limit map-side
   before the shuffle, so a vector shared by a third of the rows costs k
   rows per task).
2. k-means on a bounded sample gives cell centres. Every training row joins
   its nearest centre, and the rows of a cell, in order of their distance to
   it, are cut into units of S rows: a unit is a ring [rmin, rmax] around a
   centre. Ranks come from one range partitioning (a running count within a
   partition plus the totals of the earlier ones), so a cell may hold any
   share of the rows.
3. By the triangle inequality no row of a unit is closer to q than
   ``max(0, |q - c| - rmax, rmin - |q - c|)``. A test row visits its units in
   order of this bound, in three rounds (the first few, some more, all that
   are left), and never one whose bound exceeds the k-th distance found so
   far. What is left out is strictly farther, so the answer is exact.

A visit is a cogroup of a unit's rows with the test rows that visit it, in
blocks of ``QUERY_BLOCK`` test rows (wide rows: more), so a popular unit is many tasks. Inside,
a matrix product screens the pairs and the distances of those that may be
among the k best are computed directly. Centres and the unit directory are
broadcast; both are bounded (``CENTRE_CELLS`` numbers, ``MAX_UNITS`` rings:
beyond, units hold more rows).
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.errors import InvalidParameter
from tabforge.functions.columns import ROW_ID
from tabforge.session import discard, materialize

# Rows that k-means sees; centres steer the search and never its result.
SAMPLE_ROWS = 50_000
MAX_CENTRES, CENTRE_CELLS, MAX_UNITS = 1024, 8_000_000, 500_000
# Rows of so many features are wide: few cells, cut into few units of up to so many bytes.
WIDE, WIDE_CELLS, WIDE_UNITS, WIDE_BYTES = 16, 128, 64, 1 << 26
QUERY_BLOCK = 8192
PAIRS_AT_ONCE = 1 << 21
# Units visited in the first two rounds; the third visits what is left.
ROUNDS = (4, 36, None)
_SETTINGS = "k int, weights string, features_col string, label_col string, id_col string, n_classes int"
_UNITS = "unit long, cell int, rmin double, rmax double, n long"
log = logging.getLogger(__name__)


def _cell_count(n: int, d: int) -> int:
    """Cells, each a unit at least."""
    return max(1, min(round(math.sqrt(n)), MAX_CENTRES if d < WIDE else WIDE_CELLS, CENTRE_CELLS // d))


def _unit_rows(n: int, d: int, k: int) -> int:
    """Rows of a unit. A visit ships a test row's d numbers, and rows of WIDE
    features and more are hardly ever ruled out by distance: about WIDE_UNITS
    units beside one a cell, as far as a task holds them, keep what is shipped
    in proportion to the test rows."""
    least = max(256, 4 * k, -(-n // MAX_UNITS))
    return least if d < WIDE else max(least, min(-(-n // WIDE_UNITS), WIDE_BYTES // (8 * d)))


def _block_rows(d: int) -> int:
    """Test rows of a block. Every block is sent the unit's training rows, so wide rows come in larger ones."""
    return QUERY_BLOCK if d < WIDE else max(QUERY_BLOCK, WIDE_BYTES // (16 * d))


def _matrix(column) -> np.ndarray:
    """A list column as one matrix of doubles."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _sqnorms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to all centres by one matrix product (rounding included)."""
    return np.maximum(_sqnorms(x)[:, None] + _sqnorms(centres)[None, :] - 2.0 * x @ centres.T, 0.0)


def _assign(centres):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            cell = np.concatenate([_near(x[i:i + 4096], centres.value).argmin(1) for i in range(0, len(x), 4096)])
            diff = x - centres.value[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(_sqnorms(diff)))],
                                             ["id", "x", "y", "cell", "dist"])
    return run


def _visits(index, k: int, since: int | None, until: int | None):
    """The units that test rows (qid, x, r2) visit in the round of places ``since`` to ``until``."""
    def run(batches):
        import pyarrow as pa

        centres, unit, cell, rmin, rmax, n = index.value
        for batch in batches:
            x, r2 = _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            rows, units = [], []
            for at in range(0, len(x), 1024):
                part = x[at:at + 1024]
                near = np.sqrt(_near(part, centres))
                # rounding of the matrix product, in terms of a distance
                slack = 1e-7 * (np.sqrt(_sqnorms(part)) + np.sqrt(_sqnorms(centres).max()))
                for i in range(len(part)):
                    d = near[i][cell]
                    bound = np.maximum(np.maximum(d - rmax, rmin - d), 0.0)
                    order = np.argsort(bound, kind="stable")
                    # the first round goes on until it has k rows
                    first = max(ROUNDS[0], int(np.searchsorted(np.cumsum(n[order]), k)) + 1)
                    lo = 0 if since is None else max(since, first)
                    hi = first if since is None else max(until, first) if until else len(order)
                    chosen = order[lo:hi]
                    r = math.sqrt(r2[at + i]) * (1 + 1e-9) + slack[i] if np.isfinite(r2[at + i]) else np.inf
                    chosen = chosen[bound[chosen] <= r]
                    rows.append(np.full(len(chosen), at + i))
                    units.append(chosen)
            rows, units = np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(units) if units else np.zeros(0, int)
            for at in range(0, len(rows), 10_000):
                take = pa.array(rows[at:at + 10_000])
                sel = units[at:at + 10_000]
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(unit[sel]), pa.array(n[sel])],
                                                 ["qid", "x", "r2", "unit", "n"])
    return run


def _best(k: int):
    """The k best training rows of one unit for every test row of one block."""
    def run(left, right):
        import pyarrow as pa

        out = {c: [] for c in ("qid", "tid", "y", "d2")}
        if left.num_rows and right.num_rows:
            q, t = _matrix(left["x"]), _matrix(right["x"])
            qid, tid = left["qid"].to_numpy(), right["id"].to_numpy()
            y, r2 = right["y"].to_numpy(), left["r2"].to_numpy()
            step = max(1, PAIRS_AT_ONCE // len(t))
            for at in range(0, len(q), step):
                part = q[at:at + step]
                rough = _near(part, t)
                slack = 1e-9 * (_sqnorms(part)[:, None] + _sqnorms(t).max())
                top = np.partition(rough, min(k, len(t)) - 1, 1)[:, min(k, len(t)) - 1][:, None]
                i, j = np.nonzero(rough <= np.minimum(top + 2 * slack, r2[at:at + step][:, None] * (1 + 1e-9) + slack))
                d2 = np.concatenate([_sqnorms(part[i[a:a + 65536]] - t[j[a:a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)])
                order = np.lexsort((tid[j], d2, i))
                i, j, d2 = i[order], j[order], d2[order]
                begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
                rank = np.arange(len(i)) - np.repeat(begin, np.diff(np.r_[begin, len(i)]))
                ok = rank < k
                for c, v in zip(out, (qid[at + i[ok]], tid[j[ok]], y[j[ok]], d2[ok])):
                    out[c].append(v)
        types = {"qid": pa.int64(), "tid": pa.int64(), "y": pa.float64(), "d2": pa.float64()}
        return pa.table({c: pa.array(np.concatenate(v) if v else [], types[c]) for c, v in out.items()})
    return run


class KNNModel:
    def __init__(self, train: DataFrame, k: int, weights: str, features_col: str, label_col: str,
                 id_col: str, n_classes: int, centres: np.ndarray, units: list[tuple]):
        self.train, self.k, self.weights = train, k, weights
        self.features_col, self.label_col, self.id_col = features_col, label_col, id_col
        self.n_classes, self.centres, self.units = n_classes, centres, units
        #: pairs of a test and a training row that the last search looked at, and all pairs
        self.examined, self.all_pairs = 0, 0

    def neighbours(self, test: DataFrame) -> DataFrame:
        """(qid, tid, y, d2) of the exact k nearest training rows."""
        spark, k = test.sparkSession, self.k
        columns = [np.array(c) for c in zip(*self.units)]
        index = spark.sparkContext.broadcast((self.centres, *columns))
        queries = materialize(test.select(F.col(self.id_col).cast("long").alias("qid"),
                                          vector_to_array(F.col(self.features_col)).alias("x")), "knn-queries")
        scratch, best = [queries], None
        self.examined, self.all_pairs = 0, queries.count() * int(columns[-1].sum())
        pending = queries.withColumn("r2", F.lit(math.inf))
        for since, until in zip((None, *ROUNDS), ROUNDS):
            visits = materialize(pending.mapInArrow(_visits(index, k, since, until),
                                                    "qid long, x array<double>, r2 double, unit long, n long"), "knn-visits")
            scratch.append(visits)
            looked = visits.agg(F.sum("n")).first()[0]
            if not looked:
                break
            self.examined += int(looked)
            log.info("knn: %d of %d pairs after the round to %s", self.examined, self.all_pairs, until)
            blocks = visits.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / _block_rows(self.centres.shape[1])).cast("int").alias("blocks"))
            asked = visits.join(blocks, "unit").withColumn("block", F.pmod(F.hash("qid"), "blocks"))
            asked = asked.select("unit", "block", "qid", "x", "r2")
            held = (self.train.join(blocks, "unit").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                    .select("unit", "block", "id", "x", "y"))
            found = asked.groupBy("unit", "block").cogroup(held.groupBy("unit", "block")).applyInArrow(
                _best(k), "qid long, tid long, y double, d2 double")
            found = found if best is None else found.unionByName(best)
            rank = F.row_number().over(Window.partitionBy("qid").orderBy("d2", "tid"))
            best = materialize(found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "knn-best")
            scratch.append(best)
            radius = best.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("d2")).otherwise(F.lit(math.inf)).alias("r2"))
            # as large as the test rows: a broadcast would bring them all to the driver
            pending = queries.join(radius.hint("merge"), "qid")
        for table in scratch:
            if table is not best:
                discard(table)
        index.unpersist()
        if best is None:
            return queries.select("qid", F.lit(None).cast("long").alias("tid"), F.lit(None).cast("double").alias("y"),
                                  F.lit(None).cast("double").alias("d2")).limit(0)
        return best

    def transform(self, test: DataFrame) -> DataFrame:
        # equal test vectors are searched once, by the smallest of their ids
        keyed = test.withColumn("__knn_x", vector_to_array(F.col(self.features_col)))
        first = keyed.groupBy("__knn_x").agg(F.min(self.id_col).alias(self.id_col))
        nb = self.neighbours(first.withColumn(self.features_col, array_to_vector("__knn_x")))
        if self.weights == "distance":
            d = F.sqrt("d2")
            has_zero = F.min("d2").over(Window.partitionBy("qid")) == 0
            wt = F.when(has_zero, F.when(F.col("d2") == 0, 1.0).otherwise(0.0)).otherwise(1.0 / d)
        else:
            wt = F.lit(1.0)
        votes = nb.withColumn("wt", wt).groupBy("qid", "y").agg(F.sum("wt").alias("v"))
        total = F.sum("v").over(Window.partitionBy("qid"))
        best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("v"), F.asc("y")))
        ranked = votes.select("qid", "y", "v", (F.col("v") / total).alias("share"), best.alias("b"))
        probs = ranked.groupBy("qid").agg(
            F.max(F.when(F.col("b") == 1, F.col("y"))).alias("prediction"),
            F.map_from_entries(F.collect_list(F.struct(F.col("y").cast("int"), "share"))).alias("pm"))
        nc = max(self.n_classes, 2)
        prob = F.transform(F.sequence(F.lit(0), F.lit(nc - 1)), lambda c: F.coalesce(F.col("pm")[c], F.lit(0.0)))
        res = (probs.select(F.col("qid").alias(self.id_col), "prediction", array_to_vector(prob).alias("probability"))
               .join(first.hint("merge"), self.id_col).drop(self.id_col))
        return keyed.join(res.hint("merge"), "__knn_x", "left").drop("__knn_x")

    # ------------------------------------------------------------ persistence
    def save(self, path: str) -> None:
        """The prepared training rows, the index and the settings, as Parquet."""
        spark = self.train.sparkSession
        self.train.write.mode("overwrite").parquet(f"{path}/train")
        row = (self.k, self.weights, self.features_col, self.label_col, self.id_col, self.n_classes)
        for name, rows, schema in (("settings", [row], _SETTINGS), ("units", self.units, _UNITS),
                                   ("centres", [(i, c.tolist()) for i, c in enumerate(self.centres)], "i int, c array<double>")):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str) -> "KNNModel":
        r = spark.read.schema(_SETTINGS).parquet(f"{path}/settings").first()
        centres = np.array([c["c"] for c in spark.read.parquet(f"{path}/centres").orderBy("i").collect()])
        units = [tuple(u) for u in spark.read.schema(_UNITS).parquet(f"{path}/units").orderBy("unit").collect()]
        return KNNModel(spark.read.parquet(f"{path}/train"), r.k, r.weights, r.features_col, r.label_col, r.id_col,
                        r.n_classes, centres, units)


class KNNClassifier:
    """Exact KNN vote; ``weights`` = 'uniform' or 'distance'. Labels must be
    0..n-1 codes (as produced by label encoding)."""

    def __init__(self, k: int = 5, weights: str = "uniform", features_col: str = "features",
                 label_col: str = "label", id_col: str = ROW_ID, bucket_rows: int | None = None):
        if k < 1:
            raise InvalidParameter("n_neighbors must be >= 1")
        if weights not in ("uniform", "distance"):
            raise InvalidParameter("weights must be uniform or distance")
        self.k, self.weights = k, weights
        self.features_col, self.label_col, self.id_col = features_col, label_col, id_col
        self.bucket_rows = bucket_rows

    def fit(self, train: DataFrame) -> KNNModel:
        spark = train.sparkSession
        base = train.select(F.col(self.id_col).cast("long").alias("id"), vector_to_array(F.col(self.features_col)).alias("x"),
                            F.col(self.label_col).cast("double").alias("y"))
        # identical vectors: the k smallest ids suffice (limit applied map-side)
        rn = F.row_number().over(Window.partitionBy("x").orderBy("id"))
        base = materialize(base.withColumn("rn", rn).where(F.col("rn") <= self.k).drop("rn"), "knn-train")
        ymax, n = base.agg(F.max("y"), F.count(F.lit(1))).first()
        if not n:
            raise InvalidParameter("KNN: empty training set")
        centres = self._centres(base, n)
        shared = spark.sparkContext.broadcast(centres)
        assigned = base.mapInArrow(_assign(shared), "id long, x array<double>, y double, cell int, dist double")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = materialize(assigned.repartitionByRange(parts, "cell", "dist", "id").withColumn("part", F.spark_partition_id()), "knn-dealt")
        sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
        earlier = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        place = F.row_number().over(Window.partitionBy("part").orderBy("cell", "dist", "id")) - 1 + F.col("before")
        size = self.bucket_rows or _unit_rows(n, centres.shape[1], self.k)
        ranked = (dealt.join(F.broadcast(sizes.select("part", earlier.alias("before"))), "part")  # one row a partition
                  .withColumn("unit", F.col("cell") * F.lit(1 << 40) + F.floor(place / size))
                  .select("id", "x", "y", "unit", "cell", "dist"))
        ranked = materialize(ranked, "knn-units")
        rows = (ranked.groupBy("unit").agg(F.first("cell").alias("cell"), F.min("dist").alias("rmin"),
                                           F.max("dist").alias("rmax"), F.count(F.lit(1)).alias("n")).orderBy("unit").collect())
        discard(base)
        discard(dealt)
        shared.unpersist()
        return KNNModel(ranked.drop("cell", "dist"), self.k, self.weights, self.features_col, self.label_col, self.id_col,
                        int(ymax or 0) + 1, centres, [tuple(r) for r in rows])

    def _centres(self, base: DataFrame, n: int) -> np.ndarray:
        """Cell centres: k-means on the rows of least hash."""
        d = max(1, len(base.select("x").first()[0]))
        cells = _cell_count(n, d)
        sample = base if n <= SAMPLE_ROWS else base.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE_ROWS / n) + 1)
        sample = sample.select("id", array_to_vector("x").alias("v")).repartition(4, "id").sortWithinPartitions("id").persist()
        try:
            model = KMeans(k=cells, featuresCol="v", seed=7, maxIter=8, initMode="random").fit(sample)
        finally:
            sample.unpersist()
        return np.array(model.clusterCenters(), dtype=float)
