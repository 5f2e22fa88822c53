"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are pseudo-rotated (three rounds of random signs and a fast
Hadamard transform) and hashed to the nearest signed axis. A table
concatenates whole rotations, the last one cut to fewer axes, so that a
bucket holds about ``occupancy`` vectors whatever the size of the table. A
query visits its own bucket and, in order of the projections given up, the
nearest other ones (multiprobe). All candidates of a bucket are ranked by
their exact distance on the original vectors, in tasks; only the best of
each bucket leave it, and the best of all are the result.

How many buckets a query visits follows from the data. The exact neighbours of
``SAMPLE`` queries are found by one pass over all items; where each of them
lies in its query's order of buckets tells the probes at which ``RECALL`` of
them are found, for any number of tables and size of bucket. The cheapest such
layout is used. Its last resort is one table of which all buckets are visited,
which is exact, so a table on which hashing does not prune costs more and
loses nothing.

Equal vectors are one item with the ids that can ever be reported (the
smallest k + 1), combined before the shuffle, so a vector held by a third of
all rows is one entry of each table. A bucket above ``UNIT`` items is cut into
units, each searched by itself, with the bucket's queries sent to every unit.

The index covers every row; its rotations are seeded, nothing is fitted.
Recall against brute force is measured in tests/llm and stated in the README.

Defined cases: vectors that are null, empty, zero, of another length than most
or hold null or non-finite components take no part, neither as query nor as
candidate. A query never reports its own id; a repeated id is reported
once per query. Null ids take no part. With fewer candidates than k all found
are reported. An empty table gives an empty result. Other columns play no part
and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import materialize

TABLES = 16
OCCUPANCY = (64, 256, 1024, 4096)
RECALL = 0.995  # of the sampled queries' neighbours
SAMPLE = 128
MOST_BUCKETS = 1 << 14  # of a table, so that the order of all can be told for a sampled query
UNIT = 8192
SEED = 11
# microseconds of a probed bucket, of a distance and of an entry of a table
ASK_COST, PAIR_COST, ENTRY_COST = 50.0, 0.04, 5.0


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / math.sqrt(d)


class Tables:
    """The rotations of all tables, from the seed and the shape alone."""

    def __init__(self, dim: int, n_items: int, tables: int, probes: int, occupancy: int, seed: int = SEED):
        self.dim, self.pad = dim, 1 << max(0, math.ceil(math.log2(dim)))
        self.tables, self.probes, self.seed = tables, probes, seed
        need = max(2.0, n_items / occupancy)
        whole = 2 * self.pad
        self.axes = []
        while need > 1.5 or not self.axes:
            part = min(self.pad, max(1, 1 << max(0, math.ceil(math.log2(need / 2)))))
            self.axes.append(part)
            need /= 2 * part if part < self.pad else whole

    def _signs(self, table: int, rotation: int) -> np.ndarray:
        rng = np.random.default_rng([self.seed, table, rotation])
        return rng.integers(0, 2, (3, self.pad)).astype(np.float64) * 2 - 1

    def projections(self, unit: np.ndarray, table: int) -> list[np.ndarray]:
        x = np.zeros((len(unit), self.pad))
        x[:, :self.dim] = unit
        out = []
        for r, axes in enumerate(self.axes):
            y = x
            for signs in self._signs(table, r):
                y = hadamard(y * signs)
            y = y[:, :axes]
            out.append(np.concatenate([y, -y], axis=1))
        return out

    def bucket(self, unit: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(unit), dtype=np.int64)
        for p in self.projections(unit, table):
            out = out * p.shape[1] + p.argmax(axis=1)
        return out

    def probe(self, unit: np.ndarray, table: int) -> np.ndarray:
        """(query, probe) buckets, best first."""
        n, width = len(unit), self.probes
        code, cost = np.zeros((n, 1), dtype=np.int64), np.zeros((n, 1))
        for p in self.projections(unit, table):
            best = np.argsort(-p, axis=1, kind="stable")[:, :width]
            lost = np.take_along_axis(p, best, axis=1)
            lost = (lost[:, :1] - lost) ** 2
            code = (code[:, :, None] * p.shape[1] + best[:, None, :]).reshape(n, -1)
            cost = (cost[:, :, None] + lost[:, None, :]).reshape(n, -1)
            keep = np.argsort(cost, axis=1, kind="stable")[:, :width]
            code, cost = np.take_along_axis(code, keep, axis=1), np.take_along_axis(cost, keep, axis=1)
        return code


    def position(self, unit: np.ndarray, near: np.ndarray, table: int) -> np.ndarray:
        """How many buckets the query ``unit`` visits before that of each of ``near``."""
        total, own = np.zeros(1), np.zeros(len(near))
        for p, held in zip(self.projections(unit[None], table), self.projections(near, table)):
            lost = (p[0].max() - p[0]) ** 2
            total, own = (total[:, None] + lost).ravel(), own + lost[held.argmax(axis=1)]
        # sums in another order differ in the last place
        return np.searchsorted(np.sort(total), own * (1 + 1e-9) + 1e-12, side="right") - 1

    @property
    def buckets(self) -> int:
        return math.prod(2 * a for a in self.axes)


def layout(dim: int, n_items: int, n_queries: int, sample: list[tuple[np.ndarray, np.ndarray]], most_tables: int,
           occupancies: tuple[int, ...] = OCCUPANCY) -> tuple[int, int, int]:
    """(tables, probes, occupancy) of least cost that find ``RECALL`` of the
    neighbours of the sampled queries, given as (query, neighbours) of unit vectors."""
    best = (math.inf, 1, 1, 1)
    for occupancy in sorted({max(o, math.ceil(n_items / MOST_BUCKETS)) for o in occupancies}):
        shape = Tables(dim, n_items, 1, 1, occupancy)
        at = np.full(sum(len(near) for _, near in sample), shape.buckets - 1)
        for tables in range(1, most_tables + 1):
            here = [shape.position(query, near, tables - 1) for query, near in sample]
            at = np.minimum(at, np.concatenate([*here, np.empty(0, at.dtype)]))
            wanted = max(0, math.ceil(RECALL * len(at)) - 1)
            probes = int(np.sort(at)[wanted]) + 1 if len(at) else 1
            # with every bucket of one table more tables add nothing
            cost = (n_queries * tables * probes * (ASK_COST + PAIR_COST * n_items / shape.buckets)
                    + n_items * tables * ENTRY_COST)
            best = min(best, (cost, tables, probes, occupancy))
        exact = n_queries * shape.buckets * (ASK_COST + PAIR_COST * n_items / shape.buckets) + n_items * ENTRY_COST
        best = min(best, (exact, 1, shape.buckets, occupancy))
    return best[1:]


def _closest(x: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of ``asked`` the rows of ``x`` with the k smallest (distance, id), and the distances.

    Products tell which can be among them; those are measured exactly."""
    size = (x ** 2).sum(axis=1)
    for lo in range(0, len(asked), 256):
        part = asked[lo:lo + 256]
        own = (part ** 2).sum(axis=1)[:, None]
        rough = size + own - 2 * part @ x.T
        if len(x) > k:
            slack = 4e-15 * (x.shape[1] + 8) * (size.max() + own)
            # what overflows compares as neither, and is measured
            near = ~(rough > np.partition(rough, k - 1, axis=1)[:, k - 1:k] + slack)
        else:
            near = np.ones(rough.shape, dtype=bool)
        for q, mask in zip(part, near):
            at = np.flatnonzero(mask)
            d = np.sqrt(((x[at] - q) ** 2).sum(axis=1))
            best = np.lexsort((ids[at], d))[:k]
            yield at[best], d[best]


def _sampled(items: DataFrame, asked: list, dim: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The unit vectors of the asked rows, each with those of its k exact neighbours."""
    matrix = np.array([r.v for r in asked], dtype=np.float64).reshape(-1, dim)

    def nearby(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept = [(np.empty((0, dim)), np.empty(0, np.int64))] * len(matrix)
        for batch in batches:
            if batch.num_rows:
                x, ids = _matrix(batch.column("v"), dim), batch.column("item").to_numpy()
                for i, (at, _) in enumerate(_closest(x, ids, matrix, k + 1)):
                    both, names = np.concatenate([kept[i][0], x[at]]), np.concatenate([kept[i][1], ids[at]])
                    best, _ = next(_closest(both, names, matrix[i:i + 1], k + 1))
                    kept[i] = both[best], names[best]
        for i, (x, ids) in enumerate(kept):
            d = np.sqrt(((x - matrix[i]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), i, np.int32)), pa.array(d), pa.array(ids), pa.array(list(x), pa.list_(pa.float64()))],
                names=["asked", "d", "item", "v"])

    found = items.select("item", "v").mapInArrow(nearby, "asked int, d double, item long, v array<double>")
    order = Window.partitionBy("asked").orderBy("d", "item")
    found = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).filter("d > 0")
    near: dict[int, list] = {}
    for r in found.collect():  # at most SAMPLE * (k + 1) rows
        near.setdefault(r.asked, []).append(r.v)
    return [(_unit(matrix[i:i + 1])[0], _unit(np.array(v))) for i, v in sorted(near.items())]


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(vectors: DataFrame, query_filter, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10,
            tables: int = TABLES, probes: int | None = None, occupancy: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that
    ``query_filter`` (a condition on column ``vec_id``) selects. ``tables`` is
    the largest number of tables; probes and occupancy follow from the data
    where they are not given."""
    kind = vectors.select(F.col(vec_col)).schema[0].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("v"))
    good = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    v = v.filter(F.col("vec_id").isNotNull() & good & F.exists("v", lambda x: x != 0))
    v = v.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(kind[6:-1])))  # -0.0 equals 0.0
    shapes = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not shapes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = shapes[0].dim
    v = v.filter(F.size("v") == dim)
    # one item per distinct vector, with the ids that can be among any k nearest;
    # the limit on the row number is applied before the shuffle as well
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    items = materialize(v.distinct().withColumn("n", first).filter(F.col("n") <= k + 1)
                        .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                        .withColumn("item", F.col("ids")[0]), "polytope-items")
    queries, n_items = materialize(v.filter(query_filter).distinct(), "polytope-queries"), items.count()
    if probes is None or occupancy is None:
        asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
        found = layout(dim, n_items, queries.count(), _sampled(items, asked, dim, k), tables,
                       OCCUPANCY if occupancy is None else (occupancy,))
        tables, probes, occupancy = found[0], found[1] if probes is None else probes, found[2]
    shape = Tables(dim, n_items, tables, probes, occupancy)

    def index(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            unit = _unit(_matrix(batch.column("v"), dim)) if batch.num_rows else np.zeros((0, dim))
            for t in range(tables if batch.num_rows else 0):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(unit), t, np.int32)), pa.array(shape.bucket(unit, t)), batch.column("item"),
                     batch.column("v")], names=["t", "bucket", "item", "v"])

    def probe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            unit = _unit(_matrix(batch.column("v"), dim)) if batch.num_rows else np.zeros((0, dim))
            step = max(1, (1 << 14) // probes)  # few enough that their probes fit one batch
            for lo, t in ((lo, t) for lo in range(0, len(unit), step) for t in range(tables)):
                code = shape.probe(unit[lo:lo + step], t)
                row = pa.array(lo + np.repeat(np.arange(len(code)), code.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(code.size, t, np.int32)), pa.array(code.ravel()), batch.column("vec_id").take(row),
                     batch.column("v").take(row)], names=["t", "bucket", "query_id", "v"])

    base = items.select("item", "v").mapInArrow(index, f"t int, bucket long, item long, v {kind}")
    asks = queries.mapInArrow(probe, f"t int, bucket long, query_id long, v {kind}")
    # buckets above UNIT items are cut into units
    sizes = (materialize(base.groupBy("t", "bucket").count().withColumn("units", F.ceil(F.col("count") / UNIT).cast("int"))
                         .select("t", "bucket", "units"), "polytope-sizes"))
    large = sizes.filter("units > 1")
    base = (base.join(large, ["t", "bucket"], "left")
            .withColumn("unit", F.pmod(F.xxhash64("item"), F.coalesce("units", F.lit(1))).cast("int"))
            .select("t", "bucket", "unit", "item", "v"))
    asks = (asks.join(sizes, ["t", "bucket"])
            .withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1)))
            .select("t", "bucket", "unit", "query_id", "v"))
    # many small buckets make a cell, so that a group is worth its call
    per_cell = max(1, 2048 // max(1, occupancy))
    n_cells = max(1, math.ceil(n_items / (occupancy * per_cell)))
    cell = F.pmod(F.xxhash64("bucket", "unit"), F.lit(n_cells)).cast("int")
    base, asks = base.withColumn("cell", cell), asks.withColumn("cell", cell)

    def rank(left, right):
        import pyarrow as pa

        out: list = [[], [], []]
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            bv, qv = (_matrix(x.column("v").combine_chunks(), dim) for x in (left, right))
            item, qid = (x.column(c).to_numpy() for x, c in ((left, "item"), (right, "query_id")))
            bkey, qkey = ((x.column("bucket").to_numpy(), x.column("unit").to_numpy()) for x in (left, right))
            border, qorder = np.lexsort(bkey[::-1]), np.lexsort(qkey[::-1])
            groups = {}
            for name, key, order in (("b", bkey, border), ("q", qkey, qorder)):
                b, u = key[0][order], key[1][order]
                cut = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (u[1:] != u[:-1])]))
                for lo, hi in zip(cut, np.append(cut[1:], len(order))):
                    groups.setdefault((int(b[lo]), int(u[lo])), {})[name] = order[lo:hi]
            for g in groups.values():
                if len(g) < 2:
                    continue
                x, ids = bv[g["b"]], item[g["b"]]
                for q, (best, d) in zip(g["q"], _closest(x, ids, qv[g["q"]], k + 1)):
                    out[0].append(np.full(len(best), qid[q]))
                    out[1].append(ids[best])
                    out[2].append(d)
        cols = [np.concatenate([*o, np.empty(0, t)]) for o, t in zip(out, (np.int64, np.int64, np.float64))]
        return pa.table({c: pa.array(x) for c, x in zip(("query_id", "item", "score"), cols)})

    found = (asks.groupBy("t", "cell").cogroup(base.groupBy("t", "cell")).applyInArrow(
        lambda asked, held: rank(held, asked), "query_id long, item long, score double").distinct())
    top = Window.partitionBy("query_id").orderBy("score", "item")
    found = found.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1)
    pairs = (found.join(items.select("item", "ids"), "item").select("query_id", "score", F.explode("ids").alias("vec_id"))
             .filter("vec_id <> query_id"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
