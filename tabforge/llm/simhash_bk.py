"""SimHash near-duplicates found by BK-trees.

Each document has a 64-bit fingerprint: a bit is set if it is set in over half
of the XXH64 hashes of its word shingles, repeats included. Distinct
fingerprints (with their smallest id) are the items. Two that differ in at
most r bits agree on all bits of m - r of any m bit blocks, so one shard
per choice of blocks and their value holds every linked pair; m grows with the
number of items, which keeps shards small and changes no result. In
each shard a BK-tree (children keyed by their Hamming distance to the
pivot) is searched with only the edges within the radius. The search takes out
what it finds, so a dense group of n items yields n - 1 links and not all its
pairs. A shard above ``UNIT`` items is cut into chunks, and each pair of
chunks is a unit of its own, in any task. Links are joined to connected
components in Spark.

Defined cases: null or wordless text has fingerprint zero and links like any
other. With fewer words than a shingle the whole sequence is the one
shingle. Rows that repeat share fingerprint and component. A null id is
smaller than none, and a text of any length is hashed whole: a component has a null id only if all its ids are null. An
empty table gives an empty result. Columns other than id and text play no part
and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import free_prefix, materialize, one_of_each
from tabforge.llm.components import components

SEED = 42
UNIT = 4096
LEAF = 48
PIECE = 4096


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Signed 64-bit SimHash of one text."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles, n = [b" ".join(words)], 1
    else:
        n = len(words) - words_per_shingle + 1
        shingles = map(b" ".join, zip(*[words[i:] for i in range(words_per_shingle)]))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n)
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, n, PIECE):
        part = hashes[at:at + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(texts, words_per_shingle: int = 3):
    """Column of SimHash fingerprints (signed 64-bit) of a text column."""
    @F.pandas_udf("long")
    def fp(s: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words_per_shingle) for t in s], dtype="int64")
    return fp(texts)


class BKTree:
    """Items in a tree keyed by Hamming distance to the pivots; found items leave it."""

    def __init__(self, values: np.ndarray, radius: int):
        self.values, self.radius = values, radius
        self.alive = np.ones(len(values), dtype=bool)
        self.root = self._build(np.arange(len(values)))

    def _build(self, items: np.ndarray):
        if len(items) <= LEAF:
            return items
        pivot, rest = items[0], items[1:]
        d = np.bitwise_count(self.values[rest] ^ self.values[pivot])
        return pivot, {int(k): self._build(rest[d == k]) for k in np.unique(d)}

    def take(self, queries: np.ndarray) -> np.ndarray:
        """Remove and return the items within the radius of any query."""
        found: list[np.ndarray] = []
        todo = [(self.root, queries)]
        while todo:
            node, q = todo.pop()
            if isinstance(node, np.ndarray):
                items = node[self.alive[node]]
                if len(items):
                    near = (np.bitwise_count(q[:, None] ^ self.values[items][None, :]) <= self.radius).any(axis=0)
                    self.alive[items[near]] = False
                    found.append(items[near])
                continue
            pivot, children = node
            d = np.bitwise_count(q ^ self.values[pivot]).astype(np.int64)
            if self.alive[pivot] and (d <= self.radius).any():
                self.alive[pivot] = False
                found.append(np.array([pivot]))
            for key, child in children.items():
                near = np.abs(d - key) <= self.radius  # the triangle inequality
                if near.any():
                    todo.append((child, q[near]))
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def unit_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(item, root) links that connect all items within the radius of each other."""
    if len(values) == 2:
        near = np.bitwise_count(values[:1] ^ values[1:]) <= radius
        return values[1:][near], values[:1][near]
    tree = BKTree(values, radius)
    items, roots = [], []
    for i in range(len(values)):
        if not tree.alive[i]:
            continue
        tree.alive[i] = False
        front = values[i:i + 1]
        while len(front):
            found = tree.take(front)
            front = values[found]
            items.append(front)
            roots.append(np.full(len(front), values[i]))
    return (np.concatenate(items), np.concatenate(roots)) if items else (values[:0], values[:0])


def _masks(n_items: int, radius: int) -> list[int]:
    """Bit masks of the shards' keys: all choices of m - radius of m blocks."""
    m = radius + 1
    while m < 2 * radius + 2 and n_items / 2 ** (64 * (m - radius) // m) > 64:
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(m)]
    return [sum(c) for c in combinations(blocks, m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that span every
    group connected within ``radius`` bits."""
    masks = _masks(distinct.count(), radius)
    shards = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for i, m in enumerate(masks)])).alias("s")).select("fp", "s.t", "s.key")
    sizes = shards.groupBy("t", "key").count().filter("count > 1").withColumn(
        "k", F.ceil(F.col("count") / UNIT).cast("int"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    units = (shards.join(sizes, ["t", "key"]).withColumn("c", chunk)
             .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .select("t", "key", F.least("c", "x").alias("u"), F.greatest("c", "x").alias("v"), "fp"))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.repartition(n, "t", "key", "u", "v").sortWithinPartitions("t", "key", "u", "v")

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def found(values: np.ndarray):
            a, b = unit_links(values.view(np.uint64), radius)
            return a.view(np.int64), b.view(np.int64)

        held_key, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            fps = batch.column(4).to_numpy(zero_copy_only=False)
            if not len(fps):
                continue
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), len(fps)]
            out = []
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(keys[:, lo])
                if key != held_key:
                    if held:
                        out.append(found(np.concatenate(held)))
                    held_key, held = key, []
                held.append(fps[lo:hi])
            yield pa.RecordBatch.from_pydict({c: pa.array(np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64))
                                              for i, c in enumerate(("a", "b"))})
        if held:
            a, b = found(np.concatenate(held))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

    return units.mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3,
                    radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id, keep_fp per row of ``docs``; component_id is
    the smallest id reachable over links, keep_fp a fingerprint that it has."""
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"),
                                   fingerprints(F.col(text_col), words_per_shingle).alias("fp")), "simhash-rows")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = materialize(components(links(distinct, radius), "simhash-links"), "simhash-roots")
    member = (distinct.join(roots, distinct["fp"] == roots["node"], "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    low = member.groupBy("root").agg(
        F.min(F.when(F.col("first_id").isNotNull(), F.struct("first_id", "fp"))).alias("low"), F.min("fp").alias("any_fp"))
    classes = member.join(low, "root").select(
        "fp", F.col("low.first_id").alias("component_id"), F.coalesce(F.col("low.fp"), F.col("any_fp")).alias("keep_fp"))
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id", "keep_fp")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id, all
    columns kept; of rows that share id and fingerprint, the smallest by their
    other columns. Texts are fingerprinted again only where rows share an id."""
    x = free_prefix(docs)
    found = near_duplicates(docs, id_col, text_col, **options)
    kept = (found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("keep_fp")))
            .select(F.col("doc_id").alias(f"{x}keep_id"), F.col("fp").alias(f"{x}fp")).distinct())
    rows = found.groupBy("doc_id").agg(F.count("*").alias(f"{x}rows")).withColumnRenamed("doc_id", f"{x}row_id")
    kept = kept.join(rows, F.col(f"{x}keep_id").eqNullSafe(F.col(f"{x}row_id"))).drop(f"{x}row_id")
    joined = docs.withColumn(f"{x}id", F.col(id_col)).join(kept, F.col(f"{x}id").eqNullSafe(F.col(f"{x}keep_id")))
    own = fingerprints(F.when(F.col(f"{x}rows") > 1, F.col(text_col)), options.get("words_per_shingle", 3))
    left = joined.withColumn(f"{x}own", own).filter((F.col(f"{x}rows") == 1) | (F.col(f"{x}own") == F.col(f"{x}fp")))
    left = left.drop(f"{x}keep_id", f"{x}rows", f"{x}own")
    return one_of_each(left, [f"{x}id", f"{x}fp"], text_col).select(*[F.col(f"`{c}`") for c in docs.columns])
