"""Random forest regression on a grid of bins, for tables of few features.

A tree learner of 32 bins a feature (Spark's ``maxBins``) never tells two rows
of the same bins apart: a forest needs, of each grid cell and tree, only the
number of drawn rows and the sum of their labels. Both come from one pass over
the rows, each row drawn Poisson(1) times for every tree as in Spark's learner;
that one looks up the node of every row in every tree again at each level. A
node of a tree is a box of cells, so the trees grow from the sums alone, one
task a tree, by Spark's rules (greatest fall of the variance, the first of equal
ones, no empty child).

The fitted forest is one value a cell, the mean of its trees. A grid with more
cells than rows, or too many cells and trees to add up in a task, has no such
use: then there is no grid forest, and Spark's learner is asked.
"""

import json
import math
from types import SimpleNamespace

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.errors import InvalidParameter
from tabforge.operators.features import FeatureModel

# Tables of up to so many training values are left to Spark's learner.
GRID_FROM = 400_000
BINS, GRID_FEATURES = 32, 16
# Cells times trees that a task adds up at most: 16 bytes each.
GRID_MOST = 8_000_000
# Distinct values of a feature that a part counts one by one; of more, so many shares of its rows.
KEPT_VALUES = 4_096
# Rows drawn for all trees at a time.
DRAWN_ROWS = 4_096


class GridForestModel(FeatureModel):
    """State: the split points of each feature, a value a cell, importances."""

    def _transform(self, df: DataFrame) -> DataFrame:
        import pyarrow as pa

        st = self.feature_state()
        bounds, values = [np.array(b) for b in st["bounds"]], np.array(st["values"])

        @F.arrow_udf("double")
        def predict(features: pa.Array) -> pa.Array:
            return pa.array(values[cells_of(_columns(features, len(bounds)), bounds)])

        (source,), (out,) = self.getOrDefault(self.featureCols), self.getOrDefault(self.outputCols)
        return df.withColumn(out, predict(vector_to_array(F.col(source))))

    @property
    def featureImportances(self):
        return SimpleNamespace(toArray=lambda: np.array(self.feature_state()["importances"]))


def _columns(features, n: int) -> np.ndarray:
    """The feature vectors of a batch, a row a feature."""
    return features.flatten().to_numpy(zero_copy_only=False).reshape(-1, n).T


def cells_of(x: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    """The cell of each row; a value up to a split point is on its left."""
    at = np.zeros(x.shape[1], dtype=np.int64)
    for b, v in zip(bounds, x):
        at = at * (len(b) + 1) + np.searchsorted(b, v)
    return at


def split_points(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> list[float]:
    """Points between neighbouring values: all of up to ``bins`` values, else
    those nearest to equal shares of the rows, as Spark's learner places them."""
    middle = (values[:-1] + values[1:]) / 2
    if len(values) <= bins:
        return middle.tolist()
    upto, stride, out = np.cumsum(counts), counts.sum() / bins, []
    target = stride
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(float(middle[i - 1]))
            target += stride
    return out


def value_counts(x: np.ndarray, kept: int = KEPT_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """The values in order and how often each comes; of more than ``kept``, those
    that close equal shares of the rows, with the rows of their shares."""
    values, counts = np.unique(x, return_counts=True)
    if len(values) <= kept:
        return values, counts
    upto = np.cumsum(counts)
    at = np.unique(np.searchsorted(upto, np.ceil(upto[-1] * np.arange(1, kept + 1) / kept)))
    return values[at], np.diff(upto[at], prepend=0)


def poisson_table() -> tuple[np.ndarray, np.ndarray]:
    """Draws of Poisson(1) by 16 random bits (255: they lie across a step), and the steps."""
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(25)])
    low, high = (np.searchsorted(steps, np.arange(k, 65536 + k) / 65536, side) for k, side in ((0, "right"), (1, "left")))
    return np.where(low == high, low, 255).astype(np.uint8), steps


def poisson_draws(rng: np.random.Generator, shape: tuple[int, int], table: np.ndarray, steps: np.ndarray) -> np.ndarray:
    size = shape[0] * shape[1]
    bits = rng.integers(0, 2 ** 64, -(-size // 4), dtype=np.uint64).view(np.uint16)[:size]
    out = np.take(table, bits, mode="wrap")
    across = np.flatnonzero(out == 255)
    out[across] = np.searchsorted(steps, (bits[across] + rng.random(len(across))) / 65536, "right")
    return out.reshape(shape)


def grow_tree(n: np.ndarray, total: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaf value of each cell and the gain of each feature's splits, from
    the rows and label sums of the cells (arrays with an axis a feature)."""
    leaf, gains = np.empty(n.shape), np.zeros(n.ndim)
    others = [tuple(a for a in range(n.ndim) if a != f) for f in range(n.ndim)]
    stack = [((slice(None),) * n.ndim, 0)]
    while stack:
        box, level = stack.pop()
        rows, sums = n[box], total[box]
        all_rows, all_sums = rows.sum(), sums.sum()
        best, found = 0.0, None
        for f in range(n.ndim) if level < depth else ():
            left, left_sums = rows.sum(axis=others[f]).cumsum()[:-1], sums.sum(axis=others[f]).cumsum()[:-1]
            some = np.flatnonzero((left > 0) & (left < all_rows))
            if not len(some):
                continue
            left, left_sums = left[some], left_sums[some]
            gain = left_sums ** 2 / left + (all_sums - left_sums) ** 2 / (all_rows - left) - all_sums ** 2 / all_rows
            at = int(gain.argmax())
            if gain[at] > best:
                best, found = float(gain[at]), (f, int(some[at]) + 1)
        if found is None:
            leaf[box] = all_sums / all_rows if all_rows else 0.0
            continue
        f, at = found
        gains[f] += best
        start = box[f].start or 0
        stop = n.shape[f] if box[f].stop is None else box[f].stop
        for side in (slice(start, start + at), slice(start + at, stop)):
            stack.append(((*box[:f], side, *box[f + 1:]), level + 1))
    return leaf, gains


def _read(batches, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows of a part: features (a row a feature) and labels."""
    xs, ys = [np.zeros((n_features, 0))], [np.zeros(0)]
    for b in batches:
        xs.append(_columns(b.column("x"), n_features) if "x" in b.schema.names else
                  np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(n_features)]))
        ys.append(b.column("y").to_numpy(zero_copy_only=False))
    return np.concatenate(xs, axis=1), np.concatenate(ys)


def _grid(rows: DataFrame, n_features: int) -> tuple[list[np.ndarray], float]:
    """The split points of each feature over all rows, and the mean label."""
    import pandas as pd
    import pyarrow as pa

    def tell(batches):
        from pyspark import TaskContext

        x, y = _read(batches, n_features)
        if not len(y):
            return
        if not (np.isfinite(x).all() and np.isfinite(y).all()):
            raise InvalidParameter("features and target must be finite numbers")
        # the labels' sum comes as one more feature
        told = [*(value_counts(v) for v in x), (np.array([y.sum()]), np.array([len(y)]))]
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array(range(len(told)), pa.int32()), "part": pa.array([TaskContext.get().partitionId()] * len(told), pa.int32()),
            "v": pa.array([v for v, _ in told], pa.list_(pa.float64())), "n": pa.array([c for _, c in told], pa.list_(pa.int64()))})

    def merge(key: tuple, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("part")
        v, n = np.concatenate(told["v"].to_list()), np.concatenate(told["n"].to_list())
        if key[0] == n_features:
            out = [float(v.sum() / n.sum())]
        else:
            values, at = np.unique(v, return_inverse=True)
            out = split_points(values, np.bincount(at, weights=n))
        return pd.DataFrame({"feature": [key[0]], "points": [out]})

    told = rows.mapInArrow(tell, "feature int, part int, v array<double>, n array<long>")
    found = {r["feature"]: r["points"] for r in told.groupBy("feature").applyInPandas(merge, "feature int, points array<double>").collect()}
    return [np.array(found[f], dtype=float) for f in range(n_features)], found[n_features][0]


def fit_grid_forest(train: DataFrame, features: str, label: str, n_rows: int, n_features: int, trees: int, depth: int,
                    bootstrap: bool, seed: int, plain: DataFrame | None = None) -> GridForestModel | None:
    """The forest, or None where a grid has no use. Rows are drawn by part and
    row order and sums are added in the order of the parts. ``plain``, the features
    as columns and ``y``, saves making vectors to take them apart again."""
    import pandas as pd
    import pyarrow as pa

    attributes = train.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    if n_rows * n_features <= GRID_FROM or n_features > GRID_FEATURES or attributes.keys() & {"nominal", "binary"}:
        return None
    rows = plain if plain is not None else train.select(vector_to_array(F.col(features)).alias("x"), F.col(label).alias("y"))
    bounds, center = _grid(rows, n_features)
    shape = tuple(len(b) + 1 for b in bounds)
    if math.prod(shape) > n_rows or math.prod(shape) * trees > GRID_MOST:
        return None
    table, steps = poisson_table()

    def add_up(batches):
        from pyspark import TaskContext

        x, y = _read(batches, n_features)
        if not len(y):
            return
        part = TaskContext.get().partitionId()
        cell = cells_of(x, bounds)
        order = np.argsort(cell, kind="stable")
        y = y[order] - center
        here, first = np.unique(cell[order], return_index=True)
        counts, sums = np.zeros((len(here), trees)), np.zeros((len(here), trees))
        rng = np.random.Generator(np.random.SFC64([seed % 2 ** 64, part]))
        for a in range(0, len(y), DRAWN_ROWS):
            b = min(a + DRAWN_ROWS, len(y))
            drawn = (poisson_draws(rng, (b - a, trees), table, steps).astype(float) if bootstrap else np.ones((b - a, trees)))
            i, j = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b)
            starts = np.maximum(first[i:j] - a, 0)
            counts[i:j] += np.add.reduceat(drawn, starts, axis=0)
            drawn *= y[a:b, None]
            sums[i:j] += np.add.reduceat(drawn, starts, axis=0)
        for t in range(trees):
            some = np.flatnonzero(counts[:, t])
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([t], pa.int32()), "part": pa.array([part], pa.int32()),
                "cell": pa.array([here[some].astype(np.int32).tobytes()], pa.binary()),
                "n": pa.array([counts[some, t].astype(np.int32).tobytes()], pa.binary()),
                "total": pa.array([sums[some, t].tobytes()], pa.binary())})

    def grow(key: tuple, told: pd.DataFrame) -> pd.DataFrame:
        n, total = np.zeros(math.prod(shape)), np.zeros(math.prod(shape))
        for r in told.sort_values("part").itertuples():
            at = np.frombuffer(r.cell, dtype=np.int32)
            n[at] += np.frombuffer(r.n, dtype=np.int32)
            total[at] += np.frombuffer(r.total)
        leaf, gains = grow_tree(n.reshape(shape), total.reshape(shape), depth)
        return pd.DataFrame({"tree": [key[0]], "leaf": [leaf.tobytes()], "gains": [gains.tolist()]})

    told = rows.mapInArrow(add_up, "tree int, part int, cell binary, n binary, total binary").repartition(trees, "tree")
    grown = told.groupBy("tree").applyInPandas(grow, "tree int, leaf binary, gains array<double>")
    values, importances = np.zeros(math.prod(shape)), np.zeros(n_features)
    for r in sorted(grown.collect(), key=lambda r: r["tree"]):
        gains = np.array(r["gains"])
        values += np.frombuffer(r["leaf"])
        importances += gains / gains.sum() if gains.sum() > 0 else 0.0
    model = GridForestModel()
    model._set(featureCols=[features], outputCols=["prediction"], state=json.dumps({
        "bounds": [b.tolist() for b in bounds], "values": (center + values / trees).tolist(),
        "importances": (importances / max(importances.sum(), 1e-300)).tolist()}))
    return model
