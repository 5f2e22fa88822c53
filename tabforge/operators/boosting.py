"""Gradient boosting of several classes with one joint softmax loss.

Every round fits one regression tree per class to the residuals of the
shared class probabilities (Friedman, 2001), so the classes are learnt
together and the probabilities sum to one by themselves. The trees are Spark
ML's; a leaf's value is its Newton step, from one grouped aggregate over all
trees of the round. Raw scores are a column beside the features: a round adds
one projection, is kept in memory and disk while the next one is made, and
lineage is cut by a checkpoint every ``CHECKPOINT_ROUNDS`` rounds.

The fitted model is a small table of nodes, applied per Arrow batch.
"""

import json
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators.features import FeatureModel
from tabforge.session import checkpoint_dir

CHECKPOINT_ROUNDS = 10
# Trees of a round that are fitted at a time.
PARALLEL_TREES = 4


def tree_nodes(root) -> tuple[list[list], list[tuple[int, float]]]:
    """Nodes in preorder as [feature, threshold, left, right] (a leaf: [-1, leaf
    number, 0, 0]) and the weighted gain of every split."""
    nodes, gains, leaves = [], [], 0
    stack = [(root, None, 0)]
    while stack:
        node, parent, side = stack.pop()
        if parent is not None:
            nodes[parent][side] = len(nodes)
        if node.getClass().getSimpleName() == "LeafNode":
            nodes.append([-1, leaves, 0, 0])
            leaves += 1
            continue
        split, here = node.split(), len(nodes)
        nodes.append([split.featureIndex(), split.threshold(), 0, 0])
        gains.append((split.featureIndex(), node.gain() * node.impurityStats().count()))
        stack += [(node.rightChild(), here, 3), (node.leftChild(), here, 2)]
    return nodes, gains


def leaf_numbers(nodes: list[list], x: np.ndarray) -> np.ndarray:
    """The leaf of each row, all rows a level at a time."""
    table = np.array(nodes, dtype=float)
    feature, left, right = table[:, 0].astype(int), table[:, 2].astype(int), table[:, 3].astype(int)
    at = np.zeros(len(x), dtype=int)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return table[at, 1].astype(int)
        now = at[inner]
        at[inner] = np.where(x[inner, feature[now]] <= table[now, 1], left[now], right[now])


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class SoftmaxBoostingModel(FeatureModel):
    """State: start scores, learning rate, rounds of (nodes, leaf values) a class."""

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        st = self.feature_state()
        raw = np.tile(np.array(st["start"]), (len(x), 1))
        for trees in st["rounds"]:
            for k, (nodes, values) in enumerate(trees):
                raw[:, k] += st["rate"] * np.array(values)[leaf_numbers(nodes, x)]
        return raw

    def _transform(self, df: DataFrame) -> DataFrame:
        import pandas as pd

        scores, classes = self.raw_scores, len(self.feature_state()["start"])

        @F.pandas_udf("array<double>")
        def raw(col: pd.Series) -> pd.Series:
            return pd.Series(list(scores(np.stack(col.to_numpy()) if len(col) else np.zeros((0, 1)))))

        (source,) = self.getOrDefault(self.featureCols)
        out = df.withColumn("__raw", raw(vector_to_array(F.col(source))))
        odds = F.transform("__raw", lambda v: F.exp(v - F.array_max("__raw")))
        total = sum((odds[k] for k in range(1, classes)), odds[0])
        return out.withColumns({
            "rawPrediction": array_to_vector("__raw"), "probability": array_to_vector(F.transform(odds, lambda v: v / total)),
            "prediction": (F.array_position("__raw", F.array_max("__raw")) - 1).cast("double")}).drop("__raw")

    @property
    def featureImportances(self):
        return SimpleNamespace(toArray=lambda: np.array(self.feature_state()["importances"]))


def fit_softmax_boosting(train: DataFrame, features: str, label: str, n_classes: int, n_features: int, rounds: int,
                         rate: float, depth: int, seed: int) -> SoftmaxBoostingModel:
    checkpoint_dir(train.sparkSession)
    # without attributes: every feature is a number to the trees
    cur = train.select(F.col(features).alias("x", metadata={}), F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in cur.groupBy("y").count().collect()}
    total = sum(counts.values())
    start = [float(np.log(max(counts.get(k, 0), 1e-9) / total)) for k in range(n_classes)]
    cur = cur.withColumn("raw", F.array(*[F.lit(v) for v in start]))
    tree = DecisionTreeRegressor(featuresCol="x", maxDepth=depth, seed=seed, leafCol="leaf", predictionCol="p")
    made, importances, held = [], np.zeros(n_features), None
    for m in range(rounds):
        odds = F.transform("raw", lambda v: F.exp(v - F.array_max("raw")))
        share = F.aggregate(odds, F.lit(0.0), lambda a, v: a + v)
        cur = cur.withColumn("res", F.transform(odds, lambda v, k: (F.col("y") == k).cast("double") - v / share))
        cur = cur.persist(StorageLevel.MEMORY_AND_DISK)
        now = cur  # for the threads of this round

        def grow(k: int):
            return tree.copy().setLabelCol("r").fit(now.select("x", F.col("res")[k].alias("r")))

        with ThreadPoolExecutor(min(n_classes, PARALLEL_TREES)) as pool:
            models = list(pool.map(inheritable_thread_target(train.sparkSession)(grow), range(n_classes)))
        grown, leaf = [], cur
        for k, model in enumerate(models):
            nodes, gains = tree_nodes(model._java_obj.rootNode())
            weight = sum(g for _, g in gains)
            for f, g in gains:
                importances[f] += g / weight if weight > 0 else 0.0
            grown.append(nodes)
            leaf = model.transform(leaf).drop("p").withColumnRenamed("leaf", f"leaf{k}")
        # Newton steps of all leaves of the round in one aggregate: at most classes x 2^depth rows
        cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"leaf{k}").cast("int").alias("l"), F.col("res")[k].alias("r"))
                          for k in range(n_classes)])
        size = F.abs("r")
        sums = (leaf.select(F.inline(cells)).groupBy("k", "l")
                .agg(F.sum("r").alias("up"), F.sum(size * (1 - size)).alias("down")).collect())
        values = [[0.0] * sum(n[0] < 0 for n in nodes) for nodes in grown]
        for r in sums:
            if r["down"] > 1e-150:
                values[r["k"]][r["l"]] = (n_classes - 1) / n_classes * r["up"] / r["down"]
        made.append(list(zip(grown, values)))
        steps = [F.element_at(F.array(*[F.lit(rate * v) for v in values[k]]), F.col(f"leaf{k}").cast("int") + 1) for k in range(n_classes)]
        after = leaf.select("x", "y", F.array(*[F.col("raw")[k] + steps[k] for k in range(n_classes)]).alias("raw"))
        if (m + 1) % CHECKPOINT_ROUNDS == 0 and m + 1 < rounds:
            after = after.checkpoint()
        if held is not None:
            held.unpersist()
        held, cur = cur, after
    if held is not None:
        held.unpersist()
    model = SoftmaxBoostingModel()
    model._set(featureCols=[features], outputCols=["prediction"], state=json.dumps({
        "start": start, "rate": rate, "rounds": made, "importances": (importances / max(importances.sum(), 1e-300)).tolist()}))
    return model
