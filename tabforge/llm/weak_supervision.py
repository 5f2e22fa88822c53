"""Toxicity by weak supervision.

1. Voters. A lexicon of common insults, word and word-stem voters induced from
   labelled rows (those that mark toxic rows and next to no other), and
   patterns (shouting, exclamation runs, masked words, direct address).
   A voter says "toxic" or abstains.
2. Label model. The vote sets of all documents are counted once. Expectation
   maximisation over those counts estimates the class balance, each voter's
   rate in either class and, from the same posteriors, the pairwise
   correlations within the toxic class; a vote's evidence is divided by the
   number of correlated votes beside it, so a word and its own stem do not
   count twice.
3. Classifier. A logistic regression on words, word stems and pattern votes is
   trained on the model's posterior labels of a bounded sample of labelled
   rows, and scores every whole text. A trusted voter (lexicon word, masked
   word) that no row of the sample holds has taught the classifier nothing:
   where one votes, the class balance and the label model's evidence of such
   votes count if they give the higher odds.

Labels are read from training rows only; label, language, source and id are
no input of a score. Bounds of the fit: ``max_rows``, the labelled rows used to
induce voters and to train, and ``max_features``, the classifier's strongest
features of that sample (None: all; with all, rare words fit the noise). All
voters found are used; ``max_voters`` cuts them if given.
The label model holds a square table of its voters, candidates that do not
stand for one already chosen. Votes are counted over all documents, and all
of them are scored.

Defined cases: null text counts as empty; an empty text has no features and
gets the score of the bias. Repeated rows get equal scores. Repeated or null
labels: a document is toxic if any of its label rows is 1; null labels are
ignored. A text of any length is read whole and counts once for each feature
that it holds. A null id is held out from training only if its rule says so, and
never joins a label. Without labelled rows the label model's own posterior is
the score. An empty table gives an empty result. Other columns play no part
and may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.llm.common import discard, materialize

MAX_ROWS = 20_000
MAX_FEATURES = 20_000
ROUNDS = 12
LETTERS = re.compile(r"[^\W\d_]+")
# Common insults in the languages of the corpora.
LEXICON = (
    "idiot", "moron", "stupid", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown",
    "dumb", "imbecile", "fool", "garbage", "filth", "vermin", "jerk", "coward", "freak", "hypocrite",
    "arschloch", "blödmann", "drecksack", "dummkopf", "miststück", "schlampe", "trottel", "vollidiot", "vollpfosten", "wichser",
    "abruti", "connard", "connasse", "crétin", "débile", "enculé", "imbécile", "ordure", "salaud", "salope",
    "cabrón", "capullo", "estúpido", "estúpida", "gilipollas", "idiota", "imbécil", "mierda", "pendejo", "zorra")
PATTERNS = {
    "pattern:shouting": re.compile(r"\b[A-Z]{4,}\b.*\b[A-Z]{4,}\b.*\b[A-Z]{4,}\b", re.S),
    "pattern:exclaiming": re.compile(r"!{3,}"),
    "pattern:masked": re.compile(r"\b[A-Za-z][*@#$%]{2,}[A-Za-z]*\b"),
    "pattern:address": re.compile(r"(?i)\byou\s+(?:are|re|'re)\s+(?:a|an|so|such|the)\b"),
}
TRUSTED = (*LEXICON, "pattern:masked")
# What is believed of a voter before any row is read, as rows that it marks (clean, toxic).
BELIEF, TRUST = (0.1, 0.1), (0.005, 0.4)


def features(text: str | None) -> set[str]:
    """The words of a text and the stems of its longer words."""
    words = set(LETTERS.findall((text or "").lower()))
    out = set(words)
    for w in words:
        if len(w) >= 5:
            out.add(w[:4] + "*")
            out.add(w[:5] + "*")
    return out


def pattern_votes(text: str | None, among=PATTERNS) -> set[str]:
    """The patterns, of those ``among``, that a text shows."""
    return {k for k in among if text and PATTERNS[k].search(text)}


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """Scores texts. ``weights``: what the classifier adds to its bias for a
    feature or pattern; ``untaught``: the label model's evidence of voters that
    the classifier never saw, beside log odds ``prior`` of no such vote. Without
    labels there is no classifier (``bias`` None) and all voters are untaught."""

    def __init__(self, bias: float | None, weights: dict[str, float], prior: float, untaught: dict[str, float]):
        self.bias, self.weights, self.prior, self.untaught = bias, weights, prior, untaught

    def log_odds(self, text: str | None) -> float:
        found = features(text)
        found |= pattern_votes(text, [k for k in PATTERNS if k in self.weights or k in self.untaught])
        cast = [self.untaught[f] for f in found if f in self.untaught]
        weak = self.prior + math.fsum(cast)
        if self.bias is None:
            return weak
        z = self.bias + math.fsum([self.weights.get(f, 0.0) for f in found])
        return max(z, weak) if cast else z

    def scorer(self, spark):
        # bounded by the words of max_rows labelled rows
        shared = spark.sparkContext.broadcast((self.bias, self.weights, self.prior, self.untaught))

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            model = Model(*shared.value)
            return pd.Series([1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, model.log_odds(t))))) for t in texts], dtype="float64")

        return score


def _labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """text, toxic of at most ``max_rows`` training rows, chosen by a hash of the id."""
    truth = (labels.select(F.col("doc_id").alias("_l_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter("toxic IS NOT NULL").filter(~is_held_out(F.col("_l_id"))).groupBy("_l_id")
             .agg(F.max("toxic").alias("toxic")))
    chosen = truth.orderBy(F.xxhash64(F.lit("weak"), "_l_id"), "_l_id").limit(max_rows)
    return docs.join(chosen, docs["doc_id"] == chosen["_l_id"]).select("text", "toxic")


def _feature_counts(sample: DataFrame) -> DataFrame:
    """feature, toxic, clean: in how many rows of either label each feature occurs."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[1 if toxic else 0].update(features(text))
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield flush(pa, seen)
        yield flush(pa, seen)

    def flush(pa, seen):
        names = list({**seen[0], **seen[1]})
        out = pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()),
                                          "toxic": pa.array([seen[1][n] for n in names], pa.int64()),
                                          "clean": pa.array([seen[0][n] for n in names], pa.int64())})
        seen[0].clear()
        seen[1].clear()
        return out

    parts = sample.mapInArrow(count, "feature string, toxic long, clean long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _vote_counts(docs: DataFrame, voters: list[str]) -> DataFrame:
    """votes (sorted voter numbers), n: how many documents cast which set of votes."""
    number = {v: i for i, v in enumerate(voters)}

    def vote(batches: Iterator) -> Iterator:
        import pyarrow as pa

        patterns = [v for v in voters if v in PATTERNS]
        words = {v for v in voters if v not in PATTERNS}
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                cast = [number[v] for v in (features(text) & words) | pattern_votes(text, patterns)]
                seen[tuple(sorted(cast))] += 1
            yield pa.RecordBatch.from_pydict({"votes": pa.array([list(k) for k in seen], pa.list_(pa.int32())),
                                              "n": pa.array(list(seen.values()), pa.int64())})

    return docs.select("text").mapInArrow(vote, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n"))


def _posterior(cast: np.ndarray, bias: float, weights: np.ndarray, correlation: np.ndarray) -> float:
    """P(toxic) of one vote set; voters that stand together share their evidence."""
    z = bias
    if len(cast):
        z += float((weights[cast] / (1.0 + correlation[np.ix_(cast, cast)].sum(axis=1))).sum())
    return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def label_model(votes: DataFrame, m: int, prior: float, anchor: np.ndarray, belief: np.ndarray, rounds: int = ROUNDS):
    """(bias, weights, correlation) of the generative model of the votes.

    ``prior`` and ``anchor`` (rate of each voter in clean and in toxic
    rows) start the estimate and make up half of it, which settles what the
    two classes mean; the other half comes from the votes of all documents, to
    which each voter's ``belief`` (clean and toxic rows) is added.

    ``votes``: distinct vote sets with counts. Each round sums posteriors per
    voter and pair of voters over all vote sets, in tasks; at most m * m sums
    come to the driver.
    """
    total = votes.agg(F.sum("n")).first()[0] or 0
    correlation = np.zeros((m, m))
    bias, weights = _log_odds(prior, anchor, correlation)
    for _ in range(rounds if total else 0):
        state = (bias, weights, correlation)

        def sums(batches: Iterator, state=state) -> Iterator:
            import pyarrow as pa

            toxic, every = np.zeros((m + 1, m + 1)), np.zeros((m + 1, m + 1))
            for batch in batches:
                for cast, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    cast = np.array(cast, dtype=np.int64)
                    p = _posterior(cast, *state)
                    cells = np.ix_([*cast, m], [*cast, m])
                    toxic[cells] += n * p
                    every[cells] += n
            i, j = np.nonzero(every)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)),
                                              "t": pa.array(toxic[i, j]), "n": pa.array(every[i, j])})

        toxic, every = np.zeros((m + 1, m + 1)), np.zeros((m + 1, m + 1))
        for r in (votes.select("votes", "n").mapInArrow(sums, "i int, j int, t double, n double")
                  .groupBy("i", "j").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()):
            toxic[r.i, r.j], every[r.i, r.j] = r["t"], r["n"]
        mass = min(max(toxic[m, m], 1e-3), total - 1e-3)
        ones = np.diag(toxic)[:m]
        rates = np.stack([(np.diag(every)[:m] - ones + belief[0]) / (total - mass + 100.0), (ones + belief[1]) / (mass + 20.0)])
        p = ones / mass
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        correlation = np.clip((toxic[:m, :m] / mass - np.outer(p, p)) / np.outer(spread, spread), 0, 1)
        correlation[(correlation < 0.1) | (np.add.outer(ones, ones) < 6)] = 0
        np.fill_diagonal(correlation, 0)
        bias, weights = _log_odds((mass / total + prior) / 2, (rates + anchor) / 2, correlation)
    return bias, weights, correlation


def _log_odds(prior: float, rates: np.ndarray, correlation: np.ndarray):
    """Bias (no votes at all) and weight of each vote; the silence of correlated voters is shared evidence."""
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    rates = np.clip(rates, 1e-6, 1 - 1e-6)
    absent = np.log((1 - rates[1]) / (1 - rates[0])) / (1.0 + correlation.sum(axis=1))
    present = np.log(rates[1] / rates[0])
    return float(np.log(prior / (1 - prior)) + absent.sum()), present - absent


def _votes_for(rows: DataFrame, voters: list[str]) -> np.ndarray:
    """How many rows each voter marks."""
    out = np.zeros(len(voters))
    for r in (_vote_counts(rows, voters).select("n", F.explode("votes").alias("i")).groupBy("i")
              .agg(F.sum("n").alias("n")).collect()):
        out[r.i] = r["n"]
    return out


def _independent(sample: DataFrame, marks: list, most: int | None) -> list:
    """Of the candidate marks, in order, those that do not stand for one already chosen
    (half of the toxic rows of either hold both)."""
    names = [r.feature for r in marks]
    both: dict[tuple[int, int], int] = {}
    for r in (_vote_counts(sample.filter("toxic = 1"), names).filter("size(votes) > 0")
              .select("n", "votes", F.explode("votes").alias("i"))
              .select("n", "i", F.explode("votes").alias("j")).filter("i >= j").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()):
        both[r.i, r.j] = r["n"]
    chosen: list[int] = []
    for i in range(len(names)):
        if most is not None and len(chosen) >= most:
            break
        if all(both.get((i, c), 0) * 2 < min(both.get((i, i), 0), both.get((c, c), 0)) for c in chosen):
            chosen.append(i)
    return [marks[i] for i in chosen]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS,
        max_voters: int | None = None, max_features: int | None = MAX_FEATURES) -> Model:
    """Learn from ``labels`` (doc_id, toxic) of training rows and the votes on all of ``docs``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = materialize(_labelled(docs, labels, max_rows), "weak-sample")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    counts = materialize(_feature_counts(sample), "weak-counts").filter("toxic + clean >= 3")
    marks = (counts.filter("toxic >= 3 AND toxic >= 20 * clean")
             .orderBy(F.col("toxic").desc(), F.length("feature"), "feature").collect())
    marks = _independent(sample, marks, max_voters)
    voters = [*dict.fromkeys([*(r.feature for r in marks), *LEXICON]), *PATTERNS]
    belief = np.array([TRUST if v in TRUSTED else BELIEF for v in voters]).T
    rates, held = np.array([[0.002] * len(voters), [0.01] * len(voters)]), np.zeros(len(voters))
    if n_toxic + n_clean:
        clean, toxic = _votes_for(sample.filter("toxic = 0"), voters), _votes_for(sample.filter("toxic = 1"), voters)
        rates = np.stack([(clean + belief[0]) / (n_clean + 20.0), (toxic + belief[1]) / (n_toxic + 20.0)])
        held = clean + toxic
    votes = materialize(_vote_counts(docs, voters), "weak-votes")
    prior = (n_toxic + 0.5) / (n_toxic + n_clean + 5.0)
    bias, weights, correlation = label_model(votes, len(voters), prior, rates, belief)
    discard(votes)
    by_voter = dict(zip(voters, map(float, weights)))
    if not n_toxic + n_clean:
        return Model(None, {}, bias, by_voter)

    strength = F.abs(F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0)))
    ranked = counts.orderBy((strength * F.sqrt(F.col("toxic") + F.col("clean"))).desc(), "feature")
    vocabulary = [r.feature for r in (ranked if max_features is None else ranked.limit(max_features)).select("feature").collect()]
    vocabulary = [*dict.fromkeys([*vocabulary, *voters])]
    number = {f: i for i, f in enumerate(vocabulary)}
    voter = {v: i for i, v in enumerate(voters)}

    @F.udf(T.StructType([T.StructField("features", VectorUDT()), T.StructField("p", T.DoubleType())]))
    def encoded(text):
        found = features(text) | pattern_votes(text)
        cast = [voter[f] for f in found if f in voter]
        ids = sorted(number[f] for f in found if f in number)
        return Vectors.sparse(len(number), ids, [1.0] * len(ids)), _posterior(np.array(cast, dtype=np.int64), bias, weights, correlation)

    rows = sample.select(encoded("text").alias("e")).select("e.*")
    both = F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")),
                   F.struct(F.lit(0.0).alias("label"), (F.lit(1.0) - F.col("p")).alias("weight")))
    train = materialize(rows.select("features", F.explode(both).alias("b")).select("features", "b.*").filter("weight > 0"),
                        "weak-train")
    fitted = LogisticRegression(weightCol="weight", regParam=2e-5, maxIter=60, standardization=False).fit(train)
    w = fitted.coefficients.toArray()
    discard(train)
    discard(sample)
    untaught = {v: by_voter[v] for v, h in zip(voters, held) if v in TRUSTED and not h}
    return Model(float(fitted.intercept), {f: float(w[i]) for f, i in number.items() if w[i]}, math.log(prior / (1 - prior)), untaught)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    **options) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``."""
    model = fit(docs, labels, id_col, text_col, **options)
    scored = docs.select(F.col(id_col).alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"),
                         model.scorer(docs.sparkSession)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic, all columns kept."""
    model = fit(docs, labels, id_col, text_col)
    return docs.filter(model.scorer(docs.sparkSession)(F.col(text_col)) < 0.5)
