"""A chain of linear classifiers for categories of text.

The categories stand in a fixed order. The model of each sees the words of a text and the probabilities of the
categories before it. In training these probabilities come from models that have not seen the text (out of fold), so a
later model learns how far it can trust an earlier one.

Words are features, and so are their beginnings, which carry the mark of a word in languages that build long ones. The
features are chosen by their association with a category, counted over all training rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.arrow import map_slices, texts
from footfall.sources.staging import stage

#: Labelled rows to train on, at most; the first by a hash of their id.
TRAINING_ROWS = 20_000
#: Features of a category, training rows that hold one at least, lengths of word beginnings, folds, and regularisation.
FEATURES, LEAST_ROWS, STARTS, FOLDS, PENALTY = 3_000, 3, (4, 5, 6), 3, 0.002
#: Weight of all positive training rows of a category against all others, rounds of a fit, and partitions it works on.
BALANCE, ROUNDS, PARTITIONS = 1.0, 40, 4
#: Words that a task remembers: some 20 MB, as workers that wait for the next stage keep what they once held.
CACHED = 65_536


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STARTS if len(word) >= n)]


class Features:
    """The distinct features of a text, or of those only that are in a vocabulary."""

    def __init__(self, vocabulary: dict[str, int] | None = None):
        self.words, self.vocabulary = re.compile(r"\w+").findall, vocabulary
        self.known: dict[str, tuple] = {}

    def __call__(self, text: str) -> set:
        words, known = set(self.words(text.lower())), self.known
        if len(known) > CACHED:
            known.clear()
        for w in words.difference(known):
            own = word_features(w)
            known[w] = tuple(own if self.vocabulary is None else (self.vocabulary[f] for f in own if f in self.vocabulary))
        return set().union(*map(known.__getitem__, words))


@dataclass
class Chain:
    """A fitted chain: the vocabulary, and for every category its intercept, word weights and weights of the earlier ones."""

    categories: list[str]
    vocabulary: list[str]
    intercepts: list[float] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    earlier: list[np.ndarray] = field(default_factory=list)


def training_rows(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str, text: str, most: int) -> DataFrame:
    """``text, fold`` and a 0/1 column per category. Labels with a null in any category are left out; of several labels of
    one id the largest holds. Equal texts share a fold."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*(F.max(c).alias(c) for c in categories)).dropna()
    known = known.orderBy(F.xxhash64(F.lit(11), id_col), id_col).limit(most)
    known = known.select(F.col(id_col).alias("__id"), *(F.col(c).cast("double").alias(c) for c in categories))
    # At most `most` rows of a few numbers: a bounded table.
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(known), "__id")
    return rows.select("text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), *categories)


def choose_features(rows: DataFrame, categories: list[str], most: int) -> list[str]:
    """For each category the features whose presence says most about it (the G-statistic of their two-by-two table)."""

    def make():
        features, n = Features(), len(categories)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            total: Counter[str] = Counter()
            positive = [Counter() for _ in categories]
            marks = [batch.column(c).to_pylist() for c in categories]
            for i, t in enumerate(texts(batch)):
                own = features(t)
                total.update(own)
                for c in range(n):
                    if marks[c][i]:
                        positive[c].update(own)
            out = {"feature": list(total), "n": list(total.values())}
            return pa.RecordBatch.from_pydict(out | {f"p{c}": [positive[c][f] for f in total] for c in range(n)})

        return work

    shape = "feature string, n long, " + ", ".join(f"p{c} long" for c in range(len(categories)))
    sums = [F.sum(c).alias(c) for c in ("n", *(f"p{c}" for c in range(len(categories))))]
    counts = stage(map_slices(rows, make, shape).groupBy("feature").agg(*sums).where(F.col("n") >= LEAST_ROWS), "features")
    size, *positives = rows.agg(F.count("*"), *(F.sum(c) for c in categories)).first()
    chosen: dict[str, None] = {}
    for c in range(len(categories)):
        here, marked = F.col("n"), F.col(f"p{c}")
        p, q = (positives[c] or 0), size - (positives[c] or 0)
        if not p or not q:
            continue
        cells = [(marked, here * p / size), (here - marked, here * q / size), (p - marked, (size - here) * p / size), (q - here + marked, (size - here) * q / size)]
        g = sum(F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0) for seen, expected in cells)
        best = counts.select("feature", F.round(g, 6).alias("g")).orderBy(F.desc("g"), "feature").limit(most)
        chosen |= dict.fromkeys(r.feature for r in best.collect())
    return list(chosen)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text: str = "text", most: int = TRAINING_ROWS) -> Chain:
    """Fit a chain on at most ``most`` labelled rows. A category whose training rows are all alike, or that has none, gets
    a constant: its share of positive rows (0 without rows)."""
    rows = stage(training_rows(docs, labels, categories, id_col, text, most), "training-texts")
    chain = Chain(categories, choose_features(rows, categories, FEATURES))
    if not chain.vocabulary:
        size, *positives = rows.agg(F.count("*"), *(F.sum(c) for c in categories)).first()
        for i, p in enumerate(positives):
            chain.intercepts.append(_logit((p or 0) / size if size else 0.0))
            chain.weights.append(np.zeros(0))
            chain.earlier.append(np.zeros(i))
        return chain
    vocabulary = {f: i for i, f in enumerate(chain.vocabulary)}

    def make():
        features = Features(vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [[names[i] for i in sorted(features(t))] for t in texts(batch)]
            kept = ["fold", *categories]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string())), *(batch.column(c) for c in kept)], ["own", *kept])

        return work

    names = chain.vocabulary
    shape = "own array<string>, fold int, " + ", ".join(f"{c} double" for c in categories)
    counted = CountVectorizerModel.from_vocabulary(names, "own", "words")
    counted.setBinary(True)
    data = counted.transform(map_slices(rows, make, shape)).drop("own").repartition(PARTITIONS)
    data = stage(data, "training-features")
    for i, category in enumerate(categories):
        inputs = ["words", *(f"__p{j}" for j in range(i))]
        assembled = VectorAssembler(inputCols=inputs, outputCol="__x").transform(data)
        model = _linear(assembled, category)
        beta = np.array(model.coefficients) if model is not None else np.zeros(len(names) + i)
        share = data.agg(F.avg(category)).first()[0]
        chain.intercepts.append(model.intercept if model is not None else _logit(share or 0.0))
        chain.weights.append(beta[: len(names)])
        chain.earlier.append(beta[len(names) :])
        if i + 1 < len(categories):
            parts = []
            for fold in range(FOLDS):
                held = assembled.where(F.col("fold") == fold)
                other = _linear(assembled.where(F.col("fold") != fold), category)
                p = F.lit(share or 0.0)
                if other is not None:
                    held, p = other.transform(held), vector_to_array("probability")[1]
                parts.append(held.withColumn(f"__p{i}", p).select(*data.columns, f"__p{i}"))
            whole = parts[0]
            for part in parts[1:]:
                whole = whole.unionByName(part)
            data = stage(whole, "out-of-fold")
    return chain


def _logit(share: float) -> float:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return float(np.log(share / (1 - share)))


def _linear(data: DataFrame, category: str):
    """A logistic regression, or None if the category is constant in the data."""
    positive, size = data.agg(F.sum(category), F.count("*")).first()
    if not positive or positive == size:
        return None
    weight = F.when(F.col(category) > 0, BALANCE * (size - positive) / positive).otherwise(1.0)
    model = LogisticRegression(
        featuresCol="__x", labelCol=category, weightCol="__w", regParam=PENALTY, standardization=False, maxIter=ROUNDS
    )
    return model.fit(data.withColumn("__w", weight))


def classify(docs: DataFrame, chain: Chain, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``p_<category>`` of every whole text; a null text is an empty one. Other columns are left
    out, and repeated rows give repeated results."""
    vocabulary = {f: i for i, f in enumerate(chain.vocabulary)}
    weights = np.array(chain.weights).reshape(len(chain.categories), -1)
    names = [f"p_{c}" for c in chain.categories]
    keep = [c for c in keep if c not in names]
    read = list(dict.fromkeys([*keep, text]))

    def make():
        features = Features(vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [sorted(features(t)) for t in texts(batch, text)]
            size = np.fromiter(map(len, own), np.int64, len(own))
            flat = np.fromiter((i for one in own for i in one), np.int64, int(size.sum()))
            row = np.repeat(np.arange(len(own)), size)
            earlier = np.zeros((len(own), 0))
            for c, intercept in enumerate(chain.intercepts):
                score = intercept + earlier @ chain.earlier[c]
                if len(flat):
                    score = score + np.bincount(row, weights[c][flat], len(own))
                earlier = np.column_stack([earlier, 1 / (1 + np.exp(-np.clip(score, -500, 500)))])
            columns = [*(batch.column(c) for c in keep), *map(pa.array, earlier.T)]
            return pa.RecordBatch.from_arrays(columns, [*keep, *names])

        return work

    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_slices(docs.select(*read), make, ", ".join([shape, *(f"{n} double" for n in names)]))
