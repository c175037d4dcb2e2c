"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives P, texts without a label the unlabelled U. With a
class prior p, the risk of a classifier on negatives is that on U less p times that on P taken
as negatives; it can't be below zero, so where the estimate falls below, the step goes up
again instead of fitting it further. The classifier is logistic, on the presence of words and
of the beginnings of words.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadmill.llm.folds import held_out, sample

#: The classifier is fitted on about so many texts, and on so many features at most.
MAX_POSITIVE = 3000
MAX_UNLABELLED = 9000
MAX_FEATURES = 60_000
#: A feature must occur in so many sampled positives.
MIN_POSITIVE = 3
#: Texts whose features are spread out at once while the classifier is fitted.
CHUNK_TEXTS = 1000
#: Letters of a word's beginning.
STEM = 5
THRESHOLD = 0.7
#: Words whose features a Python worker remembers.
MAX_WORDS = 400_000

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def _features(word: str) -> tuple[str, ...]:
    w = _EDGES.sub("", word)
    if not w:
        return ()
    return (w, w[:STEM] + "*") if len(w) > STEM else (w,)


class Reader:
    """The features of texts: ids of those in the vocabulary, or the features themselves."""

    def __init__(self, vocabulary: dict[str, int] | None = None):
        self.vocabulary, self.words = vocabulary, {}

    def _word(self, word: str) -> tuple:
        found = _features(word)
        if self.vocabulary is not None:
            found = tuple(self.vocabulary[f] for f in found if f in self.vocabulary)
        if len(self.words) >= MAX_WORDS:
            self.words.clear()
        self.words[word] = found
        return found

    def __call__(self, text: str | None) -> set:
        out, get = set(), self.words.get
        for word in set((text or "").lower().split()):
            found = get(word)
            out.update(self._word(word) if found is None else found)
        return out


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, reader: Reader, text: str | None) -> float:
        z = self.bias + float(sum(self.weights[i] for i in sorted(reader(text))))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], features: int, prior: float
) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with logistic loss."""
    rows = positive + unlabelled
    if not positive or not unlabelled:
        return np.zeros(features), float(np.log(prior / (1 - prior)))
    p = np.arange(len(rows)) < len(positive)
    # Texts go in chunks, so that beside the features' ids only a chunk is ever spread out.
    chunks = []
    for k in range(0, len(rows), CHUNK_TEXTS):
        part = rows[k : k + CHUNK_TEXTS]
        chunks.append((k, np.concatenate(part), np.array([len(r) for r in part])))
    w = np.zeros(features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    z = np.zeros(len(rows))
    for step in range(1, 301):
        for k, at, sizes in chunks:
            row = np.repeat(np.arange(len(sizes)), sizes)
            z[k : k + len(sizes)] = np.bincount(row, w[at], len(sizes)) + w[-1]
        s = 1 / (1 + np.exp(-z))
        # As positives: loss log(1 + exp(-z)); as negatives: log(1 + exp(z)).
        negative = np.logaddexp(0, z)
        risk = negative[~p].mean() - prior * negative[p].mean()
        g = np.where(p, prior * (s - 1) / len(positive), 0.0)
        below = np.where(p, -prior * s / len(positive), s / len(unlabelled))
        g = g + below if risk >= 0 else -below
        grad = np.zeros_like(w)
        for k, at, sizes in chunks:
            grad[:-1] += np.bincount(at, np.repeat(g[k : k + len(sizes)], sizes), features)
        grad[-1] = g.sum()
        grad[:-1] += 2e-5 * w[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> Model:
    """Learn from labels (id_col, toxic) of rows outside the held-out fold.

    The class prior is the share of toxic rows among all labelled ones there. Positives and
    unlabelled texts are bounded samples by a hash; a document with two labels counts as toxic
    if one of them says so, and of rows that share an id one text is taken. Without positives,
    every score is the prior. At most MAX_FEATURES features, the most frequent ones, are learned.
    """
    marks = (
        labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("id"))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    n, toxic = marks.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(0.9, max(0.01, toxic / n)) if n else 0.01
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        ~held_out("id") & F.col("text").isNotNull()
    )
    # Ids choose the samples. They are few, so the texts aren't shuffled to meet them.
    known = marks.select("id")
    ids = docs.select(F.col(id_col).alias("id")).where(~held_out("id"))
    count = ids.join(known, "id", "left_anti").count()
    if count:
        some = sample(ids, MAX_UNLABELLED, count, "id").join(known, "id", "left_anti")
    else:
        # All are labelled: then the fold as a whole serves as the unlabelled texts.
        some = sample(ids, MAX_UNLABELLED, ids.count(), "id")
    toxic_ids = sample(marks.where("toxic = 1"), MAX_POSITIVE, toxic, "id").select("id")
    # One text per id, found with partial minima, so that a repeated id adds nothing to a sample.
    positives, unlabelled = (
        texts.join(F.broadcast(ids_.distinct()), "id").groupBy("id").agg(F.min("text").alias("text"))
        for ids_ in (toxic_ids, some)
    )

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Reader()
        for pdf in batches:
            for text in pdf["text"]:
                yield pd.DataFrame({"feature": sorted(read(text))})

    frequent = (
        positives.select("text")
        .mapInPandas(words, "feature string")
        .groupBy("feature")
        .count()
        .where(F.col("count") >= MIN_POSITIVE)
        .orderBy(F.desc("count"), "feature")
        .limit(MAX_FEATURES)
        .collect()
    )
    vocabulary = {r["feature"]: k for k, r in enumerate(frequent)}

    def indices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Reader(vocabulary)
        for pdf in batches:
            found = [np.array(sorted(read(t)), np.int32).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"x": found})

    def rows(df: DataFrame) -> list[np.ndarray]:
        got = sorted(r.x for r in df.select("text").mapInPandas(indices, "x binary").collect())
        return [np.frombuffer(x, np.int32) for x in got]

    weights, bias = fit(rows(positives), rows(unlabelled), len(vocabulary), prior)
    kept = {f: k for f, k in vocabulary.items() if abs(weights[k]) > 1e-3}
    return Model({f: i for i, f in enumerate(kept)}, weights[list(kept.values())], bias)


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of docs: its id, score (0 to 1) and predicted (1 from THRESHOLD on).

    Null and empty texts get the score of a text without any feature. Whole texts are read;
    other columns are neither read nor carried.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Reader(model.vocabulary)
        for pdf in batches:
            scores = [model.score(read, t) for t in pdf["text"]]
            yield pd.DataFrame(
                {"id": pdf["id"], "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(
        work, f"id {kind}, score double, predicted int"
    )
    return out.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col="text") -> DataFrame:
    """The rows of docs that are not predicted to be toxic, with all their columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(model.vocabulary)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([model.score(read, t) < THRESHOLD for t in texts], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
