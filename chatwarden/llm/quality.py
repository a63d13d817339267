"""Quality classifier: Naive Bayes support vectors (operator 3).

Features are indicators of n-grams of a whole text: pairs and (hashed) triples
of bytes, and runs of one word. Each is scaled by the log of the ratio of its
share in the two classes, counted over all texts that may be learnt from. A
linear model with hinge loss is fitted by dual coordinate descent on a bounded
sample (``SAMPLE`` texts of each class), in one task, and its margins become
scores by a logistic curve fitted on texts that the descent has not seen.

Only the text goes into a score. Defined cases: a NULL or empty text has no
features and gets the score of margin ``b``; repeated rows get one score;
without labels of both classes every score is the share of class 1 among them
(0.5 without any); an empty table gives an empty result; input columns with the
name of an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from chatwarden.llm.common import expanded, fields, labelled_texts, map_texts, platt, sample_per_class, sigmoid
from chatwarden.llm.words import SPACED, blocks, find_words

SAMPLE = 2000
_TRIPLE_BITS = 17
_PAIRS, _TRIPLES = 1 << 16, 1 << _TRIPLE_BITS
_RUNS = (2, 3, 4, 8, 16)
DIM = _PAIRS + _TRIPLES + len(_RUNS)
_C = 1.0
_EPOCHS = 12


def indicators(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted features of each text."""
    seen = np.zeros(DIM, bool)
    found = find_words(texts, SPACED, lower=False)
    longest = _longest_runs(found)
    out = []
    for text, run in zip(texts, longest):
        raw = np.frombuffer(text, np.uint8).astype(np.uint32)
        if len(raw) > 1:
            pairs = raw[:-1] << 8 | raw[1:]
            seen[pairs] = True
            triples = (pairs[:-1] << 8 | raw[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - _TRIPLE_BITS)
            seen[triples + np.uint32(_PAIRS)] = True
        for i, least in enumerate(_RUNS):
            seen[_PAIRS + _TRIPLES + i] = run >= least
        at = np.flatnonzero(seen).astype(np.int32)
        seen[at] = False
        out.append(at)
    return out


def _longest_runs(found) -> np.ndarray:
    """The longest run of one word in each text."""
    n = len(found.first) - 1
    out = np.zeros(n, np.int64)
    if len(found.hash):
        text = found.text_of_word()
        new = np.ones(len(text), bool)
        new[1:] = (found.hash[1:] != found.hash[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        np.maximum.at(out, text[first], np.diff(np.append(first, len(text))))
    return out


@dataclass
class Model:
    weights: np.ndarray  # log ratio times the linear model's weight, per feature
    ratios: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, at: np.ndarray) -> float:
        if not len(at):
            return self.bias
        norm = np.sqrt((self.ratios[at] ** 2).sum()) or 1.0
        return float(self.weights[at].sum() / norm) + self.bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.a * np.array([self.margin(at) for at in indicators(texts)]) + self.b)


def log_ratios(rows: DataFrame) -> np.ndarray:
    """Log of the ratio of each feature's share in class 1 and in class 0, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, DIM), np.int64)
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for at, texts in blocks(expanded(batch.column(0))):
                for label, features in zip(labels[at:], indicators(texts)):
                    counts[label, features] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["feature", "n0", "n1"]
        )

    schema = fields(feature=T.LongType(), n0=T.LongType(), n1=T.LongType())
    sums = rows.select("text", "label").mapInArrow(run, schema).groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = np.ones((2, DIM))
    for row in sums.toLocalIterator():  # at most DIM rows
        counts[:, row.feature] += (row.n0, row.n1)
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray, c: float = _C, epochs: int = _EPOCHS):
    """Weights and bias of a linear model with hinge loss; a row is scaled to length 1."""
    scaled = []
    for at in rows:
        x = ratios[at]
        scaled.append(x / (np.sqrt((x * x).sum()) or 1.0))
    alpha, weights, bias = np.zeros(len(rows)), np.zeros(len(ratios)), 0.0
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i], scaled[i], signs[i]
            gradient = y * (weights[at] @ x + bias) - 1
            square = (1.0 if len(at) else 0.0) + 1.0  # the bias is a feature of 1
            new = min(max(alpha[i] - gradient / square, 0.0), c)
            step = (new - alpha[i]) * y
            if step:
                alpha[i] = new
                weights[at] += step * x
                bias += step
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    rows = labelled_texts(docs, labels, label, doc_id, text)
    shares = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(shares) < 2:
        even = (shares.get(1, 0) + 1e-9) / (sum(shares.values()) + 2e-9)
        return Model(np.zeros(DIM), np.zeros(DIM), 0.0, 1.0, float(np.log(max(even, 1e-9) / max(1 - even, 1e-9))))
    ratios = log_ratios(rows)
    sent = rows.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, signs = [], []
        for batch in batches:
            order = batch.column(1).to_numpy()
            for at, texts in blocks(expanded(batch.column(0))):
                features.extend(indicators(texts))
                signs.extend((2 * order[at : at + len(texts)] - 1).tolist())
        signs = np.array(signs, float)
        unseen = np.arange(len(signs)) % 5 == 0  # for the curve
        seen = [f for f, u in zip(features, unseen) if not u]
        weights, bias = dual_coordinate_descent(seen, signs[~unseen], sent.value)
        model = Model(weights * sent.value, sent.value, bias, 1.0, 0.0)
        margins = np.array([model.margin(f) for f, u in zip(features, unseen) if u])
        a, b = platt(margins, (signs[unseen] > 0).astype(int))
        data = np.concatenate([model.weights, [bias, a, b]])
        yield pa.RecordBatch.from_arrays([pa.array([data.tobytes()], pa.binary())], names=["model"])

    chosen = sample_per_class(rows, sample).select("text", "label", "id")
    fitted = chosen.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").mapInArrow(run, fields(model=T.BinaryType()))
    data = np.frombuffer(fitted.first().model)
    return Model(data[:DIM], ratios, *(float(x) for x in data[DIM:]))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds ``score`` and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def work(texts: list[bytes]):
        scores = Model(**sent.value).score(texts)
        return scores, (scores >= threshold).astype(np.int32)

    return map_texts(docs, text, fields(score=T.DoubleType(), predicted=T.IntegerType()), work)
