"""Toxicity: toxic spans by a linear-chain conditional random field (operator 6).

Labels are given for documents, so tokens are labelled first: over all texts
that may be learnt from, features of words (the word, its first four and five
bytes) are counted by class, and those that stand out in toxic texts mark the
tokens that have them there. A field with two states is then fitted on a
bounded sample (``SAMPLE`` texts of each class) of such token sequences, in one
task. Forward-backward marginals of the tokens make the score of a document,
and tokens that are more likely toxic than not are its spans.

Only tokens with one of the field's features differ from each other for the
field. Runs of others are taken in one step, by a power of the 2 x 2 matrix of
a step, so the marginals are exact for whole texts of any length.

Words are lower-cased (A-Z) runs of digits, letters and everything beyond
ASCII. Defined cases: a NULL or empty text has no tokens, no spans and the
lowest score; repeated rows get one score; without labels of both classes no
token is toxic and all scores are the same, below 0.5; an empty table gives an
empty result; input columns with the name of an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from chatwarden.session import small_batches
from chatwarden.llm.common import expanded, fields, labelled_texts, map_batches, map_texts, platt, sample_per_class, sigmoid
from chatwarden.llm.words import ALNUM, Words, blocks, find_words, mix

SAMPLE = 1500
#: The strongest features that a field can have, 16 bytes each; the only ones that reach the driver.
FEATURES = 1 << 20
_PRECISION = 0.92
_STRENGTH = 30.0  # least log-likelihood ratio
_TOGETHER = 4  # blocks whose counts are added up before they leave a task
_PREFIXES = (0, 4, 5)  # 0: the whole word
_STEPS, _RATE, _DECAY = 120, 0.3, 1e-3
#: Weights that all tokens share; their slopes are taken by a difference of this size.
SHARED, _NUDGE = ("bias", "into", "out", "stay"), 1e-4


def token_features(found: Words) -> np.ndarray:
    """A 64-bit hash of each feature of each token: (features, tokens)."""
    rows = []
    for k in _PREFIXES:
        part = found.hash if k == 0 else found.prefix_hash(k)
        rows.append(mix(part + np.uint64(k + 1)))
    return np.stack(rows)


def _distinct_per_text(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) once for each text that has the feature."""
    features = token_features(found)
    text = np.broadcast_to(found.text_of_word(), features.shape)
    features, text = features.ravel(), text.ravel()
    order = np.lexsort((features, text))
    features, text = features[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (features[1:] != features[:-1]) | (text[1:] != text[:-1])
    return text[new], features[new]


def _summed(keys: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, with the sums of its numbers."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, *(np.bincount(place, n, len(distinct)).astype(np.int64) for n in numbers)


def _counts(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys, n0, n1 = _summed(*map(np.concatenate, zip(*held)))
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n0), pa.array(n1)], names=["f", "n0", "n1"])


def _places(features: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of features in a sorted table, and which are there."""
    if not len(table):
        return np.zeros(features.shape, np.int64), np.zeros(features.shape, bool)
    place = np.minimum(np.searchsorted(table, features), len(table) - 1)
    return place, table[place] == features


def toxic_features(rows: DataFrame, n_toxic: int, n_clean: int) -> np.ndarray:
    """Sorted hashes of the features that stand out in toxic texts, counted over all rows.

    Every feature is judged where its counts are, however rare it is; only those
    that stand out reach the driver, the ``FEATURES`` strongest of them at most."""

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for at, texts in blocks(expanded(batch.column(0))):
                text, features = _distinct_per_text(find_words(texts, ALNUM, lower=True))
                toxic = (labels[at + text] == 1).astype(np.int64)
                held.append(_summed(features, 1 - toxic, toxic))
                if len(held) == _TOGETHER:
                    yield _counts(held)
                    held = []
        if held:
            yield _counts(held)

    counted = map_batches(rows.select("text", "label"), by_class, fields(f=T.LongType(), n0=T.LongType(), n1=T.LongType()))
    clean, toxic = F.col("n0"), F.col("n1")
    # Shares of the classes are set against each other, as the classes differ in size.
    precise = toxic / n_toxic >= _PRECISION / (1 - _PRECISION) * (clean / n_clean)
    expected = (toxic + clean) / (n_toxic + n_clean)
    part = lambda n, of: F.when(n > 0, n * F.log(n / F.greatest(expected * of, F.lit(1e-12)))).otherwise(0.0)
    strength = 2 * (part(toxic, n_toxic) + part(clean, n_clean))
    found = counted.groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = found.where((toxic > 0) & precise & (strength >= _STRENGTH))
    found = found.orderBy(F.desc(strength), "f").limit(FEATURES).select("f")
    return np.sort(np.fromiter((r.f for r in found.toLocalIterator()), np.int64).view(np.uint64))


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of many 2 x 2 matrices."""
    return x[:, 0, None] * y[None, 0] + x[:, 1, None] * y[None, 1]


def _apply(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Products of many 2 x 2 matrices and vectors."""
    return x[:, 0] * v[0] + x[:, 1] * v[1]


@dataclass
class Field:
    """Two states, 0 and 1 (toxic); a text starts from state 0. ``into, out, stay`` are the
    weights of the steps 0-1, 1-0 and 1-1, ``bias`` that of state 1."""

    features: np.ndarray
    weights: np.ndarray
    bias: float = -3.0
    into: float = -1.0
    out: float = 0.0
    stay: float = 0.0
    a: float = 1.0
    b: float = 0.0

    def _step(self) -> np.ndarray:
        return np.exp(np.array([[0.0, self.into], [self.out, self.stay]]))

    def chains(self, found: Words) -> "Chains":
        """The tokens with features of each text, with the places between them."""
        place, hit = _places(token_features(found), self.features)
        at = np.flatnonzero(hit.any(axis=0))
        return Chains(found, at, place[:, at], hit[:, at])

    def _moves(self, c: "Chains") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The 2 x 2 matrix of each token with the neutral ones before it, (2, 2, tokens); the vector
        after the last token of each text, (2, texts); the log of the scale of the neutral tokens."""
        step = self._step()
        values, vectors = np.linalg.eig(step * np.exp([0.0, self.bias]))
        order = np.argsort(-values.real)
        values, vectors = values.real[order], vectors.real[:, order]
        inverse = np.linalg.inv(vectors)
        large, little = (vectors[:, i : i + 1] * inverse[i : i + 1, :] for i in (0, 1))

        def power(n: np.ndarray) -> np.ndarray:  # scaled by the largest value's power
            small = (values[1] / values[0]) ** np.minimum(n, 1 << 20)
            return large[:, :, None] + small * little[:, :, None]

        emission = np.minimum(np.exp(self.bias + (self.weights[c.place] * c.hit).sum(axis=0)), 1e30)
        move = _times(power(c.gap), step[:, :, None])
        move[:, 1] *= emission
        return move, power(c.tail).sum(axis=1), c.n_neutral * np.log(values[0])

    def marginals(self, c: "Chains", slopes: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(probability of state 1 of each token of the chains, log of the normaliser per text;
        with ``slopes`` the derivatives of the sum of those logs by the ``SHARED`` weights instead)."""
        move, tail, neutral = self._moves(c)
        product, log = c.products(move)
        alpha = product[0]  # a text starts from state 0
        back, _ = c.products(move, backward=True)
        beta = tail[:, c.text]
        inner = np.flatnonzero(c.rank_from_end > 0)
        beta[:, inner] = _apply(back[:, :, inner + 1], beta[:, inner])
        both = alpha * beta
        p = both[1] / np.maximum(both.sum(axis=0), 1e-300)
        end = np.tile([[1.0], [0.0]], (1, c.n_texts))
        end[:, c.last_text] = alpha[:, c.last]
        total = (end * tail).sum(axis=0)
        if not slopes:
            log_norm = neutral + np.log(np.maximum(total, 1e-300))
            log_norm[c.last_text] += log[c.last]
            return p, log_norm
        before = np.tile([[1.0], [0.0]], (1, len(p)))
        later = np.flatnonzero(c.rank > 0)
        before[:, later] = alpha[:, later - 1]
        whole = (before * _apply(move, beta)).sum(axis=0)
        found = np.zeros(len(SHARED))
        for i, name in enumerate(SHARED):
            moved, ends, steps = Field(**{**vars(self), name: getattr(self, name) + _NUDGE})._moves(c)
            change = ((before * _apply(moved, beta)).sum(axis=0) / whole - 1).sum()
            change += ((end * ends).sum(axis=0) / total - 1).sum() + (steps - neutral).sum()
            found[i] = change / _NUDGE
        return p, found

    def evidence(self, c: "Chains") -> tuple[np.ndarray, np.ndarray]:
        """(log-odds that any token of the text is toxic, the tokens' marginals)."""
        p, _ = self.marginals(c)
        none = np.zeros(c.n_texts)
        np.add.at(none, c.text, np.log1p(-np.minimum(p, 1 - 1e-6)))
        some = np.clip(-np.expm1(none), 1e-6, 1 - 1e-6)
        return np.log(some / (1 - some)), p


class Chains:
    def __init__(self, found: Words, at: np.ndarray, place: np.ndarray, hit: np.ndarray):
        self.at, self.place, self.hit = at, place, hit
        self.n_texts = len(found.first) - 1
        self.text = np.searchsorted(found.first, at, "right") - 1
        sizes = np.diff(found.first)
        begin = found.first[:-1][self.text]
        previous = np.concatenate([[-1], at[:-1]])
        new = np.ones(len(at), bool)
        new[1:] = self.text[1:] != self.text[:-1]
        self.gap = np.where(new, at - begin, at - previous - 1)
        counts = np.bincount(self.text, minlength=self.n_texts)
        last = np.full(self.n_texts, -1)
        last[self.text] = at - begin  # the last of each text is written last
        self.tail = sizes - 1 - last
        self.n_neutral = (sizes - counts).astype(float)
        self.rank = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(at) else at
        self.rank_from_end = counts[self.text] - 1 - self.rank
        self.longest = int(counts.max()) if len(at) else 0
        self.last = np.flatnonzero(self.rank_from_end == 0)
        self.last_text = self.text[self.last]

    def products(self, move: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Products of the matrices of a text up to each token (``backward``: from each token
        on), scaled, and the logs of the scales. Spans double: a text of n tokens takes log2(n) steps."""
        product, log = move.copy(), np.zeros(len(self.at))
        rank, side = (self.rank_from_end, 1) if backward else (self.rank, -1)
        span = 1
        while span < self.longest:
            here = np.flatnonzero(rank >= span)
            there = here + side * span
            left, right = (here, there) if backward else (there, here)
            joined = _times(product[:, :, left], product[:, :, right])
            scale = joined.sum(axis=(0, 1))
            log[here] = log[left] + log[right] + np.log(scale)
            product[:, :, here] = joined / scale
            span *= 2
        return product, log


def fit(texts: list[bytes], labels: np.ndarray, features: np.ndarray) -> Field:
    """Gradient ascent on the likelihood of the token labels; the curve of the score last."""
    field = Field(features, np.zeros(len(features)))
    parts = []
    for at, block in blocks(texts):
        found = find_words(block, ALNUM, lower=True)
        c = field.chains(found)
        toxic = labels[at + c.text] == 1
        parts.append((c, toxic, labels[at : at + len(block)]))
    gold = np.zeros(len(SHARED))  # how often the labels take each of the shared weights
    n_texts = sum(c.n_texts for c, _, _ in parts) or 1
    for c, toxic, _ in parts:
        after_toxic = np.zeros(len(toxic), bool)
        after_toxic[1:] = toxic[:-1] & (c.gap[1:] == 0) & (c.text[1:] == c.text[:-1])
        stays = (toxic & after_toxic).sum()
        ends_text = np.zeros(len(toxic), bool)
        if len(toxic):
            is_last = np.append(c.text[1:] != c.text[:-1], True)
            ends_text = is_last & (c.tail[c.text] == 0)
        gold += (toxic.sum(), toxic.sum() - stays, toxic.sum() - stays - (toxic & ends_text).sum(), stays)
    squares = np.full(len(features), 1e-6), np.full(len(SHARED), 1e-6)
    for _ in range(_STEPS):
        gradient = -_DECAY * n_texts * field.weights
        expected = np.zeros(len(SHARED))
        for c, toxic, _ in parts:
            p, slopes = field.marginals(c, slopes=True)
            expected += slopes
            np.add.at(gradient, c.place[c.hit], np.broadcast_to(toxic - p, c.hit.shape)[c.hit])
        shared = gold - expected - _DECAY * n_texts * np.array([getattr(field, n) for n in SHARED])
        for s, g in zip(squares, (gradient, shared)):
            s += (g / n_texts) ** 2
        field.weights = field.weights + _RATE * gradient / n_texts / np.sqrt(squares[0])
        for name, move in zip(SHARED, _RATE * shared / n_texts / np.sqrt(squares[1])):
            setattr(field, name, float(np.clip(getattr(field, name) + move, -12, 6)))
    evidence = np.concatenate([field.evidence(c)[0] for c, _, _ in parts]) if parts else np.zeros(0)
    field.a, field.b = platt(evidence, np.concatenate([y for _, _, y in parts]) if parts else np.zeros(0, int))
    return field


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Field:
    small_batches(docs.sparkSession)
    rows = labelled_texts(docs, labels, label, doc_id, text)
    shares = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(shares) < 2:
        return Field(np.zeros(0, np.uint64), np.zeros(0), b=-3.0)
    features = toxic_features(rows, shares[1], shares[0])
    sent = rows.sparkSession.sparkContext.broadcast(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts.extend(expanded(batch.column(0)))
            marks.append(batch.column(1).to_numpy())
        field = fit(texts, np.concatenate(marks) if marks else np.zeros(0, int), sent.value)
        shared = [field.bias, field.into, field.out, field.stay, field.a, field.b]
        data = np.concatenate([shared, field.weights]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["model"])

    chosen = sample_per_class(rows, sample).select("text", "label", "id")
    chosen = chosen.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id")
    fitted = map_batches(chosen, run, fields(model=T.BinaryType()))
    data = np.frombuffer(fitted.first().model)
    return Field(features, data[6:], *(float(x) for x in data[:6]))


def score(docs: DataFrame, field: Field, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds ``score``, ``predicted`` and ``toxic_spans`` (start:end in code points, comma-joined)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vars(field))

    def work(texts: list[bytes]):
        field = Field(**sent.value)
        found = find_words(texts, ALNUM, lower=True)
        c = field.chains(found)
        evidence, p = field.evidence(c)
        scores = sigmoid(field.a * evidence + field.b)
        spans: list[list[str]] = [[] for _ in texts]
        toxic = np.flatnonzero(p >= 0.5)
        for at, text in zip(c.at[toxic].tolist(), c.text[toxic].tolist()):
            begin = found.offset[text]
            start, end = found.start[at] - begin, found.end[at] - begin
            before = len(texts[text][:start].decode())
            spans[text].append(f"{before}:{before + len(texts[text][start:end].decode())}")
        return scores, (scores >= threshold).astype(np.int32), [",".join(s) for s in spans]

    added = fields(score=T.DoubleType(), predicted=T.IntegerType(), toxic_spans=T.StringType())
    return map_texts(docs, text, added, work)
