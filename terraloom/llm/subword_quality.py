"""Quality classifier: supervised subword embeddings.

Words, word pairs and the character n-grams of words are hashed into buckets; every bucket has a learned vector, a document is the
mean of the vectors of its features, and a softmax layer turns it into the probability of label 1. Vectors and layer are trained
together by stochastic gradient descent in numpy with a decaying rate. As the layer is linear, a trained model scores a text by the
mean over its features of one number per bucket.

Training uses a bounded sample of at most ``PER_CLASS`` documents of each label, chosen by a hash of the text; the loss is weighted
back to the labels' true shares, so scores are probabilities of the corpus. Prediction reads every whole text and nothing else.

Defined cases: null and empty texts have no feature but the constant one and get the score that goes with it; rows without a
label are not learned from; several labels of a document count as several rows; with labels of one class only the score is that class;
without labels it is 0.5; repeated rows get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terraloom.llm.common import SpanHash, hash_sample, held_out, mixed, slices, utf8, word_bounds

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
DIM = 8
PER_CLASS = 2500
EPOCHS = 4
RATE = 0.5
CUT = 0.7
CONSTANT, TWICE = 0, 1  # a bucket that every document holds once, and that of a word which follows itself


def features(text: str | None) -> np.ndarray:
    """The buckets of all features of one whole text, repeats included.

    Words, pairs of neighbouring words (a word followed by itself is one bucket, whatever the word), n-grams inside words.
    """
    found = [np.array([CONSTANT])]
    raw = utf8(text)
    start, stop = word_bounds(raw)
    if len(start):
        shift = np.uint64(64 - BUCKETS.bit_length() + 1)
        words = SpanHash(raw)(start, stop)
        pairs = mixed(words[:-1] * np.uint64(3) + words[1:]) >> shift
        pairs[words[:-1] == words[1:]] = TWICE
        found += [(words >> shift).astype(np.int64), pairs.astype(np.int64)]
        # n-grams of bytes inside words, with a sign for the borders
        flat = raw.astype(np.uint32)
        flat[(raw == 32) | ((raw >= 9) & (raw <= 13))] = 1
        flat = np.concatenate([[np.uint32(1)], flat, [np.uint32(1)]])
        crossed = np.concatenate([[0], np.cumsum(flat == 1)])
        value = np.zeros(len(flat), dtype=np.uint32)
        done = 0
        for order in GRAMS:
            if len(flat) < order:
                break
            for k in range(done, order):
                value = value[: len(flat) - k] * np.uint32(0x01000193) + flat[k:] + np.uint32(1)
            done = order
            inner = crossed[order - 1 : -1] == crossed[1 : len(flat) - order + 2]  # no border strictly inside
            found.append(((value[inner] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64))
    return np.concatenate(found)


@dataclass
class QualityModel:
    """``value`` has, for each bucket, the difference of the two output logits that its vector makes."""

    value: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.value[features(text)].mean() + self.bias, -40, 40))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> QualityModel:
    """Stochastic gradient descent over (buckets, shares) rows; every row's step touches only its own buckets' vectors."""
    if not len(labels):
        return QualityModel(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / dim, 1.0 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)).tolist():
            buckets, shares = rows[i]
            lr = rate * (1.0 - done / steps)
            done += 1
            hidden = shares @ vectors[buckets]
            logits = layer @ hidden + bias
            odds = np.exp(logits - logits.max())
            slope = odds / odds.sum()
            slope[labels[i]] -= 1.0
            slope *= np.float32(lr * weights[i])
            back = slope @ layer
            layer -= np.outer(slope, hidden)
            bias -= slope
            # plain averages would hardly move a bucket of a long text: its share is scaled to the root
            vectors[buckets] -= np.sqrt(shares)[:, None] * back[None, :]
    difference = layer[1] - layer[0]
    return QualityModel((vectors @ difference).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, **options) -> QualityModel:
    """Fit on a bounded sample of labelled documents; features are counted on the executors."""
    known = labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    sample = hash_sample(known.distinct().withColumn("order", F.xxhash64("doc_id")), "label", "order", per_class)
    share = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "label")), "doc_id")
    # repeated rows, and texts that share an id, count once: 2 * per_class rows at most
    rows = found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        for b in slices(batches):
            buckets, weights = [], []
            for text in b.column("text").to_pylist():
                found, counts = np.unique(features(text), return_counts=True)
                buckets.append(found.astype(np.int32))
                weights.append((counts / counts.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array([x.tobytes() for x in buckets], pa.binary()), pa.array([x.tobytes() for x in weights], pa.binary())],
                ["doc_id", "label", "buckets", "shares"],
            )

    found = rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, buckets binary, shares binary")
    found = sorted(found.collect(), key=lambda r: (r["doc_id"], r["label"], bytes(r["buckets"]), bytes(r["shares"])))
    target = np.array([r["label"] for r in found], dtype=np.int64)
    seen = np.bincount(target, minlength=2) if len(target) else np.zeros(2)
    total = sum(share.values()) or 1
    weight = {k: (share.get(k, 0) / total) / (seen[k] / len(target)) for k in (0, 1) if len(target) and seen[k]}
    data = [(np.frombuffer(r["buckets"], dtype=np.int32), np.frombuffer(r["shares"], dtype=np.float32)) for r in found]
    return fit(data, target, np.array([weight[k] for k in target.tolist()], dtype=np.float32), **options)


def predict(docs: DataFrame, model: QualityModel, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches):
            scores = np.array([shared.value.score(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(scores), pa.array((scores >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels of documents that are not held out, score all documents."""
    return predict(docs, train(docs, labels.filter(~held_out())))
