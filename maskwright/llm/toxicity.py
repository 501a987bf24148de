"""Toxicity by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

A feature is the 32-bit hash of a word, of two words in a row or of two words
with one between them, present or absent in the text. Each coordinate has a
learning rate of its own and L1 keeps most weights at zero, so the model is a
short list of hashes and weights, small enough to send with every task. After
McMahan et al., "Ad Click Prediction: a View from the Trenches" (2013).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import batches, bounded_sample, held_out, labelled, shared_checkpoint, unused

#: Labelled rows that a fit looks at, at most; rows in which a feature must be, and how far off; passes over the rows.
SAMPLE, LEAST_ROWS, SCREEN, EPOCHS = 16_000, 3, 3.5, 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.3, 0.0
THRESHOLD = 0.7
WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bits of a hash by which the table of hashes with a weight is looked up first.
FILTER_BITS = 22


def hashed(text: str) -> np.ndarray:
    """The hash of each word, pair and skip-pair of a whole text, repeats included."""
    words = WORDS.findall(text.lower().encode())
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    m = np.uint32
    one = h * m(0x9E3779B1)
    two = (one[:-1] ^ (h[1:] >> m(3))) * m(0x85EBCA6B)
    skip = (one[:-2] ^ (h[2:] >> m(5))) * m(0xC2B2AE35)
    return np.concatenate([one, two, skip])


@dataclass(frozen=True)
class Model:
    """Sorted hashes with their weights, the intercept, and the scale that calibrates the sum."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float = 1.0

    def filter(self) -> np.ndarray:
        table = np.zeros(1 << FILTER_BITS, bool)
        table[self.keys >> np.uint32(32 - FILTER_BITS)] = True
        return table

    def logit(self, text: str, table: np.ndarray) -> float:
        total = 0.0
        if len(self.keys):
            h = hashed(text)
            h = np.unique(h[table[h >> np.uint32(32 - FILTER_BITS)]])
            at = np.searchsorted(self.keys, h)
            at[at == len(self.keys)] = 0
            total = float(self.weights[at[self.keys[at] == h]].sum())
        return self.scale * total + self.bias


def _sigmoid(x: float | np.ndarray) -> float | np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Ftrl:
    """The state of FTRL-proximal over a fixed list of features; the last coordinate is the intercept."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def bias(self) -> float:
        return float(-self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA))

    def logit(self, at: np.ndarray) -> float:
        return float(self.weights(at).sum() + self.bias())

    def learn(self, at: np.ndarray, label: int) -> None:
        g = _sigmoid(self.logit(at)) - label
        for where, w in ((at, self.weights(at)), (slice(-1, None), np.array([self.bias()]))):
            n = self.n[where]
            self.z[where] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
            self.n[where] = n + g * g


def platt(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift that calibrate logits on rows that taught nothing (Platt's targets, Newton's steps)."""
    up, down = labels.sum(), (1 - labels).sum()
    if not up or not down:
        return 1.0, 0.0
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, ab = np.stack([logits, np.ones(len(logits))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ ab)
        grad = x.T @ (p - target) + 1e-3 * (ab - [1.0, 0.0])
        ab = ab - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad).clip(-2, 2)
    return (float(ab[0]), float(ab[1])) if ab[0] > 0.05 and np.isfinite(ab).all() else (1.0, 0.0)


def _features(text: Column) -> Column:
    """Distinct hashes of a text, as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def of(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in batches(column):
            yield pa.array([np.unique(hashed(t)).astype("<u4").tobytes() for t in part], pa.binary())

    return of.asNondeterministic()(text)


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: each hash with the rows and the toxic rows that have it."""
    for part in parts:
        held = [np.frombuffer(f, "<u4") for f in part.column(1).to_pylist()]
        label = np.repeat(part.column(0).to_numpy(), [len(h) for h in held])
        key, at, n = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        up = np.bincount(at, weights=label, minlength=len(key)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n), pa.array(up)], ["f", "n", "up"])


def _placed(features: Column, keys: np.ndarray) -> Column:
    """Places among the sorted keys of the hashes that are there."""

    @F.arrow_udf("binary")
    def of(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in column:
            yield pa.array([np.searchsorted(keys, np.intersect1d(np.frombuffer(h, "<u4"), keys, assume_unique=True)).astype("<u4").tobytes() for h in part.to_pylist()], pa.binary())

    return of.asNondeterministic()(features)


def _trainer(keys: np.ndarray):
    """Rows ``(epoch, label, places, spare)`` in order of epoch.

    All rows teach the model that is given back; a second one, which the spare
    rows don't teach, tells how logits of unseen rows are to be calibrated.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, other, logits, labels = Ftrl(len(keys)), Ftrl(len(keys)), [], []
        for part in parts:
            for epoch, label, places, spare in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                at = np.frombuffer(places, "<u4")
                if epoch > EPOCHS:
                    logits.append(other.logit(at))
                    labels.append(label)
                    continue
                state.learn(at, label)
                if not spare:
                    other.learn(at, label)
        scale, shift = platt(np.array(logits), np.array(labels)) if labels else (1.0, 0.0)
        w = state.weights(slice(0, len(keys)))
        there = np.flatnonzero(w)
        # The intercept and the scale go as rows without a hash.
        yield pa.RecordBatch.from_arrays(
            [pa.array([*keys[there].tolist(), -1, -2], pa.int64()), pa.array([*w[there].tolist(), scale * state.bias() + shift, scale], pa.float64())], ["key", "weight"]
        )

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows, which the hash of their ids picks.

    Rows of the held-out third, and rows without an id or label, teach nothing;
    of rows that repeat an id one teaches; a null text is empty. Without any such
    row all texts score one half. A feature counts if LEAST_ROWS of the sampled
    rows have it and their share of toxic rows is SCREEN standard deviations
    off the mean: most of what is left out is in a few rows by chance, and L1
    alone lets too much of it in (see the README). The one task that learns
    sees a short stream, sorted by Spark.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).filter("__id is not null and label is not null").filter(~held_out(F.col("__id")))
    chosen = bounded_sample(known, F.col("__id"), sample)
    rows = labelled(docs, chosen, id_col, text_col)
    rows = shared_checkpoint(rows.select("__id", "label", _features(F.col("__text")).alias("features")))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("up")).first()
    rate = min(max((whole["up"] or 0) / max(whole["n"], 1), 1e-6), 1 - 1e-6)
    common = rows.select("label", "features").mapInArrow(_counted, "f bigint, n bigint, up bigint").groupBy("f").agg(F.sum("n").alias("n"), F.sum("up").alias("up"))
    off = F.abs(F.col("up") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    common = common.filter((F.col("n") >= LEAST_ROWS) & (off >= SCREEN)).select("f").toArrow()  # fewer than the words of the sample
    keys = np.sort(common.column(0).to_numpy().astype(np.uint32))
    rows = rows.select("__id", "label", _placed(F.col("features"), keys).alias("places"))
    spare = F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(5)) == 0
    epochs = F.sequence(F.lit(1), F.lit(EPOCHS) + spare.cast("int"))
    stream = rows.select(F.explode(epochs).alias("epoch"), "label", "places", spare.alias("spare"), "__id")
    stream = stream.repartition(1).sortWithinPartitions("epoch", F.xxhash64("__id", "epoch"), "__id").select("epoch", "label", "places", "spare")
    made = stream.mapInArrow(_trainer(keys), "key bigint, weight double").toArrow().to_pydict()
    weight = dict(zip(made["key"], made["weight"], strict=True))
    bias, scale = weight.pop(-1, 0.0), weight.pop(-2, 1.0)
    order = sorted(weight)
    return Model(np.array(order, np.uint32), np.array([weight[k] for k in order]), bias, scale)


def score(text: Column, model: Model) -> Column:
    """Probability that a text is toxic; null is the empty text, whose score the intercept gives."""

    @F.arrow_udf("double")
    def of(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = model.filter()
        for part in batches(column):
            yield pa.array([float(_sigmoid(model.logit(t, table))) for t in part], pa.float64())

    return of.asNondeterministic()(text)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Null and empty texts have the score of the intercept. A null id is not held
    out. Repeated rows each get a row; an empty table gives an empty table;
    other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col), model).alias("score"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold.

    Null and empty texts have the score of the intercept. Ids are not read;
    repeated rows are kept or dropped alike; an empty table stays empty; columns
    of any name are carried along.
    """
    (made,) = unused(docs.columns, 1)
    return docs.withColumn(made, score(F.col(f"`{text_col}`"), model)).filter(F.col(made) < threshold).drop(made)
