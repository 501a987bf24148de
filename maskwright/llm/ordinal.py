"""Quality by ordinal cumulative-link regression on hashed text.

A text is a vector of shares: of its hashed byte triplets, and of words equal
to the word before. One weight vector is shared by all grades; ordered
thresholds turn its value into P(grade > k), of which the expected grade is the
sum. Selection uses the tail probability of a grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import batches, bounded_sample, held_out, labelled, shared_checkpoint, unused

#: Labelled rows that a fit looks at, at most; hash buckets of triplets; passes over the rows.
SAMPLE, BUCKETS, EPOCHS = 12_000, 1 << 14, 5
RATE, SCALE = 0.2, 20.0
TAIL = 0.5
SIZE = BUCKETS + 1
CHUNK = 1 << 20


def shares(text: str) -> np.ndarray:
    """The vector of one whole text; all zero where there is no triplet and no pair of words."""
    data = text.encode()
    total, n = np.zeros(BUCKETS), max(len(data) - 2, 0)
    for at in range(0, n, CHUNK):
        b = np.frombuffer(data[at : at + CHUNK + 2], np.uint8).astype(np.uint32)
        mixed = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(18)
        total += np.bincount(mixed, minlength=BUCKETS)
    words = data.split()
    same = sum(map(bytes.__eq__, words, words[1:]))
    return np.append(total / max(n, 1), same / max(len(words), 1)) * SCALE


@dataclass(frozen=True)
class Model:
    """Shared weights and increasing thresholds: P(grade > k) = sigmoid(w x - threshold k)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) of a vector for each k from 0; falls with k."""
        return 1 / (1 + np.exp(-np.clip(x @ self.weights - self.thresholds, -30, 30)))


def _vectors(text: Column) -> Column:
    """Places and values of what is not zero, as little-endian unsigned 16-bit and 32-bit floating numbers."""

    @F.arrow_udf("struct<at: binary, x: binary>")
    def of(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in batches(column):
            rows = []
            for v in map(shares, part):
                at = np.flatnonzero(v)
                rows.append((at.astype("<u2").tobytes(), v[at].astype("<f4").tobytes()))
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], names=["at", "x"])

    return of.asNondeterministic()(text)


class Learner:
    """Likelihood ascent with a rate for each coordinate (Adagrad)."""

    def __init__(self, grades: int) -> None:
        self.w, self.seen = np.zeros(SIZE), np.full(SIZE, 1e-6)
        self.cuts, self.cuts_seen = np.linspace(-1.0, 1.0, grades - 1), np.full(grades - 1, 1e-6)

    def learn(self, at: np.ndarray, x: np.ndarray, grade: int) -> None:
        tails = 1 / (1 + np.exp(-np.clip(x @ self.w[at] - self.cuts, -30, 30)))
        lower = tails[grade - 1] if grade else 1.0
        upper = tails[grade] if grade < len(tails) else 0.0
        g = (lower + upper - 1) * x
        self.seen[at] += g * g
        self.w[at] -= RATE * g / np.sqrt(self.seen[at])
        share, cuts = max(lower - upper, 1e-9), np.zeros(len(tails))
        if grade:
            cuts[grade - 1] = lower * (1 - lower) / share
        if grade < len(tails):
            cuts[grade] = -upper * (1 - upper) / share
        self.cuts_seen += cuts * cuts
        self.cuts = np.maximum.accumulate(self.cuts - RATE * cuts / np.sqrt(self.cuts_seen))


def _trainer(grades: int, epochs: int):
    """Rows ``(grade, at, x)``, a bounded sample, over which ``epochs`` passes go; gives the weights, then the thresholds."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows = Learner(grades), [r for part in parts for r in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)]
        if not rows:
            return
        for order in map(np.random.default_rng(42).permutation, [len(rows)] * epochs):
            for grade, at, x in map(rows.__getitem__, order):
                state.learn(np.frombuffer(at, "<u2"), np.frombuffer(x, "<f4").astype(np.float64), grade)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([state.w, state.cuts]).astype("<f8").tobytes()])], ["model"])

    return run


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", grades: int = 3, sample: int = SAMPLE, epochs: int = EPOCHS) -> Model:
    """A model from at most ``sample`` rated rows, which the hash of their ids picks.

    Grades are whole numbers from 0 to ``grades - 1``. Rows of the held-out
    third, and rows without an id or grade, teach nothing. The vectors are
    written once and go once to the one task that learns, which holds them: at
    most ``sample`` short vectors. Of rows that repeat an id one teaches; a null text
    is empty; without a rated row every text has every grade.
    """
    known = ratings.select(F.col(id_col).alias("__id"), F.col(grade_col).cast("int").alias("label")).filter(f"__id is not null and label between 0 and {grades - 1}").filter(~held_out(F.col("__id")))
    chosen = bounded_sample(known, F.col("__id"), sample)
    rows = labelled(docs, chosen, id_col, text_col)
    rows = shared_checkpoint(rows.select("__id", F.col("label").alias("grade"), _vectors(F.col("__text")).alias("v")))
    # Each vector goes to the task once, in the order of a hash; the task mixes the order anew for each pass.
    stream = rows.repartition(1).sortWithinPartitions(F.xxhash64("__id"), "__id", "v.at", "v.x").select("grade", "v.at", "v.x")
    made = stream.mapInArrow(_trainer(grades, epochs), "model binary").first()
    if made is None:  # no rated row: every text has every grade
        return Model(np.zeros(SIZE), np.full(grades - 1, -30.0))
    found = np.frombuffer(made["model"], "<f8")
    return Model(found[:SIZE], found[SIZE:])


def tails(text: Column, model: Model) -> Column:
    """Array of P(grade > k) for k from 0; null is the empty text."""

    @F.arrow_udf("array<double>")
    def of(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in batches(column):
            yield pa.array([model.tails(shares(t)).tolist() for t in part], pa.list_(pa.float64()))

    return of.asNondeterministic()(text)


def graded(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: int = 1, tail: float = TAIL) -> DataFrame:
    """One row per input row: ``doc_id, expected_grade, tail, kept``.

    ``tail`` is the probability of grade ``least`` or a higher one, and a text
    is kept where it reaches the given share. Null and empty texts have the
    grade of the thresholds alone. Repeated rows each get a row; an empty table
    gives an empty table; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), tails(F.col(text_col), model).alias("t"))
    expected = F.aggregate("t", F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", expected.alias("expected_grade"), F.col("t")[least - 1].alias("tail"), (F.col("t")[least - 1] >= tail).alias("kept"))


def keep_sound(docs: DataFrame, model: Model, text_col: str = "text", least: int = 1, tail: float = TAIL) -> DataFrame:
    """The rows of ``docs``, all columns, whose tail probability reaches the given share.

    Null and empty texts have the grade of the thresholds alone. Ids are not
    read; repeated rows are kept or dropped alike; an empty table stays empty;
    columns of any name are carried along.
    """
    (made,) = unused(docs.columns, 1)
    return docs.withColumn(made, tails(F.col(f"`{text_col}`"), model)).filter(F.col(made)[least - 1] >= tail).drop(made)


def ratings(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Grades from two yes-or-no labels: 0 of poor quality, 1 sound but toxic, 2 sound and civil."""
    sound, toxic = F.col("quality"), F.col("toxic")
    grade = F.when(sound == 0, 0).when((sound == 1) & (toxic == 1), 1).when((sound == 1) & (toxic == 0), 2)
    return labels.select(F.col(id_col), grade.alias("grade"))
