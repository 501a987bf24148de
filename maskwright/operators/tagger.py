"""A sequence tagger for people, organizations and places: an averaged structured perceptron.

Tokens have hashed features of their own word, its shape and ends, and of their
neighbours; tags are the beginning or the inside of an entity, or none, and the
best sequence of a text is found by Viterbi's rule. Training mixes parameters
(McDonald, Hall and Mann, 2010): each partition runs over its texts from common
weights, what the partitions have learned is averaged, and the next epoch
starts from there. All that travels is weights, whose number FEATURES bounds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators import scoring
from maskwright.operators.shared import shared_checkpoint, spread

LABELS = ("PERSON", "ORGANIZATION", "LOCATION")
#: No entity, then the beginning and the inside of each kind.
TAGS = ("O", *(f"{edge}-{label}" for label in LABELS for edge in "BI"))
#: Hashed features; epochs; tokens of a text that are tagged together, from its start in steps (a sentence ends no later).
FEATURES, EPOCHS, STRETCH = 1 << 17, 5, 400
TOKEN = re.compile(r"[^\W\d_]+(?:['’.-][^\W\d_]+)*|\d+|[^\w\s]|_")
ENDS = frozenset(".!?;")
ENTITIES = "array<struct<start: int, end: int, label: string>>"
NONE, BEGINS = 0, {label: 1 + 2 * k for k, label in enumerate(LABELS)}
#: An inside tag follows its own beginning or inside only; the last row stands for the start of a text.
ALLOWED = np.array([[not t.startswith("I-") or p[2:] == t[2:] for t in TAGS] for p in (*TAGS, "O")])
FAR = np.float32(-1e9)


def tokens(text: str) -> Iterator[list[tuple[int, int]]]:
    """Places of the tokens of a text, in sentences of at most STRETCH."""
    sentence: list[tuple[int, int]] = []
    for m in TOKEN.finditer(text):
        sentence.append(m.span())
        if m[0] in ENDS or len(sentence) >= STRETCH or text[m.end() : m.end() + 1] == "\n":
            yield sentence
            sentence = []
    if sentence:
        yield sentence


def _shape(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c for c in word))


def features(text: str, sentence: list[tuple[int, int]]) -> np.ndarray:
    """A row of hashed features for each token."""
    words = [text[a:b] for a, b in sentence]
    low, shapes = ["<", *(w.lower() for w in words), ">"], ["<", *map(_shape, words), ">"]
    rows = []
    for k in range(1, len(words) + 1):
        w, s = low[k], shapes[k]
        named = (
            "b", f"w{w}", f"s{s}", f"p{w[:3]}", f"e{w[-3:]}", f"f{w[-2:]}", f"l{low[k - 1]}", f"r{low[k + 1]}", f"m{shapes[k - 1]}|{s}", f"n{s}|{shapes[k + 1]}",
            f"L{low[k - 1]}|{s}", f"R{s}|{low[k + 1]}", f"2{low[k - 2] if k > 1 else '<'}|{s}", f"3{s}|{low[k + 2] if k + 2 < len(low) else '>'}",
        )
        rows.append([zlib.crc32(n.encode()) % FEATURES for n in named])
    return np.array(rows)


@dataclass
class Weights:
    """Scores of tags by feature, and of tags by the tag before."""

    of: np.ndarray
    after: np.ndarray

    @classmethod
    def none(cls) -> Weights:
        return cls(np.zeros((FEATURES, len(TAGS)), np.float32), np.zeros((len(TAGS) + 1, len(TAGS)), np.float32))


def best(weights: Weights, rows: np.ndarray) -> list[int]:
    """The sequence of tags with the largest score."""
    local = weights.of[rows].sum(axis=1)
    step = np.where(ALLOWED, weights.after, FAR)
    score, back = local[0] + step[-1], []
    for here in local[1:]:
        reach = score[:, None] + step[:-1]
        back.append(reach.argmax(axis=0))
        score = reach.max(axis=0) + here
    tags = [int(score.argmax())]
    for way in reversed(back):
        tags.append(int(way[tags[-1]]))
    return tags[::-1]


def gold(sentence: list[tuple[int, int]], entities: list[dict]) -> list[int]:
    """The tags that annotated spans give; of overlapping ones the first counts."""
    tags = [NONE] * len(sentence)
    for e in sorted(entities, key=lambda e: (e["start"], -e["end"])):
        inside = [k for k, (a, b) in enumerate(sentence) if a < e["end"] and e["start"] < b]
        if inside and e["label"] in BEGINS and not any(tags[k] for k in inside):
            tags[inside[0] : inside[-1] + 1] = [BEGINS[e["label"]], *[BEGINS[e["label"]] + 1] * (len(inside) - 1)]
    return tags


def _learned(batches: Iterator[pa.RecordBatch], start: Broadcast) -> Iterator[pa.RecordBatch]:
    """One pass over a partition: what its weights, and their mean over its steps, differ by from those it began with.

    The copies of a text follow one another; once one of them changes nothing,
    nor do the others, and they only count as steps.
    """
    begun: Weights = start.value
    now, total, n = Weights(begun.of.copy(), begun.after.copy()), Weights.none(), 1
    for batch in batches:
        for row in batch.to_pylist():
            text, left = row["text"] or "", row["copies"]
            while left:
                left, first, same = left - 1, n, True
                for sentence in tokens(text):
                    rows, want = features(text, sentence), gold(sentence, row["entities"] or [])
                    got = best(now, rows)
                    if got != want:
                        same = False
                        before_w, before_g = len(TAGS), len(TAGS)
                        for k, (w, g) in enumerate(zip(want, got, strict=True)):
                            if w != g:
                                for of, c in ((now, 1), (total, n)):
                                    np.add.at(of.of, (rows[k], w), c)
                                    np.add.at(of.of, (rows[k], g), -c)
                            if (before_w, w) != (before_g, g):
                                for of, c in ((now, 1), (total, n)):
                                    of.after[before_w, w] += c
                                    of.after[before_g, g] -= c
                            before_w, before_g = w, g
                    n += 1
                if same:
                    left, n = 0, n + left * (n - first)
    # The mean over all steps is the last state less what each change came too late by.
    for kind, last, late, first in (("of", now.of, total.of, begun.of), ("after", now.after, total.after, begun.after)):
        moved = np.flatnonzero((last != first) | (late != 0))
        if len(moved):
            change, mean = (last - first).ravel()[moved], (last - first - late / n).ravel()[moved]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(moved)), pa.array(moved), pa.array(change.astype(float)), pa.array(mean.astype(float))], ["kind", "at", "change", "mean"])


def sentences(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(text, entities)`` for training, from annotated values ``(set, block_idx, ord, label, text)`` and all blocks in scope, those without a value too."""
    found = scoring.expected_spans(annotations.filter(F.col("label").isin(*LABELS)), blocks).filter("start >= 0")
    listed = found.groupBy("set", "block_idx").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("entities"))
    return blocks.join(listed, ["set", "block_idx"], "left").select("text", F.coalesce("entities", F.expr(f"cast(array() as {ENTITIES})")).alias("entities"))


def trained(examples: DataFrame, epochs: int = EPOCHS) -> Weights:
    """Weights from ``examples(text, entities)``; without examples all text is no entity.

    Texts are dealt to partitions and ordered within them by their hash, anew
    in each epoch, so the weights depend on the texts and the number of
    partitions alone. Equal examples would follow one another in a partition
    and are one row with their number. A partition's changes are a row for each weight that it
    moved, FEATURES times the number of tags at most, and their sums are as
    many. Null texts teach nothing.
    """
    spark, parts = examples.sparkSession, spread(examples.sparkSession)
    rows = shared_checkpoint(examples.filter("text is not null").groupBy("text", "entities").agg(F.count(F.lit(1)).alias("copies")))
    weights, means = Weights.none(), []
    for epoch in range(epochs):
        order = F.xxhash64(F.lit(epoch), "text")
        dealt = rows.repartition(parts, order).sortWithinPartitions(order, "text", "entities")
        start = spark.sparkContext.broadcast(weights)
        moved = dealt.mapInArrow(lambda batches, start=start: _learned(batches, start), "kind string, at bigint, change double, mean double")
        mixed = moved.groupBy("kind", "at").agg((F.sum("change") / parts).alias("change"), (F.sum("mean") / parts).alias("mean")).toArrow()
        start.unpersist()
        following, mean = Weights(weights.of.copy(), weights.after.copy()), Weights(weights.of.copy(), weights.after.copy())
        for kind in ("of", "after"):
            mask = np.asarray(mixed.column("kind").to_pylist(), dtype=object) == kind
            at = mixed.column("at").to_numpy()[mask]
            getattr(following, kind).ravel()[at] += mixed.column("change").to_numpy()[mask]
            getattr(mean, kind).ravel()[at] += mixed.column("mean").to_numpy()[mask]
        means.append(mean)
        weights = following
    count = max(len(means), 1)
    return Weights(sum((m.of for m in means), Weights.none().of) / count, sum((m.after for m in means), Weights.none().after) / count)


def entities_of(text: str, weights: Weights) -> list[dict]:
    """``(start, end, label)`` of the entities of a text."""
    out = []
    for sentence in tokens(text):
        open_ = None
        for (a, b), tag in [*zip(sentence, best(weights, features(text, sentence)), strict=True), ((0, 0), NONE)]:
            if open_ and not TAGS[tag].startswith("I-"):
                out.append(open_)
                open_ = None
            if TAGS[tag].startswith("B-"):
                open_ = {"start": a, "end": b, "label": TAGS[tag][2:]}
            elif open_:
                open_["end"] = b
    return out


def tagged(text: Column, weights: Broadcast) -> Column:
    """Entities of a text column, as ``detected`` and ``entities.prepared`` take them; ``weights`` is a broadcast of ``trained``."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))

    @F.arrow_udf(ENTITIES)
    def of(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in column:
            listed = part.to_pylist()
            each = {t: entities_of(t or "", weights.value) for t in set(listed)}
            yield pa.array([each[t] for t in listed], kind)

    return of(text)
