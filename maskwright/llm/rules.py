"""Learned quality rules: sequential covering over statistics of whole texts.

Statistics of each text are counted once; a decision list of threshold
conjunctions is grown and pruned from labelled statistics, and applied as one
ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import bounded_sample, held_out, labelled

#: Labelled rows that a fit looks at, at most.
SAMPLE = 20_000
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
CAPITALS = bytes(range(65, 91))
DIGITS = b"0123456789"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_marks", "n_distinct", "n_most")
#: What rules may test, as (name, numerator, denominator).
SHARES = (
    ("symbols", "n_symbols", "word_chars"),
    ("capitals", "n_capitals", "word_chars"),
    ("digits", "n_digits", "word_chars"),
    ("marks", "n_marks", "n_words"),
    ("repeats", "n_repeat_words", "n_words"),
    ("dup_lines", "n_dup_lines", "n_lines"),
    ("distinct", "n_distinct", "n_words"),
    ("most", "n_most", "n_words"),
    ("word_length", "word_chars", "n_words"),
)


def repeated_words(ids: np.ndarray, kinds: int, window: int = WINDOW) -> int:
    """How many words lie in windows that occur twice or more. Exact: no hashing."""
    n = len(ids) - window + 1
    if n < 2 or kinds == len(ids):
        return 0
    key, base = ids[:n].astype(np.int64), kinds
    for k in range(1, window):
        if base > (1 << 62) // max(kinds, 1):  # renumber what there is, before a product would overflow
            there, key = np.unique(key, return_inverse=True)
            base = len(there)
        key = key * kinds + ids[k : k + n]
        base *= kinds
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return int((np.convolve(again, np.ones(window, np.int64)) > 0).sum())


def measured(text: str) -> tuple[int, ...]:
    """The statistics of one whole text, in the order of STATS."""
    data = text.encode()
    words = data.split()
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    lines = [x for x in data.split(b"\n") if x.strip()]
    without = lambda signs: len(data) - len(data.translate(None, signs))
    return (
        len(words),
        len(text) - without(BLANKS),
        without(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(number)),
        len(lines),
        without(CAPITALS),
        without(DIGITS),
        without(b"!?"),
        len(number),
        int(np.bincount(ids).max()) if words else 0,
    )


def statistics(text: Column) -> Column:
    """Struct of the statistics of a text column; null is the empty text."""

    @F.arrow_udf("struct<" + ", ".join(f"{s}: bigint" for s in STATS) + ">")
    def of(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in column:
            rows = np.array([measured(t or "") for t in part.to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=list(STATS))

    return of.asNondeterministic()(text)


def base_failed(stats: str = "s") -> Column:
    n, repeats = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 10) | (100 * repeats > 20 * n)


def share(name: str, stats: str = "s") -> Column:
    top, below = next((a, b) for k, a, b in SHARES if k == name)
    return F.col(f"{stats}.{top}") / F.greatest(F.col(f"{stats}.{below}"), F.lit(1))


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests ``(share, is_least, threshold)`` that rejects what meets all."""

    tests: tuple[tuple[str, bool, float], ...]

    def covers(self, x: np.ndarray) -> np.ndarray:
        names = [s[0] for s in SHARES]
        return reduce(np.logical_and, [(x[:, names.index(k)] >= v) if least else (x[:, names.index(k)] <= v) for k, least, v in self.tests], np.ones(len(x), bool))

    def condition(self, stats: str = "s") -> Column:
        return reduce(lambda a, b: a & b, [share(k, stats) >= v if least else share(k, stats) <= v for k, least, v in self.tests])


def _grown(x: np.ndarray, bad: np.ndarray, most: int) -> Rule:
    """Add the test of the greatest information gain until no good row is covered."""
    tests, covered = [], np.ones(len(x), bool)
    while len(tests) < most and (~bad & covered).any():
        p, n = (bad & covered).sum(), (~bad & covered).sum()
        now, best = math.log2(p / (p + n)), (0.0, None, None)
        for k, (name, _, _) in enumerate(SHARES):
            values = x[:, k]
            for v in np.unique(np.quantile(values[covered & bad], np.linspace(0, 1, 21), method="nearest")):
                for least in (True, False):
                    inside = covered & ((values >= v) if least else (values <= v))
                    p1, n1 = (bad & inside).sum(), (~bad & inside).sum()
                    gain = p1 * (math.log2(p1 / (p1 + n1)) - now) if p1 else 0.0
                    if gain > best[0] + 1e-9:
                        best = gain, (name, least, float(v)), inside
        if best[1] is None:
            break
        tests.append(best[1])
        covered = best[2]
    return Rule(tuple(tests))


def _pruned(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[Rule, float, int]:
    """The start of the rule that does best on rows it was not grown on."""
    best = (-2.0, rule, 0.0, 0)
    for k in range(1, len(rule.tests) + 1):
        short = Rule(rule.tests[:k])
        inside = short.covers(x)
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = worth, short, p / (p + n) if p + n else 0.0, p
    return best[1:]


def learn(x: np.ndarray, bad: np.ndarray, prune: np.ndarray, most_rules: int = 12, most_tests: int = 4, precision: float = 0.9, least: int = 3) -> list[Rule]:
    """Sequential covering: each rule is grown on one part of the rows, pruned on the other, and takes what it covers away."""
    rules, left = [], np.ones(len(x), bool)
    while len(rules) < most_rules:
        grow, check = left & ~prune, left & prune
        if not (bad & grow).any() or not (~bad & grow).any():
            break
        rule = _grown(x[grow], bad[grow], most_tests)
        if not rule.tests:
            break
        rule, held, hits = _pruned(rule, x[check], bad[check])
        if held < precision or hits < least:
            break
        rules.append(rule)
        left &= ~rule.covers(x)
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """A decision list from at most ``sample`` labelled rows, which the hash of their ids picks.

    Label 0 is to be rejected. Rows of the held-out third, rows without an id
    or a label and rows that fail the base rules teach nothing; of rows that
    repeat an id one teaches. Without any such row there is no learned rule.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("label")).filter("__id is not null and label is not null").filter(~held_out(F.col("__id")))
    chosen = bounded_sample(known, F.col("__id"), sample)
    rows = labelled(docs, chosen, id_col, text_col)
    stats = rows.select("label", (F.xxhash64("__id") % 3 == 0).alias("prune"), statistics(F.col("__text")).alias("s"), "__id").filter(~base_failed())
    taught = stats.select("__id", "label", "prune", *(share(k).alias(k) for k, _, _ in SHARES)).toPandas().sort_values("__id")
    x = taught[[k for k, _, _ in SHARES]].to_numpy(np.float64)
    return learn(x, taught["label"].to_numpy() == 0, taught["prune"].to_numpy(bool))


def verdict(rules: list[Rule], stats: str = "s") -> Column:
    """True where a text is kept: no base rule fails it and no learned rule, in order, rejects it."""
    out = F.when(base_failed(stats), False)
    for rule in rules:
        out = out.when(rule.condition(stats), False)
    return out.otherwise(True)


def judged(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the statistics, ``base_failed``, ``kept`` and ``rule``.

    ``rule`` is 0 for the base rules, the number of the first learned rule that
    rejects the text, or null if it is kept. A null or empty text has no words
    and fails the base rules. Repeated rows each get a row, an empty table
    gives an empty table, other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), statistics(F.col(text_col)).alias("s"))
    number = F.when(base_failed(), 0)
    for k, rule in enumerate(rules, 1):
        number = number.when(rule.condition(), k)
    return rows.select("doc_id", *(F.col(f"s.{k}").alias(k) for k in STATS), base_failed().alias("base_failed"), verdict(rules).alias("kept"), number.cast("int").alias("rule"))
