import random
import zlib
from collections import Counter

import numpy as np
import pytest

from maskwright.llm import rules
from tests.llm.cases import ROWS, awkward, empty


def plain(text):
    text = text or ""
    blank = " \t\n\v\f\r"
    cut = text
    for c in blank:
        cut = cut.replace(c, " ")
    words = [w for w in cut.split(" ") if w]
    lines, seen, dup = [], set(), 0
    for line in text.split("\n"):
        if line.strip(blank):
            lines.append(line)
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup,
        "n_repeat_words": len(inside),
        "base_failed": len(words) < 10 or 100 * len(inside) > 20 * len(words),
    }


def test_statistics_and_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = rules.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in rules.judged(docs, learned).collect():
        want = plain(text[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert not (r.base_failed and r.kept)


def test_awkward_rows(spark):
    got = rules.judged(awkward(spark), [rules.Rule((("symbols", True, 0.1),))]).collect()
    assert len(got) == len(ROWS) and rules.judged(empty(spark), []).count() == 0
    texts = dict(ROWS)
    for r in got:
        want = plain(texts[r.doc_id])
        assert {k: r[k] for k in want} == want


@pytest.mark.parametrize("kinds", [1, 2, 3, 50, 100_000])
def test_repeated_words(kinds):
    rng = random.Random(kinds)
    for _ in range(60):
        words = [rng.randrange(kinds) for _ in range(rng.randint(0, 60))]
        words += words[: rng.randint(0, 9)]
        number = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        assert rules.repeated_words(ids, len(number)) == plain(" ".join(map(str, words)))["n_repeat_words"]
    ids = np.arange(10_000) % 9_973  # products overflow unless renumbered
    assert rules.repeated_words(ids, 9_973) == 54


def test_covering_finds_the_rules():
    rng = np.random.default_rng(1)
    x = rng.random((4_000, len(rules.SHARES)))
    bad = (x[:, 0] > 0.8) | ((x[:, 3] > 0.7) & (x[:, 6] < 0.3))
    prune = rng.random(4_000) < 1 / 3
    learned = rules.learn(x, bad, prune)
    hit = np.logical_or.reduce([r.covers(x) for r in learned])
    assert (hit & bad).sum() > 0.85 * bad.sum() and (hit & ~bad).sum() < 0.05 * hit.sum()
    assert rules.learn(x, np.zeros(4_000, bool), prune) == []


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = {r.doc_id: r.kept for r in rules.judged(docs, rules.fit(docs, labels)).collect()}
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    good = [k for q, k in held if q == 1]
    poor = [k for q, k in held if q == 0]
    assert sum(good) > 0.8 * len(good) and sum(poor) < 0.35 * len(poor)
