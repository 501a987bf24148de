import zlib

import numpy as np
import pytest

from maskwright.llm import ordinal, toxicity
from tests.llm.cases import ROWS, awkward, empty

PATH = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{PATH}/documents.parquet"), spark.read.parquet(f"{PATH}/labels.parquet")


def held(labels, column):
    return {r.doc_id: r[column] for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}


def area(scores, labels):
    rank = np.argsort(np.argsort(scores))
    up = labels == 1
    return (rank[up].mean() - (up.sum() - 1) / 2) / (~up).sum()


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    assert 0 < len(model.keys) < 5_000, "L1 keeps the model sparse"
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    want = held(labels, "toxic")
    y, p = np.array(list(want.values())), np.array([got[i].score for i in want])
    assert area(p, y) > 0.85 and (p[y == 0] >= 0.7).mean() < 0.02 and (p[y == 1] >= 0.7).mean() > 0.4
    assert all(got[i].held_out for i in want) and all(r.predicted == (r.score >= 0.7) for r in got.values())


def test_toxicity_recall_with_more_labels(spark):
    """At ten times the rows most of the held-out toxic texts are caught; nearly all others pass."""
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs.join(labels.select("doc_id"), "doc_id"), toxicity.fit(docs, labels)).collect()}
    want = held(labels, "toxic")
    y, p = np.array(list(want.values())), np.array([got[i] for i in want])
    assert p[y == 1].mean() > 0.82 and p[y == 0].mean() < 0.003


def test_repeated_ids_teach_once(spark):
    rows = [(k, f"you are {'trash' if k % 2 else 'kind'} number {k}") for k in range(60)] + [(3, f"copy {n}") for n in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(60)] + [(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    assert toxicity.fit(docs, labels) is not None and ordinal.fit(docs, ordinal.ratings(labels)) is not None
    assert {r.doc_id for r in toxicity.keep_civil(docs.withColumn("__made_0", docs.text), toxicity.fit(docs, labels)).collect()} >= {k for k in range(0, 60, 2)}


def test_fit_does_not_depend_on_partitions_or_held_out_labels(tables):
    from pyspark.sql import functions as F

    docs, labels = tables
    a = toxicity.fit(docs, labels)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    b = toxicity.fit(docs.repartition(7), flipped.repartition(3))
    assert (a.keys == b.keys).all() and (a.weights == b.weights).all() and a.bias == b.bias


def test_hashes_and_lookup_agree():
    model = toxicity.Model(np.sort(np.unique(toxicity.hashed("you are trash"))), np.arange(1.0, 7.0), -1.0)
    table = model.filter()
    assert model.logit("", table) == -1
    assert model.logit("x y z you  ARE, trash! you are trash", table) == model.logit("you are trash", table) == 20
    assert len(toxicity.hashed("")) == 0 and len(toxicity.hashed("one")) == 1 and len(toxicity.hashed("one two")) == 3


def test_ftrl_matches_the_formula():
    state = toxicity.Ftrl(1)
    z = n = zb = nb = 0.0
    for label in [1, 1, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1]:
        weight = lambda z, n, l1: 0.0 if abs(z) <= l1 else -(z - np.sign(z) * l1) / ((toxicity.BETA + n**0.5) / toxicity.ALPHA + toxicity.L2)
        w, b = weight(z, n, toxicity.L1), weight(zb, nb, 0)
        g = 1 / (1 + np.exp(-(w + b))) - label
        z, n = z + g - ((n + g * g) ** 0.5 - n**0.5) / toxicity.ALPHA * w, n + g * g
        zb, nb = zb + g - ((nb + g * g) ** 0.5 - nb**0.5) / toxicity.ALPHA * b, nb + g * g
        state.learn(np.array([0]), label)
        assert np.allclose([state.z[0], state.n[0], state.z[1], state.n[1]], [z, n, zb, nb])


def test_platt_is_monotone_and_calibrates():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 3, 4_000)
    y = (rng.random(4_000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(int)
    scale, shift = toxicity.platt(x, y)
    assert abs(scale - 2) < 0.3 and abs(shift + 1) < 0.3
    assert toxicity.platt(x, np.zeros(4_000)) == (1.0, 0.0)


@pytest.mark.parametrize("which", ["toxicity", "ordinal"])
def test_awkward_rows(spark, which):
    schema = "doc_id bigint, quality int, toxic int"
    labels = spark.createDataFrame([(i, 1, (i or 0) % 2) for i, _ in ROWS] + [(1, None, None), (None, 0, 0)], schema)
    none = spark.createDataFrame([], schema)
    for docs, taught in ((awkward(spark), labels), (awkward(spark), none), (empty(spark), labels)):
        if which == "toxicity":
            model = toxicity.fit(docs, taught)
            rows, kept = toxicity.scored(docs, model).collect(), toxicity.keep_civil(docs, model)
            assert all(0 <= r.score <= 1 for r in rows)
        else:
            model = ordinal.fit(docs, ordinal.ratings(taught))
            rows, kept = ordinal.graded(docs, model).collect(), ordinal.keep_sound(docs, model)
            assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
            if taught is none:
                assert all(r.kept for r in rows)
        assert len(rows) == docs.count() and kept.columns == docs.columns and kept.count() <= len(rows)


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    model = ordinal.fit(docs, ordinal.ratings(labels))
    assert (np.diff(model.thresholds) >= 0).all()
    got = {r.doc_id: r for r in ordinal.graded(docs, model).collect()}
    want = held(labels, "quality")
    good, poor = [got[i].kept for i, q in want.items() if q == 1], [got[i].kept for i, q in want.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(poor) < 0.2


def test_ordinal_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(5)
    for grade in range(4):
        state, at, x = ordinal.Learner(4), np.array([3, 5]), np.array([0.7, -1.2])
        state.w[at] = rng.normal(size=2)
        state.cuts = np.array([-1.0, 0.3, 1.1])

        def loss(v, cuts, grade=grade):
            t = np.concatenate([[1.0], 1 / (1 + np.exp(-(v - cuts))), [0.0]])
            return -np.log(t[grade] - t[grade + 1])

        v, e = x @ state.w[at], 1e-6
        slope = (loss(v + e, state.cuts) - loss(v - e, state.cuts)) / (2 * e)
        cut = [(loss(v, state.cuts + e * np.eye(3)[k]) - loss(v, state.cuts - e * np.eye(3)[k])) / (2 * e) for k in range(3)]
        before, seen, cuts = state.w[at].copy(), state.seen[at].copy(), state.cuts.copy()
        state.learn(at, x, grade)
        g = slope * x
        assert np.allclose(before - state.w[at], ordinal.RATE * g / np.sqrt(seen + g * g), atol=1e-5)
        moved = cuts - state.cuts
        assert all(np.sign(m) == np.sign(c) or abs(c) < 1e-5 for m, c in zip(moved, cut, strict=True))


def test_long_texts_in_chunks(monkeypatch):
    text = "Ab cd cd é " * 50
    whole = ordinal.shares(text)
    monkeypatch.setattr(ordinal, "CHUNK", 7)
    assert np.allclose(ordinal.shares(text), whole)
    assert abs(whole[:-1].sum() - ordinal.SCALE) < 1e-9 and not ordinal.shares("").any()
