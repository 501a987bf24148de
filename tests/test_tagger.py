"""The sequence tagger: its search, its training, and what it finds on names that it has not seen."""

import random
from itertools import product

import numpy as np
import pyarrow as pa

from maskwright.operators import tagger
from maskwright.plans import redact

FIRST = ["Tarun", "Anita", "Vikram", "Leela", "Arjun", "Meera"]
SEEN, UNSEEN = ["Desai", "Patil", "Joshi", "Rao", "Kulkarni", "Naik"], ["Shah", "Verma", "Iyer"]
TOWNS = (["Pune", "Nagpur", "Thane", "Supa"], ["Surat", "Kochi"])


def written(rng, last, towns):
    person, firm, town = f"{rng.choice(FIRST)} {rng.choice(last)}", f"{rng.choice(last)} Works LLP", rng.choice(towns)
    kinds = {"PERSON": person, "ORGANIZATION": firm, "LOCATION": town}
    text = rng.choice([f"Signed by {person} of {firm} in {town}.", f"{firm} paid {person}, who lives in {town}, on time.", f"Send it to {town} for {person} and {firm}.", "Nothing was found in the Market Report."])
    return text, [{"start": text.index(v), "end": text.index(v) + len(v), "label": k} for k, v in kinds.items() if v in text]


def test_the_best_sequence_is_found():
    rng = np.random.default_rng(1)
    weights = tagger.Weights(rng.normal(size=(tagger.FEATURES, len(tagger.TAGS))).astype(np.float32), rng.normal(size=(len(tagger.TAGS) + 1, len(tagger.TAGS))).astype(np.float32))
    for text in ("Ann", "Ann Lee left", "in Pune , Rao"):
        (sentence,) = tagger.tokens(text)
        rows = tagger.features(text, sentence)

        def score(tags):
            steps = list(zip([len(tagger.TAGS), *tags], tags))
            return sum(weights.of[rows[k], t].sum() for k, t in enumerate(tags)) + sum(weights.after[s] for s in steps) if all(tagger.ALLOWED[s] for s in steps) else -1e9  # noqa: B023

        assert score(tagger.best(weights, rows)) > max(map(score, product(range(len(tagger.TAGS)), repeat=len(sentence)))) - 1e-3


def test_tags_and_places():
    (sentence,) = tagger.tokens("Ann Lee-Roy met D’Arcy 42 times")
    assert ["Ann Lee-Roy met D’Arcy 42 times"[a:b] for a, b in sentence] == ["Ann", "Lee-Roy", "met", "D’Arcy", "42", "times"]
    assert tagger.gold(sentence, [{"start": 0, "end": 11, "label": "PERSON"}, {"start": 4, "end": 11, "label": "LOCATION"}, {"start": 16, "end": 22, "label": "LOCATION"}]) == [1, 2, 0, 5, 0, 0]
    assert list(tagger.tokens("")) == [] and [len(s) for s in tagger.tokens("a. b\nc " + "d " * 900)] == [2, 1, 400, 400, 101]


def test_unseen_names(spark):
    rng = random.Random(3)
    examples = spark.createDataFrame([written(rng, SEEN, TOWNS[0]) for _ in range(240)] + [(None, [])], f"text string, entities {tagger.ENTITIES}")
    weights = tagger.trained(examples)
    again = tagger.trained(examples.repartition(3))
    assert np.array_equal(weights.of, again.of) and np.array_equal(weights.after, again.after)
    tests = [written(rng, UNSEEN, TOWNS[1]) for _ in range(120)]
    data = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(tests)] + [(-1, None)], "scope int, text string").selectExpr("scope", "0 as block_idx", "text")
    model = spark.sparkContext.broadcast(weights)
    got = {r.scope: {(e.start, e.end, e.label) for e in r.e} for r in data.withColumn("e", tagger.tagged(data.text, model)).collect()}
    want = {n: {(e["start"], e["end"], e["label"]) for e in found} for n, (_, found) in enumerate(tests)}
    right, found, there = sum(len(got[n] & want[n]) for n in want), sum(len(got[n]) for n in want), sum(map(len, want.values()))
    assert got[-1] == set() and right >= 0.9 * there and right >= 0.9 * found
    # The same column is the source of entities for the whole detection.
    blocks = data.withColumn("model", tagger.tagged(data.text, model))
    spans = redact.detections_of(redact.detected(blocks, ["email"], entities="model")).filter("label = 'PERSON'").count()
    assert spans >= 0.8 * sum(e[2] == "PERSON" for found in want.values() for e in found)


def test_without_examples(spark):
    weights = tagger.trained(spark.createDataFrame([], f"text string, entities {tagger.ENTITIES}"))
    assert tagger.entities_of("Ann Lee met Bob", weights) == []


def test_sentences_from_annotations(spark):
    notes = spark.createDataFrame([("s", 1, 0, "PERSON", "Ann Lee"), ("s", 1, 1, "EMAIL", "a@b.co"), ("s", 1, 2, "LOCATION", "Nowhere")], "set string, block_idx int, ord int, label string, text string")
    blocks = spark.createDataFrame([("s", 1, "By Ann Lee, a@b.co"), ("s", 2, "Nothing")], "set string, block_idx int, text string")
    got = {r.text: [tuple(e) for e in r.entities] for r in tagger.sentences(notes, blocks).collect()}
    assert got == {"By Ann Lee, a@b.co": [(3, 10, "PERSON")], "Nothing": []}


class Given:
    value = tagger.Weights.none()


def test_copies_of_a_text_teach_as_often_as_they_stand_and_cost_little(monkeypatch):
    rng, calls, best = random.Random(4), [], tagger.best
    examples = [{"text": t, "entities": e} for t, e in (written(rng, SEEN, TOWNS[0]) for _ in range(30))]
    examples.append({"text": "Ann Lee left. Bob Rao, of Pune, did not.", "entities": [{"start": 0, "end": 7, "label": "PERSON"}]})
    monkeypatch.setattr(tagger, "best", lambda *a: (calls.append(1), best(*a))[1])
    learned = lambda rows: pa.Table.from_batches(tagger._learned([pa.RecordBatch.from_pylist(rows)], Given)).sort_by([("kind", "ascending"), ("at", "ascending")])
    one_by_one = learned([e | {"copies": 1} for e in examples for _ in range(200)])
    alone = len(calls)
    together = learned([e | {"copies": 200} for e in examples])
    assert together.equals(one_by_one) and len(calls) - alone < alone / 20
